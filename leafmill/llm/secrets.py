"""Secret scans: Aho-Corasick keywords, regular expressions anchored near hits only, then checksums embedded in the secrets."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which spans that start together are listed. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "iban", "card")
BASE = KINDS[:3]
#: Keywords that open an assignment; the pattern is matched where one begins, on text with A-Z in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Tokens whose last six characters are a base-62 CRC-32 of the 30 before them.
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: A card or account number counts only this near after its keyword (characters).
NEAR = 48


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0 and len(set(digits)) > 1


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


class Scanner:
    """Finds secrets in one text; holds the automaton."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, words in {"assign": ASSIGN_WORDS, "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "iban": ("iban",), "card": ("card", "visa", "credit")}.items():
            for w in words:
                self.automaton.add_word(w, (kind, len(w)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind. Of one kind, matches are the leftmost that do not overlap; those that fail are dropped after."""
        # Only A-Z change, so that places stay: str.lower() may change a text's length.
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        hits: dict[str, list[int]] = {}
        for last, (kind, n) in self.automaton.iter(low):
            hits.setdefault(kind, []).append(last - n + 1)
        out = [("hex", *m.span()) for m in HEX.finditer(text)]
        for kind, starts in hits.items():
            done = 0
            for start in sorted(set(starts)):
                if start < done:
                    continue
                if kind == "assign":
                    if m := ASSIGN.match(low, start):
                        done = m.end()
                        if len(m[1]) >= 6:
                            out.append((kind, start, done))
                elif kind == "access":
                    if m := ACCESS.match(text, start):
                        done = m.end()
                        if done - start >= 20:
                            out.append((kind, start, done))
                elif kind in ("github", "npm"):
                    m = (GITHUB if kind == "github" else NPM).match(text, start)
                    if m and base62_crc(m[1]) == m[2]:
                        done = m.end()
                        out.append((kind, start, done))
                else:
                    pattern, ok = (IBAN, iban_ok) if kind == "iban" else (CARD, lambda s: luhn(re.sub("[ -]", "", s)))
                    m = pattern.search(text, start + 4, start + 4 + NEAR + 40)
                    if m and m.start() <= start + 4 + NEAR and m.start() >= done and ok(m[0]):
                        done = m.end()
                        out.append((kind, *m.span()))
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's secrets: id and `secrets`, an array of (kind, start, end, found), by start, then kind.

    Places are code points, ends exclusive. A null or empty text has an empty array; a null id stays null, and rows with equal
    ids stay apart. Other columns of `docs` play no part. One pass without a shuffle; memory is one Arrow batch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("found", pa.string())]))
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "found": t[s:e]} for k, s, e in scanner.spans(t)] if (t := x.as_py()) else [] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=[id_col, "secrets"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {id_type}, secrets array<struct<kind:string,start:int,end:int,found:string>>")


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """`docs` with each secret's characters replaced by `mark`; overlapping secrets are replaced as one."""

    def clean(batches):
        scanner = Scanner()
        for b in batches:
            i = b.schema.get_field_index(text_col)
            out = []
            for x in b.column(i):
                t = x.as_py()
                merged: list[list[int]] = []
                for _, s, e in scanner.spans(t) if t else []:
                    if merged and s < merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                for s, e in reversed(merged):
                    t = t[:s] + mark + t[e:]
                out.append(t)
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))

    return docs.mapInArrow(clean, docs.schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of what scan_secrets() returns."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
