"""Token alignment against a plain walk over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafmill.llm import alignment

A, B, RANKS = (f"{alignment.TOKENIZERS}/{f}" for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, chunk long, pair string, n_a long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["the", "The", "naïve", "日本語", "🙂🙂", "  ", "\n", "\t\n", "<|endoftext|>", "<s>", "</s>", "<unk>", "1234567", "x" * 40, "don't", " ", "\x00", "=====", "Größe", "internationalisation", "́"]
    out = [None, "", " ", "  ", "a", "▁", "the ▁ word", "<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 50, "\n\n \n", "abc" * 3000]
    return out + [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)]


def plain(text):
    """(n_a, n_b, groups) by a walk; groups hold ids of both sides."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    back = {}
    for b in range(256):
        back[chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(256 + len([c for c in back if ord(c) > 255]))] = b
    out = []
    for x in text:
        if not x:
            out.append([])
            continue
        a, b = t.encode(" " + x, add_special_tokens=False), s.encode(x)
        a_bytes = [bytes(back[c] for c in p) for p in a.tokens]
        b_bytes = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != (" " + x).encode() or b"".join(b_bytes) != (" " + x).encode():
            out.append([])
            continue
        groups, i, j, m, n, left, right = [], 0, 0, 0, 0, [], []
        while i < len(a.ids) or j < len(b):
            if m <= n and i < len(a.ids) or j == len(b):
                m += len(a_bytes[i])
                left.append(a.ids[i])
                i += 1
            else:
                n += len(b_bytes[j])
                right.append(b[j])
                j += 1
            if m == n and left and right:
                groups.append((left, right))
                left, right = [], []
        out.append(groups)
    return out


def test_digests(spark, texts):
    rows = [(i if i % 9 else None, t, 1, "p", 2) for i, t in enumerate(texts)] + [(3, texts[30], 1, "p", 2), (3, texts[30], 1, "p", 2)]
    groups = plain([r[1] for r in rows])
    held, most = Counter(), defaultdict(int)
    for g in groups:
        held.update({(a, b) for left, right in g for a in left for b in right})
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = Counter()
    for r, g in zip(rows, groups, strict=True):
        links = Counter()
        for left, right in g:
            for a, n in Counter(left).items():
                for b, m in Counter(right).items():
                    links[a, b] += n * m
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        want[r[0], sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""] += 1
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"work": 3, "chunk_bytes": 500, "a_ranks": None}):
        assert Counter(tuple(r) for r in alignment.alignment_digests(df, **options).collect()) == want
    got = Counter((r["doc_id"], tuple(r["a_ids"]), tuple(r["b_ids"]), tuple(r["a_cuts"]), tuple(r["b_cuts"])) for r in alignment.align_documents(df, chunk_bytes=2000).collect())
    assert got == Counter((r[0], tuple(a for x, _ in g for a in x), tuple(b for _, y in g for b in y), tuple(np.cumsum([len(x) for x, _ in g]).astype(int).tolist()), tuple(np.cumsum([len(y) for _, y in g]).astype(int).tolist())) for r, g in zip(rows, groups, strict=True))
    assert alignment.alignment_digests(df.limit(0)).count() == 0 and alignment.align_documents(df.limit(0)).count() == 0


def test_ranks_give_the_ids_of_the_tokenizer_file(texts):
    quick, slow = alignment.BytePieces(A, RANKS), alignment.BytePieces(A)
    forms = [f.replace("_", chr(c)) for c in range(0x250) for f in ("a_b _ __1 _", "_", " _\n_  _x", "'_'s___ 12_3")]
    for t in [*forms, *(t for t in texts if t)]:
        assert quick.encode(t).tolist() == slow.encode(t).tolist()


def test_merge_pieces():
    rng = np.random.default_rng(1)
    for work in [1, 2, 3, 7, 40, 1000] * 20:
        x, y = (np.sort(rng.choice(400, rng.integers(0, 200), replace=False)) for _ in range(2))
        p, q = alignment.merge_pieces(x, y, work)
        both = np.intersect1d(x, y)
        assert (x[p - 1] == both).all() and (y[q - 1] == both).all() and len(p) == len(q) == len(both)
    a, b = np.arange(0, 100, 2), np.arange(0, 100, 3)
    d = np.arange(0, len(a) + len(b))
    order = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
    assert alignment.diagonal_splits(a, b, d).tolist() == [sum(1 for _, s in order[:k] if s == 0) for k in d]


def test_repeats_in_one_group_are_counted_not_paired():
    c = alignment.Aligned.__new__(alignment.Aligned)
    c.a_ids, c.b_ids = np.array([5] * 3000 + [6], np.int64), np.array([8] * 2000 + [9], np.int64)
    c.a_cuts, c.b_cuts = np.array([3001]), np.array([2001])
    rows = sorted(zip(*(x.tolist() for x in alignment.linked_ids(c)), strict=True))
    assert rows == [(0, 5, 8, 6_000_000), (0, 5, 9, 3000), (0, 6, 8, 2000), (0, 6, 9, 1)]
