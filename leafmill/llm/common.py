"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new temporary one where it is unset and Spark runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-leafmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it back: a lost executor costs no recomputation and the rows stay the same."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """Marks `df` for broadcast if its counted `rows` are at most `limit`; beyond that, Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def numbered(df: DataFrame, times: str, name: str, run: int = 65_536) -> DataFrame:
    """Each row as often as its column `times` says, with `name` counting from 1: by runs, so that no row makes an array longer than `run`."""
    n = F.col(times).cast("long")
    runs = df.where(n > 0).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(CAST({times} AS BIGINT) - 1) div {run}"))))
    return runs.withColumn(name, F.explode(F.sequence(F.col(name) * run + 1, F.least(n, (F.col(name) + 1) * run))))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class WordHashes(dict):
    """64-bit hashes of words, kept for at most `most` words at a time."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of UTF-8 text with A-Z in lower case. bytes.split() cuts at exactly the six ASCII white-space bytes of WORD."""
    return text.lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(0x5EED)
_BYTES = _RNG.integers(0, 2**64, 256, np.uint64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BASE = np.uint64(int(_RNG.integers(0, 2**62)) * 4 + 3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Texts are hashed in pieces of about so many bytes, cut at white space.
_PIECE = 1 << 20


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 text with A-Z in lower case, in order.

    A word's hash is a polynomial of random numbers for its bytes, from running sums over the text.
    """
    if not text:
        return np.zeros(0, np.uint64)
    if len(text) > _PIECE:
        parts, at = [], 0
        while at < len(text):
            end = at + _PIECE
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            parts.append(_hashed(text[at:end]))
            at = end
        return np.concatenate(parts)
    return _hashed(text)


def _hashed(text: bytes) -> np.ndarray:
    b = np.frombuffer(text.lower(), np.uint8)
    if len(b) > len(_powers[0]):
        size = 1 << len(b).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate(([np.uint64(1)], np.full(size - 1, base))).cumprod(dtype=np.uint64)
    edges = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * _powers[0][: len(b)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of `width` words, in their order; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i]
    return mixed(out + np.uint64(width))


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of whole numbers, byte plane by byte plane."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def parts_for(rows: float, each: int) -> int:
    """Buckets for `rows` rows at about `each` rows a bucket."""
    return max(1, math.ceil(rows / each))


def give_back() -> None:
    """Hands memory that a task no longer needs back to the system: Python workers outlive their tasks, and what they keep counts for the executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str | int, rows: int = 500, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most `rows` rows and about `size` bytes of `column` (or one row) each."""
    for b in batches:
        c = b.column(column)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(c), 0)))
        at = 0
        while at < b.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            upto = min(max(upto, at + 1), at + rows, b.num_rows)
            yield b.slice(at, upto - at)
            at = upto
