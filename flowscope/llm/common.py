"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.session import shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD_GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package also when the driver was started from another folder."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, gives real sizes."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(df: DataFrame, text: str = "text"):
    """The text as a string, null counting as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def lower_ascii(text):
    return F.translate(text, UPPER, LOWER)


def words(text):
    """Words of lower-cased (A-Z only) text between ASCII white space, as an array column."""
    spaced = F.translate(text, UPPER + "\t\n\x0b\x0c\r", LOWER + "     ")
    return F.array_remove(F.split(spaced, " "), "")


# ---- numpy kernels -------------------------------------------------------------------------------------------------

ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int = 0xD1342543DE82EF95):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            grown = []
            for step in (self.base, self.inverse):
                out = np.full(size, step, np.uint64)
                out[0] = 1
                grown.append(np.cumprod(out, dtype=np.uint64))
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums ``P`` and inverse powers ``D``: (P[b] - P[a]) * D[a] identifies the bytes a..b-1 wherever they stand."""
    up, down = POWERS.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=sums[1:])
    return sums, down


_LOWER_TABLE = np.arange(256, dtype=np.uint8)
_LOWER_TABLE[65:91] += 32
POLYNOMIAL_BYTES = 256  # polynomials modulo 2^64 have known collisions on long regular strings
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of one UTF-8 text given as bytes; A-Z lower-cased, ASCII white space separates."""
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = ~_IS_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    lowered = _LOWER_TABLE[data]
    sums, down = prefix_sums(BYTE_CODES[lowered])
    hashes = mix((sums[end] - sums[start]) * down[start])
    for i in np.flatnonzero(end - start > POLYNOMIAL_BYTES):
        digest = blake2b(lowered[start[i] : end[i]].tobytes(), digest_size=8).digest()
        hashes[i] = np.frombuffer(digest, np.uint64)[0]
    return hashes


def shingle_hashes(data: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text; fewer words make one shingle, none makes none."""
    w = word_hashes(data)
    if not len(w):
        return w
    k = min(size, len(w))
    out = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out * ODD + w[i : len(w) - k + 1 + i])
    return np.unique(out)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, borders) of an Arrow string column without nulls."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    borders = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), borders
