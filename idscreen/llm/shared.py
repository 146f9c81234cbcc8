"""Small helpers of the training-text operators: words, hashes, Arrow batches, intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idscreen.sources.scratch import fresh_dir, remove, written  # noqa: F401 - the operators take them from here

# A word is a run of characters other than these six; the same class as bytes.split() without arguments.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

GOLDEN = 0x9E3779B97F4A7C15


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table once in the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    return written(df, purpose)[0]


def keep_one(docs: DataFrame, id_col: str, key: Column, stay: DataFrame) -> DataFrame:
    """The rows of `docs` named by `stay` (key, doc_id, n), with all their columns; one of n rows equal in key and id.

    Rows meet their decision by key and id together, so a key held by a third of all rows is spread by its ids. Of rows
    equal in both, the one whose columns come first as JSON stays.
    """
    decided = stay.select(F.col("key").alias("_k"), F.col("doc_id").alias("_i"), F.col("n").alias("_n"))
    whole = docs.select(key.alias("_key"), F.col(id_col).alias("_id"), F.struct(*docs.columns).alias("_row"))
    met = whole.join(decided, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")))
    single = met.where("_n = 1").select("_row.*")
    repeated = met.where("_n > 1").groupBy("_key", "_id").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return single.unionByName(repeated.select("_row.*"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet, whatever the caller's columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def binary_values(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as empty, a few rows at a time so that few copies live at once."""
    column = column.cast(pa.large_binary())
    for start in range(0, len(column), 64):
        for value in column.slice(start, 64).to_pylist():
            yield value or b""


def byte_slices(batch: pa.RecordBatch, text: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `limit` bytes of its column number `text`, at least one row each."""
    sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0)).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words seen most recently. Bounded, so a long task cannot grow it."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all windows of a fixed number of words, from one prefix sum, whatever the window's length.

    A window's sum of word hash times base ** position is brought to position 0 by the inverse of the base, which
    exists modulo 2 ** 64 because the base is odd; a finaliser then mixes the bits.
    """

    def __init__(self) -> None:
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)
        self._base = np.uint64(GOLDEN | 1)
        self._inverse = np.uint64(pow(GOLDEN | 1, -1, 1 << 64))

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            size = max(n, 2 * len(self._powers), 4096)
            base, inverse = np.full(size, self._base), np.full(size, self._inverse)
            base[0] = inverse[0] = 1
            self._powers, self._inverses = np.cumprod(base), np.cumprod(inverse)

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.uint64)
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self._powers[:n], out=sums[1:])
        return mixed((sums[size:] - sums[:-size]) * self._inverses[: n - size + 1] + np.uint64(size))
