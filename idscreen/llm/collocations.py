"""Phrase collocations by SON partitioning: shards mined at lowered support, then one exact count of the union.

Documents are dealt to a fixed number of shards. A phrase that occurs `support` times in all occurs at least
ceil(support / shards) times in one shard, so the union of the shards' frequent phrases misses none. Shards are mined by
length: pairs first, then phrases of three and four words whose pairs are all in the union so far. Mining counts 64-bit
hashes folded in every task; two phrases with one hash can only add a candidate. The union becomes a bitmap of a fixed
size, and every task then counts the phrases that pass it, as text. So counts are exact, whatever the hashes do.

Words and pieces are cut at ASCII characters only. Very long texts are cut into words a slice at a time, and a task folds
what it has counted every few million words, so neither length nor the number of texts grows its memory.

Cases: a null text is empty; a null language is `und`; repeated rows count as often as they are there; a language without
candidates has no rows; equal scores are ordered by count and then by the phrase's bytes; an empty table gives an empty result; other
columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idscreen.llm.shared import binary_values, materialise, mixed

SUPPORT = 30
LONGEST = 4
TOP = 2_000
ABSORBED_PERCENT = 80
SHARDS = 4
FILTER_BITS = 27  # a bitmap of 16 MB
FOLD_BYTES = 24 << 20
SLICE_BYTES = 1 << 20

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
# Pieces end at these; all of them become a full stop, which is a token of its own.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _ENDS + b"\t", _LOWER + b"." * len(_ENDS) + b" ")


def parts(text: bytes, slice_bytes: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text as words and full stops between spaces, a slice of whole words at a time. It begins with a full stop."""
    text = b". " + text.translate(_TABLE)
    begin = 0
    while begin < len(text):
        end = begin + slice_bytes
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        part = text[begin:end].replace(b".", b" . ").strip(b" ")
        if part:
            yield part
        begin = end


class Folder:
    """Gathers texts by a key (language, shard) until there are `limit` bytes, then numbers their words and hands them out."""

    def __init__(self, limit: int) -> None:
        self._limit = limit
        self._clear()

    def _clear(self) -> None:
        self._parts: dict[tuple, list[bytes]] = {}
        self._size = 0

    def add(self, key: tuple, text: bytes) -> Iterator[tuple[tuple, np.ndarray, pa.Array]]:
        held = self._parts.setdefault(key, [])
        for part in parts(text):
            held.append(part)
            self._size += len(part)
        if self._size >= self._limit:
            yield from self.rest()

    def rest(self) -> Iterator[tuple[tuple, np.ndarray, pa.Array]]:
        """(key, numbers of the words in order, the words by number) of everything gathered so far. Words are numbered as they
        come, and a text begins with a full stop, so number 0 is the end of a piece."""
        for key, held in self._parts.items():
            split = pc.ascii_split_whitespace(pa.array(held, pa.binary()).cast(pa.string()))
            words = split.flatten().dictionary_encode()
            yield key, words.indices.to_numpy().astype(np.int64), words.dictionary
        self._clear()


def _hashes(words: pa.Array) -> np.ndarray:
    spelled = words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, spelled), np.uint64, len(spelled))


class Grams:
    """Hashes of the phrases of a word sequence, by length, and where phrases are that pass a bitmap of shorter ones."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, language: str, bitmap: np.ndarray | None) -> None:
        self._bitmap = bitmap
        self._words = hashes[ids]
        self._hash = mixed(self._words + np.uint64(xxhash.xxh3_64_intdigest(language.encode())))
        self._ok = ids != 0
        self.hit = self._ok  # phrases that begin here: of one word, all

    def longer(self) -> np.ndarray:
        """Goes one word further. Returns the hashes; `hit` tells the places whose two shorter phrases were hits."""
        n = len(self._hash) - 1
        step = len(self._words) - n
        self._hash = mixed(self._hash[:n] * np.uint64(0xD6E8FEB86659FD93) + self._words[step:])
        self.hit = self.hit[:n] & self.hit[1:]
        return self._hash

    def passed(self) -> None:
        """Keeps only the places that pass the bitmap."""
        slot = self._hash >> np.uint64(64 - self._bits())
        self.hit = self.hit & ((self._bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def _bits(self) -> int:
        return (len(self._bitmap) * 8).bit_length() - 1


def _narrow(docs: DataFrame, lang: str, text: str, shard: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), shard.alias("shard"), F.col(text).alias("text"))


def _mined(narrow: DataFrame, lengths: tuple[int, ...], shard_support: int, bitmap, fold_bytes: int) -> DataFrame:
    """(gram): hashes of the phrases of these lengths that reach the lowered support in one shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(fold_bytes)
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)

        def folded(gathered) -> Iterator[pa.RecordBatch]:
            for (language, shard), ids, words in gathered:
                grams, found = Grams(ids, _hashes(words), language, bits), []
                for length in range(2, max(lengths) + 1):
                    if len(ids) < length:
                        break
                    h = grams.longer()
                    if length in lengths:
                        found.append(h[grams.hit])
                    if bits is not None and length < min(lengths):
                        grams.passed()
                for h in found:
                    value, n = np.unique(h, return_counts=True)
                    for k in range(0, len(value), 100_000):
                        part = value[k : k + 100_000].view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), shard, np.int32)), pa.array(part), pa.array(n[k : k + 100_000].astype(np.int64))],
                            names=["shard", "gram", "n"],
                        )

        for batch in batches:
            columns = batch.column("lang").to_pylist(), batch.column("shard").to_pylist(), binary_values(batch.column("text"))
            for language, shard, text in zip(*columns):
                yield from folded(folder.add((language, shard), text))
        yield from folded(folder.rest())

    counted = narrow.mapInArrow(count, "shard int, gram bigint, n bigint")
    frequent = counted.groupBy("shard", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= shard_support)
    return frequent.select("gram").distinct()


def bitmap_of(grams: DataFrame, bits: int) -> bytes:
    """Which of the first `bits` bits of a hash a gram has. The driver reads this bitmap, whose size does not depend on data."""
    chunk_bits = min(20, bits)
    slots = grams.select(F.shiftrightunsigned("gram", 64 - bits).alias("slot")).distinct()
    placed = slots.select(F.shiftright("slot", chunk_bits).cast("int").alias("chunk"), F.col("slot").bitwiseAND((1 << chunk_bits) - 1).alias("slot"))

    def packed(table: pa.Table) -> pa.Table:
        set_ = np.zeros(1 << chunk_bits, np.uint8)
        set_[table.column("slot").to_numpy()] = 1
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(set_, bitorder="little").tobytes()])})

    whole = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (chunk_bits - 3)
    for row in placed.groupBy("chunk").applyInArrow(packed, "chunk int, bits binary").collect():
        whole[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return whole.tobytes()


def _counted(narrow: DataFrame, longest: int, bitmap, fold_bytes: int) -> DataFrame:
    """(lang, length, phrase, n): exact counts of all words, of all phrases that pass the bitmap, and of nothing (length 0:
    how many words there are)."""

    def spelled(ids: np.ndarray, language: str, words: pa.Array, bits: np.ndarray) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        size = len(words)
        n = np.bincount(ids, minlength=size)
        yield 0, pa.array([""]), np.array([len(ids) - n[0]])
        yield 1, words.slice(1), n[1:]
        grams, rank = Grams(ids, _hashes(words), language, bits), ids
        for length in range(2, longest + 1):
            if len(ids) < length:
                return
            grams.longer()
            grams.passed()
            at = np.flatnonzero(grams.hit)
            # a phrase is its first words' rank and its last word: different phrases never share a key
            key = rank[at] * size + ids[at + length - 1]
            _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            rank = np.full(len(grams.hit), -1)
            rank[at] = inverse
            yield length, pc.binary_join_element_wise(*[words.take(pa.array(ids[at[first] + k])) for k in range(length)], " "), n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(fold_bytes)
        bits = np.frombuffer(bitmap.value, np.uint8)

        def folded(gathered) -> Iterator[pa.RecordBatch]:
            for (language, _), ids, words in gathered:
                for length, phrases, n in spelled(ids, language, words, bits):
                    for k in range(0, len(phrases), 50_000):
                        part = phrases.slice(k, 50_000)
                        columns = [pa.array([language] * len(part), pa.string()), pa.array(np.full(len(part), length, np.int32))]
                        yield pa.RecordBatch.from_arrays(
                            [*columns, part, pa.array(n[k : k + 50_000].astype(np.int64))], names=["lang", "length", "phrase", "n"]
                        )

        for batch in batches:
            for language, text in zip(batch.column("lang").to_pylist(), binary_values(batch.column("text"))):
                yield from folded(folder.add((language, 0), text))
        yield from folded(folder.rest())

    counted = narrow.mapInArrow(count, "lang string, length int, phrase string, n bigint")
    return counted.groupBy("lang", "length", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    support: int = SUPPORT,
    longest: int = LONGEST,
    shards: int = SHARDS,
    filter_bits: int = FILTER_BITS,
    fold_bytes: int = FOLD_BYTES,
) -> DataFrame:
    """(lang, length, phrase, n): phrases of 1 to `longest` words that occur `support` times or more in a language, and
    under length 0 how many words the language has."""
    spark = docs.sparkSession
    dealt = F.pmod(F.xxhash64(F.col(text)), F.lit(shards)).cast("int")
    narrow = _narrow(docs, lang, text, dealt)
    local = -(-support // shards)
    pairs = materialise(_mined(narrow, (2,), local, None, fold_bytes), "frequent-pairs")
    grams, shared = pairs, None
    if longest > 2:
        shared = spark.sparkContext.broadcast(bitmap_of(pairs, filter_bits))
        more = _mined(narrow, tuple(range(3, longest + 1)), local, shared, fold_bytes)
        grams = pairs.unionByName(materialise(more, "frequent-phrases"))
    every = spark.sparkContext.broadcast(bitmap_of(grams, filter_bits))
    counts = _counted(_narrow(docs, lang, text, F.lit(0)), longest, every, fold_bytes)
    kept = materialise(counts.where((F.col("n") >= support) | (F.col("length") == 0)), "phrase-counts")
    for used in (shared, every):
        if used is not None:
            used.unpersist()
    return kept


def _cut(phrase: str, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    support: int = SUPPORT,
    longest: int = LONGEST,
    top: int = TOP,
    absorbed_percent: int = ABSORBED_PERCENT,
    shards: int = SHARDS,
    filter_bits: int = FILTER_BITS,
    fold_bytes: int = FOLD_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language.

    A candidate of `length` words is cut after its first k words; l and r count the two parts, which are frequent because the
    candidate is, so they are in the same table. Products are decimals of 28 digits.
    """
    counts = phrase_counts(docs, lang, text, support, longest, shards, filter_bits, fold_bytes)
    phrases = counts.where("length >= 2").select("lang", "length", "phrase", F.col("n").alias("a"))
    shorter = counts.where((F.col("length") >= 1) & (F.col("length") < longest)).select("lang", "phrase", "n")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        _cut("phrase", F.lit(1), F.col("k")).alias("left"),
        _cut("phrase", F.col("k") + 1, F.col("length") - F.col("k")).alias("right"),
    )
    lefts = shorter.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = shorter.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).withColumn(
        "score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(20,0)) + r)")
    )
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr(
        "flatten(transform(sequence(2, length - 1), size -> transform(sequence(0, length - size),"
        " p -> array_join(slice(split(phrase, ' '), p + 1, size), ' '))))"
    )
    around = (
        phrases.where("length > 2")
        .select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    absorbed = 100 * F.col("longer") >= absorbed_percent * F.col("a")
    alone = lowest.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~absorbed)
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = alone.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = counts.where("length = 0").select("lang", F.col("n").alias("n"))
    return ranked.join(sizes, "lang").select(
        "lang",
        F.col("rank").cast("bigint").alias("rank"),
        "phrase",
        "a",
        F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"),
        "n",
        F.col("cut.score").cast("bigint").alias("score"),
    )
