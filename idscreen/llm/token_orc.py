"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Texts are range-partitioned by document id before they are encoded, so the files hold ascending ids, each file is a
shard of bounded size, and a reader can skip files, stripes and row groups by their statistics. Reading is
parallel over stripes; where a document's tokens start in the whole corpus comes from per-shard totals.

Cases: a null text counts as empty and holds the end id alone; null document ids come first; rows of equal id are
ordered by their tokens, so reruns agree; an empty table gives files without rows; other columns are never looked at.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idscreen.llm.shared import byte_slices

SHARD_BYTES = 64 << 20
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LAST_LATIN = "\u024f"


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(seen)))}


_BYTES = _byte_letters()
# What a tokenizer file must say for texts to be encoded word by word; any other file is given whole texts.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def drops_blanks(path: str) -> bool:
    """Whether the file's tokenizer lower-cases, cuts at white space and drops it, so that words can be encoded alone."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    normalizer, pre = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}
    split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
    return (
        normalizer.get("normalizers") == _NORMALIZERS
        and pre.get("pretokenizers", [None])[0] == split
        and not said.get("post_processor")
        and said["model"].get("dropout") is None
    )


class WordIds:
    """Ids of texts by the tokenizers library; texts are cut at ASCII blanks and only new words are encoded.

    The tokenizer drops white space, so a text's ids are its words' ids one after the other. Arrow splits a slice of
    texts and numbers its different words; the ids of every word are looked up once per slice and laid out by number. ASCII letters
    are lower-cased before, which the tokenizer does as well, so that fewer different words are left. The memory is bounded: it is emptied when `limit` words are held. A file whose
    tokenizer works otherwise is given whole texts.
    """

    def __init__(self, path: str, limit: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are then ordinary text
        self._model = self._tokenizer.model
        self._by_words = drops_blanks(path)
        self._known: dict[str, tuple[int, ...]] = {}
        self._limit = limit

    def _encoded(self, texts: list[str]) -> list[tuple[int, ...]]:
        return [tuple(e.ids) for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _part(self, part: str) -> tuple[int, ...]:
        """A word of Latin letters is one piece, whose bytes the library's model merges; all else goes through the whole tokenizer."""
        low = part.lower()
        if part.isalpha() and part[0] <= _LAST_LATIN and max(part) <= _LAST_LATIN and low.isalpha():
            piece = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTES)
            return tuple(t.id for t in self._model.tokenize(piece))
        return tuple(self._tokenizer.encode(part, add_special_tokens=False).ids)

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word that is not known. Marks at the end of a word of letters are a piece of their own."""
        body = word.rstrip(_MARKS)
        if not body.isalpha() or len(body) == len(word):
            return self._part(word) if word else ()
        ids = ()
        for part in (body, word[len(body) :]):
            known = self._known.get(part)
            if known is None:
                known = self._known[part] = self._part(part)
            ids += known
        return ids

    def _look_up(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of different words."""
        found = list(map(self._known.get, words))
        for k, ids in enumerate(found):
            if ids is None:
                if len(self._known) >= self._limit:
                    self._known.clear()
                found[k] = self._known[words[k]] = self._word(words[k])
        return found

    def lists(self, texts: pa.Array, end_id: int | None = None) -> pa.ListArray:
        """Ids of every text of a string array, null as empty, with the end id after each."""
        texts = pc.fill_null(texts, "")
        if self._by_words:
            split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            words = split.flatten().dictionary_encode()
            codes = words.indices.to_numpy()
            ids = self._look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            at = np.asarray(split.offsets) - split.offsets[0].as_py()
        else:
            codes, at, ids = np.arange(len(texts)), np.arange(len(texts) + 1), self._encoded(texts.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))
        starts, counts = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.r_[0, np.cumsum(counts)]
        laid = flat[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])]
        offsets = ends[at]
        if end_id is not None:
            laid = np.insert(laid, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(laid.astype(np.int32)))

    def of(self, text: str) -> list[int]:
        return self.lists(pa.array([text], pa.string()))[0].as_py()


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
) -> None:
    """Encode every whole text, append the end id, and write (shard, doc_id, n_tokens, ids) in ascending id order."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    if shards is None:
        size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES), docs.sparkSession.sparkContext.defaultParallelism)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        for whole in batches:
            for batch in byte_slices(whole, 1, 4 << 20):
                ids = words.lists(batch.column(1), end_id)
                yield pa.RecordBatch.from_arrays([batch.column(0), ids.value_lengths(), ids], names=["doc_id", "n_tokens", "ids"])

    placed = narrow.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
    encoded = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").mapInArrow(
        encode, f"doc_id {kind}, n_tokens int, ids array<int>"
    )
    (
        encoded.withColumn("shard", F.spark_partition_id())
        .select("shard", "doc_id", "n_tokens", "ids")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(shard, doc_id, n_tokens, ids) from the files; filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(f"shard int, doc_id {id_type}, n_tokens int, ids array<int>").orc(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of written files: where each document starts and the checksum of its ids.

    Checksums are made where the stripes are read; only narrow rows are shuffled, to their shard, whose size is
    bounded. The running total over shards has one row per shard.
    """
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype("<u4")
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ends[1:] - ends[:-1], pa.int64()), pa.array(sums, pa.int64())],
                names=["shard", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = tokens.select("shard", "doc_id", "ids").mapInArrow(
        checksum, f"shard int, doc_id {kind}, n_tokens bigint, ids_crc32 bigint"
    )
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("shard", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_first"))
    in_shard = (
        Window.partitionBy("shard")
        .orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return rows.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        (F.col("_first") + F.coalesce(F.sum("n_tokens").over(in_shard), F.lit(0))).cast("bigint").alias("start"),
        "n_tokens",
        "ids_crc32",
    )
