"""Byte-level BPE by rank files, equal to the tiktoken library, for texts of any length.

Texts up to `chunk_chars` are encoded in the task that reads them. Longer ones are cut into overlapping chunks, which
are dealt out and split by the pre-token pattern in parallel. A chunk that begins inside a pre-token is out of step at
first; at a boundary that the chunk before also has, both agree from there on, because the pattern never looks back.
Each chunk takes over from the one before at their first common boundary, and the pieces between these places are
encoded, again in parallel. Decoding concatenates the raw bytes of the ids.

Cases: a null text counts as empty and has no ids; document ids may be null or repeated, every row gets its own
result; an empty table gives an empty result; other columns are never looked at. A seam without a common boundary (a
run of letters, digits or blanks longer than the overlap) makes that one text be encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idscreen.llm.shared import binary_values, materialise, parallelism

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
# How far the pattern may look beyond a match: one character after white space, two for the rest of `'re`.
LOOK_AHEAD = 3


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoder(ranks_path: str, pattern: str) -> Callable[[str], bytes]:
    """Text to ids as little-endian unsigned 32-bit integers. Made in the task, where the rank file is read."""
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
    return lambda text: np.asarray(encoding.encode_to_numpy(text, disallowed_special=())).astype("<u4").tobytes()


def decoder(ranks_path: str) -> Callable[[bytes], bytes]:
    """Ids back to raw bytes; an id need not end at a character."""
    tokens = {rank: token for token, rank in load_ranks(ranks_path).items()}
    return lambda ids: b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _cut(docs: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """(row, doc_id, chunk, last, text): chunks of long texts with the first characters of the chunk that follows."""

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(len(frame)):
                text = frame["text"].iloc[k]
                starts = range(0, len(text), chunk_chars)
                repeated = frame.iloc[[k] * len(starts)][["row", "doc_id"]].reset_index(drop=True)
                yield repeated.assign(
                    chunk=range(len(starts)),
                    last=[s + chunk_chars >= len(text) for s in starts],
                    text=[text[s : s + chunk_chars + overlap] for s in starts],
                )

    # ids travel through pandas as strings, which keep large numbers beside nulls
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string"), "text")
    return numbered.mapInPandas(chunks, "row bigint, doc_id string, chunk int, last boolean, text string")


def _seams(chunks: DataFrame, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(row, chunk, first, after): the part of its own text that each chunk encodes; `first` is null at a bad seam."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        compiled = regex.compile(pattern)
        for frame in frames:
            heads, tails = [], []
            for text, last in zip(frame["text"], frame["last"]):
                ends = np.array([0, *(m.end() for m in compiled.finditer(text))], np.int32)
                sure = ends if last else ends[ends + LOOK_AHEAD <= len(text)]
                heads.append(ends[ends <= overlap])
                tails.append(sure[sure >= chunk_chars] - chunk_chars)
            yield frame[["row", "chunk"]].assign(head=heads, tail=tails)

    dealt = chunks.select("row", "chunk", "last", "text").repartition(parallelism(chunks.sparkSession), "row", "chunk")
    ends = dealt.mapInPandas(split, "row bigint, chunk int, head array<int>, tail array<int>")
    in_order = Window.partitionBy("row").orderBy("chunk")
    first = F.when(F.col("chunk") == 0, 0).otherwise(
        F.array_min(F.array_intersect("head", F.lag("tail").over(in_order)))
    )
    return (
        ends.withColumn("first", first)
        .withColumn("after", F.lead("first").over(in_order) + chunk_chars)
        .select("row", "chunk", "first", "after")
    )


def _encode_long(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    chunks = materialise(_cut(docs, chunk_chars, overlap), "bpe-chunks")
    seams = materialise(_seams(chunks, pattern, chunk_chars, overlap), "bpe-seams")
    bad = seams.where("first is null").select("row").distinct()

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(ranks_path, pattern)
        for frame in frames:
            after = frame["after"].fillna(-1).astype(int)
            parts = [
                ids(text[first:] if end < 0 else text[first:end])
                for text, first, end in zip(frame["text"], frame["first"], after)
            ]
            yield frame[["row", "doc_id", "chunk"]].assign(ids=parts)

    def rejoin(frame: pd.DataFrame) -> pd.DataFrame:
        texts = frame.sort_values("chunk")["text"].tolist()
        whole = "".join([*(t[:chunk_chars] for t in texts[:-1]), texts[-1]])
        return frame.iloc[:1][["row", "doc_id"]].assign(chunk=0, ids=[encoder(ranks_path, pattern)(whole)])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[:1][["doc_id"]].assign(ids=[b"".join(frame.sort_values("chunk")["ids"])])

    schema = "row bigint, doc_id string, chunk int, ids binary"
    good = chunks.join(seams, ["row", "chunk"]).join(bad, "row", "left_anti")
    whole = chunks.join(bad, "row", "left_semi").groupBy("row").applyInPandas(rejoin, schema)
    pieces = good.select("row", "doc_id", "chunk", "text", "first", "after").mapInPandas(encode, schema)
    # what comes together here is one text's ids, never more
    texts = pieces.unionByName(whole).groupBy("row").applyInPandas(joined, "doc_id string, ids binary")
    return texts.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "ids")


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as little-endian unsigned 32-bit integers."""
    if not LOOK_AHEAD < overlap <= chunk_chars:
        raise ValueError("the overlap must be longer than the look-ahead and no longer than a chunk")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(ranks_path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 1_024):
                batch = whole.slice(start, 1_024)
                values = [ids(b.decode()) for b in binary_values(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["doc_id", "ids"])

    size = F.char_length("text")
    short = narrow.where(size <= chunk_chars).mapInArrow(encode, f"doc_id {kind}, ids binary")
    return short.unionByName(_encode_long(narrow.where(size > chunk_chars), ranks_path, pattern, chunk_chars, overlap))


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds `decoded`, the raw bytes of (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = decoder(ranks_path)
        for whole in batches:
            for start in range(0, whole.num_rows, 1_024):
                batch = whole.slice(start, 1_024)
                values = [raw(b) for b in binary_values(batch.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(values, pa.binary())], names=["doc_id", "ids", "decoded"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded documents."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
