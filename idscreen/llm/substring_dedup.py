"""Exact repeated passages through fixed-block anchors.

A window of 50 words contains, wherever it starts, a whole block of 25 words that begins at a multiple of 25. So the
reference blocks of every document (non-overlapping) are indexed by hash and probed with every rolling window of 25
words of every document. A hit is extended: the 50-word windows around it are looked up by their own hashes, each with
the smallest document that holds it, and runs of repeated windows are the maximal repeats.

Hashes are dealt to cells by their value. They travel packed, a few bytes each, as arrays with one entry per document,
never as rows. A cell is a part of the hash range and a salt of the document id: as documents grow in number so do the
salts, and a passage that every document holds still fills no cell beyond its bound. The index of a part is put
together from its cells' smallest documents and sent to each of them.

Cases: a null text has no words; documents without an id are left whole and remove nothing; rows of equal id count as
one document and do not remove each other's words; an empty table gives an empty result; other columns are never looked at.
Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idscreen.llm.shared import Rolling, WordHashes, binary_values, byte_slices, materialise, mixed, remove, written

WINDOW_WORDS = 50
CELL_ENTRIES = 1_000_000
SALT_DOCUMENTS = 2_000_000
BUCKET_BYTES = 16 << 20


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _packed(doc: np.ndarray, h: np.ndarray, ids: np.ndarray, parts: int, salts: int, width: str) -> pa.RecordBatch:
    """One row per cell: its documents, how many entries each has, and the entries' low hash bits."""
    salt = (mixed(ids.astype(np.uint64)) % np.uint64(salts))[doc]
    cell = (_part(h, parts) * np.uint64(salts) + salt).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, doc, low = cell[order], doc[order], h[order].astype(width)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(starts, [*starts[1:], len(cell)]):
        at = np.flatnonzero(np.r_[True, doc[a + 1 : b] != doc[a : b - 1]])
        counts = np.diff(np.r_[at, b - a]).astype("<u4")
        rows.append((int(cell[a]), ids[doc[a:b][at]].tobytes(), counts.tobytes(), low[a:b].tobytes()))
    columns = list(zip(*rows)) or [(), (), (), ()]
    types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=["cell", "docs", "counts", "prints"]
    )


def _unpacked(frame: pd.DataFrame, width: str) -> tuple[np.ndarray, np.ndarray]:
    """(document id, print) of every entry of a cell."""
    counts = np.frombuffer(b"".join(frame["counts"]), "<u4")
    return np.repeat(np.frombuffer(b"".join(frame["docs"]), "<i8"), counts), np.frombuffer(b"".join(frame["prints"]), width)


_CELLS = "cell bigint, docs binary, counts binary, prints binary"


def _smallest(cells: DataFrame, salts: int, width: str, indexed: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(part, prints, owners): the smallest document of every indexed print, as packed pieces of each part."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        doc, prints = _unpacked(frame, width)
        chosen = indexed(prints)
        doc, prints = doc[chosen], prints[chosen]
        order = np.lexsort((doc, prints))
        doc, prints = doc[order], prints[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, np.int64)
        return pd.DataFrame(
            {
                "part": frame["cell"].iloc[:1] // salts,
                "prints": [prints[first].tobytes()],
                "owners": [doc[first].tobytes()],
            }
        )

    return cells.groupBy("cell").applyInPandas(fold, "part bigint, prints binary, owners binary")


def _hits(cells: DataFrame, index: DataFrame, salts: int, width: str, buckets: int, with_owner: bool) -> DataFrame:
    """(doc_id, keys): entries whose print is indexed for a smaller document; on wish the owner's entry too.

    Cells find hits, documents need theirs from all cells. On the way hits are packed by cell and bucket of documents, so that
    there are never as many rows as documents times cells; a bucket's hits, which follow its documents' texts, are then dealt
    to its documents. A key is a print with its part above it, where prints are short.
    """
    spread = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = spread.select((F.col("part") * salts + F.col("_salt")).alias("cell"), "prints", "owners")

    def find(key: tuple, entries: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"bucket": [], "part": [], "docs": [], "counts": [], "prints": []})
        if not len(entries) or not len(known):
            return nothing
        prints = np.frombuffer(b"".join(known["prints"]), width)
        owners = np.frombuffer(b"".join(known["owners"]), "<i8")
        order = np.lexsort((owners, prints))
        prints, owners = prints[order], owners[order]
        if not len(prints):
            return nothing
        doc, probe = _unpacked(entries, width)
        if with_owner:
            probe = probe & ~np.array(1, width)  # the mark of a reference block is not part of the hash
        place = np.searchsorted(prints, probe)  # the first of equal prints has the smallest owner
        place[place == len(prints)] = 0
        found = (prints[place] == probe) & (owners[place] < doc)
        doc, probe, owner = doc[found], probe[found], owners[place[found]]
        if with_owner:
            doc, probe = np.r_[doc, owner], np.r_[probe, probe]
        order = np.lexsort((probe, doc))
        doc, probe = doc[order], probe[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (probe[1:] != probe[:-1])] if len(doc) else np.zeros(0, bool)
        doc, probe = doc[new], probe[new]
        if not len(doc):
            return nothing
        bucket = _bucket(doc, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, doc, probe = bucket[order], doc[order], probe[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = []
        for a, b in zip(starts, [*starts[1:], len(bucket)]):
            docs, counts = np.unique(doc[a:b], return_counts=True)  # in order already
            part = int(key[0]) // salts
            rows.append((int(bucket[a]), part, docs.tobytes(), counts.astype("<u4").tobytes(), probe[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "part", "docs", "counts", "prints"])

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        doc, prints = _unpacked(frame, width)
        keys = prints.astype("<u8")
        if width == "<u4":
            sizes = [len(x) // 4 for x in frame["prints"]]
            keys |= np.repeat(frame["part"].to_numpy().astype("<u8"), sizes) << np.uint64(32)
        order = np.argsort(doc, kind="stable")
        doc, keys = doc[order], keys[order]
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        ends = np.r_[starts[1:], len(doc)]
        return pd.DataFrame({"doc_id": doc[starts], "keys": [keys[a:b].tobytes() for a, b in zip(starts, ends)]})

    found = (
        cells.groupBy("cell")
        .cogroup(spread.groupBy("cell"))
        .applyInPandas(find, "bucket bigint, part bigint, docs binary, counts binary, prints binary")
    )
    return found.groupBy("bucket").applyInPandas(deal, "doc_id bigint, keys binary")


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


class _Words:
    """The words of texts and their hashes, and the rolling windows over them."""

    def __init__(self) -> None:
        self._hashes, self.rolling = WordHashes(), Rolling()

    def of(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        words = text.split()
        return words, self._hashes.of(words)


def _probes(texts: DataFrame, window: int, parts: int, salts: int) -> DataFrame:
    """Cells of all rolling half windows; the lowest bit of a print marks the reference blocks."""
    block = window // 2

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for whole in batches:
            for batch in byte_slices(whole, 1):
                ids = np.asarray(batch.column(0))
                hashes = []
                for raw in binary_values(batch.column(1)):
                    _, h = words.of(raw)
                    h = words.rolling.windows(h, block) & ~np.uint64(1) if len(h) >= window else h[:0]
                    h[::block] |= np.uint64(1)
                    hashes.append(h)
                doc = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
                yield _packed(doc, np.concatenate(hashes), ids, parts, salts, "<u4")

    return texts.mapInArrow(pack, _CELLS)


def _windows(met: DataFrame, window: int, parts: int, salts: int) -> DataFrame:
    """Cells of the windows around hits, of (doc_id, text, live): each distinct window of a document once."""
    block = window // 2

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for whole in batches:
            for batch in byte_slices(whole, 1):
                ids = np.asarray(batch.column(0))
                hashes = []
                for raw, live in zip(binary_values(batch.column(1)), batch.column(2).to_pylist()):
                    _, h = words.of(raw)
                    if len(h) < window:
                        hashes.append(h[:0])
                        continue
                    small = words.rolling.windows(h, block) & ~np.uint64(1)
                    key = (_part(small, parts) << np.uint64(32)) | (small & np.uint64(0xFFFFFFFF))
                    hit = np.isin(key, np.frombuffer(live or b"", "<u8"))
                    counts = np.r_[0, np.cumsum(hit)]
                    inside = window - block + 1
                    near = counts[inside : len(h) - window + 1 + inside] > counts[: len(h) - window + 1]
                    hashes.append(np.unique(words.rolling.windows(h, window)[near]))
                doc = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
                yield _packed(doc, np.concatenate(hashes), ids, parts, salts, "<u8")

    return met.mapInArrow(pack, _CELLS)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = WINDOW_WORDS,
    cell_entries: int = CELL_ENTRIES,
    salt_documents: int = SALT_DOCUMENTS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): texts without the words of windows that a smaller document holds too.

    `window` is even and at least 4. Kept words are joined by one space. The number of cells follows the amount of
    text and the number of salts the number of documents, so a cell's entries stay near `cell_entries`.
    """
    if window < 4 or window % 2:
        raise ValueError("the window must be an even number of words, at least 4")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = narrow.where("doc_id is not null")
    size, count = known.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    salts = max(1, -(-count // salt_documents))
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    parts = max(1, min(1 << 30, -(-(size or 0) // (4 * cell_entries * salts))))

    # every table is removed once what is made of it is written
    spark = docs.sparkSession
    probes, probes_at = written(_probes(known, window, parts, salts), "probes")
    index, index_at = written(_smallest(probes, salts, "<u4", lambda p: (p & np.array(1, "<u4")).astype(bool)), "anchors")

    def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [(np.frombuffer(x, "<u4") & ~np.array(1, "<u4")).tobytes() for x in binary_values(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.binary()), b.column(2)], names=b.schema.names)

    index = index.mapInArrow(unmarked, index.schema)
    hits = _hits(probes, index, salts, "<u4", buckets, with_owner=True).withColumnRenamed("keys", "live")
    live, live_at = written(hits, "hits")
    remove(spark, probes_at, index_at)
    met = known.join(live.hint("merge"), "doc_id").select("doc_id", "text", "live")
    windows, windows_at = written(_windows(met, window, parts, salts), "windows")
    remove(spark, live_at)
    owners, owners_at = written(_smallest(windows, salts, "<u8", lambda p: np.ones(len(p), bool)), "owners")
    repeated = _hits(windows, owners, salts, "<u8", buckets, with_owner=False).withColumnRenamed("keys", "gone")
    repeated = materialise(repeated, "repeats")
    remove(spark, windows_at, owners_at)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for whole in batches:
            for batch in byte_slices(whole, 1):
                total, removed, left = [], [], []
                for raw, gone in zip(binary_values(batch.column(1)), batch.column(2).to_pylist()):
                    own, h = words.of(raw)
                    keep = np.ones(len(own), bool)
                    if gone and len(own) >= window:
                        first = np.isin(words.rolling.windows(h, window), np.frombuffer(gone, "<u8"))
                        edges = np.zeros(len(own) + 1, np.int64)
                        at = np.flatnonzero(first)
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + window, -1)
                        keep = np.cumsum(edges)[:-1] == 0
                    total.append(len(own))
                    removed.append(int((~keep).sum()))
                    left.append(b" ".join(w for w, k in zip(own, keep.tolist()) if k) if removed[-1] else b" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(total, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    whole = narrow.join(repeated.hint("merge"), "doc_id", "left").select("doc_id", "text", "gone")
    return whole.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
