"""Near-duplicates by weighted Jaccard: BagMinHash signatures, bands, and exact multiset overlap.

A document is a multiset of word shingles, a shingle's count being its weight. BagMinHash (Ertl 2018) runs a Poisson
process over every shingle's weight: level 0 covers the weights from 0 to 1, level k those from 2 ** (k - 1) to 2 ** k,
each with as many points per unit of time as it is wide. A point carries its time, a signature component, and its
place in the level, whose bits are the way down a binary tree of half levels; it counts if the place lies below the
shingle's weight. The earliest point of each component is kept, so two components agree with a probability of
exactly the weighted Jaccard similarity.

Documents with the same multiset are one bag and go on as one. Bags that share a band of their signatures are linked
to one representative of that bucket and verified. Bags that buckets bring together and that are still in different
components are then compared in blocks, by signatures first, and verified there; only links that join components leave
a block. So no bucket is expanded into all its pairs, and no component is split.

Cases: null and blank texts are empty multisets and form one class; a text shorter than a shingle is one shingle; ids
may be null or repeated; an empty table gives an empty result; other columns pass through or are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idscreen.functions.blocks import meetings_of_two
from idscreen.llm.components import components
from idscreen.llm.shared import GOLDEN, Rolling, WordHashes, binary_values, keep_one, materialise, mixed

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
COMPONENTS = 128
BAND_ROWS = 4
BLOCK_BAGS = 500


class Shingles:
    """Multisets of word shingles as (64-bit hash, count), by ascending hash. A text shorter than a shingle is one shingle."""

    def __init__(self, words: int) -> None:
        self._size = words
        self._hashes, self._rolling = WordHashes(), Rolling()

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = self._hashes.of(text.split())
        if not len(h):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.unique(self._rolling.windows(h, min(self._size, len(h))), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """[sets, m] signature components of several non-empty multisets together; m is a power of two.

    Every track (shingle and level) is advanced point by point until it is later than all components of its document,
    so results do not depend on which documents are computed together.
    """
    doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    element = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([c for _, c in sets])
    # tracks: level 0 for all, level k for weights above 2 ** (k - 1)
    tracks = [(doc, element, np.ones(len(doc)), np.full(len(doc), np.inf))]
    level, low = 1, 1
    while (above := weight > low).any():
        salted = mixed(element[above] + np.uint64(level * GOLDEN % (1 << 64)))
        tracks.append((doc[above], salted, np.full(int(above.sum()), float(low)), (weight[above] - low) / low))
        level, low = level + 1, low * 2
    doc, state, rate, limit = (np.concatenate(part) for part in zip(*tracks))
    best = np.full(len(sets) * m, np.inf)
    value = np.zeros(len(sets) * m, np.uint64)
    time = np.zeros(len(doc))
    while len(doc):
        state = state + np.uint64(GOLDEN)
        bits = mixed(state)
        # 40 bits for the waiting time, 17 for the place in the level, the lowest for the component
        time = time - np.log(((bits >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / rate
        place = ((bits >> np.uint64(7)) & np.uint64(0x1FFFF)).astype(np.float64) * 2.0**-17
        slot = doc * m + (bits & np.uint64(m - 1)).astype(np.int64)
        counts = (place < limit) & (time < best[slot])
        np.minimum.at(best, slot[counts], time[counts])
        first = counts & (time == best[slot])
        value[slot[first]] = bits[first]
        latest = best.reshape(len(sets), m).max(axis=1)
        on = time < latest[doc]
        doc, state, rate, limit, time = doc[on], state[on], rate[on], limit[on], time[on]
    return value.reshape(len(sets), m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets: summed minima by summed maxima of the counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def sketch(docs: DataFrame, shingle_words: int, m: int) -> DataFrame:
    """(doc_id, content, bag, sig) of (doc_id, text, content): a digest of the multiset and its signature, null if empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle_words)
        for whole in batches:
            start = 0
            sizes = np.asarray(pc.binary_length(whole.column(1)).fill_null(0))
            while start < whole.num_rows:
                # about two megabytes of text at a time, at least one row
                end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start : start + 512]), 2 << 20, "right")))
                batch = whole.slice(start, end - start)
                start = end
                sets = [shingles.of(b) for b in binary_values(batch.column(1))]
                filled = [k for k, (h, _) in enumerate(sets) if len(h)]
                sig: list[bytes | None] = [None] * len(sets)
                if filled:
                    for k, s in zip(filled, signatures([sets[k] for k in filled], m)):
                        sig[k] = (s ^ (s >> np.uint64(32))).astype("<u4").tobytes()
                bags = [xxhash.xxh3_128_digest(h.tobytes() + c.tobytes()) for h, c in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array(bags, pa.binary()),
                        pa.array(sig, pa.binary()),
                    ],
                    names=["doc_id", "content", "bag", "sig"],
                )

    return docs.mapInArrow(rows, f"doc_id {kind}, content bigint, bag binary, sig binary")


def _bands(bags: DataFrame, m: int, band_rows: int) -> DataFrame:
    """(bucket, bag): one row per band of every signature; signature components are four bytes each."""
    width = 4 * band_rows
    band = [F.xxhash64(F.lit(b), F.substring("sig", 1 + b * width, width)) for b in range(m // band_rows)]
    return bags.where("sig is not null").select(F.explode(F.array(*band)).alias("bucket"), "bag")


def verified(pairs: DataFrame, bags: DataFrame, texts: DataFrame, shingle_words: int, min_similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs of bags whose multisets reach `min_similarity`; only their texts are shuffled."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("bag")).distinct()
    chosen = bags.join(named, "bag").select("bag", "rep.doc_id", "rep.content")
    same = F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("c.content") == F.col("t.content"))
    with_text = chosen.alias("c").join(texts.alias("t"), same).select("c.bag", "t.text").dropDuplicates(["bag"])
    with_text = materialise(with_text, "bag-texts")
    left = with_text.select(F.col("bag").alias("a"), F.col("text").alias("text_a"))
    right = with_text.select(F.col("bag").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle_words)
        last, bag = None, None
        for batch in batches:
            scores = []
            for raw_a, raw_b in zip(binary_values(batch.column(2)), binary_values(batch.column(3))):
                if raw_a != last:
                    last, bag = raw_a, shingles.of(raw_a)
                scores.append(similarity(bag, shingles.of(raw_b)))
            kept = pa.array([s >= min_similarity for s in scores])
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["a", "b", "similarity"]
            )
            yield out.filter(kept)

    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(compare, "a binary, b binary, similarity double")


def _straggling(bags: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """(field, bag, root, apart): bags that candidate links bring together but that are not one component yet.

    A field is a component of the candidate links, verified or not, so all bags of one bucket are in one field. `apart`
    marks the bags outside the field's largest component. Fields of two bags are left out: their one pair is tested.
    """
    fields = components(links).select(F.col("node").alias("bag"), F.col("root").alias("field"))
    placed = fields.join(roots.withColumnRenamed("node", "bag"), "bag", "left")
    placed = placed.select("field", "bag", F.coalesce("root", "bag").alias("root"))
    parts = placed.groupBy("field", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("field").agg(
        F.max_by("root", F.struct("n", "root")).alias("_main"), F.count(F.lit(1)).alias("_parts"), F.sum("n").alias("_n")
    )
    mixed_fields = largest.where("_parts > 1 and _n > 2").select("field", "_main")
    return placed.join(mixed_fields, "field").select("field", "bag", "root", (F.col("root") != F.col("_main")).alias("apart"))


def _late_links(members: DataFrame, m: int, band_rows: int, shingle_words: int, min_similarity: float) -> DataFrame:
    """(a, b, similarity): verified links between components of one field, of (field, bag, root, apart, sig, text).

    The bags apart meet all bags of the field, block by block. A pair is compared if its signatures share a band, as any
    candidate must, and agree as often as the similarity asks, less six standard deviations; pairs that links found
    before have joined are not compared again. What leaves a group is at most one link per component in it.
    """
    least = m * (min_similarity - 6 * (min_similarity * (1 - min_similarity) / m) ** 0.5)

    def compare(apart: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        shingles = Shingles(shingle_words)
        bags = [shingles.of(t.encode()) for t in every["text"]]
        sizes = np.array([len(h) for h, _ in bags])
        hashes, counts = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags])
        begins = np.cumsum(sizes) - sizes
        totals = np.add.reduceat(counts, begins)
        sig = np.frombuffer(b"".join(every["sig"]), "<u4").reshape(len(every), m)
        names, roots = every["bag"].tolist(), every["root"].tolist()
        joined: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while x in joined:
                x = joined[x]
            return x

        links = []
        for bag, text, own_root, own_sig in zip(apart["bag"], apart["text"], apart["root"], apart["sig"]):
            same = sig == np.frombuffer(own_sig, "<u4")
            near = (same.sum(axis=1) >= least) & same.reshape(len(every), -1, band_rows).all(axis=2).any(axis=1)
            own, own_counts = shingles.of(text.encode())
            for k in np.flatnonzero(near):
                if root(roots[k]) == root(own_root):
                    continue
                part = slice(begins[k], begins[k] + sizes[k])
                place = np.searchsorted(own, hashes[part])
                place[place == len(own)] = 0
                shared = own[place] == hashes[part]
                both = int(np.minimum(own_counts[place[shared]], counts[part][shared]).sum())
                value = both / (int(own_counts.sum() + totals[k]) - both)
                if value >= min_similarity:
                    links.append((bag, names[k], value))
                    joined[root(own_root)] = root(roots[k])
        return pd.DataFrame(links, columns=["a", "b", "similarity"])

    apart = members.where("apart").select(*[F.col(c).alias(c) for c in members.columns])
    left, right = meetings_of_two(apart, members, ["field"], "bag", "bag", BLOCK_BAGS)
    key = ["field", "_i", "_j"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key))
    return pairs.applyInPandas(compare, "a binary, b binary, similarity double")


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_similarity: float = MIN_SIMILARITY,
    shingle_words: int = SHINGLE_WORDS,
    m: int = COMPONENTS,
    band_rows: int = BAND_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate classes. Returns rows (doc_id, content, bag) of all documents and bags (bag, class_id, class_content,
    class_rows): a class holds all documents that are linked over any chain of pairs that reach `min_similarity`, and
    is named by its first document.

    With 32 bands of 4 rows a pair at similarity 0.8 shares no bucket with a probability of 5 in 10 ** 8.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = narrow.withColumn("content", F.xxhash64("text"))
    rows = materialise(sketch(texts, shingle_words, m), "bags-of-rows")
    bags = materialise(
        rows.groupBy("bag").agg(
            F.min(F.struct("doc_id", "content")).alias("rep"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")
        ),
        "bags",
    )
    bands = _bands(bags, m, band_rows)
    heads = bands.groupBy("bucket").agg(F.min("bag").alias("head"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    heads = materialise(heads.select("bucket", "head"), "buckets")
    links = bands.join(heads, "bucket").where("bag <> head").select(F.col("head").alias("a"), F.col("bag").alias("b"))
    links = materialise(links.distinct(), "candidates")
    near = materialise(verified(links, bags, texts, shingle_words, min_similarity), "near")
    roots = components(near)
    late = _straggling(bags, links, roots).join(bags.select("bag", "rep", "sig"), "bag")
    same = F.col("rep.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("rep.content") == F.col("t.content"))
    late = late.join(texts.alias("t"), same).select("field", "bag", "root", "apart", "sig", "text").dropDuplicates(["bag"])
    late = materialise(late, "apart")
    also = materialise(_late_links(late, m, band_rows, shingle_words, min_similarity), "late-links")
    # what is joined already goes in as stars, so that only the late links take rounds
    stars = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    roots = components(stars.unionByName(also.select("a", "b")))
    placed = bags.join(roots.withColumnRenamed("node", "bag"), "bag", "left").select(
        "bag", F.coalesce("root", "bag").alias("root"), "rep", "n"
    )
    firsts = placed.groupBy("root").agg(F.min("rep").alias("first"), F.sum("n").alias("class_rows"))
    named = placed.join(firsts, "root").select(
        "bag", F.col("first.doc_id").alias("class_id"), F.col("first.content").alias("class_content"), "class_rows"
    )
    return rows.select("doc_id", "content", "bag"), named


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, class_size, kept), one row per document; one document of each class is kept."""
    rows, named = classes(docs, **options)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("content") == F.col("class_content"))
    counted = rows.groupBy("bag", "doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
    every = counted.join(named, "bag").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return every.select(
        "doc_id", "class_id", F.col("class_rows").alias("class_size"), (first & (F.col("_k") == 1)).alias("kept")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The first document of each class, with all its columns."""
    rows, named = classes(docs, id_col, text, **options)
    counted = rows.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
    firsts = named.select(F.col("class_id").alias("_c"), F.col("class_content").alias("key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_c")) & (F.col("content") == F.col("key"))
    stay = counted.join(firsts, same).select("key", "doc_id", "n")
    return keep_one(docs, id_col, F.xxhash64(F.coalesce(F.col(text), F.lit(""))), stay)
