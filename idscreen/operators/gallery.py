"""A stored index over a gallery of embeddings: cells of nearby vectors, short codes, exact re-ranking.

The model is fitted once on a bounded sample: about twice the square root of the gallery's size in cells, by two levels of k-means
(Lloyd 1982), and codebooks for the parts of what is left after the cell's centre (product quantisation, Jegou et al. 2011). Every vector is
then stored in its cell with its code. New vectors are added with the same model, as a batch of their own; nothing is rebuilt.

A search looks into the few cells nearest to a probe, ranks their rows by codes and compares only the best of them exactly.
Vectors are compared by cosine, so they are brought to length 1 first; null and zero vectors are left out.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idscreen.functions.blocks import BLOCK_ROWS, meetings_of_two
from idscreen.operators.vectors import _unit, _usable

# Fixed bounds of what is fitted on: rows for the upper level and the codebooks, and rows for each fine cell.
SAMPLE_ROWS = 50_000
ROWS_PER_CELL = 64
MAX_CELLS = 1 << 16
ROUNDS = 12
PARTS = 8
CODEWORDS = 64


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centres. Each starts from a row far from those chosen; a centre that loses all rows is left out."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(x, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        moved = sums[counts > 0] / counts[counts > 0, None]
        if len(moved) == len(centres) and np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


class Model:
    """Centres of the cells and codebooks of the parts, small enough to go to every task."""

    def __init__(self, centres: np.ndarray, codebooks: np.ndarray) -> None:
        self.centres, self.codebooks = centres, codebooks
        self.parts, self.words, self.width = codebooks.shape

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, codebooks=self.codebooks)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as held:
            return Model(held["centres"], held["codebooks"])

    def _split(self, left: np.ndarray) -> np.ndarray:
        """What is left after the centre, cut into parts; the last one is filled up with zeros."""
        room = self.parts * self.width - left.shape[1]
        return np.pad(left, ((0, 0), (0, room))).reshape(len(left), self.parts, self.width)

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each vector."""
        cell = _nearest(unit, self.centres)
        split = self._split(unit - self.centres[cell])
        code = np.stack([_nearest(split[:, p], self.codebooks[p]) for p in range(self.parts)], axis=1)
        return cell, code.astype(np.uint8)

    def cells_near(self, unit: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres * self.centres).sum(axis=1)[None, :] - 2 * unit @ self.centres.T
        n = min(n, len(self.centres))
        return np.argpartition(far, n - 1, axis=1)[:, :n]

    def likeness(self, unit: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Estimated products of probes with the coded vectors of one cell, from one table per probe."""
        parts = self._split(unit)
        tables = np.einsum("npw,pkw->npk", parts, self.codebooks)
        total = np.repeat((unit @ self.centres[cell])[:, None], len(codes), axis=1)
        for p in range(self.parts):
            total += tables[:, p][:, codes[:, p]]
        return total


def fit(gallery: DataFrame, id_col: str, vec: str, cells: int | None = None, parts: int = PARTS, words: int = CODEWORDS, seed: int = 7) -> Model:
    """Centres and codebooks from a sample by hash of the id: at most SAMPLE_ROWS rows and ROWS_PER_CELL for each cell.

    The upper level and the codebooks are fitted on the driver from the bounded sample, the fine centres in tasks, one for each
    upper cell.
    """
    usable = _usable(gallery, id_col, vec)
    n = usable.count()
    if not n:
        raise ValueError("the gallery has no usable vector")
    cells = min(MAX_CELLS, n, cells or max(1, round(2 * n**0.5)))
    hashed = usable.withColumn("_h", F.xxhash64(F.lit(seed), "_id"))

    def sample(rows: int) -> DataFrame:
        share = min(1.0, rows / n)
        return hashed.where(F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))

    first = sample(SAMPLE_ROWS).orderBy("_h", "_id").limit(SAMPLE_ROWS).select("_vec").toPandas()
    unit = _unit(first["_vec"])
    upper = _kmeans(unit, max(1, round(cells**0.5)), seed)
    per_upper = -(-cells // len(upper))

    @F.pandas_udf("int")
    def upper_cell(vectors: pd.Series) -> pd.Series:
        return pd.Series(_nearest(_unit(vectors), upper))

    def fine(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("_h")["_vec"].head(4 * ROWS_PER_CELL * per_upper)
        return pd.DataFrame({"centre": list(_kmeans(_unit(rows), per_upper, seed))})

    dealt = sample(ROWS_PER_CELL * cells).select("_h", "_vec").withColumn("_upper", upper_cell("_vec"))
    found = dealt.groupBy("_upper").applyInPandas(fine, "centre array<double>").toPandas()
    centres = np.unique(np.stack(found["centre"].to_numpy()), axis=0)
    width = -(-unit.shape[1] // parts)
    model = Model(centres, np.zeros((parts, 1, width)))
    left = model._split(unit - centres[_nearest(unit, centres)])
    books = [_kmeans(left[:, p], min(words, 256), seed) for p in range(parts)]
    size = max(len(b) for b in books)
    return Model(centres, np.stack([np.concatenate([b, np.repeat(b[:1], size - len(b), axis=0)]) for b in books]))


def create_index(gallery: DataFrame, path: str, id_col: str, vec: str, batch_id: str = "0", **fitted: int) -> None:
    """Fit a model on the gallery, store it below `path`, and enter the gallery as the first batch."""
    spark = gallery.sparkSession
    model = fit(gallery, id_col, vec, **fitted)
    spark.createDataFrame([(bytearray(model.dump()),)], "model binary").coalesce(1).write.mode("errorifexists").parquet(f"{path}/model")
    add_to_index(gallery, path, id_col, vec, batch_id)


def read_model(spark: SparkSession, path: str) -> Model:
    return Model.load(bytes(spark.read.schema("model binary").parquet(f"{path}/model").first()["model"]))


def add_to_index(batch: DataFrame, path: str, id_col: str, vec: str, batch_id: str) -> None:
    """Enter more vectors with the stored model. A batch written again replaces itself and nothing else."""
    usable = _usable(batch, id_col, vec)
    model = batch.sparkSession.sparkContext.broadcast(read_model(batch.sparkSession, path).dump())
    kind = usable.schema["_id"].dataType.simpleString()

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model.load(model.value)
        for frame in frames:
            if len(frame):
                unit = _unit(frame["_vec"])
                cell, code = own.place(unit)
                codes = [c.tobytes() for c in code]
                yield pd.DataFrame({"id": frame["_id"], "cell": cell.astype(np.int32), "code": codes, "vec": frame["_vec"]})

    placed = usable.mapInPandas(place, f"id {kind}, cell int, code binary, vec array<double>")
    placed = placed.withColumn("vec", F.col("vec").cast(batch.schema[vec].dataType))
    # in order of cell, so that a search of few cells skips the other row groups; a large cell may span several files
    ordered = placed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell")
    ordered.write.mode("overwrite").parquet(f"{path}/rows/batch_id={quote(batch_id, safe='')}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, cell, code, vec, batch_id); vectors are as they were given."""
    return spark.read.parquet(f"{path}/rows")


def search_index(
    probes: DataFrame,
    path: str,
    id_col: str,
    vec: str,
    k: int,
    cells: int = 8,
    rerank: int = 32,
    min_cos: float = -1.0,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k most similar gallery rows that the nearest `cells` cells hold: (probe_id, gallery_id, cosine, place).

    Probes and rows of a cell meet in blocks of bounded size. In a block the `rerank` * k rows of the best codes are
    compared exactly; cosines are rounded to six places, equal ones ordered by gallery id. Rows with the same id in several batches
    count once, by their best cosine.
    """
    spark = probes.sparkSession
    usable = _usable(probes, id_col, vec)
    kind = usable.schema["_id"].dataType.simpleString()
    raw = read_model(spark, path).dump()
    model = spark.sparkContext.broadcast(raw)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model.load(model.value)
        for frame in frames:
            if len(frame):
                unit = _unit(frame["_vec"])
                near = own.cells_near(unit, cells)
                at = np.repeat(np.arange(len(unit)), near.shape[1])
                yield pd.DataFrame(
                    {
                        "id": frame["_id"].to_numpy()[at],
                        "cell": near.reshape(-1).astype(np.int32),
                        "code": None,
                        "vec": frame["_vec"].to_numpy()[at],
                    }
                )

    visits = usable.mapInPandas(visit, f"id {kind}, cell int, code binary, vec array<double>")
    rows = read_index(spark, path).select("id", "cell", "code", F.col("vec").cast("array<double>").alias("vec"))
    left, right = meetings_of_two(visits, rows, ["cell"], "id", "id", block_rows)
    met = left.withColumn("_probe", F.lit(True)).unionByName(right.withColumn("_probe", F.lit(False)))

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = Model.load(model.value)
        p, g = frame[frame["_probe"]], frame[~frame["_probe"]]
        if not len(p) or not len(g):
            return pd.DataFrame({"probe_id": [], "gallery_id": [], "cosine": []})
        codes = np.frombuffer(b"".join(g["code"]), np.uint8).reshape(len(g), own.parts)
        unit, held = _unit(p["vec"]), _unit(g["vec"])
        pid, gid = p["id"].to_numpy(), g["id"].to_numpy()
        # near copies have the same code, so a few more rows than asked for are compared exactly
        best = min(len(g), max(rerank * k, 1))
        found = []
        for begin in range(0, len(p), 256):
            part = unit[begin : begin + 256]
            like = own.likeness(part, int(key[0]), codes)
            top = np.argpartition(-like, best - 1, axis=1)[:, :best]
            cosine = np.round(np.einsum("nd,nrd->nr", part, held[top]), 6)
            row, place = np.nonzero(cosine >= min_cos)
            found.append(pd.DataFrame({"probe_id": pid[begin + row], "gallery_id": gid[top[row, place]], "cosine": cosine[row, place]}))
        out = pd.concat(found)
        out = out[out["probe_id"] != out["gallery_id"]] if exclude_self else out
        out = out.sort_values(["probe_id", "cosine", "gallery_id"], ascending=[True, False, True])
        return out.drop_duplicates(["probe_id", "gallery_id"]).groupby("probe_id").head(k)

    pairs = met.groupBy("cell", "_i", "_j").applyInPandas(compare, f"probe_id {kind}, gallery_id {kind}, cosine double")
    once = pairs.groupBy("probe_id", "gallery_id").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("probe_id").orderBy(F.desc("cosine"), "gallery_id")
    ranked = once.withColumn("place", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("place") <= k).select("probe_id", "gallery_id", "cosine", "place")
