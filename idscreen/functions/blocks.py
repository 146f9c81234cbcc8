"""Comparing rows that share a bucket, in tasks of bounded size.

A bucket of n rows is cut into ceil(n / block_rows) blocks. Every block meets itself and every other block once,
each meeting in a group of its own, so a bucket with a third of all rows becomes many small groups instead of one
large one. No row and no meeting is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idscreen.sources.scratch import written

BLOCK_ROWS = 2_000
# Bytes that one side of a cell of pairs may bring.
CELL_BYTES = 8 << 20


def _with_blocks(df: DataFrame, bucket: Sequence[str], id_col: str, sizes: DataFrame, size: str, rows: int):
    return df.join(sizes, list(bucket)).withColumns(_blocks_of(id_col, size, rows))


def _blocks_of(id_col: str, size: str, rows: int) -> dict[str, Column]:
    blocks = F.ceil(F.col(size) / F.lit(rows)).cast("int")
    return {"_blocks": blocks, "_block": F.pmod(F.xxhash64(id_col), blocks).cast("int")}


def meetings(
    df: DataFrame, bucket: Sequence[str], id_col: str, block_rows: int = BLOCK_ROWS, size: str | None = None
) -> DataFrame:
    """Rows repeated once per meeting of their block: adds `_i`, `_j` (i <= j) and `_side` (L in i, R in j).

    Rows alone in their bucket are gone. For i = j each row comes once per side. `size` is a column with the number of rows of the
    bucket, if that is known.
    """
    if size:
        placed = df.where(F.col(size) > 1).withColumns(_blocks_of(id_col, size, block_rows))
    else:
        sizes = df.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
        placed = _with_blocks(df, bucket, id_col, sizes, "_rows", block_rows)
    as_left = F.transform(
        F.sequence(F.col("_block"), F.col("_blocks") - 1),
        lambda j: F.struct(F.col("_block").alias("_i"), j.alias("_j"), F.lit("L").alias("_side")),
    )
    as_right = F.transform(
        F.sequence(F.lit(0), F.col("_block")),
        lambda i: F.struct(i.alias("_i"), F.col("_block").alias("_j"), F.lit("R").alias("_side")),
    )
    return placed.select(*df.columns, F.inline(F.concat(as_left, as_right)))


def meetings_of_two(
    left: DataFrame, right: DataFrame, bucket: Sequence[str], left_id: str, right_id: str,
    block_rows: int = BLOCK_ROWS, right_rows: int | None = None, few_buckets: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The same for two sides: every left block of a bucket meets every right block. Adds `_i`, `_j` to both.

    `right_rows` is the size of right blocks if it differs. `few_buckets` says that the sizes of all buckets are a small table
    whatever the input, which is then sent to all tasks.
    """
    count = F.count(F.lit(1))
    lefts = left.groupBy(*bucket).agg(count.alias("_left_rows"))
    rights = right.groupBy(*bucket).agg(count.alias("_right_rows"))
    sizes = lefts.join(rights, list(bucket))
    if few_buckets:
        sizes = F.broadcast(sizes)
    rows = {"_left_rows": block_rows, "_right_rows": right_rows or block_rows}
    other = {"_left_rows": "_right_rows", "_right_rows": "_left_rows"}

    def placed(df: DataFrame, id_col: str, size: str, own: str, opposite: str) -> DataFrame:
        mine = _with_blocks(df, bucket, id_col, sizes, size, rows[size])
        theirs = F.ceil(F.col(other[size]) / F.lit(rows[other[size]])).cast("int")
        return mine.select(
            *df.columns, F.col("_block").alias(own), F.explode(F.sequence(F.lit(0), theirs - 1)).alias(opposite)
        )

    return placed(left, left_id, "_left_rows", "_i", "_j"), placed(right, right_id, "_right_rows", "_j", "_i")


def _cells(pairs: DataFrame, rows: DataFrame, cell_bytes: int) -> DataFrame:
    """(id_a, id_b, _cell): pairs dealt to cells, so that an id is in few cells and a cell holds few bytes of rows.

    An id lives with the smallest id it is paired with or its own, so the members of a dense group live together. Who lives
    together is cut into blocks by size, and a cell is where two blocks meet.
    """
    both = F.array(
        F.struct(F.col("id_a").alias("_id"), F.col("id_b").alias("_other")),
        F.struct(F.col("id_b").alias("_id"), F.col("id_a").alias("_other")),
    )
    homes = pairs.select(F.inline(both)).groupBy("_id").agg(F.min("_other").alias("_other"))
    homes = homes.select("_id", F.least("_id", "_other").alias("_home"))
    homes = homes.join(rows.groupBy("_id").agg(F.sum("_bytes").alias("_bytes")), "_id")
    sizes = homes.groupBy("_home").agg(F.sum("_bytes").alias("_all"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_all") / F.lit(cell_bytes))).cast("bigint")
    spot = F.xxhash64("_home", F.pmod(F.xxhash64("_id"), blocks))
    spots, _ = written(homes.join(sizes, "_home").select("_id", spot.alias("_spot")), "pair-spots")
    a, b = (spots.select(F.col("_id").alias(f"id_{x}"), F.col("_spot").alias(f"_{x}")) for x in "ab")
    cell = F.xxhash64(F.least("_a", "_b"), F.greatest("_a", "_b"))
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", cell.alias("_cell"))


def compare_pairs(
    pairs: DataFrame,
    rows: DataFrame,
    start: Callable[[pa.Table], Callable[[pa.Array, pa.Array], Iterator[pa.RecordBatch]]],
    schema: str,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """What `start(rows)(ids_a, ids_b)` yields for the pairs (id_a, id_b) and the rows (_id, _bytes, others) with their ids.

    Rows are not carried to each of their pairs: they come once to every cell in which they have pairs (`_cells`), and `start`
    gets the rows of a cell. An id without rows has no results.
    """
    pairs, rows = pairs.select("id_a", "id_b"), rows.where("_id is not null")
    cells, _ = written(_cells(pairs, rows, cell_bytes), "pair-cells")
    named = F.array(*[F.struct("_cell", F.col(x).alias("_id")) for x in ("id_a", "id_b")])
    visits = cells.select(F.inline(named)).distinct()
    given = [c for c in rows.columns if c not in ("_id", "_bytes")]
    loads = visits.join(rows, "_id").select(
        "_cell", F.lit(0).alias("_kind"), F.col("_id").alias("id_a"), F.col("_id").alias("id_b"), *given
    )
    links = cells.select(
        "_cell", F.lit(1).alias("_kind"), "id_a", "id_b", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in given]
    )

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under_way, held, compare = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = ((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])).nonzero()[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if cell[a] != under_way:
                    under_way, held, compare = cell[a], [], None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(part.select(["id_a", *given]))
                    continue
                if compare is None:
                    compare = start(pa.Table.from_batches(held).combine_chunks())
                    held = []
                yield from compare(part.column(2), part.column(3))

    dealt = loads.unionByName(links).repartition("_cell").sortWithinPartitions("_cell", "_kind", "id_a")
    return dealt.mapInArrow(results, schema)


def lists(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per value of the keys with the columns as arrays, in the given order."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{c} array<{kinds[c]}>" for c in columns])
    keys, columns = list(keys), list(columns)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in (*batches, None):
            parts = [rest] if rest is not None else []
            if batch is not None and batch.num_rows:
                parts.append(pa.Table.from_batches([batch]))
            if not parts or (batch is not None and not batch.num_rows):
                continue
            here = pa.concat_tables(parts).combine_chunks()
            changed = None
            for k in keys:
                values = here.column(k)
                differs = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1))
                changed = differs if changed is None else pc.or_(changed, differs)
            cuts = [0, *(changed.to_numpy().nonzero()[0] + 1).tolist()]
            if batch is None:
                cuts.append(here.num_rows)
                rest = None
            else:
                rest = here.slice(cuts[-1])
            if len(cuts) < 2:
                continue
            firsts = here.take(pa.array(cuts[:-1]))
            values = [firsts.column(k).combine_chunks() for k in keys]
            offsets = pa.array(cuts, pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, one_array(here.column(c).slice(0, cuts[-1]))) for c in columns]
            yield pa.RecordBatch.from_arrays([*map(one_array, values), *arrays], names=[*keys, *columns])

    ordered = rows.select(*keys, *dict.fromkeys([*columns, *order]))
    return ordered.repartition(keys[0]).sortWithinPartitions(*keys, *order).mapInArrow(listed, schema)


def one_array(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
