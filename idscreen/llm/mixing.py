"""Mixing sources to target weights, from built-in functions only.

The words of each source are packed into blocks of fixed length. Slots of the mix are dealt to output shards; in every
shard the sources' counts are a multinomial draw with the target shares. A source numbers its slots through all
shards; numbers beyond its quota of blocks are handed to the sources whose draws fell short. Each number is mapped
through a pseudorandom permutation of the source's block indexes, a new one for every pass over the source, so a block
comes again only after all others. Blocks then meet the documents by index.

All draws are md5 and integer arithmetic on a seed, the source's rank and an index, so reruns agree on any cluster.

Cases: a null text has size 0 and is never taken; a null source is a source, the last one; a null id comes first in its
source; rows equal in id and size are interchangeable; an empty table, or one without words, has nothing taken; other
columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idscreen.llm.shared import BLANK, materialise, parallelism

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 65_536
GROUP_ROWS = 20_000
SEED = "mix"
CELLS = 4_096
# Primes that multiply indexes. A number of blocks divisible by all three would exceed 10 ** 18.
PRIMES = (1_000_003, 1_000_033, 1_000_037)


def draw(*parts: Column) -> Column:
    """52 pseudorandom bits that depend on all parts."""
    text = F.concat_ws(":", F.lit(SEED), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """Adds `rank` and `target` to (source, source_size): shares by weight, each at most `max_repeats` sizes.

    What a source cannot take is dealt to the others by weight, again and again. In the end every source is either at
    its limit or at one common rate times its weight. Sources by rising limit per weight reach their limits first, so
    the rate is the first one, from running sums, at which a source stays below its limit. One row per source.
    """
    place = (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("bigint"))
    limited = ranked.withColumns(
        {
            "_w": F.element_at(F.array(*[F.lit(w) for w in weights]), place).cast("bigint"),
            "_limit": F.col("source_size") * max_repeats,
        }
    )
    order = Window.orderBy(F.col("_limit") / F.col("_w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("_limit").over(before), F.lit(0))
    left = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    rated = limited.withColumns(
        {"_rate": (F.sum("source_size").over(whole) * F.lit(share) - full) / left, "_place": F.row_number().over(order)}
    )
    below = F.when(F.col("_rate") * F.col("_w") <= F.col("_limit"), F.col("_place"))
    common = F.min_by("_rate", below).over(whole)
    target = F.least(F.col("_limit").cast("double"), F.coalesce(common, F.lit(0.0)) * F.col("_w"))
    return rated.select("source", "rank", "source_size", target.alias("target"))


def _offsets(rows: DataFrame, group_rows: int) -> DataFrame:
    """Adds `start`, the words of the source's documents before this one; order is by a hash, then by id.

    Sources are cut into groups of about `group_rows` documents by that hash; running sums go over groups first, then
    inside one group, so a source with a third of all rows is many small windows.
    """
    total = rows.count()
    groups = max(1, -(-total // group_rows))
    placed = rows.withColumn("_group", F.pmod(draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), F.lit(groups)))
    sums = placed.groupBy("rank", "_group").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("rank").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("rank", "_group", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_first"))
    inside = (
        Window.partitionBy("rank", "_group")
        .orderBy(F.col("doc_id").asc_nulls_first(), "size", "content")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return placed.withColumn("_within", within).join(firsts, ["rank", "_group"]).withColumn(
        "start", F.col("_first") + F.col("_within")
    ).drop("_group", "_within", "_first")


def permuted(index: Column, n: Column, rank: Column, epoch: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, another one for every source and epoch, by arithmetic alone.

    Rounds of a multiplication modulo n by a prime that does not divide n, a draw added modulo n, and, for indexes
    below the largest power of two in n, an exclusive or with a draw and with the index's own upper bits.
    """
    bits = F.length(F.bin(n)) - 1
    power = F.expr("1L") * F.pow(F.lit(2.0), bits).cast("bigint")
    factor = F.coalesce(*[F.when(n % p != 0, F.lit(p)) for p in PRIMES]).cast("bigint")
    x = index
    for r in range(3):
        x = (x * factor + draw(rank, epoch, F.lit(2 * r)) % n) % n
        flipped = x.bitwiseXOR(draw(rank, epoch, F.lit(2 * r + 1)) % power)
        x = F.when(x < power, flipped.bitwiseXOR(F.shiftright(flipped, 3))).otherwise(x)
    return x


def slots(sources: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    """(rank, number, shard): every slot of the mix with its source and the source's running number.

    Expects `rank`, `quota` (blocks to take) and `blocks` (blocks there are). Each slot's draw picks a source by its
    interval of the quotas, found through equal cells of the range; the counts per shard and source are what is kept
    of the draws.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).first()[0] or 0
    upto = Window.orderBy("rank")
    bounds = sources.where("quota > 0").select("rank", "quota", F.sum("quota").over(upto).alias("_hi"))
    bounds = bounds.withColumn("_lo", F.col("_hi") - F.col("quota"))
    width = max(1, -(-total // CELLS))
    cells = bounds.withColumn(
        "_cell", F.explode(F.sequence(F.expr(f"_lo div {width}"), F.expr(f"(_hi - 1) div {width}")))
    )
    drawn = spark.range(total).select(
        F.expr(f"id div {shard_slots}").alias("shard"), (draw(F.lit("slot"), F.col("id")) % F.lit(max(total, 1))).alias("_u")
    )
    picked = drawn.withColumn("_cell", F.expr(f"_u div {width}")).join(cells, "_cell").where("_lo <= _u and _u < _hi")
    counts = materialise(picked.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("_n")), "mix-counts")
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    # running counts of a source are one small window; dealt anew by shard, each is at most one shard of numbers
    dealt = counts.withColumn("_first", first).repartition(parallelism(spark), "shard", "rank")
    numbered = dealt.select(
        "shard", "rank", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("number")
    )
    # surplus numbers, and the numbers that are missing elsewhere, are matched one to one by running order
    drawn_of = counts.groupBy("rank").agg(F.sum("_n").alias("_drawn"))
    balance = sources.join(drawn_of, "rank", "left").select(
        "rank", "quota", F.coalesce("_drawn", F.lit(0)).alias("_drawn")
    )
    over = F.greatest(F.col("_drawn") - F.col("quota"), F.lit(0))
    under = F.greatest(F.col("quota") - F.col("_drawn"), F.lit(0))
    so_far = Window.orderBy("rank")
    balance = materialise(
        balance.withColumns(
            {"_over_at": F.sum(over).over(so_far) - over, "_under_at": F.sum(under).over(so_far) - under}
        ),
        "mix-balance",
    )
    surplus = (
        numbered.join(balance.where("_drawn > quota"), "rank")
        .where("number >= quota")
        .select("shard", (F.col("_over_at") + F.col("number") - F.col("quota")).alias("_order"))
    )
    missing = balance.where("_drawn < quota").select(
        "rank", "_drawn", "_under_at", F.explode(F.sequence(F.col("_drawn"), F.col("quota") - 1)).alias("number")
    )
    missing = missing.select("rank", "number", (F.col("_under_at") + F.col("number") - F.col("_drawn")).alias("_order"))
    kept = numbered.join(balance.select("rank", "quota"), "rank").where("number < quota").select("rank", "number", "shard")
    return kept.unionByName(missing.join(surplus, "_order").select("rank", "number", "shard"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    group_rows: int = GROUP_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as three tables: documents (doc_id, content, source, size, rank, source_size, target, start), pieces
    (rank, block, doc_id, content, from_word, n_words) and draws (rank, block, epoch, shard).

    A draw is one block in one output shard; its text is the pieces of that block in the order of their words. Quotas
    are whole blocks, so a source's words come within a block of its target, or two where its last block is short.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content"),
        F.col(source).alias("source"),
        F.size(words_of(F.col(text))).cast("bigint").alias("size"),
    )
    rows = materialise(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    n_blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    sources = targets(sizes, weights, share, max_repeats).withColumns(
        {
            "blocks": n_blocks,
            "quota": F.least(n_blocks * max_repeats, F.round(F.col("target") / block_words).cast("bigint")),
        }
    )
    sources = materialise(sources, "mix-sources")
    named = sources.withColumnRenamed("source", "_s").select("_s", "rank", "source_size", "target")
    documents = rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    documents = materialise(_offsets(documents, group_rows), "mix-documents")
    last = F.col("start") + F.col("size") - 1
    pieces = documents.where("size > 0").select(
        "rank", "doc_id", "content", "start", "size",
        F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block"),
    )
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(last + 1, (F.col("block") + 1) * block_words)
    pieces = pieces.select("rank", "block", "doc_id", "content", "start", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("n_words"))
    epoch = F.expr("number div blocks")
    draws = slots(sources, block_words, shard_slots).join(sources.select("rank", "blocks"), "rank").select(
        "rank",
        permuted(F.col("number") % F.col("blocks"), F.col("blocks"), F.col("rank"), epoch).alias("block"),
        epoch.alias("epoch"),
        "shard",
    )
    return documents, pieces, materialise(draws, "mix-draws")


def taken(documents: DataFrame, pieces: DataFrame, draws: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document, repeats counted."""
    times = draws.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("_times"))
    words = (
        pieces.join(times, ["rank", "block"])
        .groupBy("rank", "start", "doc_id", "content")
        .agg(F.sum(F.col("n_words") * F.col("_times")).alias("taken"))
    )
    d, w = documents.alias("d"), words.alias("w")
    same = (F.col("d.rank") == F.col("w.rank")) & (F.col("d.start") == F.col("w.start")) & (F.col("d.size") > 0)
    return d.join(w, same, "left").select(
        "d.doc_id", "d.size", "d.source_size", "d.target", F.coalesce("w.taken", F.lit(0)).cast("bigint").alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents with all their columns: one row per document and pass that takes words of it.

    A row's text is what that pass takes: the whole text where it takes every word, else the taken words in their
    order, joined by one space. Documents of which nothing is taken are gone.
    """
    documents, pieces, draws = mix(docs, id_col, text, source)
    passes = (
        pieces.join(draws, ["rank", "block"])
        .groupBy("rank", "start", "doc_id", "content", "epoch")
        .agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("_ranges"), F.sum("n_words").alias("_taken"))
    )
    sized = documents.where("size > 0").select("rank", "start", "size")
    passes = passes.join(sized, ["rank", "start"]).select(
        F.col("doc_id").alias("_i"), F.col("content").alias("_c"), "start", "rank", "epoch", "_ranges", "_taken", "size"
    )
    # rows equal in id and text are numbered on both sides, so that each gets passes of its own; a hash orders them, since
    # the order's key is shuffled with the row
    copies = Window.partitionBy("_i", "_c").orderBy("rank", "start")
    passes = passes.withColumn("_copy", F.dense_rank().over(copies))
    content = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    whole = docs.select(content.alias("_content"), F.col(id_col).alias("_id"), F.struct(*docs.columns).alias("_row"))
    whole = whole.withColumn("_number", F.row_number().over(Window.partitionBy("_id", "_content").orderBy(F.xxhash64(F.to_json("_row")))))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_content") == F.col("_c")) & (F.col("_number") == F.col("_copy"))
    met = whole.join(passes, same)
    words = words_of(F.col("_row").getField(text))
    some = F.array_join(
        F.flatten(F.transform("_ranges", lambda r: F.slice(words, (r["from_word"] + 1).cast("int"), r["n_words"].cast("int")))), " "
    )
    new = F.when(F.col("_taken") == F.col("size"), F.col("_row").getField(text)).otherwise(some)
    return met.select(*[(new if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])
