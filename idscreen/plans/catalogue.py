"""Every operator as a query over the given tables: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idscreen.operators import fields, gallery, linkage, merkle, registry, report, reuse, score, sketches, trail, vectors
from idscreen.plans import flagship
from idscreen.sources.scratch import fresh_dir
from idscreen.sources.tables import SCHEMAS, table
from idscreen.sources.trail_store import read_trail, trail_append
from idscreen.streaming import as_of, cases, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Flagship


@query
def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship.screen(spark, sf_dir)


@query
def case_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship.case_decisions(spark, sf_dir).select("case_id", "score", "decision")


# Fields


@query
def unpivot_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    return fields.unpivot_fields(table(spark, sf_dir, "part"), ["p_partkey"], columns)


@query
def normalize_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = fields.unpivot_fields(table(spark, sf_dir, "documents"), ["doc_id"], ["text", "lang", "source"])
    return fields.normalize_fields(long)


@query
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_first"),
        F.date_format("o_orderdate", " yyyy-MM-dd ").alias("iso"),
        F.date_format("o_orderdate", "yyyy-MM-31").alias("impossible"),
        "o_orderpriority",
    )
    long = fields.unpivot_fields(orders, ["o_orderkey"], ["day_first", "iso", "impossible", "o_orderpriority"])
    formats = ["yyyy-MM-dd", "dd/MM/yyyy"]
    return fields.normalize_fields(long, {f: formats for f in ("day_first", "iso", "impossible")})


# Format rules for part types: doc_type, field, pattern, required.
PART_RULES = [
    ("ECONOMY", "p_name", "^[a-z]+ [a-z]+$", True),
    ("ECONOMY", "p_brand", "^Brand#[0-9]$", True),
    ("SMALL", "p_size", "^[1-9]$", True),
    ("SMALL", "p_brand", "^Brand#1[0-9]$", True),
    ("LARGE", "p_size", "^[2-5][0-9]$", True),
    ("PROMO", "p_name", "(red|blue) ", False),
    ("PROMO", "p_note", "x", True),
    ("MEDIUM", "p_note", "x", False),
]


@query
def validate_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("doc_type"), "p_name", "p_brand", "p_size", F.nullif("p_type", "p_type").alias("p_note")
    )
    long = fields.unpivot_fields(part, ["p_partkey", "doc_type"], ["p_name", "p_brand", "p_size", "p_note"])
    rules = spark.createDataFrame(PART_RULES, "doc_type STRING, field STRING, pattern STRING, required BOOLEAN")
    return fields.validate_format(long, rules)


def _card_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    long = table(spark, sf_dir, "documents").select("doc_id", F.explode(runs).alias("number"))
    return long.where(F.length("number") >= 2)


@query
def validate_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.validate_check_digit(_card_numbers(spark, sf_dir), "number", [7, 3, 1], 10)


@query
def validate_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.validate_luhn(_card_numbers(spark, sf_dir), "number")


@query
def validate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_shipdate"
    )
    joined = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return fields.validate_order(joined, "o_orderdate", "l_shipdate")


@query
def field_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.field_conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query
def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.fuzzy_matches(table(spark, sf_dir, "part"), None, ["p_brand"], "p_name", 3)


@query
def fuzzy_registry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.regexp_replace("c_name", "^Customer", "Person").alias("name")
    )
    firms = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.regexp_replace("s_name", "^Supplier", "Person").alias("name")
    )
    return fields.fuzzy_matches(people, firms, ["nation"], "name", 1)


# Registry


def _claimed(row: str, key: str) -> Column:
    """The key as claimed: every tenth row claims one that no register holds."""
    return F.when(F.col(row) % 10 == 0, -F.col(key)).otherwise(F.col(key))


@query
def registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        _claimed("o_orderkey", "o_custkey").alias("c_custkey"),
        (F.col("o_custkey") % 25).cast("int").alias("c_nationkey"),
        F.lit("MACHINERY").alias("c_mktsegment"),
    )
    known = table(spark, sf_dir, "customer")
    checked = registry.registry_check(claims, known, ["c_custkey"], ["c_nationkey", "c_mktsegment"])
    return checked.select("o_orderkey", "c_custkey", "status", F.array_join("differing", ",").alias("differing"))


@query
def not_in_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _claimed("o_orderkey", "o_custkey").alias("c_custkey"))
    return registry.not_in_registry(orders, table(spark, sf_dir, "customer"), ["c_custkey"])


@query
def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    listing = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'")
    return registry.listed(orders, listing, ["c_custkey"])


def _as_of(spark: SparkSession, sf_dir: str, **more: object) -> DataFrame:
    events = table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select(
        F.col("event_id").alias("view_id"),
        "user_id",
        F.col("ts").alias("view_ts"),
        F.col("value").alias("view_value"),
        (F.col("ts") + F.expr("INTERVAL '2' DAY")).alias("ends"),
    )
    return registry.registry_as_of(
        purchases,
        views,
        "user_id",
        "ts",
        record_order="event_id",
        version_ts="view_ts",
        version_order="view_id",
        values=["view_id", "view_value"],
        **more,
    )


@query
def registry_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_of(spark, sf_dir)


@query
def registry_valid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_of(spark, sf_dir, valid_to="ends")


LINK_FIELDS = ["name", "nation", "segment", "balance"]


def _link_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and the same as another source has them: some names, nations, segments and balances differ or are missing."""
    people = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.floor(F.col("c_acctbal") / 100).cast("bigint").alias("balance"),
    )
    key = F.col("c_custkey")
    other = people.select(
        "c_custkey",
        F.when(key % 11 > 0, F.col("name")).alias("name"),
        F.when(key % 5 == 0, (F.col("nation") + 1) % 25).otherwise(F.col("nation")).cast("int").alias("nation"),
        F.when(key % 7 == 0, "OTHER").otherwise(F.col("segment")).alias("segment"),
        F.when(key % 13 == 0, F.col("balance") + 1).otherwise(F.col("balance")).alias("balance"),
    )
    return people, other


@query
def agreement_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = linkage.agreement_patterns(*_link_sides(spark, sf_dir), LINK_FIELDS)
    return counted.select(F.col("pattern").cast("bigint").alias("pattern"), F.col("pairs").cast("bigint").alias("pairs"))


@query
def linked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a weight that needs the name, or nation, segment and balance together."""
    left, right = _link_sides(spark, sf_dir)
    weights = linkage.weights_of(left, right, LINK_FIELDS)
    links = linkage.linked_records(left, right, "c_custkey", "c_custkey", weights, weights.of(0b1110))
    return links.select("left_id", "right_id", F.col("pattern").cast("bigint").alias("pattern"))


# Reuse of content


@query
def exact_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.exact_reuse(table(spark, sf_dir, "documents"), "text", "source", "doc_id")


@query
def near_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.near_reuse(table(spark, sf_dir, "documents"), "doc_id", "text", 0.5)


@query
def near_reuse_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.near_reuse(table(spark, sf_dir, "documents"), "doc_id", "text", 0.5, method="minhash")


@query
def altered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return reuse.altered_lines(reuse.near_reuse(documents, "doc_id", "text", 0.5), documents, "doc_id", "text")


@query
def template_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return reuse.template_outliers(documents, ["source"], "n_chars", 3.0)


# Embeddings


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query
def match_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _faces(spark, sf_dir).select(F.col("vec_id").alias("case_id"), "embedding")
    photos = _faces(spark, sf_dir).select((F.col("vec_id") - 1).alias("case_id"), "embedding")
    return vectors.match_one_to_one(captures, photos, "case_id", "embedding", 0.1)


@query
def match_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    return vectors.match_one_to_many(faces, faces, "vec_id", "embedding", 5)


@query
def match_one_to_many_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    return vectors.match_one_to_many(faces, faces, "vec_id", "embedding", 5, method="lsh", bits=4)


@query
def match_one_to_many_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every face, altered, is looked up in an index of two batches."""
    faces, path = _faces(spark, sf_dir), fresh_dir(spark, "gallery")
    gallery.create_index(faces.where("vec_id % 5 > 0"), path, "vec_id", "embedding")
    gallery.add_to_index(faces.where("vec_id % 5 = 0"), path, "vec_id", "embedding", "later")
    altered = F.transform("embedding", lambda x, i: x.cast("double") + F.get("embedding", (i + 1) % F.size("embedding")) / 4)
    return gallery.search_index(faces.select("vec_id", altered.alias("embedding")), path, "vec_id", "embedding", 1)


@query
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_faces(spark, sf_dir), "vec_id", "embedding", 0.3, every_copy=True)


@query
def near_vectors_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_faces(spark, sf_dir), "vec_id", "embedding", 0.3, method="lsh", tables=32, bits=4)


@query
def shared_face_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vectors.near_vectors(_faces(spark, sf_dir), "vec_id", "embedding", 0.4)
    return vectors.shared_face_groups(pairs, _faces(spark, sf_dir), "vec_id", "label")


@query
def match_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    found = match_one_to_one(spark, sf_dir).select("case_id", F.col("cosine").alias("score"))
    captured = faces.select(F.col("vec_id").alias("case_id"), "label")
    on_photo = faces.select((F.col("vec_id") - 1).alias("case_id"), F.col("label").alias("_label"))
    # A case without photo has no score; it counts as genuine.
    truth = captured.join(on_photo, "case_id", "left").select(
        "case_id", F.coalesce(F.col("label") == F.col("_label"), F.lit(True)).alias("same")
    )
    return score.match_error_rates(found, truth, [-0.1, 0.0, 0.1, 0.25], ["case_id"])


# Scores. A case is a user; a signal is an event type with its value, or its type and the number in `props`.

SIGNAL_WEIGHTS = [("view", 0.2), ("click", 0.1), ("error", 0.3), ("error_k", 0.2), ("purchase_k", 0.4), ("absent", 0.1)]


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    common = [F.col("user_id").alias("case_id"), F.col("ts").alias("at"), "event_id"]
    values = events.select(*common, F.col("event_type").alias("signal"), (F.col("value") / 100).alias("value"))
    number = F.from_json("props", "k INT")["k"]
    numbers = events.select(*common, F.concat("event_type", F.lit("_k")).alias("signal"), (number / 100).alias("value"))
    return score.collect_signals(values, numbers)


@query
def collect_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)


@query
def signal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["view", "click", "error", "purchase", "signup"]
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("signal"), "value"
    )
    return score.signal_matrix(events, names)


@query
def risk_score_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    return score.risk_score(_signals(spark, sf_dir), SIGNAL_WEIGHTS, "skip", cases=people)


@query
def risk_score_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.risk_score(_signals(spark, sf_dir), SIGNAL_WEIGHTS, "zero")


@query
def risk_score_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.risk_score(_signals(spark, sf_dir), SIGNAL_WEIGHTS, "worst")


@query
def risk_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.risk_decision(risk_score_skip(spark, sf_dir), [(0, 0.3, "clear"), (0.3, 0.6, "review"), (0.6, 1, "refer")])


@query
def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.top_reasons(_signals(spark, sf_dir), SIGNAL_WEIGHTS, 3)


@query
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(
        "c_nationkey", F.col("c_custkey").alias("case_id"), F.round(F.col("c_acctbal") / 1000, 0).alias("score")
    )
    return score.review_queue(people, ["c_nationkey"], 10)


@query
def first_in_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_acctbal").alias("score"))
    return score.first_in_queue(people, 50)


def _document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.round(F.least(F.col("n_chars") / 10_000, F.lit(1.0)), 3)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), value.alias("score"))


def _document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("label"))


@query
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.calibration(_document_scores(spark, sf_dir), _document_labels(spark, sf_dir), 10)


@query
def calibration_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.calibration(_document_scores(spark, sf_dir), _document_labels(spark, sf_dir), 5, method="width")


@query
def detection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = [0.0, 0.05, 0.1, 0.2, 0.5, 1.1]
    return score.detection_quality(_document_scores(spark, sf_dir), _document_labels(spark, sf_dir), points)


# Reports


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    people = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", (F.col("c_acctbal") < 0).alias("owing"))
    return people.join(nations.join(regions, "n_regionkey"), "c_nationkey")


@query
def checkpoint_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.checkpoint_summary(_places(spark, sf_dir), ["r_name", "n_name", "c_mktsegment"], "rollup", "owing")


@query
def checkpoint_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.checkpoint_summary(_places(spark, sf_dir), ["r_name", "c_mktsegment"], "cube", "owing")


@query
def checkpoint_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = ["r_name", "n_name", "c_mktsegment"]
    return report.checkpoint_summary(_places(spark, sf_dir), dims, "sets", sets=[["r_name", "n_name"], ["c_mktsegment"]])


@query
def checkpoint_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    cases_ = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("failed"))
    return report.checkpoint_deviation(cases_.join(people, "o_custkey"), "c_nationkey", "failed")


@query
def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stage_times(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


@query
def stage_times_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stage_times(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id", method="approx")


@query
def stored_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from sketches of single days; whether each lies within the bound of its rank, held against all rows."""
    events = table(spark, sf_dir, "events")
    stored = sketches.value_sketches(events, ["event_type"], "ts", "value")
    found = sketches.merged_quantiles(stored, ["event_type"], [0.05, 0.5, 0.95])
    bound = sketches.rank_error()
    ranked = found.join(events.select("event_type", "value"), "event_type").groupBy("event_type", "share", "n").agg(
        F.avg((F.col("value") < F.col("estimate")).cast("double")).alias("_below"),
        F.avg((F.col("value") <= F.col("estimate")).cast("double")).alias("_upto"),
    )
    near = (F.col("_below") - bound <= F.col("share")) & (F.col("share") <= F.col("_upto") + bound)
    return ranked.select("event_type", "share", "n", near.alias("within_bound"))


@query
def stored_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct persons from sketches of single days, held against the exact number."""
    orders = table(spark, sf_dir, "orders")
    stored = sketches.person_sketches(orders, ["o_orderpriority"], "o_orderdate", "o_custkey")
    exact = orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("persons"))
    about = sketches.distinct_persons(stored, ["o_orderpriority"]).select("o_orderpriority", F.col("persons").alias("_about"))
    near = F.abs(F.col("_about") - F.col("persons")) <= F.lit(sketches.count_error()) * F.col("persons")
    return exact.join(about, "o_orderpriority").select("o_orderpriority", "persons", near.alias("within_bound"))


@query
def volume_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.volume_trend(table(spark, sf_dir, "events"), "ts", "day", 7)


@query
def volume_trend_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.volume_trend(table(spark, sf_dir, "events"), "ts", "hour", 24, by=["event_type"])


# Trail

CONVERSATION = ["conv_id", "turn", "role", "text"]
# Small, so that the trails of the query tables cover several segments.
QUERY_SEGMENT = 3


@query
def case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.case_timeline(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


@query
def conversation_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.timestamp_seconds("turn").cast("timestamp_ntz").alias("at")
    )
    return trail.case_timeline(rows, "conv_id", "at", "turn", "role").drop("at")


@query
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 1_800)


@query
def trail_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.trail_segments(table(spark, sf_dir, "conversations"), "conv_id", "turn", CONVERSATION, QUERY_SEGMENT)


@query
def trail_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.trail_digest(table(spark, sf_dir, "conversations"), "conv_id", "turn", CONVERSATION, QUERY_SEGMENT)


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with some words changed and short closing turns taken away."""
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", "tion", "sion"))
    return rows.where("NOT (role = 'assistant' AND length(text) < 60)")


@query
def trail_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    stored = trail.trail_digest(rows, "conv_id", "turn", CONVERSATION, QUERY_SEGMENT)
    # Every eleventh conversation is found under another id: one is missing and one is extra.
    now = _edited(spark, sf_dir).withColumn("conv_id", F.expr("CASE WHEN conv_id % 11 = 0 THEN -1 - conv_id ELSE conv_id END"))
    return trail.trail_verify(now, stored, "conv_id", "turn", CONVERSATION, QUERY_SEGMENT)


@query
def trail_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.trail_diff(table(spark, sf_dir, "conversations"), _edited(spark, sf_dir))


@query
def trail_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns differ from the conversations that a digest tree was made of."""
    then, now = table(spark, sf_dir, "conversations"), _edited(spark, sf_dir)
    trees = [merkle.trail_tree(rows, "conv_id", "turn", CONVERSATION, fanout=4) for rows in (then, now)]
    return merkle.tree_changes(*trees, "conv_id", fanout=4).withColumnRenamed("node", "turn")


@query
def trail_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the edited conversations, each held against the proof of its place in the original ones."""
    tree = merkle.trail_tree(table(spark, sf_dir, "conversations"), "conv_id", "turn", CONVERSATION, fanout=4)
    claimed = merkle.trail_leaves(_edited(spark, sf_dir), "conv_id", "turn", CONVERSATION)
    roots = tree.groupBy("conv_id").agg(F.max_by("digest", "level").alias("digest"))
    proofs = merkle.inclusion_proofs(tree, claimed, "conv_id", fanout=4)
    return merkle.proven(proofs, claimed, roots, "conv_id", fanout=4)


@query
def trail_append_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "trail")
    events = table(spark, sf_dir, "events")
    trail_append(events.where("event_type <> 'error'"), path, "first", "ts")
    trail_append(events.where("event_type = 'error'"), path, "second", "ts")
    # The same batch once more: it takes its own place and leaves the first batch as it is.
    trail_append(events.where("event_type = 'error'"), path, "second", "ts")
    return read_trail(spark, path, SCHEMAS["events"]).select("event_id", "user_id", "event_type", "event_date", "batch_id")


# Streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.read_events(spark, sf_dir, SCHEMAS["events"], "ts", "events.parquet")


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query
def live_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = live.window_counts(_stream(spark, sf_dir), "ts", ["event_type"], "1 day", None, "1 hour")
    return _ntz(live.finish(counts), "window_start", "window_end")


@query
def live_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = live.window_counts(_stream(spark, sf_dir), "ts", [], "6 hours", "2 hours", "1 hour")
    return _ntz(live.finish(counts), "window_start", "window_end")


@query
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = live.live_sessions(_stream(spark, sf_dir), "user_id", "ts", "30 minutes", "1 hour")
    return _ntz(live.finish(found), "session_start", "session_end")


@query
def live_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = live.drop_repeats(_stream(spark, sf_dir), "ts", ["user_id", "event_type"], "60 days")
    return live.finish(kept.select("user_id", "event_type"))


@query
def live_registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _stream(spark, sf_dir).select(
        "event_id",
        _claimed("event_id", "user_id").alias("c_custkey"),
        (F.col("user_id") % 25).cast("int").alias("c_nationkey"),
    )
    known = table(spark, sf_dir, "customer")
    checked = live.live_registry_check(claims, known, ["c_custkey"], ["c_nationkey"])
    return live.finish(checked.select("event_id", "status", F.array_join("differing", ",").alias("differing")))


@query
def live_registry_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the latest view before them, both as streams."""
    purchases = _stream(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = _stream(spark, sf_dir).where("event_type = 'view'").select(
        F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value")
    )
    looked_up = as_of.live_registry_as_of(
        purchases,
        views,
        "user_id",
        "ts",
        record_order="event_id",
        version_ts="view_ts",
        version_order="view_id",
        values=["view_id", "view_value"],
        delay="1 hour",
        spread=2,
    )
    with as_of.rocksdb_state(spark):
        return _ntz(live.finish(looked_up), "ts", "version_from")


@query
def live_join_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _stream(spark, sf_dir).where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    buys = _stream(spark, sf_dir).where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts")
    )
    joined = live.join_within(
        views, buys, ["user_id"], "view_ts", "purchase_ts", "2 hours", "1 hour", spread=2, spread_by="view_id"
    )
    return _ntz(live.finish(joined), "view_ts", "purchase_ts")


@query
def live_complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("signal"), F.col("ts").alias("at")
    )
    required = ["view", "click", "error", "purchase", "signup"]
    return _ntz(live.finish(cases.complete_cases(rows, required, 2 * 86_400, "1 hour")), "first_at", "last_at")
