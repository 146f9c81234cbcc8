"""Conversation structure repair: the cheapest edits that make a conversation alternate, by a checkpointed DP.

The result of a repair has the role initials `(s?(ua)+)?`. Edits are Keep (0), Rerole to user or assistant (3), Delete
(4, required for blank and repeated rows) and Insert of an empty user or assistant row (3); a truncated row that is not
deleted adds 3. Of the cheapest edits those are taken whose initials, in order, come first in ASCII.

Costs are computed backward, for four states: nothing so far, after the system row, after a user row, after an
assistant row. Of n rows only about the square root's number of cost vectors is stored; walking forward, the vectors of one block
are recomputed from the checkpoint at its end, and the least edit is taken whose cost closes the gap exactly ("tight").

A conversation of up to `whole_rows` rows and `whole_bytes` bytes is repaired in one task, next to many others. A larger one is dealt by
turn over many tasks and cut into blocks of about the square root of its rows. Each block gives the cheapest costs between
its states (4 x 4); combined from the end they give the checkpoints between blocks. With its checkpoint a block tells
where each state that could enter it leaves it, and so which one does; then all blocks are walked at once. Only its SHA-256, one
stream by nature, passes a single task, block after block. Both ways give the same rows.

Cases: null ids, roles and texts are defined (a null conversation id is a conversation; a null role or text is one space); null
turns come first; rows of one turn are ordered by role, then text; rows that are equal in turn, role and text are repeats of the
first; a conversation without rows has zeros and the empty string's hash; an empty table gives an empty result; other columns are never
looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idscreen.llm.shared import materialise, parallelism

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
WHOLE_ROWS = 20_000
WHOLE_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
# What a state expects next, where that leads, and what a finished conversation still needs.
EXPECTED = ("u", "u", "a", "u")
NEXT = (USER, USER, ASSISTANT, USER)
FINISH = (0, 2 * INSERT, INSERT, 0)
ROLE = {"u": "user", "a": "assistant"}
_FAR = 1 << 60
# A row as the DP sees it: role initial, is it forced out, what keeping it adds.
Step = tuple[str, bool, int]


def _with_inserts(v: list[int]) -> list[int]:
    """Costs when rows may be inserted first. Two rounds suffice: after two insertions the state is one already seen."""
    for _ in range(2):
        v = [min(v[q], INSERT + v[NEXT[q]]) for q in range(4)]
    return v


def before(step: Step, after: list[int]) -> list[int]:
    """Costs from every state before a row, given those after it."""
    initial, forced, extra = step
    v = [DELETE + after[q] for q in range(4)]
    if not forced:
        for q in range(4):
            v[q] = min(v[q], REROLE + extra + after[NEXT[q]])
            if initial == EXPECTED[q]:
                v[q] = min(v[q], extra + after[NEXT[q]])
        if initial == "s":
            v[START] = min(v[START], extra + after[SYSTEM])
    return _with_inserts(v)


def walk(steps: list[Step], after: list[int], state: int) -> Iterator[tuple[str, int, str]]:
    """The tight edits from a state on: (initial of the edit, number of the row, role initial it leaves or ''). Rows end
    with the costs `after`. Cost vectors are kept at checkpoints only and recomputed a block at a time."""
    n = len(steps)
    block = max(1, math.isqrt(n))
    checkpoints = {n: after}
    v = after
    for k in range(n - 1, -1, -1):
        v = before(steps[k], v)
        if k % block == 0:
            checkpoints[k] = v
    for begin in range(0, n, block):
        end = min(n, begin + block)
        vectors = [checkpoints[end]]
        for k in range(end - 1, begin - 1, -1):
            vectors.append(before(steps[k], vectors[-1]))
        vectors.reverse()
        for k in range(begin, end):
            here, there = vectors[k - begin], vectors[k - begin + 1]
            initial, forced, extra = steps[k]
            while True:
                need = here[state]
                if need == DELETE + there[state]:
                    yield "D", k, ""
                    break
                if need == INSERT + here[NEXT[state]]:
                    yield "I", k, EXPECTED[state]
                    state = NEXT[state]
                    continue
                if initial == "s" and state == START and need == extra + there[SYSTEM]:
                    yield "K", k, "s"
                    state = SYSTEM
                    break
                letter = "K" if initial == EXPECTED[state] and need == extra + there[NEXT[state]] else "R"
                yield letter, k, EXPECTED[state]
                state = NEXT[state]
                break


def finish(state: int) -> list[str]:
    """Roles to insert after the last row."""
    missing = []
    while FINISH[state]:
        missing.append(EXPECTED[state])
        state = NEXT[state]
    return missing


def last_state(edits: Iterable[tuple[str, int, str]], state: int) -> int:
    """The state that edits lead to."""
    for _, _, role in edits:
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role, state)
    return state


def transfer(steps: list[Step]) -> list[int]:
    """Cheapest costs from every state before the rows to every state after them, row by row of a 4 x 4 matrix."""
    columns = []
    for out in range(4):
        v = _with_inserts([0 if q == out else _FAR for q in range(4)])
        for step in reversed(steps):
            v = before(step, v)
        columns.append(v)
    return [columns[out][q] for q in range(4) for out in range(4)]


def damaged(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after damage; a dropped row stays with 0 copies and without texts."""
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col(conv_id).cast("string"), space), F.coalesce(F.col(turn).cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    whole = F.coalesce(F.col(text), space)
    body = F.when(kind < 2, F.lit("")).when(kind == 2, F.regexp_replace(whole, "[.!?]", "")).otherwise(whole)
    return conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.when(kind == 0, F.lit("")).when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), space)).alias("role"),
        body.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def untouched(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The same columns for conversations as they are."""
    return conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.lit(1).alias("copies"),
    )


def _fault(text: str, seen: bool) -> str:
    last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
    return "blank" if not last else "duplicate" if seen else "" if last in ".!?" else "truncated"


def _step(role: str, fault: str) -> Step:
    return role[:1], fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0


def _lines(edits: Iterable[tuple[str, int, str]], rows: list[tuple[str, str]]) -> Iterator[str]:
    """`role:text` of every row that the edits leave."""
    for letter, k, role in edits:
        if letter == "K":
            yield f"{rows[k][0]}:{rows[k][1]}"
        elif letter == "R":
            yield f"{ROLE[role]}:{rows[k][1]}"
        elif letter == "I":
            yield f"{ROLE[role]}:"


def price(edits: list[tuple[str, int, str]], steps: list[Step]) -> int:
    base = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
    return sum(base[e] + (steps[k][2] if e in "KR" else 0) for e, k, _ in edits)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


FIELDS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def repair_one(rows: list[tuple[str, str]]) -> tuple[int, int, int, int, int, str, list[str]]:
    """Repairs the rows (role, text) of one conversation in order: counts of the three faults, illegal neighbours, cost,
    audit and the lines that are left."""
    seen, steps, faults = set(), [], []
    for row in rows:
        faults.append(_fault(row[1], row in seen))
        seen.add(row)
        steps.append(_step(row[0], faults[-1]))
    edits = list(walk(steps, list(FINISH), START))
    edits += [("I", len(rows), role) for role in finish(last_state(edits, START))]
    return (
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        _illegal([s[0] for s in steps]),
        price(edits, steps),
        "".join(e for e, _, _ in edits),
        list(_lines(edits, rows)),
    )


def _repair_whole(rows: DataFrame) -> DataFrame:
    """Conversations of bounded size: their rows stream through sorted, one conversation is in memory at a time."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, done = None, [], []

        def close() -> None:
            *numbers, lines = repair_one(held)
            done.append((current[0], *numbers, hashlib.sha256("\n".join(lines).encode()).hexdigest()))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        types = names = None
        for batch in batches:
            if types is None:
                types = [batch.schema.field("conv_id").type, *[pa.int64()] * 5, pa.string(), pa.string()]
                names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
            for begin in range(0, batch.num_rows, 256):
                columns = [batch.column(c).slice(begin, 256).to_pylist() for c in ("conv_id", "role", "text", "copies")]
                for conv, role, text, copies in zip(*columns):
                    if current is None or current[0] != conv:
                        if current is not None:
                            close()
                        current, held = (conv,), []
                    held.extend([(role, text)] * copies)
                if done:
                    yield out()
        if current is not None:
            close()
            yield out()

    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text", "copies").mapInArrow(repair, f"conv_id {kind}, {FIELDS}")


def _first_of_equal(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, seen): equal rows folded; `seen` if an earlier turn has the same role and text."""
    folded = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    keyed = folded.withColumns(
        {
            "key": F.sha2(F.concat_ws("\n", F.char_length("role"), "role", "text"), 256),
            "at": F.struct(F.col("turn").isNotNull().alias("known"), "turn"),
        }
    )
    first = keyed.groupBy("conv_id", "key").agg(F.min("at").alias("first")).withColumnsRenamed({"conv_id": "_c", "key": "_k"})
    met = keyed.join(first, keyed["conv_id"].eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")))
    return met.select("conv_id", "turn", "role", "text", "copies", (F.col("at") > F.col("first")).alias("seen"))


def _blocks(rows: DataFrame, sizes: DataFrame, block_bytes: int) -> DataFrame:
    """Rows in the order of their conversations, packed: (conv_id, part, number, steps, roles, texts, copies, transfer...)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.join(sizes.withColumnRenamed("conv_id", "_c"), rows["conv_id"].eqNullSafe(F.col("_c"))).select(
        "conv_id", "turn", "role", "text", "copies", "seen", F.greatest(F.lit(16), F.ceil(F.sqrt("rows"))).cast("int").alias("block")
    )
    head = F.substring("text", 1, 64)
    spread = ordered.repartitionByRange(parallelism(rows.sparkSession), "conv_id", "turn", "role", head)
    spread = spread.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, number, kind_ = 0, 0, None

        def block() -> pa.RecordBatch:
            steps = list(_unpacked(held))
            faults = [f for f, _ in steps]
            only = [s for _, s in steps]
            made = {
                "conv_id": pa.array([held[0]["conv_id"]], kind_),
                "part": pa.array([held[0]["part"]], pa.int32()),
                "number": pa.array([number], pa.int32()),
                "roles": pa.array([[r["role"] for r in held]], pa.list_(pa.string())),
                "texts": pa.array([[r["text"] for r in held]], pa.list_(pa.string())),
                "copies": pa.array([[r["copies"] for r in held]], pa.list_(pa.int64())),
                "seen": pa.array([[r["seen"] for r in held]], pa.list_(pa.bool_())),
                "transfer": pa.array([transfer(only)], pa.list_(pa.int64())),
                "first": pa.array([only[0][0]]),
                "last": pa.array([only[-1][0]]),
                **{f: pa.array([faults.count(f)], pa.int64()) for f in ("blank", "duplicate", "truncated")},
                "illegal": pa.array([_illegal([s[0] for s in only])], pa.int64()),
            }
            return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

        for batch in batches:
            kind_ = batch.schema.field("conv_id").type
            for begin in range(0, batch.num_rows, 256):
                for row in batch.slice(begin, 256).to_pylist():
                    if held and (row["conv_id"] != held[0]["conv_id"] or len(held) >= held[0]["block"] or size >= block_bytes):
                        yield block()
                        held, size, number = [], 0, number + 1
                    held.append(row)
                    size += len(row["text"]) + len(row["role"])
        if held:
            yield block()

    return spread.mapInArrow(
        pack,
        f"conv_id {kind}, part int, number int, roles array<string>, texts array<string>, copies array<bigint>, seen array<boolean>,"
        " transfer array<bigint>, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint",
    )


def _unpacked(rows: list[dict]) -> Iterator[tuple[str, Step]]:
    """(fault, step) of every row of a block, repeats one after the other."""
    for r in rows:
        fault = _fault(r["text"], r["seen"])
        yield fault, _step(r["role"], fault)
        again = "blank" if fault == "blank" else "duplicate"
        for _ in range(1, r["copies"]):
            yield again, _step(r["role"], again)


def _checkpoints(frame: pd.DataFrame) -> pd.DataFrame:
    """Costs at the end of every block of a conversation, combined from the last block on."""
    frame = frame.sort_values(["part", "number"])
    v, costs = list(FINISH), []
    for matrix in reversed(frame["transfer"].tolist()):
        costs.append(v)
        v = [min(int(matrix[4 * q + out]) + v[out] for out in range(4)) for q in range(4)]
    return frame[["conv_id", "part", "number"]].assign(after=costs[::-1])


def _entries(frame: pd.DataFrame) -> pd.DataFrame:
    """The state that enters every block, and what the conversation's blocks sum to."""
    frame = frame.sort_values(["part", "number"])
    state, states = START, []
    for exits in frame["exits"]:
        states.append(state)
        state = int(exits[state])
    last = [False] * (len(frame) - 1) + [True]
    return frame[["conv_id", "part", "number"]].assign(state=states, is_last=last)


def _repair_blocks(rows: DataFrame, sizes: DataFrame, block_bytes: int) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    key = f"conv_id {kind}, part int, number int"
    blocks = materialise(_blocks(_first_of_equal(rows), sizes, block_bytes), "turn-blocks")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """Blocks are told by part and number alone; both are in the written table."""
        return left.join(right.drop("conv_id"), ["part", "number"])

    after = blocks.select("conv_id", "part", "number", "transfer").groupBy("conv_id").applyInPandas(_checkpoints, f"{key}, after array<bigint>")
    after = materialise(after, "turn-checkpoints")

    def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for k in range(batch.num_rows):
            block = batch.slice(k, 1).to_pylist()[0]
            held = [dict(zip(("role", "text", "copies", "seen"), r)) for r in zip(*(block[c] for c in ("roles", "texts", "copies", "seen")))]
            yield {**block, "held": held, "steps": [s for _, s in _unpacked(held)]}

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "number"]
        for batch in batches:
            for b in rows_of(batch):
                exits = [last_state(walk(b["steps"], b["after"], q), q) for q in range(4)]
                values = [pa.array([b[c]], batch.schema.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays([*values, pa.array([exits], pa.list_(pa.int32()))], names=[*names, "exits"])

    exits = met(blocks.select("conv_id", "part", "number", "roles", "texts", "copies", "seen"), after).mapInArrow(leave, f"{key}, exits array<int>")
    entries = materialise(exits.groupBy("conv_id").applyInPandas(_entries, f"{key}, state int, is_last boolean"), "turn-entries")
    known = met(met(blocks.drop("transfer"), after), entries)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "number", "first", "last", "blank", "duplicate", "truncated", "illegal"]
        for batch in batches:
            for b in rows_of(batch):
                pairs = [(r["role"], r["text"]) for r in b["held"] for _ in range(r["copies"])]
                edits = list(walk(b["steps"], b["after"], b["state"]))
                if b["is_last"]:
                    edits += [("I", len(pairs), role) for role in finish(last_state(edits, b["state"]))]
                lines = "".join(f"{line}\n" for line in _lines(edits, pairs))
                values = [pa.array([b[c]], batch.schema.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*values, pa.array([price(edits, b["steps"])], pa.int64()), pa.array(["".join(e for e, _, _ in edits)]), pa.array([lines])],
                    names=[*names, "cost", "audit", "lines"],
                )

    pieces = materialise(
        known.mapInArrow(
            emit,
            f"{key}, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
            " cost bigint, audit string, lines string",
        ),
        "turn-repairs",
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stream, rest, type_ = None, hashlib.sha256(), b"", None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current[0]], type_), pa.array([stream.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            for k in range(batch.num_rows):
                conv, lines = batch.column("conv_id")[k].as_py(), batch.column("lines")[k].as_py().encode()
                if current is None or current[0] != conv:
                    if current is not None:
                        yield done()
                    current, stream, rest = (conv,), hashlib.sha256(), b""
                if lines:  # the newline that ends a line counts once another line follows
                    stream.update(rest + lines[:-1])
                    rest = b"\n"
        if current is not None:
            yield done()

    ordered = pieces.select("conv_id", "part", "number", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    digests = ordered.select("conv_id", "lines").mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")
    places = Window.partitionBy("conv_id").orderBy("part", "number")
    seam = F.concat(F.substring(F.lag("last").over(places), 1, 1), "first")
    small = pieces.drop("lines").withColumn("illegal", F.col("illegal") + F.coalesce((~seam.isin("su", "ua", "au")).cast("int"), F.lit(0)))
    summed = small.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "number", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    digests = digests.withColumnRenamed("conv_id", "_c")
    return summed.join(digests, summed["conv_id"].eqNullSafe(F.col("_c"))).drop("_c")


def repair(rows: DataFrame, whole_rows: int = WHOLE_ROWS, whole_bytes: int = WHOLE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text, copies): (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256)."""
    turns = rows.groupBy("conv_id", "turn").agg(F.sum("copies").alias("rows"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    there = F.when(F.col("rows") > 0, F.col("turn"))
    sizes = turns.groupBy("conv_id").agg(
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
        F.coalesce(F.max(there) - F.min(there) + 1 - F.count(there), F.lit(0)).cast("bigint").alias("gaps"),
    )
    sizes = materialise(sizes, "conversation-sizes").withColumn("large", (F.col("rows") > whole_rows) | (F.col("bytes") > whole_bytes))
    large = sizes.where("large").select("conv_id", "rows")
    if large.isEmpty():  # plans change with this, results do not
        repaired = _repair_whole(rows)
    else:
        named = large.select(F.col("conv_id").alias("_c"))
        same = rows["conv_id"].eqNullSafe(F.col("_c"))
        repaired = _repair_whole(rows.join(named, same, "left_anti")).unionByName(_repair_blocks(rows.join(named, same, "left_semi"), large, block_bytes))
    repaired = repaired.withColumnRenamed("conv_id", "_r")
    return sizes.join(repaired, sizes["conv_id"].eqNullSafe(F.col("_r"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
