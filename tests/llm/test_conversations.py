"""Conversation repair against an independent search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import pytest

from idscreen.llm import conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies string, part int"


def _cheapest(steps):
    """Best-first over (cost, audit): the first goal taken is the cheapest, and of those the first in ASCII."""
    nexts = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, state = heapq.heappop(heap)
        if k == len(steps) and state in ("", "a"):
            return cost, audit
        if (k, state) in done:
            continue
        done.add((k, state))
        for role, to in nexts[state].items():
            if role in "ua":
                heapq.heappush(heap, (cost + 3, audit + "I", k, to))
        if k < len(steps):
            initial, fault = steps[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state))
            extra = 3 if fault == "truncated" else 0
            for role, to in nexts[state].items() if fault not in ("blank", "duplicate") else ():
                if role == initial:
                    heapq.heappush(heap, (cost + extra, audit + "K", k + 1, to))
                if role in "ua":
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", k + 1, to))
    raise AssertionError


def _expected(rows, damage=True):
    held: dict = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20 if damage else 9
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        held.setdefault(conv, []).extend([(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = []
    for conv, group in held.items():
        group.sort()
        seen, steps = set(), []
        for _, _, role, text in group:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            steps.append((role[:1], fault))
        cost, audit = _cheapest(steps)
        size = len(audit) - audit.count("D")
        lines, k = [], 0
        for e in audit:
            row = None if e == "I" else group[k]
            k += e != "I"
            if e == "D":
                continue
            wanted = ("user", "assistant")[(len(lines) - size % 2) % 2]
            lines.append(f"{row[2] if e == 'K' else wanted}:{row[3] if row else ''}")
        turns = {t for known, t, *_ in group if known}
        faults = [f for _, f in steps]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(steps, steps[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def _rows(conversations_: int, turns: int, seed: int):
    rng = random.Random(seed)
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None, "ux", "User"]
    texts = ["Yes.", "No!", "why", "Is it? ", "\n\t", "", None, " ok.\n", "x.y", "..."]
    rows = []
    for c in range(conversations_):
        for t in range(rng.randint(1, turns)):
            turn = rng.choice([None, t, t, t, t, t + 3])
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.randint(0, 99)} of {c}{rng.choice(['.', '!', '?', ''])}"
            rows.append((c, turn, rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2], text, "x", 1))
    rows += [(None, 0, "user", "a.", "x", 1), (None, 1, "assistant", "b.", "x", 1), rows[0], rows[0]]
    return rows


def _got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("bounds", [{}, {"whole_rows": 3, "block_bytes": 60}, {"whole_bytes": 40}])
def test_repair_against_search(spark, bounds):
    rows = _rows(60, 14, 1)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    damaged = conversations.damaged(frame, "conv_id", "turn", "role", "text")
    assert _got(conversations.repair(damaged, **bounds)) == _expected(rows)


def test_long_conversations_are_cut_into_blocks(spark):
    rows = _rows(3, 700, 2)
    rows += [(1, 5, "user", "same.", "x", 1)] * 300 + [(2, None, "assistant", "word " * 30_000, "x", 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plain = conversations.untouched(frame, "conv_id", "turn", "role", "text")
    whole = _got(conversations.repair(plain))
    assert whole == _expected(rows, damage=False)
    assert _got(conversations.repair(plain, whole_rows=20, block_bytes=5_000)) == whole


def test_checkpoints_are_few():
    steps = [("u" if k % 3 else "a", k % 7 == 0, 3 * (k % 5 == 0)) for k in range(400)]
    edits = list(conversations.walk(steps, list(conversations.FINISH), conversations.START))
    faults = ["blank" if f else "truncated" if x else "" for _, f, x in steps]
    rest = conversations.finish(conversations.last_state(edits, conversations.START))
    audit = "".join(e for e, _, _ in edits) + "I" * len(rest)
    assert (conversations.price(edits, steps) + 3 * len(rest), audit) == _cheapest([(s[0], f) for s, f in zip(steps, faults)])


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert _got(conversations.repair(conversations.damaged(none, "conv_id", "turn", "role", "text"))) == []
    gone = next(t for t in range(1_000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(7, gone, "user", "x.", "", 1)], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert _got(conversations.repair(conversations.damaged(one, "conv_id", "turn", "role", "text"))) == [(7, 0, 0, 0, 0, 0, 0, "", empty)]
