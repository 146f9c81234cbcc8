"""The training-text operators against brute force on small tables, with nulls, empty texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from idscreen.llm import (
    bag_minhash,
    byte_bpe,
    components,
    exact_dedup,
    licenses,
    mixing,
    ngram_ratio,
    quality_classifier,
    substring_dedup,
    token_orc,
    url_filter,
)
from idscreen.llm.expected import SQL
from idscreen.llm.queries import GLOBS, QUERIES, RULES
from tests.conftest import SMALL_DIR
from tests.oracle import connect

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
# Extra columns have the names that operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, score string, _row string"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _texts(n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["Über", "naïve", "it's", "x!!", "日本"]
    passage = " ".join(rng.choices(vocabulary, k=70))
    rows: list[tuple[int | None, str | None]] = []
    for k in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(5, 200)))
        rows.append((k, f"{text} {passage}\nend {k}" if k % 7 == 0 else text))
    rows += [(n, rows[3][1]), (n + 1, (rows[3][1] or "").upper()), (n + 2, f"{rows[4][1]} more"), (n + 3, None)]
    rows += [(n + 4, ""), (n + 5, " \n\t "), (None, rows[5][1]), (n + 6, passage * 30), rows[6], rows[6], (None, None)]
    return rows


def _frame(spark, rows):
    full = [(i, t, "en", None if i is None else f"s{i % 4}", None if t is None else len(t), "d", "s", "r") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    return _frame(spark, _texts()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return _frame(spark, [])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    frame = QUERIES[name](spark, SMALL_DIR)
    cursor = connect(SMALL_DIR).execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(map(repr, cursor.fetchall()))


def test_exact_dedup_decides_every_row(docs, none):
    rows, entered = exact_dedup.add_batch(docs, f"t_{uuid.uuid4().hex}", "b1")
    got = exact_dedup.decisions(rows, entered, hot_rows=1).collect()
    groups = collections.defaultdict(list)
    lower = {c: c.lower() for c in map(chr, range(65, 91))}
    for i, t in _texts():
        groups[hashlib.sha256("".join(lower.get(c, c) for c in t or "").encode()).hexdigest()].append(i)
    assert len(got) == sum(map(len, groups.values()))
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    empty = exact_dedup.add_batch(none, f"t_{uuid.uuid4().hex}", "b1")
    assert exact_dedup.decisions(*empty).collect() == []


def test_exact_dedup_remembers_earlier_batches(spark, docs):
    index = f"t_{uuid.uuid4().hex}"
    first = exact_dedup.keep_new(docs, index, "b1")
    assert first.columns == docs.columns
    n = first.count()
    assert exact_dedup.keep_new(docs, index, "b1").count() == n  # the same batch again
    more = _frame(spark, [*_texts(10), (900, "quite new"), (901, "Quite New")])
    assert [r.doc_id for r in exact_dedup.keep_new(more, index, "b2").where("doc_id >= 900").collect()] == [901]
    assert spark.table(index).count() == n + exact_dedup.keep_new(more, index, "b2").count()


_OTHER_SESSION = """
import sys
from pyspark.sql import SparkSession
from idscreen.llm import exact_dedup
warehouse, index, batch = sys.argv[1:4]
spark = SparkSession.builder.master("local[2]").config("spark.sql.warehouse.dir", warehouse).config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(20)] + [(90, batch)], "doc_id bigint, text string")
print("kept", sorted(r.doc_id for r in exact_dedup.keep_new(docs, index, batch, buckets=4).collect()), spark.table(index).count())
"""


def test_exact_dedup_index_outlives_its_session(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    told = []
    for batch in ("b1", "b2", "b1"):
        args = [sys.executable, "-c", _OTHER_SESSION, str(tmp_path / "warehouse"), "lasting", batch]
        done = subprocess.run(args, cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr[-2_000:]
        told.append(done.stdout.strip().splitlines()[-1])
    first = "kept [13, 14, 15, 16, 17, 18, 19, 90] 8"
    assert told == [first, "kept [90] 9", first.replace("] 8", "] 9")]


@pytest.mark.parametrize("chunk,overlap", [(16_384, 512), (64, 16), (20, 8)])
def test_byte_bpe_equals_the_library_and_comes_back(docs, none, chunk, overlap):
    import tiktoken

    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={}
    )
    encoded = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, overlap=overlap)
    got = byte_bpe.decode_documents(encoded, RANKS).collect()
    want = [(i, own.encode_ordinary(t or ""), (t or "").encode()) for i, t in _texts()]
    key = repr
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)
    assert byte_bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_without_common_boundaries(spark):
    texts = ["a" * 500, " " * 300 + "x", "1" * 77 + " b" * 90, "it's we're " * 40, "\n" * 90 + "é" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    encoded = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, chunk_chars=32, overlap=8)
    encode = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.ids) for r in encoded.collect()} == {k: encode(t) for k, t in enumerate(texts)}


def test_url_rules_and_globs(spark):
    urls = [
        "http://www.example.com/en/x", "https://EXAMPLE.com/en/", "http://a.example.com/fr/", "http://com", "http://com/",
        "http://b.net/es/1?q=/fr/", "http://b.net/fr", "no-scheme", None, "http://spam-farm.org/x", "ftp://x.org/cart/y#z",
        "http://x.org/a.example.com/en/", "http://x.org/" + "p" * 5_000 + "/wp-login.php",
    ]
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(pages, RULES, GLOBS).collect()}
    assert got[0] == ("www.example.com/en/", "allow") and got[1] == ("example.com/en/", "block")
    assert got[2] == ("com/", "allow") and got[3] == (None, "allow") and got[4] == ("com/", "allow")
    assert got[5] == ("net/es/", "block") and got[6] == (None, "allow") and got[7] == got[8] == (None, "allow")
    assert got[9] == got[10] == got[12] == (None, "block") and got[11] == (None, "allow")


def test_globs_against_regular_expressions():
    import re

    rng = random.Random(3)
    globs = ["".join(rng.choices(["a", "b", "/", "?", "*", "**"], k=rng.randint(1, 30))) for _ in range(60)]
    urls = ["".join(rng.choices("ab/", k=rng.randint(0, 25))).encode() for _ in range(400)]
    found = url_filter.matches(urls, url_filter.compiled(globs))
    for k, glob in enumerate(globs):
        parts = {"**": ".*", "*": "[^/]*", "?": "."}
        expression = re.compile("".join(parts.get(p, re.escape(p)) for p in re.findall(r"\*\*|.", glob)).encode(), re.S)
        assert [bool(expression.fullmatch(u)) for u in urls] == found[:, k].tolist(), glob


def _bag(text: str | None) -> collections.Counter:
    w = _words(text)
    k = min(5, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()


def _classes(rows):
    bags = [_bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            union = sum((bags[a] | bags[b]).values())
            if not union or sum((bags[a] & bags[b]).values()) >= 0.8 * union:
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, row in enumerate(rows):
        groups[find(k)].append(row[0])
    return sorted((sorted(map(repr, g)) for g in groups.values()))


def _near_copies() -> list[tuple[int, str]]:
    """A group in which every copy has words of its own, so that many pairs lie around the threshold."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(70):
        words = list(base)
        for place in rng.sample(range(150), rng.randint(0, 4)):
            words[place] = f"own{k}_{place}"
        rows.append((k, " ".join(words)))
    return rows


def test_near_duplicates_against_all_pairs(spark, docs, none, monkeypatch):
    monkeypatch.setattr(bag_minhash, "BLOCK_BAGS", 10)
    rows = [*_texts(), *((1_000 + k, t) for k, t in _near_copies())]
    frame = _frame(spark, rows)
    got = bag_minhash.near_duplicates(frame).collect()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.class_id, r.class_size].append(r)
    # class id and size name a class, but for the classes whose first id is null
    assert len(got) == len(rows) and all(len(g) % size == 0 for (_, size), g in groups.items())
    want = _classes(rows)
    by_class = collections.defaultdict(set)
    for r in got:
        by_class[r.class_id].add(r.doc_id)
    for group in want:
        ids = {eval(i) for i in group} - {None}
        if ids and "None" not in group:
            assert by_class[min(ids)] == ids
    assert sum(r.kept for r in got) == len(want)
    kept = bag_minhash.keep_first(frame)
    assert kept.columns == frame.columns and kept.count() == len(want)
    assert bag_minhash.near_duplicates(none).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = rng.integers(1, 20, 300), rng.integers(1, 20, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    seen = []
    for k in range(20):
        salted = np.sort(bag_minhash.mixed(hashes + np.uint64(k)))
        one, two = bag_minhash.signatures([(salted, a), (salted, b)], 128)
        assert (bag_minhash.signatures([(salted, b)], 128)[0] == two).all()
        seen.append((one == two).mean())
    assert abs(np.mean(seen) - true) < 4 * (true * (1 - true) / 2_560) ** 0.5


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a int, b int")).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("window,salt", [(50, 2_000_000), (6, 20)])
def test_repeats_against_brute_force(docs, none, window, salt):
    rows = _texts()
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = _words(t)
        for k in range(len(w) - window + 1 if i is not None else 0):
            first[tuple(w[k : k + window])] = min(i, first.get(tuple(w[k : k + window]), i))
    want = []
    for i, t in rows:
        w = _words(t)
        keep = [True] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        want.append((i, len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    got = substring_dedup.remove_repeats(docs, window=window, cell_entries=500, salt_documents=salt)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    tokenizer.encode_special_tokens = True
    path = str(tmp_path / "tokens")
    token_orc.write_token_files(docs, path, WORD_BPE, 2, shards=4)
    tokens = token_orc.read_token_files(spark, path)
    want = sorted(
        ((-1 if i is None else i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in _texts()),
        key=lambda r: (r[0], len(r[1]), zlib.crc32(np.array(r[1], "<u4").tobytes())),
    )
    got = sorted(token_orc.token_index(tokens).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, ids) in zip(got, want, strict=True):
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc)
        start += len(ids)
    assert tokens.where("doc_id = 11").count() == 1
    token_orc.write_token_files(none, str(tmp_path / "none"), WORD_BPE, 2, shards=2)
    assert token_orc.token_index(token_orc.read_token_files(spark, str(tmp_path / "none"))).count() == 0


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    tokenizer.encode_special_tokens = True
    words = token_orc.WordIds(WORD_BPE, limit=7)
    hard = "It's we'll ÀB́C á. x!! !!x 'S don't'd 12ab34 <|endoftext|> ΑΣ ΣΑΣ. İI ﬁ… a b c \x1c d\u0085e fin."
    for text in [hard, hard.upper(), "", " \n", "the,the. The; THE!", "日本語のテキスト。", "é ́e"]:
        assert words.of(text) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_are_given_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_orc.drops_blanks(WORD_BPE) and not token_orc.drops_blanks(path)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = ["Two  words.", None, "", " lead\n\n", "Über <|endoftext|>"]
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    assert token_orc.WordIds(path).lists(pa.array(texts, pa.string()), 7).to_pylist() == want


def test_word_lists_of_many_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    tokenizer.encode_special_tokens = True
    texts = [t for _, t in _texts()] + ["ĲSSEL ǅungla ŉ İstanbul ΑΣ. ﬁn", "x" * 5_000, "a\x0bb\x0cc\x1cd\x85e\u2003f"]
    words = token_orc.WordIds(WORD_BPE, limit=50)
    for end, tail in ((None, []), (2, [2])):
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids + tail for t in texts]
        assert words.lists(pa.array(texts, pa.string()), end).to_pylist() == want


def test_quality_rules_counts(docs, none, spark):
    trusted = spark.createDataFrame([(k,) for k in range(0, 40, 2)], "doc_id bigint")
    got = ngram_ratio.quality_rules(docs, trusted, buckets=1 << 10).collect()
    want = []
    for i, t in _texts():
        text = t or ""
        w = _words(text)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if _words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text),
                     len(lines) - len(set(lines)), len(covered), failed))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert not any(r.kept and (r.base_failed or r.score < ngram_ratio.THRESHOLD) for r in got)
    assert ngram_ratio.quality_rules(none, trusted, buckets=64).count() == 0
    nobody = ngram_ratio.quality_rules(docs, trusted.where("doc_id < 0"), buckets=64).collect()
    assert {r.score for r in nobody} == {0.0}


def test_log_ratio_follows_its_definition(spark):
    import regex
    import xxhash

    texts = ["good words here", "bad ### words ###", "good good"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    trusted = spark.createDataFrame([(0,), (2,)], "doc_id bigint")
    got = {r.doc_id: r.score for r in ngram_ratio.quality_rules(docs, trusted, buckets=256).collect()}

    def grams(text):
        runs = [r.encode() for r in regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+", text)]
        one = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        two = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(runs, runs[1:])]
        return [(h - (h >> 63 << 64)) % 256 for h in one + two]

    raw = collections.Counter(g for t in texts for g in grams(t))
    good = collections.Counter(g for k in (0, 2) for g in grams(texts[k]))
    for k, text in enumerate(texts):
        ratio = [
            np.log((good[g] + 1) / (good.total() + 256)) - np.log((raw[g] + 1) / (raw.total() + 256)) for g in grams(text)
        ]
        assert got[k] == pytest.approx(np.mean(ratio))


def test_classifier_learns_and_scores_all(spark, none):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(3_000)]
    rows = []
    for k in range(600):
        words = rng.choices(vocabulary, k=rng.randint(20, 60))
        rows.append((k, " ".join(words) if k % 3 else " ".join(w + "&&&" for w in words)))
    docs = _frame(spark, [*rows, (700, None), (701, "")])
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(400)] + [(5, None), (None, 1)], "doc_id bigint, label int")
    weights = quality_classifier.train(docs, labels, shard_rows=100)
    assert (weights == quality_classifier.train(docs, labels, shard_rows=100)).all()
    got = {r.doc_id: r.p for r in quality_classifier.add_score(docs, weights, "text", "p").select("doc_id", "p").collect()}
    assert all((got[k] >= 0.5) == (k % 3 > 0) for k in range(400, 600)) and got[700] == got[701]
    flat = quality_classifier.train(docs, labels.where("label > 1"))
    assert {r.p for r in quality_classifier.add_score(docs, flat, "text", "p").collect()} == {0.5}
    assert quality_classifier.add_score(none, weights, "text", "p").count() == 0


def test_mix_meets_targets_and_repeats_itself(spark, docs, none):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 300))) for k in range(800)]
    frame = _frame(spark, rows)
    parts = mixing.mix(frame, block_words=16, shard_slots=128, group_rows=50)
    got = mixing.taken(*parts).collect()
    again = mixing.taken(*mixing.mix(frame.repartition(3), block_words=16, shard_slots=128, group_rows=50)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    assert all(r["size"] == len(_words(dict(rows)[r.doc_id])) and 0 <= r.taken <= 2 * r["size"] for r in got)
    sizes, took, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r.doc_id % 4] += r["size"]
        took[r.doc_id % 4] += r.taken
        target[r.doc_id % 4] = r.target
    # brute force: deal by weight, stop at twice the size, deal the excess again
    weight, left, full = {0: 3, 1: 1, 2: 2, 3: 3}, 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in full]
        rate = (left - sum(full.values())) / sum(weight[s] for s in open_)
        above = {s: 2.0 * sizes[s] for s in open_ if rate * weight[s] > 2 * sizes[s]}
        if not above:
            break
        full |= above
    want = full | {s: rate * weight[s] for s in open_}
    assert all(target[s] == pytest.approx(want[s]) and abs(took[s] - want[s]) <= 2 * 16 for s in sizes)
    assert mixing.taken(*mixing.mix(none)).count() == 0
    assert len(mixing.taken(*mixing.mix(docs)).collect()) == len(_texts())


def test_mixed_documents_hold_what_is_taken(docs):
    took = sum(r.taken for r in mixing.taken(*mixing.mix(docs)).collect())
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    assert sum(len(_words(r.text)) for r in rows.collect()) == took


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1_000])
def test_permutations_are_permutations(spark, n):
    from pyspark.sql import functions as F

    for epoch in (0, 1):
        frame = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(3), F.lit(epoch)).alias("p"))
        assert sorted(r.p for r in frame.collect()) == list(range(n))


def test_license_spans(spark, none):
    apache = licenses.TEMPLATES["Apache-2.0 notice"]
    changed = apache.replace("compliance", "accordance").replace("obtain a copy", "get one copy")
    texts = [f"words before. {apache} and after", f"x {changed} y", "Released under the MIT License. " * 2, "licensed", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = licenses.license_spans(docs).collect()
    full = [r for r in got if r.doc_id == 0 and r.license == "Apache-2.0 notice"]
    assert full[0].coverage == 1.0 and texts[0][full[0].begin : full[0].end] == apache
    edited = [r for r in got if r.doc_id == 1 and r.license == "Apache-2.0 notice"]
    assert 0.85 < edited[0].coverage < 1.0
    assert [(r.begin, r.end) for r in got if r.doc_id == 2] == [(0, 30), (32, 62)]
    assert {r.doc_id for r in got} == {0, 1, 2} and licenses.license_spans(none).count() == 0


def test_pipeline_runs_on_tables_and_on_nothing(spark, docs, none):
    result = corpus_pipeline.run(spark, SMALL_DIR)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and result.count() > 100
    for frame in (docs, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SMALL_DIR).columns == docs.columns
        assert (corpus_pipeline.STAGES[-1][1](spark, frame, SMALL_DIR).count() > 0) == (frame is docs)
