"""Phrase mining against brute force."""

from __future__ import annotations

import collections
import random
import re

import pytest

from idscreen.llm import collocations

_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _expected(rows, support, top):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    f[lang, tuple(words[k : k + size])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= support}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        longer = [b for (other, v), b in found.items() if other == lang and len(v) > len(w)
                  and any(v[k : k + len(w)] == w for k in range(len(v) - len(w) + 1))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    rows = []
    for lang, best in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(rows)


def _rows():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(40)] + ["Über", "ÜBER", "it's", "日本", "\x01", "a b", "\x0e", "İ"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for k in range(300):
        words = []
        for w in rng.choices(vocabulary, weights, k=rng.randint(0, 60)):
            words += ["New", "york", "city"] if rng.random() < 0.05 else [w]
        joins = rng.choices([" ", "  ", "\t", ". ", ",", "\n", "!?", "\r", "\x0b", ":;"], [20, 2, 2, 1, 1, 1, 1, 1, 1, 1], k=len(words))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), "".join(w + j for w, j in zip(words, joins))))
    copies = "one two three four five. one two"
    return rows + [("de", copies)] * 40 + [("fr", None), ("fr", ""), ("fr", " \t.\n"), ("en", "the the the the " * 2_000)]


@pytest.mark.parametrize(
    "options", [{}, {"shards": 1}, {"shards": 7, "fold_bytes": 1_000, "filter_bits": 12}, {"support": 31, "top": 3}]
)
def test_against_brute_force(spark, options):
    rows = _rows()
    options = {"support": 12, "top": 50, "filter_bits": 20, **options}
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    got = sorted(map(tuple, collocations.collocations(frame, **options).collect()))
    assert got == _expected(rows, options["support"], options["top"])


def test_nothing(spark):
    for rows in ([], [("en", None), (None, "a b c")]):
        frame = spark.createDataFrame(rows, "lang string, text string")
        assert collocations.collocations(frame, filter_bits=12).collect() == []


def test_long_texts_are_cut_between_words():
    text = b"ab cd. ef,gh\tij " * 500 + b"x" * 300
    whole = [w for part in collocations.parts(text) for w in part.split()]
    assert [w for part in collocations.parts(text, 64) for w in part.split()] == whole
    assert whole[:8] == [b".", b"ab", b"cd", b".", b"ef", b".", b"gh", b"ij"]
    assert list(collocations.parts(b"")) == [b"."]


def test_scores_need_more_than_64_bits(spark):
    from pyspark.sql import functions as F

    a = 9_000_000_000_000
    frame = spark.createDataFrame([(a, a + 1, a + 2)], "a bigint, l bigint, r bigint")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(20,0)) + r)")
    assert frame.select(score.alias("s")).first().s == 2_000_000 * a // (2 * a + 3)
