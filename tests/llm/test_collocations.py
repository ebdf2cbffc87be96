"""Phrase mining against plain counting."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from civitally.config import Skew
from civitally.llm import collocations

from .conftest import SCHEMA


def plain(docs, least, share=80, top=2000, longest=4):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in docs:
        lang = lang or "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            cuts = [(2_000_000 * a // (count[g[:k]] + count[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            inside = any(
                len(o) > len(g) and any(o[i: i + len(g)] == g for i in range(len(o) - len(g) + 1))
                and 100 * b >= share * a for o, b in found.items())
            if not inside:
                rows.append((" ".join(g), a, count[g[:k]], count[g[k:]], score))
        rows.sort(key=lambda r: (-r[4], -r[1], r[0].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s)
                for i, (p, a, left, right, s) in enumerate(rows[:top])]
    return sorted(out)


def mixed(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "of", "New", "york", "ÉCOLE", "école", "|", "a\x01b", "b", "日本", "x\x85y"]
    docs = []
    for i in range(n):
        text = "".join(
            rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"])
            for _ in range(rng.randrange(60)))
        docs.append((i, text + rng.choice(["", "new york city hall ", "of the of the of the"]),
                     rng.choice(["en", "d\te %+\\", None, "und", ""]), "s", 0))
    return docs


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_against_plain_counts(spark, bits):
    docs = mixed(1, 250) + [(None, None, "en", "s", 0), (1, "", None, None, 0)]
    docs += docs[:20]  # repeated rows count
    table = spark.createDataFrame(docs, SCHEMA).repartition(5).selectExpr(
        "*", "1 as words", "2 as weight", "'x' as phrase", "3 as rank", "4 as n", "5 as score")
    got = sorted(map(tuple, collocations.collocations(table, least=8, filter_bits=bits).collect()))
    assert got == plain(docs, 8) and len(got) > 60


def test_limits_and_salted_parts(spark):
    docs = mixed(2, 200)
    table = spark.createDataFrame(docs, SCHEMA)
    got = collocations.collocations(table, least=5, share=50, top=7, skew=Skew(hot_rows=10))
    assert sorted(map(tuple, got.collect())) == plain(docs, 5, share=50, top=7)


def test_salted_choice_of_the_first(spark):
    rows = spark.createDataFrame([(f"g{i % 3}", i % 11, str(i)) for i in range(500)],
                                 "lang string, score int, phrase string")
    from pyspark.sql import functions as F
    order = [F.desc("score"), F.asc("phrase")]
    few = collocations.best_of_each(rows, "lang", order, F.col("phrase"), 13, per_task=20)
    one = collocations.best_of_each(rows, "lang", order, F.col("phrase"), 13)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, one.collect()))
    assert few.count() == 39


def test_long_and_empty_tables(spark):
    docs = [(1, "tick tock " * 40_000, "en", "s", 0), (2, "tick", "en", "s", 0)]
    got = collocations.collocations(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == plain(docs, 30)
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, "en", "s", 0)], SCHEMA)).count() == 0


def test_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    table = collocations.bloom(spark.createDataFrame([(int(k),) for k in keys], "key bigint"), 1 << 18)
    assert collocations.holds(table, keys).all() and len(table) == 1 << 15
    others = rng.integers(-(2**63), 2**63 - 1, 20_000)
    assert collocations.holds(table, others).mean() < 0.01


def test_filter_needs_no_second_python_worker(spark):
    """The filter's bits are made by Spark, behind the Python function that counts."""
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63 - 1, 300)
    keys[:3] = [-1, 0, -(2**63)]
    docs = spark.createDataFrame([(1, "a b " * 40, "en", "s", 0)], SCHEMA)
    counted = collocations.filter_words(collocations.frequent_keys(docs, 2), 1 << 16)
    plan = counted._jdf.queryExecution().toString().partition("Physical Plan")[2]
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("MapInArrow") == 1
    words = collocations.filter_words(
        spark.createDataFrame([(int(k),) for k in keys], "key bigint"), 1 << 16)
    bits = {r["slot"] * 64 + i for r in words.collect() for i in range(64) if r["value"] >> i & 1}
    assert bits == {((k % 2**64) + t * ((k % 2**64) >> 33 | 1)) % (1 << 16)
                    for k in map(int, keys) for t in range(3)}


def test_filter_is_read_in_few_arrays():
    keys = np.arange(200_000)
    tracemalloc.start()
    collocations.holds(np.zeros(1 << 13, np.uint8), keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * len(keys)


def test_states_of_ranges_are_joined(spark):
    paths = [("en\ta\t" + f"w{i:03}\t" * 2, 1) for i in range(200)] + [("en\ta\t", 5), ("en\t", 9)]
    paths += [("en\ta\x01\t", 2), ("a%09b\tx\t", 4)]
    table = spark.createDataFrame(paths, collocations.PATHS).repartition(7)
    got = {(r["lang"], *r["words"]): r["weight"] for r in collocations.united(table, 3).collect()}
    assert got == {("en",): 216, ("en", "a"): 205, ("a\tb",): 4, ("a\tb", "x"): 4}
