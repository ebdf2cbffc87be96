"""The Jaccard join and components against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from civitally.llm import jaccard
from civitally.llm.components import components
from civitally.llm.queries import QUERIES

from .conftest import ODD, SCHEMA, prose

SMALL = "/root/testdata/sf0.001"


def word_set(text, k=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i: i + k]) for i in range(len(words) - k + 1))


def brute(rows, percent=85):
    """(doc_id, set size, component) of rows of (doc_id, text)."""
    sets = [(i, word_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for at, (i, a) in enumerate(sets):
        for j, b in sets[:at]:
            if i is None or j is None or not a or not b:
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def got(df, **options):
    return sorted(map(tuple, jaccard.join(df, **options).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def edited(text, changes, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = rng.choice(["new", "", "x y", words[at].upper()])
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    """Chains of edits around the limit, in sets of many sizes."""
    rng = random.Random(11)
    rows, n = [], 0
    for size in (1, 2, 3, 4, 5, 8, 9, 10, 13, 20, 30, 60, 120, 300, 700):
        for turn in range(3):
            text = prose(size * 10 + turn, size)
            for _ in range(7):
                rows.append((n, text))
                n += 1
                text = edited(text, min(size, rng.randint(0, max(1, size // 25))), rng)
    rng.shuffle(rows)
    return rows


def test_chains_of_edits(spark, copies):
    want = brute(copies)
    assert len({c for _, _, c in want}) < len(want)
    assert got(frame(spark, copies).repartition(5)) == want


@pytest.mark.parametrize("seed", range(3))
def test_star_does_not_hide_links(spark, seed):
    """Members that link with each other but not with the centre of their cells."""
    rng = random.Random(seed)
    base = prose(99 + seed, 260)
    rows = [(0, base)]
    for i in range(1, 60):
        rows.append((i, edited(rng.choice(rows)[1], rng.randint(1, 9), rng)))
    want = brute(rows)
    assert len({c for _, _, c in want}) > 1
    assert got(frame(spark, rows).repartition(3)) == want


def test_large_neighbourhoods_are_split(spark, monkeypatch):
    rng = random.Random(5)
    base = prose(7, 200)
    rows = [(0, base)] + [(i, edited(base, rng.randint(3, 9), rng)) for i in range(1, 50)]
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    assert got(frame(spark, rows)) == brute(rows)


def test_families_without_their_original(spark):
    """Copies of a lost original, four edits each: cells shared by many documents that
    do not link. The search passes on links that join components and nothing else."""
    rng = random.Random(8)
    rows = []
    for family in range(3):
        base = prose(800 + family, 200)
        rows += [(family * 100 + i, edited(base, 4, rng)) for i in range(60)]
    rows += [(900, edited(rows[5][1], 1, rng)), (901, edited(rows[70][1], 1, rng))]
    want = brute(rows)
    docs = frame(spark, rows).select("doc_id", "text").repartition(4)
    layer = jaccard.describe(docs, jaccard.Bands(), 4)
    pairs = jaccard.star_pairs(layer)
    none = spark.createDataFrame([], "id bigint, root bigint")
    points = layer.select("doc_id", "n_shingles", "counts")
    links = jaccard.tree_links(pairs, none, points, docs, 85, 4).collect()
    of = {i: c for i, _, c in want}
    assert links and all(of[r["a"]] == of[r["b"]] for r in links)
    assert len(links) < len(rows)
    assert got(frame(spark, rows)) == want


def test_a_quoted_passage_makes_no_neighbours(spark):
    """Texts that share a passage and nothing else meet in a few cells, too few to link."""
    rng = random.Random(12)
    passage = prose(600, 45)
    rows = [(i, f"{prose(3000 + i, 50)} {passage} {prose(4000 + i, 50)}") for i in range(150)]
    rows += [(500 + i, edited(rows[i][1], 1, rng)) for i in range(5)]
    docs = frame(spark, rows).select("doc_id", "text").repartition(4)
    layer = jaccard.describe(docs, jaccard.Bands(), 4)
    met = {c for r in layer.collect() for c in r["met"]}
    assert len(met) > 3  # cells of the passage
    pairs = {(r["a"], r["b"]) for r in jaccard.star_pairs(layer).collect()}
    assert {(i, 500 + i) for i in range(5)} <= pairs <= {
        (a, b) for a in range(150) for i in range(5) for b in (i, 500 + i)}
    assert len(pairs) < 30
    for parts in (1, 4):
        assert got(frame(spark, rows).coalesce(parts)) == brute(rows)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_the_cells_they_must(percent):
    """The least number of common cells holds for pairs at the limit, in all bands."""
    rng = np.random.default_rng(percent)
    bands = jaccard.Bands(percent)
    seen = 0
    for a in [*range(2, 60), *range(60, 700, 17), 1500, 4000]:
        for b in {a, a + 1, a * 100 // percent, (a + a * 100 // percent) // 2}:
            least = jaccard.needed(a, b, percent)
            if least > a:
                continue
            tokens = rng.integers(0, 2**64 - 1, a + b - least, np.uint64)
            x, y = np.sort(tokens[:a]), np.sort(tokens[a - least:])
            (kx, weak, tx), (ky, _, ty) = jaccard.cells(x, bands), jaccard.cells(y, bands)
            if not weak:
                seen += 1
                assert len(np.intersect1d(kx, ky)) >= max(tx, ty)
    assert seen > 50


def test_cells_are_dealt_once(spark):
    rows = [(i, prose(i % 30, 40)) for i in range(60)]
    layer = jaccard.settle(jaccard.describe(
        frame(spark, rows).select("doc_id", "text"), jaccard.Bands(), 4), "cells")
    met = jaccard.met_pairs(layer)
    assert met.filter("n > 9").count()
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Generate explode(cells") == 1 and "ReusedExchange" in plan


def chunk_rows(monkeypatch):
    """What ``describe`` makes of a chunk."""
    monkeypatch.setattr(jaccard, "map_rows", lambda df, schema, rows, *a: rows)
    return jaccard.describe(None, jaccard.Bands(), 4)


def lists_of(column):
    return [np.asarray(x).tolist() for x in (
        column.to_pylist() if isinstance(column, pa.Array) else column)]


def test_cells_of_a_chunk_take_little_memory(monkeypatch):
    """A task's Python memory grows by little more than what it hands on."""
    rows = chunk_rows(monkeypatch)
    texts = [prose(i % 900, 250) + f" end {i}" for i in range(1000)]
    batch = pa.record_batch({"doc_id": pa.array(range(1000), pa.int64()), "text": pa.array(texts)})
    rows(batch.slice(0, 10))
    tracemalloc.start()
    try:
        made = rows(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    cells, met = lists_of(made["cells"]), lists_of(made["met"])
    keys = sum(map(len, cells)) + sum(map(len, met))
    assert keys > 50_000 and any(met)
    assert peak < 70 * keys


def test_cells_of_a_chunk_are_kept_by_their_first_document(monkeypatch):
    rows = chunk_rows(monkeypatch)
    rng = random.Random(13)
    base = prose(50, 120)
    texts = [base, None, edited(base, 2, rng), prose(51, 70), "", base, edited(base, 3, rng)]
    ids = [9, 8, None, 4, 3, 2, 1]
    made = rows(pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts)}))
    bands, first, held = jaccard.Bands(), {}, {}
    want = []
    for at, (i, text) in enumerate(zip(ids, texts)):
        tokens = jaccard.shingles(text)
        copy = at == 5  # of row 0
        keys = [] if i is None or copy else jaccard.cells(tokens, bands)[0].tolist()
        for k in keys:
            first.setdefault(k, at)
            held[k] = held.get(k, 0) + 1
        want.append(keys)
    for at, keys in enumerate(want):
        own = [k for k in keys if first[k] == at]
        met = [k for k in keys if first[k] != at]
        assert lists_of(made["cells"])[at] == own and lists_of(made["met"])[at] == met
        assert lists_of(made["met_by"])[at] == [ids[first[k]] for k in met]
        assert list(made["lent"])[at] == sum(held[k] > 1 for k in own)
    assert made["copy_of"] == [None] * 5 + [9, None] and any(lists_of(made["met"]))
    empty = rows(pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": pa.array([""])}))
    assert lists_of(empty["cells"]) == lists_of(empty["met_by"]) == [[]] and list(empty["lent"]) == [0]


def test_long_sets_make_small_blocks(spark, monkeypatch):
    rng = random.Random(6)
    base = prose(9, 300)
    rows = [(0, base)] + [(i, edited(base, rng.randint(6, 12), rng)) for i in range(1, 40)]
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 900)
    assert got(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("sent", [0, 4_000_000])
def test_many_rows_without_id(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "SENT_IDS", sent)
    a = prose(21, 60)
    rows = [(None, a)] * 30 + [(None, "")] * 5 + [(4, a), (9, a + " end"), (2, prose(22, 60))]
    assert got(frame(spark, rows).repartition(3)) == brute(rows)


def test_sets_with_too_few_cells(spark, copies):
    """With hardly any groups most sets take the exact way by single tokens."""
    bands = jaccard.Bands(spare=0)
    rows = [r for r in copies if len(r[1].split()) < 40]
    assert got(frame(spark, rows), bands=bands) == brute(rows)


def test_guarantee_of_the_bands():
    bands = jaccard.Bands()
    for a in [*range(1, 400), 1000, 5000, 20_000]:
        for b in range(a, a * 100 // 85 + 1):
            least = jaccard.needed(a, b)
            if least > a:
                continue
            assert a + b - 2 * least <= bands.differ(a)
            assert bands.of(a)[0] in bands.of(b)
    for k, groups in enumerate(bands.groups[:40]):
        assert groups > bands.differ(bands.lows[k + 1] - 1)


def test_odd_rows(spark, odd, none):
    want = brute([(i, t) for i, t, *_ in ODD])
    assert got(odd) == want
    assert jaccard.join(none).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = prose(1, 50), prose(2, 50)
    rows = [(5, a), (5, b), (7, a), (3, b + " more")]
    assert [r[2] for r in got(frame(spark, rows))] == [3, 3, 3, 3]


def test_a_third_of_all_rows_are_copies(spark):
    rng = random.Random(2)
    base = prose(3, 90)
    rows = [(i, base) for i in range(100)]
    rows += [(100 + i, edited(base, 1, rng)) for i in range(100)]
    rows += [(200 + i, prose(500 + i, 90)) for i in range(100)]
    rng.shuffle(rows)
    pairs = jaccard.star_pairs(jaccard.describe(
        frame(spark, rows).repartition(6).select("doc_id", "text"), jaccard.Bands(), 4))
    assert pairs.count() < 3000  # far from all pairs
    assert got(frame(spark, rows).repartition(6)) == brute(rows)


def test_registered_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet")
            .select("doc_id", "text").collect()]
    rows = QUERIES["op8_ngram_jaccard"](spark, SMALL).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["id"]: r["root"] for r in rows} == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
