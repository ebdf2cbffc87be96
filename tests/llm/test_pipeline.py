"""Stages of the corpus pipeline against brute force on their own input."""

from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civitally.llm import attention, line_dedup
from civitally.llm.common import table
from civitally.session import settle

from .conftest import SCHEMA, prose
from . import test_jaccard
from .test_filters import counts
from .test_jaccard import brute, word_set
from .test_tokens import packed_well

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SMALL, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], SMALL), f"test-{name}").cache())
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "line_dedup", "ngram_jaccard", "best_fit_packing"]
    assert all(s.dtypes == steps[0].dtypes for s in steps[1:5])
    sizes = [s.count() for s in steps[:5]]
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0.5 * sizes[0]


def test_rules_stage(steps):
    """No host of this table is bad enough to go, so the base verdict decides."""
    good = []
    for r in steps[0].collect():
        c = counts(r["text"])
        if c[0] >= 50 and 100 * c[4] <= 50 * c[0]:
            good.append(tuple(r))
    assert rows(steps[1]) == sorted(good, key=str)


def test_classifier_stage(spark, steps):
    labels = table(spark, SMALL, "labels")
    scores = attention.score(steps[1], attention.train(steps[1], labels))
    assert rows(steps[2].select("doc_id")) == rows(scores.filter("predicted = 1").select("doc_id"))
    known = steps[1].join(labels, "doc_id")
    kept = {r["doc_id"] for r in steps[2].select("doc_id").collect()}
    right = [(r["doc_id"] in kept) == bool(r["quality"]) for r in known.collect()]
    assert sum(right) / len(right) > 0.95


def test_lines_stage(steps):
    docs = [tuple(r) for r in steps[2].collect()]
    key = lambda x: "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = Counter(k for d in docs for k in {key(x) for x in d[1].split("\n")} if k)
    want = []
    for doc_id, text, lang, source, _ in docs:
        text = "\n".join(x for x in text.split("\n") if held[key(x)] < 10)
        want.append((doc_id, text, lang, source, len(text)))
    assert rows(steps[3]) == sorted(want, key=str) != rows(steps[2])


@pytest.mark.parametrize("stage", ["classifier", "lines"])
def test_stages_hand_on_few_texts_at_once(monkeypatch, stage):
    """Whole Arrow batches of texts are neither held as Python objects nor handed on."""
    texts = [f"{prose(i, 5)}\nline" if i % 7 else None for i in range(3000)]
    columns = {"doc_id": pa.array(range(3000), pa.int64()), "text": pa.array(texts),
               "drop": pa.array([None] * 3000, pa.null())}

    class Docs:
        schema = StructType().add("doc_id", "long").add("text", "string")

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(line_dedup, "hidden", lambda name: name)
    monkeypatch.setattr(line_dedup, "_joined", lambda docs, *a: docs)
    run = (line_dedup.drop_lines(Docs()) if stage == "lines"
           else attention.keep(Docs(), attention.Model(None, 0.9)))
    made = list(run(iter([pa.record_batch(columns)])))
    assert [x for b in made for x in b.column("doc_id").to_pylist()] == list(range(3000))
    assert [x for b in made for x in b.column("text").to_pylist()] == texts
    assert max(b.num_rows for b in made) <= 500


def test_near_copies_stage(steps):
    docs = [(r["doc_id"], r["text"]) for r in steps[3].collect()]
    want = sorted(i for i, _, c in brute(docs) if i == c)
    assert sorted(r["doc_id"] for r in steps[4].collect()) == want


@pytest.mark.parametrize("repeated", [False, True])
def test_near_copies_by_other_measures(spark, steps, monkeypatch, repeated):
    """Five words and 80 %, where ids are unique and where a row is there twice."""
    monkeypatch.setattr(test_jaccard, "word_set", lambda text: word_set(text, 5))
    docs = steps[3].unionByName(steps[3].filter("doc_id = 1")) if repeated else steps[3]
    want = sorted(i for i, _, c in brute([(r["doc_id"], r["text"]) for r in steps[3].collect()], 80) if i == c)
    made = corpus_pipeline.near_copies(spark, docs, SMALL, words=5, percent=80)
    kept = sorted(r["doc_id"] for r in made.collect())
    assert kept == want and len(want) < steps[4].count()


def test_packing_stage(steps):
    pieces = steps[5].collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in steps[4].collect()}
    bins = packed_well(pieces, 2048)
    assert len(bins) <= 1.02 * sum(r["length"] for r in pieces) / 2048 + 1


def test_run_is_the_stages(spark, steps):
    whole = corpus_pipeline.run(spark, SMALL)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(whole.select(cols)) == rows(steps[5].select(cols))


def test_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0
        made = settle(stage(spark, odd, SMALL), "odd")
        if name != "best_fit_packing":
            assert made.dtypes == odd.dtypes
        if name == "ngram_jaccard":
            ids = [r["doc_id"] for r in made.collect()]
            assert sorted(map(str, ids)) == sorted(map(str, {1, 2, 3, 4, 5, 6, 7, None}))
    two = odd.filter("doc_id is null").unionByName(odd.filter("doc_id is null"))
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    assert stage(spark, two.unionByName(odd), SMALL).filter(F.col("doc_id").isNull()).count() == 3


def test_repeated_ids_lose_no_text(spark):
    """Different texts under one id stay; near copies and equal rows go."""
    a, b, c = (prose(i, 60) for i in (31, 32, 33))
    rows = [(1, a), (1, b), (2, a + " end"), (3, c), (3, c), (4, b), (None, a), (None, a), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    made = corpus_pipeline.near_copies(spark, docs, SMALL)
    assert made.dtypes == docs.dtypes
    want = [(1, a), (1, b), (3, c), (None, a), (None, a), (5, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in made.collect()), key=str) == sorted(want, key=str)
