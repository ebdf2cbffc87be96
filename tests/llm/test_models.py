"""Classifiers on held out documents, and the vector search."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from civitally.llm import attention, toxicity, vafile
from civitally.llm.labelled import training_texts
from civitally.llm.queries import QUERIES

from .conftest import ODD, prose

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, folds, fold, limit", [
    ("op4_attention_quality", "quality", 4, 2, 0.7), ("op9_noisy_or_toxicity", "toxic", 5, 0, 0.5)])
def test_held_out_accuracy(spark, name, label, folds, fold, limit):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % folds == fold for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= limit)).all()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    both = got[got["held_out"]].merge(labels, on="doc_id")
    assert (both["predicted"] == both[label]).mean() >= 0.95


def bags(kind: str, n: int):
    """Documents of which a share holds one bad passage or sentence among good ones."""
    rows = []
    for i in range(n):
        bad = i % 2 == (0 if kind == "quality" else 1)
        if kind == "quality":
            parts = [prose(i * 9 + k, 150) for k in range(3)]
            if bad:
                parts[i % 3] = " | ".join(prose(i, 300).split())
            text = "\n".join(parts)
        else:
            text = ". ".join(prose(i * 9 + k, 12) for k in range(5))
            if bad:
                text += f". you {random.Random(i).choice(['zorgon', 'zorgling', 'brutz'])} there"
        rows.append((i, text))
    return rows


def test_quality_from_document_labels(spark, labels):
    docs = spark.createDataFrame(bags("quality", 200), "doc_id bigint, text string")
    model = attention.train(docs, labels)
    rows = attention.score(docs, model).collect()
    unseen = [r for r in rows if r["held_out"]]
    assert len(unseen) > 20 and all(r["predicted"] == r["doc_id"] % 2 for r in unseen)
    kept = attention.keep(docs, model)
    assert kept.schema == docs.schema
    assert {r["doc_id"] % 2 for r in kept.collect()} == {1}


def test_toxic_sentences_are_found(spark, labels):
    docs = spark.createDataFrame(bags("toxic", 200), "doc_id bigint, text string")
    model = toxicity.train(docs, labels.withColumn("toxic", F.col("quality")))
    rows = toxicity.score(docs, model).collect()
    unseen = [r for r in rows if r["held_out"]]
    assert len(unseen) > 20 and all(r["predicted"] == r["doc_id"] % 2 for r in unseen)
    found = toxicity.locate(docs, model).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 200, 2))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(" you " in r["sentence"] and texts[r["doc_id"]][r["start"]: r["end"]] == r["sentence"]
               for r in found)


def test_labels_of_the_held_out_fold_are_not_used(spark, labels):
    docs = spark.createDataFrame(bags("quality", 200), "doc_id bigint, text string")
    changed = labels.withColumn("quality", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(0)
    ).otherwise(F.col("quality")))
    one, two = (attention.score(docs, attention.train(docs, x)).toPandas() for x in (labels, changed))
    assert np.allclose(one.sort_values("doc_id")["score"], two.sort_values("doc_id")["score"])


def test_odd_rows_and_missing_labels(odd, none, labels):
    for module in (attention, toxicity):
        for known in (labels, labels.limit(0), labels.filter("doc_id = 4")):
            model = module.train(odd, known)
            rows = module.score(odd, model).collect()
            assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
            assert module.score(none, model).count() == 0
        assert module.train(none, labels) is not None
    assert toxicity.score(odd, toxicity.train(odd, labels)).filter("doc_id < 3").first()["score"] == 0
    assert toxicity.locate(none, toxicity.train(odd, labels)).count() == 0
    assert attention.keep(odd, attention.train(odd, labels)).dtypes == odd.dtypes


def test_passages_are_the_whole_text():
    for n in (0, 1, 10, 799, 800, 5000):
        text = prose(n, n) if n % 2 else "x" * n
        assert b"".join(attention.passages(text)) == text.encode()
        assert all(len(p) <= 2 * attention.PASSAGE for p in attention.passages(text))


# ---- vectors ----------------------------------------------------------------


def brute(rows, k, every):
    good = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, k=5, every=4, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df = df.selectExpr("*", "1 as class", "2 as h1", "3 as query")
    return sorted(map(tuple, vafile.top_k(df, k, every, **options).collect()))


@pytest.mark.parametrize("bits, block", [(1, 10), (3, 50), (6, 1000)])
def test_vectors(spark, bits, block):
    rng = np.random.default_rng(bits)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 7)]) for i in range(300)]
    got = found(spark, rows, bits=bits, data_block=block, query_block=20)
    assert got == brute(rows, 5, 4)


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(100)]
    rows += [(100 + i, [float(x) for x in rng.integers(-2, 3, 3) / 4]) for i in range(150)]
    rows += [(7, [0.5, -0.25, 0.125]), (400, None), (404, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]),
             (408, [float("nan"), 0.0, 0.0]), (412, [float("inf"), 0.0, 0.0]), (416, [0.0, 0.0, 0.0])]
    assert found(spark, rows) == brute(rows, 5, 4)


def test_short_vectors_and_few_rows(spark):
    assert found(spark, [(0, [1.0, 1.0]), (1, [1.0]), (2, [])]) == [
        (0, 1, 1, 4096), (0, 2, 2, 0)]
    assert found(spark, [(4, [1.0])]) == [] and found(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert found(spark, []) == []


def exact_lists(rows, k, every):
    """Products as whole numbers of any size, cut to the range of a long."""
    whole = [(i, [math.floor(64 * x) if abs(64 * x) < 2**53 else int(64 * x) for x in v]) for i, v in rows]
    out = []
    for q, a in whole:
        if q % every:
            continue
        best = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -2**63), 2**63 - 1), i)
                      for i, b in whole if i != q)
        out += [(q, at + 1, i, -s) for at, (s, i) in enumerate(best[:k])]
    return sorted(out)


@pytest.mark.parametrize("big", [[], [1e12], [1e300, -1e300, 3e9, 1e12], [4e4] * 30])
def test_large_components(spark, big):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    for at, x in enumerate(big):
        rows[at * 4][1][at % 6] = x
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    made = vafile.top_k(df, 5, 4, data_block=32, query_block=8)
    assert sorted(map(tuple, made.collect())) == exact_lists(rows, 5, 4)


def test_components_without_a_finite_multiple_take_no_part(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1e307]), (2, [float("inf")]), (3, [2.0])],
                               "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in vafile.top_k(df, 5, 2).collect()] == [(0, 1, 3, 64 * 128)]


def test_one_text_for_an_id_of_the_sample(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i // 10}") for i in range(50)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id bigint, quality int")
    rows = training_texts(docs, labels, "quality", 4, 9, 100).collect()
    assert sorted(r["doc_id"] for r in rows) == [0, 1, 2, 3, 4]
    again = training_texts(docs.repartition(7), labels, "quality", 4, 9, 100).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
