"""Periodic runs against a plain search for periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from civitally.llm import runs

from .conftest import ODD, SCHEMA, prose


def plain_runs(w, least=6, times=4):
    """Maximal stretches of each period, kept if no smaller period fits the whole."""
    found = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(least, times * p) and not any(
                all(w[k] == w[k + q] for k in range(i, i + n - q)) for q in range(1, p)
            ):
                found.append((i, n, p))
            i = j + 1 if j > i else i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    # Long texts of one word would take too long here; their run is known.
    found = [(0, n, 1)] if n > 5000 and len(set(w)) == 1 else plain_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, k, p in found for i in range(s + p, s + k)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{k},{p}\n" for s, k, p in found)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=5),
       st.integers(0, 9), st.sampled_from([(6, 4), (2, 2), (4, 3), (8, 5), (5, 4)]))
def test_runs_of_any_sequence(around, unit, repeats, limits):
    w = around + unit * repeats + around[::-1]
    assert runs.runs_of(np.array(w, np.int64), *limits) == plain_runs(w, *limits)


def test_random_sequences():
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice([1, 2, 3])
        w = [rng.randrange(letters) for _ in range(rng.randrange(120))]
        for limits in ((6, 4), (2, 2)):
            assert runs.runs_of(np.array(w, np.int64), *limits) == plain_runs(w, *limits)


def test_long_sequences_stay_quick():
    n = 200_000
    assert runs.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert runs.runs_of(np.arange(n) % 1000) == [(0, n, 1000)]
    assert runs.runs_of(np.arange(n)) == []


def test_summary_of_odd_rows(odd, none):
    got = sorted(map(tuple, runs.summary(odd).collect()), key=str)
    assert got == sorted((plain_row(i, t) for i, t, *_ in ODD), key=str)
    assert runs.summary(none).count() == 0 and runs.spans(none).count() == 0


def test_summary_against_plain_search(spark):
    rng = random.Random(5)
    docs = []
    for i in range(300):
        words = prose(i, rng.randrange(1, 90)).split()
        if rng.random() < 0.5:
            at = rng.randrange(len(words))
            words[at:at] = (words[: rng.randrange(1, 4)]) * rng.randrange(1, 9)
        docs.append((i, rng.choice([" ", "\n", "\t  "]).join(words), "en", "s", 0))
    got = sorted(map(tuple, runs.summary(spark.createDataFrame(docs, SCHEMA)).collect()))
    want = sorted(plain_row(i, t) for i, t, *_ in docs)
    assert got == want and sum(r[1] for r in want) > 50
    # Only every tenth id or so is given a tail that repeats.
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300)) > 10


@pytest.mark.parametrize("repeats", [3, 4])
def test_spans_and_collapsed_texts(spark, repeats):
    text = "see this " + "one more time " * repeats + "end of it"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, None, "en", "s", 7)], SCHEMA)
    found = [tuple(r) for r in runs.spans(docs).collect()]
    kept = {r["doc_id"]: r for r in runs.drop_repeats(docs).collect()}
    if repeats == 3:
        assert not found and kept[1]["text"] == text
    else:
        assert found == [(1, 2, 12, 3, ["one", "more", "time"])]
        assert kept[1]["text"] == "see this one more time end of it"
        assert kept[1]["n_chars"] == len(kept[1]["text"])
    assert kept[2]["text"] is None and kept[2]["n_chars"] == 7


def test_drop_repeats_keeps_columns(odd):
    kept = runs.drop_repeats(odd)
    assert kept.dtypes == odd.dtypes
    by_id = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert by_id[5] == "word" and by_id[3] == " \t\n \r\n" and by_id[2] == ""
