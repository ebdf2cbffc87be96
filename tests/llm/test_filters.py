"""Quality rules, line dedup, licences."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from checks.compare import duck, rows_of
from pyspark.sql import functions as F

from civitally.llm import cuckoo, license_texts, licenses, line_dedup, quality_rules
from civitally.llm.queries import QUERIES, SQL

from .conftest import ODD, SCHEMA, prose

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(SMALL).execute(SQL[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i: i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i: i + 3])] > 1
               for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def test_rule_counts_of_odd_rows(odd):
    got = quality_rules.verdicts(odd).collect()
    want = []
    for doc_id, text, *_ in ODD:
        c = counts(text)
        want.append((doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_repeated_windows(spark):
    texts = ["a b c a b c d", "a a a a", "x y", "a b c d e f g a b c", "# $ a#b\n# $ a#b\n"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality_rules.verdicts(docs).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("sent", [100, 0])
def test_hosts(spark, monkeypatch, sent):
    monkeypatch.setattr(quality_rules, "SENT_HOSTS", sent)
    good = [(i, prose(i, 80), "en", f"good{i % 5}", 0) for i in range(200)]
    bad = [(1000 + i, "short" if i % 16 else prose(i, 80), "en", "bad", 0) for i in range(160)]
    bad += [(3000 + i, "short" if i % 2 else prose(i, 80), "en", "half", 0) for i in range(80)]
    lone = [(2000, "short", "en", "tiny", 0), (2001, prose(1, 80), "en", None, 0)]
    docs = spark.createDataFrame(good + bad + lone, SCHEMA)
    kept = {r["doc_id"] for r in quality_rules.verdicts(docs).filter("kept").collect()}
    # All of the bad host go, its good documents too; the mixed host keeps its good ones, and
    # a host of one document is pulled to the prior.
    assert kept == {i for i in range(200)} | {2001} | {3000 + i for i in range(0, 80, 2)}
    rates = {r["host"]: r["rate"] for r in quality_rules.host_rates(
        quality_rules.judge(docs, {"host": F.col("source")})).collect()}
    assert len(rates) == 8
    assert rates["bad"] > 0.75 > rates["half"] > rates["good0"] and rates["tiny"] < 1


def test_keep_returns_the_columns(odd, none):
    assert quality_rules.keep(odd).dtypes == odd.dtypes
    assert quality_rules.keep(none).count() == 0 and quality_rules.verdicts(none).count() == 0


# ---- lines ----------------------------------------------------------------


def test_lines_of_odd_rows(odd, none):
    got = sorted(map(tuple, line_dedup.summary(odd, min_docs=2).collect()), key=str)
    want = []
    for doc_id, text, *_ in ODD:
        lines = (text or "").split("\n")
        kept = [] if doc_id == 6 else lines
        want.append((doc_id, len(lines), len(lines) - len(kept),
                     hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert line_dedup.summary(none).count() == 0 and line_dedup.drop_lines(none).count() == 0
    kept = line_dedup.drop_lines(odd, min_docs=2)
    assert kept.dtypes == odd.dtypes
    by_id = {r["doc_id"]: r for r in kept.collect()}
    assert by_id[6]["text"] == "" and by_id[6]["n_chars"] == 0 and by_id[1]["text"] is None
    assert by_id[4]["text"] == "One line only"


def test_keys_and_threshold(spark):
    docs = [(i, f"own {i}\n  Shared LINE\t\nÉcole\n", "en", "s", 0) for i in range(9)]
    ten = docs + [(9, "shared line\nécole\nx", "en", "s", 0)]
    rows = lambda d: {r["doc_id"]: (r["n_lines"], r["n_dropped"])
                      for r in line_dedup.summary(spark.createDataFrame(d, SCHEMA)).collect()}
    assert set(rows(docs).values()) == {(4, 0)}
    # É is no ASCII letter: it keeps its case, so that line is shared by nine only.
    assert rows(ten) == {i: (4, 1) for i in range(9)} | {9: (3, 1)}


def test_without_filters_the_same(spark, odd):
    narrow = odd.select("doc_id", "text")
    with_filters = line_dedup.dropped_keys(narrow, 2).collect()
    without = line_dedup.dropped_keys(narrow, 2, filter_bytes=0).collect()
    key = lambda rows: sorted((str(r["id"]), sorted(map(tuple, r["drop"]))) for r in rows)
    assert key(with_filters) == key(without) and with_filters


def test_additions_are_reversible(spark):
    make = lambda ids: spark.createDataFrame(
        [(i, f"line {i % 7}\nline {i % 3}\nown {i}", "en", "s", 0) for i in ids], SCHEMA)
    first, more = make(range(30)), make(range(100, 140))
    refs = line_dedup.line_refs(first).cache()
    grown = line_dedup.merge_refs(refs, more).cache()
    back = line_dedup.merge_refs(grown, more, -1)
    table = lambda d: sorted(map(tuple, d.select("k1", "k2", "refs").collect()))
    assert table(back) == table(refs) != table(grown)
    filters = line_dedup.build_filters(line_dedup.common_keys(refs), 2).cache()
    up = line_dedup.refresh_filters(filters, refs, grown, 2).cache()
    down = line_dedup.refresh_filters(up, grown, refs, 2)
    common = np.array([tuple(r) for r in line_dedup.common_keys(grown).collect()])
    small = {tuple(r) for r in line_dedup.common_keys(refs).collect()}
    known = lambda f: line_dedup.Filters(
        [(r["shard"], r["buckets"], r["data"]) for r in f.collect()], 2).may_be_common(common)
    assert known(up).all()
    assert {tuple(k) for k in common[known(down)].tolist()} == small


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, (20_000, 2))
    made = cuckoo.built(keys[:10_000, 0], keys[:10_000, 1])
    assert made.has(keys[:10_000, 0], keys[:10_000, 1]).all()
    assert made.has(keys[10_000:, 0], keys[10_000:, 1]).mean() < 0.001
    made.remove(keys[:5000, 0], keys[:5000, 1])
    assert made.has(keys[5000:10_000, 0], keys[5000:10_000, 1]).all()
    assert made.has(keys[:5000, 0], keys[:5000, 1]).mean() < 0.001


# ---- licences ---------------------------------------------------------------


def test_licenses(spark):
    files = [
        (1, "repo/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "repo/sub/COPYING", "Released under the MIT License."),
        (3, "repo/sub/deep/a.txt", prose(1, 40)),
        (4, "repo/other/b.txt", prose(2, 40)),
        (5, "repo/other/c.txt", prose(3, 40) + "\n# this work is LICENSED under the GNU General "
            "Public License, version 3\n" + prose(4, 20)),
        (6, "away/d.txt", prose(5, 10)),
        (7, None, None), (8, "", ""), (None, "repo/e.txt", prose(6, 10)),
        (9, "repo/other/f.txt", "the license of a version is under a work"),
    ]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string")
    got = {r["doc_id"]: (r["license"], r["how"], r["from_dir"])
           for r in licenses.scan(df.withColumn("row", F.lit(1))).collect()}
    assert got == {
        1: ("Apache-2.0", "file", None), 2: ("MIT", "file", None),
        3: ("MIT", "inherited", "repo/sub"), 4: ("Apache-2.0", "inherited", "repo"),
        5: ("GPL-3.0", "own", None), 6: (None, None, None), 7: (None, None, None),
        8: (None, None, None), None: ("Apache-2.0", "inherited", "repo"),
        9: ("Apache-2.0", "inherited", "repo"),
    }
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_of_whole_texts_and_headers(spark):
    header = dict(license_texts.HEADERS)
    mit = license_texts.TEXTS["MIT"].replace("(c)", "(c) 2019 Ada Byron and others")
    code = "\n".join(f"value_{i} = compute(value_{i - 1}, {i})" for i in range(1, 300))
    files = [
        (1, "LICENSE", mit), (2, "a.txt", prose(1, 40)), (3, "x/y/b.txt", prose(2, 40)),
        (4, "x/COPYING", license_texts.TEXTS["GPL-3.0"]), (5, "z/c.txt", prose(3, 40)),
        (6, "z/gpl.py", "# " + header["GPL-3.0"].replace("\n", "\n# ") + code),
        (7, "z/lgpl.py", "#!/usr/bin/env python\n" + header["LGPL-3.0"] + code),
        (8, "z/spdx.c", "// SPDX-License-Identifier: GPL-2.0-only OR MIT\n" + code),
        (9, "w/TITLE", "GNU GENERAL PUBLIC LICENSE"), (10, "z/none.py", code),
        (11, "z/apache.py", header["Apache-2.0"] + code), (12, "v/COPYING", license_texts.TEXTS["AGPL-3.0"]),
        (13, "u/LICENSE", "BSD 3-Clause License\n\n" + license_texts.TEXTS["BSD-3-Clause"]),
        (14, "t/LICENSE", license_texts.TEXTS["BSD-2-Clause"]), (15, "s/spdx.txt", "SPDX-License-Identifier: Zlib"),
    ]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string")
    got = {r["doc_id"]: (r["license"], r["how"], r["from_dir"]) for r in licenses.scan(df).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("MIT", "inherited", ""), 3: ("GPL-3.0", "inherited", "x"),
        4: ("GPL-3.0", "file", None), 5: ("MIT", "inherited", ""), 6: ("GPL-3.0", "own", None),
        7: ("LGPL-3.0", "own", None), 8: ("GPL-2.0-only OR MIT", "own", None),
        9: ("GPL-1.0-or-later", "file", None), 10: ("MIT", "inherited", ""),
        11: ("Apache-2.0", "own", None), 12: ("AGPL-3.0", "file", None),
        13: ("BSD-3-Clause", "file", None), 14: ("BSD-2-Clause", "file", None),
        15: ("Zlib", "file", None),
    }


def test_licenses_of_odd_rows(odd, none):
    assert licenses.scan(licenses.documents_as_files(odd)).count() == len(ODD)
    assert licenses.scan(licenses.documents_as_files(none)).count() == 0


def test_anchors_lose_no_line():
    idf = {w: 1 + len(w) / 10 for _, t in licenses.TEMPLATES for w in licenses.words_of(t)}
    vectors = licenses.template_vectors(licenses.TEMPLATES, idf)
    heavy = set(licenses.anchors(vectors, 0.75))
    for number in {v[0] for v in vectors}:
        rest = sum(w * w for n, _, word, w in vectors if n == number and word not in heavy)
        assert rest < 0.75**2


def test_rows_without_id_gather_nowhere(spark):
    """A third of the rows without id: their lines go by the same rule, and no row
    carries the common lines of the others."""
    rows = [(None if i % 3 == 0 else i, f"own line {i}\nshared {i % 4}\nrare {i % 12}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    made = line_dedup.drop_lines(docs, 10)
    want = [(i, t.split("\n")[0] + "\n" + t.split("\n")[2]) for i, t in rows]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    sizes = line_dedup.dropped_keys(docs, 10).selectExpr("size(drop) as n").collect()
    assert max(r["n"] for r in sizes) == 1
