"""The stored payment summary against a full recomputation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from civitally.operators.aggregates import payment_rows, payment_summary
from civitally.operators.cleaning import dedup_payments
from civitally.streaming.summary import BATCH, PaymentSummaryTable, reload_summary

SCHEMA = ("WORK_ID long, VENDOR_ID long, VENDOR_NAME string, FUND_DISBURSED_AMT decimal(18,2), "
          "EXPENDITURE_DATE date, WORK_STATUS string, IA_NAME string, _ord string")


def made(spark, seed, works, rows=40):
    """Payments of a few works, one of which takes a third; some are landed by other batches too."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        work = 7 if i % 3 == 0 else rng.choice(works)
        vendor, amount = rng.randint(1, 3), rng.choice(["10.00", "20.50", None, "3.10"])
        day = f"date'2024-0{rng.randint(1, 3)}-01'"
        status = rng.choice(["Payment Success", "payment in-progress", None])
        ia = rng.choice([None, "agency", "other"])
        out.append((None if i % 17 == 5 else work, vendor, f"V{vendor}", amount, day, status, ia, f"{seed}-{i:03}"))
    df = spark.createDataFrame([(w, v, n, a, d[5:-1], s, i, o) for w, v, n, a, d, s, i, o in out],
                               "WORK_ID long, VENDOR_ID long, VENDOR_NAME string, A string, D string, "
                               "WORK_STATUS string, IA_NAME string, _ord string")
    return df.select("WORK_ID", "VENDOR_ID", "VENDOR_NAME", F.col("A").cast("decimal(18,2)").alias("FUND_DISBURSED_AMT"),
                     F.to_date("D").alias("EXPENDITURE_DATE"), "WORK_STATUS", "IA_NAME", "_ord")


def full(batches):
    rows = None
    for i, df in sorted(batches.items()):
        one = df.withColumn(BATCH, F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    rows = payment_rows(rows).filter("WORK_ID is not null")
    return content(payment_summary(dedup_payments(rows, [BATCH, "_ord"]), ["_ord"]))


def content(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_repeats_and_withdrawals(spark, tmp_path, seed):
    rng = random.Random(seed)
    table = PaymentSummaryTable(spark, str(tmp_path / "t"), buckets=5, sent_works=0 if seed == 2 else 100)
    forms = {i: [made(spark, 10 * i + k, range(i, i + 9)) for k in (0, 1)] for i in (1, 2, 3)}
    live = {}
    steps = [(i, k) for i in forms for k in (0, 1)]
    rng.shuffle(steps)
    for i, k in [*steps, steps[-1]]:
        table.apply(i, forms[i][k])
        live[i] = forms[i][k]
    assert content(table.summary()) == full(live)
    gone = rng.choice([1, 2, 3])
    table.withdraw(gone)
    table.withdraw(99)
    del live[gone]
    assert content(table.summary()) == full(live)
    table.apply(gone, forms[gone][0])
    live[gone] = forms[gone][0]
    assert content(table.summary()) == full(live)


def test_untouched_buckets_stay_and_empty_batches(spark, tmp_path):
    table = PaymentSummaryTable(spark, str(tmp_path / "t"), buckets=16)
    none = made(spark, 1, [1]).limit(0)
    assert table.summary() is None and table.apply(1, none) is None and table.withdraw(5) is None
    assert table.summary() is None
    base = made(spark, 2, range(100, 140), 90)
    touched = table.apply(2, base)
    assert {r[0] for r in touched.collect()} == {
        r[0] for r in payment_rows(base).select("WORK_ID").dropna().distinct().collect()}
    before = table.version()
    one = made(spark, 3, [7], 3)
    assert [r[0] for r in table.apply(3, one).collect()] == [7]
    after = table.version()
    moved = {b for b in before.summaries if before.summaries[b] != after.summaries[b]}
    assert len(moved) == 1 and len(before.summaries) > 5
    assert content(table.summary()) == full({2: base, 3: one})
    assert content(table.summary(before)) == full({2: base})
    table.apply(3, none)
    table.withdraw(2)
    assert table.summary() is None


def test_a_run_broken_before_the_log_changes_nothing(spark, tmp_path, monkeypatch):
    table = PaymentSummaryTable(spark, str(tmp_path / "t"), buckets=3)
    a, b = made(spark, 4, range(5)), made(spark, 5, range(5))
    table.apply(1, a)

    def broken(version):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(table, "_commit", broken)
        table.apply(2, b)
    assert content(table.summary()) == full({1: a})
    table.apply(2, b)
    assert content(table.summary()) == full({1: a, 2: b})


def test_stream_takes_new_files_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def land(name, *rows):
        (landing / name).write_text("\n".join(json.dumps(dict(
            WORK_RECOMMENDATION_DTL_ID=str(w), WORK_ID="p", FUND_DISBURSED_AMT=a, EXPENDITURE_DATE="01-02-2024",
            VENDOR_ID="5", VENDOR_NAME="V", WORK_STATUS="Payment Success", _ord=o)) for w, a, o in rows))

    table = PaymentSummaryTable(spark, str(tmp_path / "table"), buckets=4)
    go = lambda: reload_summary(spark, str(landing), table, str(tmp_path / "state"))
    land("a.json", (1, "10.00", "1"), (2, "5", "2"), (2, "bad", "3"))
    go()
    land("b.json", (1, "10.00", "4"), (1, "7.50", "5"))
    go()
    go()
    got = {r["WORK_ID"]: (float(r["TOTAL_FUND_DISBURSED_AMT"]), r["PAYMENT_COUNT"]) for r in table.summary().collect()}
    assert got == {1: (17.5, 2), 2: (5.0, 1)}
