"""A stored payment summary that follows landed, repeated and withdrawn batches.

Payments lie in buckets of works, one folder for each batch and bucket; the
summary lies in the same buckets. Applying a batch recomputes the works that it
touches, now or in its earlier form, from the payments of their buckets and writes
the summaries of these buckets anew; the other buckets stay as they are. What is
valid is told by a numbered log entry, written last, so a broken run changes nothing
and can be repeated. The result depends on the batches only, not on the order of
their arrival: a payment that landed in several batches counts in the smallest id.

One writer at a time; two that log the same number fail, the later one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregates import payment_rows, payment_summary
from ..operators.cleaning import dedup_payments, extract_payments
from ..session import write_layer
from ..sources.schemas import RAW_RECORD

BATCH = "_batch"
LOG = "kind string, id bigint, part string, buckets array<int>"


@dataclass(frozen=True)
class Version:
    """What one log entry says: the folder of each live batch with its buckets, and the
    folder of each bucket's summaries. It grows with batches and buckets, not with rows."""

    number: int = 0
    batches: dict[int, tuple[str, list[int]]] = field(default_factory=dict)
    summaries: dict[int, str] = field(default_factory=dict)


class PaymentSummaryTable:
    """Payment summaries under ``root``, in ``buckets`` buckets (a fixed number for a
    table). ``order`` settles which payment's attributes come first, ``sent_works`` is
    how many touched works are broadcast; more are joined by a shuffle."""

    def __init__(self, spark: SparkSession, root: str, order: Sequence[str] = ("_ord",),
                 *, buckets: int = 64, sent_works: int = 1_000_000):
        self.spark, self.root, self.order = spark, root.rstrip("/"), list(order)
        self.buckets, self.sent_works = buckets, sent_works

    # --- log -------------------------------------------------------------------------

    def _entries(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [s.getPath() for s in files.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("=")[1]) for p in names
                      if files.exists(done(p, "_SUCCESS")))

    def version(self) -> Version:
        entries = self._entries()
        if not entries:
            return Version()
        rows = self.spark.read.schema(LOG).parquet(f"{self.root}/log/v={entries[-1]}").collect()
        return Version(
            entries[-1],
            {r["id"]: (r["part"], list(r["buckets"])) for r in rows if r["kind"] == "batch"},
            {r["id"]: r["part"] for r in rows if r["kind"] == "summary"},
        )

    def _commit(self, version: Version) -> None:
        rows = [("batch", i, part, held) for i, (part, held) in version.batches.items()]
        rows += [("summary", b, part, [b]) for b, part in version.summaries.items()]
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(
            f"{self.root}/log/v={version.number}")

    # --- rows ------------------------------------------------------------------------

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("WORK_ID"), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, kind: str) -> tuple[str, list[int]]:
        """Folder and buckets of the stored rows; crowded buckets are split among tasks."""
        part = uuid.uuid4().hex
        path = f"{self.root}/{kind}/{part}"
        spread = self._bucketed(df).hint("rebalance", F.col("bucket"))
        write_layer(spread.sortWithinPartitions("bucket", "WORK_ID"), path, "bucket")
        schema = T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])
        held = self.spark.read.schema(schema).parquet(path).select("bucket").distinct().collect()
        return part, sorted(r["bucket"] for r in held)

    def _read(self, kind: str, part: str, buckets: Sequence[int]) -> DataFrame:
        base = f"{self.root}/{kind}/{part}"
        return self.spark.read.option("basePath", base).parquet(
            *[f"{base}/bucket={b}" for b in buckets]).drop("bucket")

    def payments(self, version: Version, buckets: Sequence[int]) -> DataFrame | None:
        """Payments of the live batches in these buckets, with their batch."""
        wanted, out = set(buckets), None
        for batch, (part, held) in sorted(version.batches.items()):
            here = sorted(wanted.intersection(held))
            if here:
                rows = self._read("payments", part, here).withColumn(BATCH, F.lit(batch).cast("bigint"))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def summary(self, version: Version | None = None) -> DataFrame | None:
        """All summaries; None as long as no batch holds a payment."""
        version = version or self.version()
        parts: dict[str, list[int]] = {}
        for bucket, part in version.summaries.items():
            parts.setdefault(part, []).append(bucket)
        out = None
        for part, held in sorted(parts.items()):
            rows = self._read("summaries", part, held)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    # --- changes ---------------------------------------------------------------------

    def apply(self, batch: int, payments: DataFrame) -> DataFrame | None:
        """Take a batch in, in place of what its id stood for; returns touched works.

        Payments without a work id or a readable amount do not count.
        """
        rows = payment_rows(payments).filter(F.col("WORK_ID").isNotNull())
        return self._change(batch, self._write(rows, "payments"))

    def withdraw(self, batch: int) -> DataFrame | None:
        """Undo a batch; an unknown id changes nothing."""
        return self._change(batch, None)

    def _change(self, batch: int, stored: tuple[str, list[int]] | None) -> DataFrame | None:
        old = self.version()
        before = old.batches.get(batch)
        live = {i: b for i, b in old.batches.items() if i != batch}
        if stored is not None:
            live[batch] = stored
        changed = [self._read("payments", part, held).select("WORK_ID")
                   for part, held in (b for b in (before, stored) if b is not None) if held]
        new = Version(old.number + 1, live, dict(old.summaries))
        if not changed:
            if live != old.batches:
                self._commit(new)
            return None
        every = changed[0] if len(changed) == 1 else changed[0].unionByName(changed[1])
        part, buckets = self._write(every.distinct(), "touched")
        touched = self._read("touched", part, buckets)
        sent = F.broadcast(touched) if touched.count() <= self.sent_works else touched
        fresh = self._fresh(new, buckets, sent)
        kept = self._kept(old, buckets, sent)
        parts = [p for p in (fresh, kept) if p is not None]
        for b in buckets:
            new.summaries.pop(b, None)
        if parts:
            merged = parts[0] if len(parts) == 1 else parts[0].unionByName(
                parts[1], allowMissingColumns=True)
            part, held = self._write(merged, "summaries")
            new.summaries.update(dict.fromkeys(held, part))
        self._commit(new)
        return touched

    def _fresh(self, version: Version, buckets: list[int], touched: DataFrame) -> DataFrame | None:
        rows = self.payments(version, buckets)
        if rows is None:
            return None
        mine = rows.join(touched, "WORK_ID", "left_semi")
        return payment_summary(dedup_payments(mine, [BATCH, *self.order]), self.order)

    def _kept(self, version: Version, buckets: list[int], touched: DataFrame) -> DataFrame | None:
        known = {b: p for b, p in version.summaries.items() if b in set(buckets)}
        rows = self.summary(Version(version.number, version.batches, known))
        return None if rows is None else rows.join(touched, "WORK_ID", "left_anti")


def reload_summary(
    spark: SparkSession,
    landed: str,
    table: PaymentSummaryTable,
    checkpoint: str,
    schema: T.StructType = RAW_RECORD,
) -> None:
    """Take the payments of newly landed JSON-lines files into the table; a micro-batch
    that is run again after a failure replaces itself."""
    query = (
        spark.readStream.schema(schema).json(landed).writeStream
        .foreachBatch(lambda rows, batch: table.apply(batch, extract_payments(rows)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
