"""Reversible removal of lines that many documents share.

A line's key is the line without white space at its ends, A-Z in lower case; a
128-bit hash stands for it. The exact table of references (key, number of
documents) takes additions and deletions of documents: ``merge_refs`` adds or
subtracts the references of a batch. Keys with at least ``min_docs`` references
are common; each shard of them has a cuckoo filter that follows the table by
insertions and deletions (``refresh_filters``). Documents are tested against
the filters and only lines that may be common are checked against the table, so
a filter's false positives never drop a line.

A null text is the empty text: one empty line, never dropped. Every row counts
as a document, repeated rows too. Rows without a doc_id work like others. Other
columns are passed through by ``drop_lines``. An empty table gives an empty
table. Filters are sent to executors only while they are below ``filter_bytes``;
beyond that all lines are checked against the table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitally.session import settle

from .common import cut, hidden, map_rows
from .cuckoo import CuckooFilter, Full, built

WHITE = b" \t\n\x0b\x0c\r"
REFS = "k1 bigint, k2 bigint, refs bigint"
FILTERS = "shard int, buckets int, keys bigint, data binary"
MIN_DOCS = 10


def keys_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text as UTF-8 and the hash of each line's key (empty: none)."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    digest = xxhash.xxh3_128_digest
    return lines, [digest(k) if k else b"" for k in (x.strip(WHITE).lower() for x in lines)]


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def line_refs(docs: DataFrame) -> DataFrame:
    """k1, k2, refs: the number of documents that hold each key."""

    def rows(batch: pa.RecordBatch) -> dict:
        found: Counter = Counter()
        for text in batch.column("text"):
            found.update({k for k in keys_of(text.as_py())[1] if k})
        pairs = halves(list(found))
        return {"k1": pairs[:, 0], "k2": pairs[:, 1], "refs": list(found.values())}

    partial = map_rows(docs.select(F.col("text").cast("string")), REFS, rows)
    return partial.groupBy("k1", "k2").agg(F.sum("refs").alias("refs"))


def merge_refs(refs: DataFrame, batch: DataFrame, sign: int = 1) -> DataFrame:
    """The table after a batch of documents came (1) or went (-1)."""
    change = line_refs(batch).withColumn("refs", F.col("refs") * sign)
    return refs.unionByName(change).groupBy("k1", "k2").agg(F.sum("refs").alias("refs")).filter(
        "refs <> 0"
    )


def common_keys(refs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    return refs.filter(F.col("refs") >= min_docs).select("k1", "k2")


def build_filters(common: DataFrame, shards: int) -> DataFrame:
    """One cuckoo filter for each shard of keys (k1 modulo ``shards``)."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = built(rows["k1"].to_numpy(), rows["k2"].to_numpy())
        return pd.DataFrame({
            "shard": [int(rows["shard"].iloc[0])], "buckets": [len(made.table)],
            "keys": [len(rows)], "data": [made.table.tobytes()],
        })

    dealt = common.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, FILTERS)


def refresh_filters(
    filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Filters after the references changed: keys that became common are inserted,
    keys that no longer are common are deleted; a filter that overflows is built
    anew from the table."""
    old = common_keys(before, min_docs).withColumn("was", F.lit(1))
    new = common_keys(after, min_docs).withColumn("now", F.lit(1))
    both = old.join(new, ["k1", "k2"], "full").withColumn(
        "shard", F.pmod("k1", F.lit(shards)).cast("int")
    )

    def refresh(have: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        shard = int((keys if len(keys) else have)["shard"].iloc[0])
        now = keys[keys["now"].notna()]
        if len(have):
            made = CuckooFilter(int(have["buckets"].iloc[0]), have["data"].iloc[0])
            gone, come = keys[keys["now"].isna()], now[now["was"].isna()]
            made.remove(gone["k1"].to_numpy(), gone["k2"].to_numpy())
            try:
                made.add(come["k1"].to_numpy(), come["k2"].to_numpy())
            except Full:
                made = built(now["k1"].to_numpy(), now["k2"].to_numpy())
        else:
            made = built(now["k1"].to_numpy(), now["k2"].to_numpy())
        return pd.DataFrame({"shard": [shard], "buckets": [len(made.table)], "keys": [len(now)],
                             "data": [made.table.tobytes()]})

    return filters.groupBy("shard").cogroup(both.groupBy("shard")).applyInPandas(refresh, FILTERS)


class Filters:
    """The shards' filters in a Python worker."""

    def __init__(self, rows: list[tuple[int, int, bytes]], shards: int):
        self.shards = shards
        self.by_shard = {s: CuckooFilter(b, d) for s, b, d in rows}

    def may_be_common(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), bool)
        shard = pairs[:, 0] % self.shards
        for s in np.unique(shard):
            if s in self.by_shard:
                at = np.flatnonzero(shard == s)
                out[at] = self.by_shard[s].has(pairs[at, 0], pairs[at, 1])
        return out


def candidates(docs: DataFrame, filters: DataFrame | None, shards: int) -> DataFrame:
    """id, k1, k2: the lines of each document that its shard's filter knows."""
    sent = None
    if filters is not None:
        rows = [(r["shard"], r["buckets"], bytes(r["data"])) for r in filters.collect()]
        sent = docs.sparkSession.sparkContext.broadcast((rows, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filters(*sent.value) if sent is not None else None
        for part in cut(batches):
            owners, digests = [], []
            for owner, text in zip(part.column("id").to_pylist(), part.column("text")):
                keys = {k for k in keys_of(text.as_py())[1] if k}
                digests.extend(keys)
                owners.extend([owner] * len(keys))
            pairs = halves(digests)
            keep = known.may_be_common(pairs) if known else np.ones(len(pairs), bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()).filter(pa.array(keep)),
                 pa.array(pairs[keep, 0]), pa.array(pairs[keep, 1])],
                names=["id", "k1", "k2"],
            )

    return docs.mapInArrow(run, "id bigint, k1 bigint, k2 bigint")


def row_key() -> Column:
    """What rows are joined on: a hash of doc_id and text, so that neither rows without
    doc_id nor the texts of a repeated one gather in a group. Rows that share a
    hash by accident get the common keys of both, which drops no other line: a
    line goes only if its own key is common."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def dropped_keys(
    docs: DataFrame, min_docs: int = MIN_DOCS, per_shard: int = 50_000,
    filter_bytes: int = 64 << 20,
) -> DataFrame:
    """id, drop: the common keys of the rows with each ``row_key``."""
    narrow = docs.select(row_key().alias("id"), F.col("text").cast("string").alias("text"))
    refs = settle(line_refs(narrow), "line-refs")
    common = common_keys(refs, min_docs)
    n = common.count()
    shards = max(1, -(-n // per_shard))
    filters = None
    if n * 8 <= filter_bytes:  # at most 8 bytes a key, also after a doubling
        filters = settle(build_filters(common, shards), "line-filters")
    found = candidates(narrow, filters, shards).join(common, ["k1", "k2"], "left_semi")
    return found.groupBy("id").agg(
        F.collect_set(F.struct("k1", "k2")).alias("drop")
    )


def _joined(docs: DataFrame, min_docs: int, drop: str) -> DataFrame:
    known = dropped_keys(docs, min_docs).select(F.col("id").alias(drop + "id"),
                                                F.col("drop").alias(drop))
    return docs.join(known, row_key() == F.col(drop + "id"), "left").drop(drop + "id")


def without(text: str | None, drop: list | None) -> tuple[int, int, bytes]:
    """Lines, dropped lines, and the kept text."""
    lines, keys = keys_of(text)
    if not drop:
        return len(lines), 0, b"\n".join(lines)
    gone = {np.array([d["k1"], d["k2"]], "<i8").tobytes() for d in drop}
    kept = [line for line, key in zip(lines, keys) if key not in gone]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def summary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_lines": [], "n_dropped": [], "kept_sha256": []}
        for text, drop in zip(batch.column("text"), batch.column("__drop")):
            n, gone, kept = without(text.as_py(), drop.as_py())
            out["n_lines"].append(n)
            out["n_dropped"].append(gone)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return {"doc_id": batch.column("doc_id")} | out

    narrow = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return map_rows(_joined(narrow, min_docs, "__drop"),
                    "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string", rows)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the kept text (null stays null) and, if there, its n_chars."""
    schema, drop = docs.schema, hidden("drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 500):
            kept = [
                None if t.as_py() is None else without(t.as_py(), d.as_py())[2].decode()
                for t, d in zip(batch.column("text"), batch.column(drop))
            ]
            changed = {"text": kept}
            if "n_chars" in schema.names:
                changed["n_chars"] = [None if t is None else len(t) for t in kept]
            columns = [
                pa.array(changed[f.name], batch.schema.field(f.name).type)
                if f.name in changed else batch.column(f.name)
                for f in schema
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _joined(docs, min_docs, drop).mapInArrow(run, schema)


SQL = r"""
WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS MATERIALIZED (
  SELECT rid, i, l[i] AS line,
         translate(regexp_replace(regexp_replace(l[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, l, unnest(range(1, len(l) + 1)) AS i FROM base)),
common AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
kept AS (
  SELECT rid, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM lines
  WHERE key NOT IN (SELECT key FROM common) GROUP BY rid)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(t, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (rid)
"""
