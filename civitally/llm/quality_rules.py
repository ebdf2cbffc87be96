"""Quality rules of documents and of their hosts; built-in expressions only.

Every document gets counts and a base verdict. The failures are summed for each
host (``source``), the hosts' failure rates are shrunk towards a beta prior
that is estimated from all hosts by moments, and a host whose shrunk rate is
above ``max_host_rate`` loses all its documents.

Null and empty texts have no words and fail. Documents without a source belong
to no host: their base verdict stands. Repeated rows and repeated or missing
doc_ids are judged like any other row. Columns besides doc_id, source and text
are passed through by ``keep`` and do not clash with the counts. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitally.session import settle

from .common import hidden

WHITE = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 3
#: Good documents go with their host only where three quarters of it fail.
MAX_HOST_RATE = 0.75
SENT_HOSTS = 100_000


def counted(docs: DataFrame, text: str, wanted: dict[str, Column]) -> DataFrame:
    """``wanted`` columns of ``docs`` and the counts of column ``text``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words, lines, windows, placed, repeated = (
        hidden(n) for n in ("words", "lines", "windows", "placed", "repeated")
    )
    names = list(wanted)
    split = docs.select(
        *[c.alias(n) for n, c in wanted.items()],
        F.array_remove(F.split(body, WHITE, -1), "").alias(words),
        (F.size(F.split(body, SYMBOL, -1)) - 1).cast("bigint").alias("n_symbols"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(HAS_WORD)).alias(lines),
    )
    n = F.size(words)
    hashed = split.select(
        *names,
        "n_symbols",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.when(
            n >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), n - WINDOW),
                lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")).alias(windows),
    )
    # Most texts repeat no window; only the others sort theirs.
    sorted_windows = hashed.withColumn(
        placed,
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    found = sorted_windows.withColumn(
        repeated,
        F.filter(
            placed,
            lambda p, i: ((i > 0) & (F.get(placed, i - 1)["h"] == p["h"]))
            | ((i < F.size(placed) - 1) & (F.get(placed, i + 1)["h"] == p["h"])),
        ),
    )
    covered = F.flatten(
        F.transform(repeated, lambda p: F.array(*[p["i"] + k for k in range(WINDOW)]))
    )
    return found.select(
        *names,
        *COUNTS[:4],
        F.size(F.array_distinct(covered)).cast("bigint").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_rates(judged: DataFrame) -> DataFrame:
    """host, docs, failures, rate: each host's failure rate under the beta prior."""
    hosts = judged.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).cast("double").alias("docs"),
        F.sum(F.col("base_failed").cast("double")).alias("failures"),
    )
    total = hosts.agg(
        F.sum("docs").alias("n"),
        F.sum("failures").alias("f"),
        F.sum(F.col("docs") * F.col("docs")).alias("n2"),
        F.sum(F.col("failures") * F.col("failures") / F.col("docs")).alias("q"),
        F.count(F.lit(1)).cast("double").alias("k"),
    )
    mean = F.col("f") / F.col("n")
    spread = (F.col("q") - F.col("f") * mean) / F.nullif(mean * (1 - mean), F.lit(0.0))
    free = F.col("n") - F.col("n2") / F.col("n") - (F.col("k") - 1)
    share = (spread - (F.col("k") - 1)) / F.nullif(free, F.lit(0.0))
    # A prior of at most a million documents where hosts do not differ.
    share = F.greatest(F.least(F.coalesce(share, F.lit(0.0)), F.lit(0.5)), F.lit(1e-6))
    prior = total.select(mean.alias("mean"), (1 / share - 1).alias("strength"))
    only = F.broadcast(prior.withColumn("one", F.lit(1)))  # one row
    return (
        hosts.withColumn("one", F.lit(1)).join(only, "one")
        .withColumn("rate", (F.col("failures") + F.col("mean") * F.col("strength"))
                    / (F.col("docs") + F.col("strength")))
        .select("host", "docs", "failures", "rate")
    )


def judge(
    docs: DataFrame, wanted: dict[str, Column], max_host_rate: float = MAX_HOST_RATE, salts: int = 16
) -> DataFrame:
    """``wanted`` columns, counts, base_failed and kept for every row of ``docs``.

    The counts are stored once: host sums and the join back both read that layer.
    Rejected hosts are counted; up to ``SENT_HOSTS`` are broadcast, so the documents
    stay where they are. More are repeated for ``salts`` salts, so that a host with
    a third of all documents is joined by as many tasks.
    """
    host = hidden("host")
    layer = settle(
        counted(docs, "text", wanted | {host: F.col("source").cast("string")})
        .withColumn("base_failed", base_failed()),
        "quality-rules",
    )
    bad = host_rates(layer.select(F.col(host).alias("host"), "base_failed")).filter(F.col("rate") > max_host_rate)
    salt, failed = hidden("salt"), hidden("failed")
    bad = settle(bad.select(F.col("host").alias(host), F.lit(True).alias(failed)), "bad-hosts")
    if bad.count() <= SENT_HOSTS:
        joined = layer.join(F.broadcast(bad), host, "left")
    else:
        row = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        joined = layer.withColumn(salt, row).join(bad.withColumn(salt, each), [host, salt], "left")
    return joined.select(
        *wanted,
        *COUNTS,
        "base_failed",
        (~F.col("base_failed") & F.col(failed).isNull()).alias("kept"),
    )


def verdicts(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, counts, base_failed, kept of every document."""
    return judge(docs, {"doc_id": F.col("doc_id").cast("bigint")}, max_host_rate)


def keep(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    row = hidden("row")
    judged = judge(docs, {row: F.struct(*[F.col(f"`{c}`") for c in docs.columns])}, max_host_rate)
    return judged.filter("kept").select(f"{row}.*")


SQL = r"""
WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
lines AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM base)),
rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1) GROUP BY rid),
counts AS MATERIALIZED (
  SELECT b.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f
  FROM judged WHERE source IS NOT NULL GROUP BY source),
total AS (
  SELECT sum(f) / sum(n) AS m, count(*) - 1 AS k1, sum(n) - sum(n * n) / sum(n) AS eff,
         sum(f * f / n) - sum(f) * sum(f) / sum(n) AS s2 FROM hosts),
prior AS (
  SELECT m, 1 / greatest(least(coalesce((s2 / nullif(m * (1 - m), 0) - k1) / nullif(eff - k1, 0), 0),
                               0.5), 1e-6) - 1 AS strength FROM total)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((f + m * strength) / (n + strength) > 0.75, false) AS kept
FROM judged LEFT JOIN hosts USING (source) CROSS JOIN prior
"""
