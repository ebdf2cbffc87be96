"""Stored works index: pages without a sort, text search without a scan, facets from a cube.

``write_index`` lays a finished hybrid table out in four parts under one folder:

* ``rows``: all works in page order (score descending, id as text), dealt by ranges of
  that order into buckets, a folder each (at most ``MOST_BUCKETS``);
* ``cuts``: each bucket's works and candidates and how many come before it, so that a
  page opens the one or two buckets that hold it and the total needs no scan;
* ``postings``, ``trigrams``: which works' joined text fields hold which three
  characters, in ranges of (trigram, work), and how many works hold each;
* ``cube``: counts and score sums by all facets. Its rows are as many as combinations
  of facet values, whatever the number of works, and sums of it merge.

``write_rows``, ``write_postings`` and ``write_cube`` write one part each, for a reader
that needs no other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import round_even
from ..session import shuffles_freed, write_layer
from . import search

BUCKET_ROWS = 50_000
#: Folders of the rows; more works than fill them make them larger.
MOST_BUCKETS = 1_000
#: Works whose postings one task sorts.
POSTED_ROWS = 50_000
#: So many of a query's trigrams are intersected, the rarest ones.
RAREST = 3
#: Beyond this share of all works, the rarest trigram helps less than reading them.
SCAN_SHARE = 0.1
CUBE_KEYS = (*search.FACETS.values(), "INDEPENDENT_SIGNAL_COUNT", "INVESTIGATION_CANDIDATE")


def _score() -> Column:
    return F.coalesce("HYBRID_RISK_SCORE", F.lit(0.0))


def _order() -> list[Column]:
    return [_score().desc(), F.col("WORK_ID").cast("string").asc()]


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters. The look-ahead goes through the text once; a
    substring for each start would count characters from the front every time."""
    cut = F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))."), F.lit(1))
    return F.array_distinct(cut)


def searched_text(df: DataFrame) -> Column:
    """The lower-case text that ``search.search_text`` looks into."""
    fields = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in search.SEARCH_FIELDS if c in df.columns]
    return F.lower(F.concat_ws(" ", *fields))


def facet_cube(hybrid: DataFrame) -> DataFrame:
    """WORKS and SCORE_SUM for each combination of facet values."""
    return hybrid.groupBy(*CUBE_KEYS).agg(
        F.count(F.lit(1)).alias("WORKS"),
        F.coalesce(F.sum(F.col("HYBRID_RISK_SCORE").cast("decimal(18,1)")), F.lit(0))
        .cast("decimal(38,1)").alias("SCORE_SUM"),
    )


def refresh_cube(cube: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """The cube after rows of the hybrid table went and others came: only those are read."""
    less = facet_cube(gone).withColumns(
        {"WORKS": -F.col("WORKS"), "SCORE_SUM": (-F.col("SCORE_SUM")).cast("decimal(38,1)")})
    return cube.unionByName(less).unionByName(facet_cube(come)).groupBy(*CUBE_KEYS).agg(
        F.sum("WORKS").alias("WORKS"), F.sum("SCORE_SUM").cast("decimal(38,1)").alias("SCORE_SUM")
    ).filter("WORKS <> 0")


def _works(condition: Column | None = None) -> Column:
    n = F.col("WORKS") if condition is None else F.when(condition, F.col("WORKS")).otherwise(0)
    return F.coalesce(F.sum(n), F.lit(0))


def cube_state_overview(cube: DataFrame) -> DataFrame:
    """``search.state_overview`` from the cube alone."""
    candidate = F.col("INVESTIGATION_CANDIDATE") == 1
    rows = cube.groupBy(F.coalesce(F.trim("STATE_NAME"), F.lit("Unknown")).alias("STATE_NAME")).agg(
        _works().alias("ANALYZED_WORKS"), _works(candidate).alias("CANDIDATES"),
        *[_works(candidate & (F.col("HYBRID_RISK_LEVEL") == lv)).alias(lv) for lv in search.LEVELS[:4]],
    )
    rate = F.col("CANDIDATES") / F.col("ANALYZED_WORKS") * 100.0
    return rows.withColumn("CANDIDATE_RATE_PERCENT", round_even(rate, 2)).orderBy(
        F.desc("CANDIDATES"), "STATE_NAME")


def cube_candidates(cube: DataFrame) -> DataFrame:
    return cube.filter(F.col("INVESTIGATION_CANDIDATE") == 1)


def cube_summary(cube: DataFrame, **facets: str | None) -> DataFrame:
    """``search.filtered_summary`` of the candidates from the cube alone."""
    hits = search.facet_filter(cube_candidates(cube), **facets)
    n = F.col("INDEPENDENT_SIGNAL_COUNT")
    mean = F.sum("SCORE_SUM").cast("double") / F.nullif(_works(), F.lit(0))
    return hits.agg(
        _works().alias("TOTAL"),
        *[_works(F.col("HYBRID_RISK_LEVEL") == lv).alias(lv) for lv in search.LEVELS],
        _works(n == 3).alias("ALL_THREE"), _works(n == 2).alias("TWO_METHODS"),
        _works(n == 1).alias("ONE_METHOD"),
        F.coalesce(round_even(mean, 2), F.lit(0.0)).alias("AVERAGE_HYBRID_RISK_SCORE"),
    )


def cube_filter_values(cube: DataFrame, **facets: str | None) -> DataFrame:
    """``search.filter_values`` of the candidates from the cube alone."""
    return search.filter_values(cube_candidates(cube), **facets)


def write_cube(hybrid: DataFrame, path: str) -> WorksIndex:
    write_layer(facet_cube(hybrid), f"{path}/cube", mode="overwrite")
    return WorksIndex(hybrid.sparkSession, path)


def write_rows(hybrid: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> WorksIndex:
    """Rows in page order and the cuts; ``hybrid`` should be a stored layer."""
    buckets = min(max(1, math.ceil(hybrid.count() / bucket_rows)), MOST_BUCKETS)
    ranged = hybrid.repartitionByRange(buckets, *_order()).withColumn("BUCKET", F.spark_partition_id())
    write_layer(ranged.sortWithinPartitions("BUCKET", *_order()), f"{path}/rows", "BUCKET", mode="overwrite")
    # An empty partitioned table keeps no schema.
    ranged.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    index = WorksIndex(hybrid.sparkSession, path)
    sizes = index.part("rows").groupBy("BUCKET").agg(
        F.count(F.lit(1)).alias("WORKS"),
        F.count_if(F.col("INVESTIGATION_CANDIDATE") == 1).alias("CANDIDATES"),
    )
    before = Window.partitionBy(F.lit(0)).orderBy("BUCKET").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each bucket, so one task orders MOST_BUCKETS of them at most.
    sizes.withColumns({
        "WORKS_BEFORE": F.coalesce(F.sum("WORKS").over(before), F.lit(0)),
        "CANDIDATES_BEFORE": F.coalesce(F.sum("CANDIDATES").over(before), F.lit(0)),
    }).coalesce(1).write.mode("overwrite").parquet(f"{path}/cuts")
    return index


def write_postings(index: WorksIndex) -> WorksIndex:
    """Postings of the stored rows and how many works hold each trigram. The texts are
    dealt to tasks before they are cut, so that a work's many postings are not moved:
    each file is in order of (trigram, work) and a search reads a few blocks of each."""
    rows = index.part("rows")
    works = index.part("cuts").agg(F.coalesce(F.sum("WORKS"), F.lit(0))).first()[0]
    texts = rows.select("WORK_ID", "BUCKET", searched_text(rows).alias("_text"))
    dealt = texts.repartition(max(1, math.ceil(works / POSTED_ROWS)), "WORK_ID")
    posted = dealt.select("WORK_ID", "BUCKET", F.explode(trigrams(F.col("_text"))).alias("TRIGRAM"))
    with shuffles_freed(index.spark):
        posted.sortWithinPartitions("TRIGRAM", "WORK_ID").write.mode("overwrite").option(
            "parquet.block.size", str(4 << 20)).parquet(f"{index.path}/postings")
    index.part("postings").groupBy("TRIGRAM").agg(
        F.count(F.lit(1)).alias("WORKS")).repartitionByRange("TRIGRAM").sortWithinPartitions(
        "TRIGRAM").write.mode("overwrite").parquet(f"{index.path}/trigrams")
    return index


def write_index(hybrid: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> WorksIndex:
    """Write all parts; ``hybrid`` should be a stored layer, it is read three times."""
    write_cube(hybrid, path)
    return write_postings(write_rows(hybrid, path, bucket_rows))


@dataclass(frozen=True)
class WorksIndex:
    """Reads what ``write_index`` wrote."""

    spark: SparkSession
    path: str

    def part(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name == "rows":
            reader = reader.schema(self.part("columns").schema)
        return reader.parquet(f"{self.path}/{name}")

    @property
    def cube(self) -> DataFrame:
        return self.part("cube")

    def page(self, scope: str = "candidates", limit: object = 50, offset: object = 0) -> search.Page:
        """The page of ``search.query_works`` without filters. Only buckets that hold
        some of it are read; their numbers, one for each ``limit`` works at most,
        pass through the driver."""
        size, skip = search.clamp_page(limit, offset)
        kind = "WORKS" if scope == "all" else "CANDIDATES"
        cuts, n, start = self.part("cuts"), F.col(kind), F.col(f"{kind}_BEFORE")
        found = cuts.filter((n > 0) & (start < skip + size) & (start + n > skip)).select(
            "BUCKET", start.alias("BEFORE")).collect()
        first = min((r["BEFORE"] for r in found), default=skip)
        rows = search.in_scope(self.part("rows"), scope).filter(
            F.col("BUCKET").isin([r["BUCKET"] for r in found]))
        meta = cuts.agg(F.coalesce(F.sum(kind), F.lit(0)).alias("TOTAL")).select(
            "TOTAL", F.lit(size).alias("LIMIT"), F.lit(skip).alias("OFFSET"),
            (F.lit(skip + size) < F.col("TOTAL")).alias("HAS_MORE"),
        )
        return search.Page(rows.orderBy(*_order()).offset(skip - first).limit(size), meta, size, skip)

    def candidates(self, query: str) -> DataFrame | None:
        """WORK_ID, BUCKET of the works that hold the query's rarest trigrams: all hits
        and perhaps more. None where reading all works is cheaper."""
        text = query.strip().lower()
        wanted = sorted({text[i: i + 3] for i in range(len(text) - 2)})
        if not wanted:
            return None
        counts = {r["TRIGRAM"]: r["WORKS"]
                  for r in self.part("trigrams").filter(F.col("TRIGRAM").isin(wanted)).collect()}
        postings = self.part("postings")
        if len(counts) < len(wanted):  # no work holds one of them
            return postings.select("WORK_ID", "BUCKET").limit(0)
        rarest = sorted(wanted, key=lambda t: (counts[t], t))[:RAREST]
        total = self.part("cuts").agg(F.sum("WORKS")).first()[0]
        if counts[rarest[0]] > SCAN_SHARE * total:
            return None
        few = [t for t in rarest if counts[t] <= SCAN_SHARE * total]
        return postings.filter(F.col("TRIGRAM").isin(few)).groupBy("WORK_ID", "BUCKET").agg(
            F.count(F.lit(1)).alias("HELD")).filter(F.col("HELD") == len(few)).drop("HELD")

    def find(self, query: str | None, **facets: str | None) -> DataFrame:
        """Rows of all works that ``search.search_text`` and the facets let through."""
        rows = self.part("rows")
        known = self.candidates(query) if query and query.strip() else None
        if known is not None:
            buckets = [r["BUCKET"] for r in known.select("BUCKET").distinct().collect()]
            rows = rows.filter(F.col("BUCKET").isin(buckets)).join(
                known.select("WORK_ID"), "WORK_ID", "left_semi")
        return search.facet_filter(search.search_text(rows, query), **facets)
