"""Exact top-k by inner product with a vector-approximation file.

Components become whole numbers. Equal vectors form a class that keeps its
``k + 1`` smallest ids: no query can need more of them, so a vector with very
many copies costs as much as any other. Every class is written to the
approximation file as one byte per dimension, the number of its cell among
``2^bits`` slices of the dimension's range.

1. Blocks of query vectors scan blocks of cells. A cell gives a lower and an
   upper bound of the inner product; what lies below the block's k-th lower
   bound is left out, then what lies below the k-th lower bound of all blocks.
2. The exact vectors of the rest are read in the order of their bounds: first
   the best ``2k + 2``, then those whose upper bound still reaches the k-th exact
   score. What is left cannot be among the first k.

Bounds and products are sums of doubles, exact while components are small whole
numbers. A vector with a component too large for that is wide: all its products
are computed exactly as whole numbers of any size, in blocks that keep the k + 1
best classes of each query. A score outside the range of a long counts as the
nearest long, for its rank too.

Rows without vec_id, null vectors, and vectors with null or non-finite
components (or whose 64-fold is no finite double) take no part. Shorter vectors count as filled with zeros. Repeated
rows count once; an id with several vectors is as many rows. Other columns are
not read. An empty table, or one without queries, gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civitally.session import settle

K, EVERY, SCALE = 20, 20, 64
DATA_BLOCK, QUERY_BLOCK, SALTS = 16_384, 1024, 16


def whole(embedding: Column) -> Column:
    """floor(64 x) as doubles, which are whole from 2^53 on."""
    return F.transform(embedding, lambda x: F.when(
        F.abs(SCALE * x.cast("double")) < float(1 << 53), F.floor(SCALE * x.cast("double")).cast("double")
    ).otherwise(SCALE * x.cast("double")))


def usable(embedding: Column) -> Column:
    finite = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(SCALE * x.cast("double")) < float("inf")),
    )
    return embedding.isNotNull() & finite


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """h1, h2, ids: the k + 1 smallest ids of each class, in order. Ranked in salts
    first, so that a large class is ranked by several tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for keys in (["h1", "h2", "salt"], ["h1", "h2"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        salted = salted.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")
    return salted.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def scan(bits: int, lows: list[int], widths: list[int], k: int):
    """Bounds of one block of queries against one block of cells."""

    def run(key, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "class": [], "low": [], "high": []}
        if len(data) and len(queries):
            width = np.array(widths, float)
            cells = np.frombuffer(b"".join(data["cells"]), np.uint8).reshape(len(data), -1)
            edge = np.array(lows, float) + cells * width
            ids = data["class"].to_numpy()
            number = queries["class"].to_numpy()
            for at in range(0, len(queries), 128):
                q = np.stack(list(queries["v"].iloc[at: at + 128])).astype(float)
                base = q @ edge.T
                low = base + np.minimum(q, 0) @ (width - 1)[:, None]
                high = base + np.maximum(q, 0) @ (width - 1)[:, None]
                if len(ids) > k:
                    cut = np.partition(low, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
                else:
                    cut = np.full(len(q), -np.inf)
                row, column = np.nonzero(high >= cut[:, None])
                out["query"].append(number[at + row])
                out["class"].append(ids[column])
                out["low"].append(low[row, column])
                out["high"].append(high[row, column])
        return pd.DataFrame({
            n: np.concatenate(x) if x else np.zeros(0, "int64" if n in ("query", "class") else float)
            for n, x in out.items()
        })

    return run


def exact_scan(k: int):
    """The k + 1 best classes of each query of one block against one block of classes,
    by products of whole numbers of any size; ties go to the smaller first id."""

    def run(key, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(data) and len(queries):
            vectors = [[int(x) for x in v] for v in data["v"]]
            ids, first = data["class"].to_numpy(), np.array([i[0] for i in data["ids"]], np.int64)
            for number, v in zip(queries["class"], queries["v"]):
                q = [(i, int(x)) for i, x in enumerate(v) if x]
                score = np.array([
                    min(max(sum(x * w[i] for i, x in q), -1 << 63), (1 << 63) - 1) for w in vectors
                ], np.int64)
                best = np.lexsort((first, ~score))[: k + 1]
                out.extend((int(number), int(ids[b]), int(score[b])) for b in best)
        return pd.DataFrame(out, columns=["query", "class", "score"]).astype("int64")

    return run


def top_k(
    table: DataFrame, k: int = K, every: int = EVERY, bits: int = 6,
    data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score of every query's k best rows. Queries are the
    rows whose vec_id is divisible by ``every``."""
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                        F.col("embedding").alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("e")))
    rows = rows.select("vec_id", whole(F.col("e")).alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    filled = F.concat("v", F.array_repeat(F.lit(0.0), width - F.size("v")))
    # Sums of ``width`` products of two such numbers, and their bounds, are exact.
    most = float(1 << (50 - int(width).bit_length()) // 2)
    rows = settle(
        rows.select("vec_id", filled.alias("v")).select(
            "vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")
        ), "vectors")
    narrow = rows.select("vec_id", "h1", "h2").distinct()
    # One row for each distinct vector; its number is fixed by being stored.
    classes = settle(
        rows.groupBy("h1", "h2").agg(F.first("v").alias("v"))
        .join(smallest_ids(narrow, k), ["h1", "h2"])
        .withColumn("wide", F.exists("v", lambda x: F.abs(x) > most))
        .withColumn("class", F.monotonically_increasing_id()),
        "vector-classes",
    )
    every_class, classes = classes, classes.filter(~F.col("wide"))
    ranges = {
        r["pos"]: (int(r["low"]), int(r["high"])) for r in classes.select(F.posexplode("v"))
        .groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).collect()
    }  # one row for each dimension
    lows = [ranges[i][0] for i in range(len(ranges))]
    widths = [-(-(ranges[i][1] - ranges[i][0] + 1) // (1 << bits)) for i in range(len(ranges))]

    @F.pandas_udf("binary")
    def cells(vectors: pd.Series) -> pd.Series:
        if not len(vectors) or not lows:
            return pd.Series([b""] * len(vectors))
        at = (np.stack(list(vectors)) - np.array(lows)) // np.array(widths)
        return pd.Series([row.tobytes() for row in at.astype(np.uint8)])

    approximations = settle(classes.select("class", cells("v").alias("cells")), "va-file")
    asked = narrow.filter(F.col("vec_id") % every == 0)
    hot = asked.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    salted = every_class.select(
        "h1", "h2", "class", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    queries = settle(
        hot.join(salted, ["h1", "h2", "salt"]).select(F.col("vec_id").alias("query_id"), "class"),
        "vector-queries")
    all_asking = settle(
        every_class.select("class", "v", "wide")
        .join(queries.select("class").distinct(), "class", "left_semi"),
        "query-classes")
    asking = all_asking.filter(~F.col("wide")).drop("wide")
    data_blocks = max(1, -(-approximations.count() // data_block))
    query_blocks = max(1, -(-asking.count() // query_block))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        )

    data = dealt(approximations, "d", data_blocks, "q", query_blocks)
    probes = dealt(asking, "q", query_blocks, "d", data_blocks)
    scanned = data.groupBy("d", "q").cogroup(probes.groupBy("d", "q")).applyInPandas(
        scan(bits, lows, widths, k), "query bigint, class bigint, low double, high double"
    )
    scanned = settle(scanned, "va-bounds")
    by_low = Window.partitionBy("query").orderBy(F.desc("low"), "class")
    cut = (
        scanned.withColumn("place", F.row_number().over(by_low)).filter(F.col("place") <= k + 1)
        .groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("low")).alias("cut"))
    )
    by_high = Window.partitionBy("query").orderBy(F.desc("high"), "class")
    left = scanned.join(cut, "query").filter("cut is null or high >= cut").withColumn(
        "place", F.row_number().over(by_high)
    ).select("query", "class", "high", "place")
    left = settle(left, "va-left")

    def exact(pairs: DataFrame) -> DataFrame:
        vectors = classes.select("class", "v", "ids")
        asked_for = asking.select(F.col("class").alias("query"), F.col("v").alias("w"))
        product = F.aggregate(
            F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b
        ).cast("bigint")
        return pairs.join(vectors, "class").join(asked_for, "query").select(
            "query", "class", "ids", product.alias("score")
        )

    first = settle(exact(left.filter(F.col("place") <= 2 * k + 2)), "va-exact")
    by_score = F.sort_array(F.collect_list("score"), asc=False)
    sure = first.groupBy("query").agg(F.get(by_score, F.lit(k)).alias("sure"))
    second = exact(
        left.filter(F.col("place") > 2 * k + 2).join(sure, "query")
        .filter("sure is null or high >= sure")
    )
    scored = first.unionByName(second)

    def compared(probes: DataFrame, data: DataFrame) -> DataFrame:
        """Blocks of queries against blocks of classes, one side of them wide."""
        blocks = max(1, -(-data.count() // data_block))
        others = max(1, -(-probes.count() // query_block))
        return dealt(data.select("class", "v", "ids"), "d", blocks, "q", others).groupBy("d", "q").cogroup(
            dealt(probes.select("class", "v"), "q", others, "d", blocks).groupBy("d", "q")
        ).applyInPandas(exact_scan(k), "query bigint, class bigint, score bigint")

    wide = every_class.filter("wide")
    if not wide.isEmpty():
        found = compared(all_asking.filter("wide"), every_class).unionByName(compared(asking, wide))
        scored = scored.unionByName(found.join(every_class.select("class", "ids"), "class"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        scored
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score")))
                              .alias("best"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return (
        queries.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
        .withColumnRenamed("class", "query").join(lists, ["query", "salt"])
        .select("query_id", F.posexplode(others).alias("at", "b"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"),
                F.col("b.score").alias("score"))
    )


SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(
           list_transform(q.e, lambda x: CAST(x AS DOUBLE)), list_transform(c.e, lambda x: CAST(x AS DOUBLE))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
