"""Exact quantiles of many numeric columns in two vectorised passes.

Melting forty columns would multiply the rows; instead each task histograms
its Arrow batches. The first pass counts values per bin of an order-preserving
integer key, the second looks only at the few bins holding a wanted position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import finite
from ..session import settle
from .ranking import interpolate, null_safe_join, quantile_positions

MANTISSA_BITS = 52


def order_key(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles they stand for."""
    raw = (values + 0.0).view(np.int64)
    return np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw)


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, where = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    names: Sequence[str],
    bits: int = 12,
) -> DataFrame:
    """COLUMN, N, LOWEST, HIGHEST and one column per probability.

    ``bits`` mantissa bits make a bin; a bin is as narrow as 2**-bits of its
    values. Columns without values are left out. Runs the first pass at once.
    """
    shift = MANTISSA_BITS - bits
    numbers = df.select(
        *[finite(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]
    )

    def known(batch: pd.DataFrame, i: int) -> np.ndarray:
        values = batch[f"c{i}"].to_numpy(dtype=float, na_value=np.nan)
        return values[~np.isnan(values)]

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            for i in range(len(columns)):
                values = known(batch, i)
                if len(values):
                    keys, counts, ends = seen.setdefault(i, ([], [], []))
                    unique, n = np.unique(order_key(values) >> shift, return_counts=True)
                    keys.append(unique)
                    counts.append(n)
                    ends.append((values.min(), values.max()))
        for i, (keys, counts, ends) in seen.items():
            unique, n = _counted(keys, counts)
            low, high = min(e[0] for e in ends), max(e[1] for e in ends)
            yield pd.DataFrame({"i": i, "bin": unique, "c": n, "lo": low, "hi": high})

    schema = "i int, bin long, c long, lo double, hi double"
    whole = Window.partitionBy("i")
    earlier = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        numbers.mapInPandas(histogram, schema)
        .groupBy("i", "bin")
        .agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumns(
            {
                "before": F.coalesce(F.sum("c").over(earlier), F.lit(0)),
                "n": F.sum("c").over(whole),
                "lowest": F.min("lo").over(whole),
                "highest": F.max("hi").over(whole),
            }
        )
    )
    positions = quantile_positions(probs)
    holds_one = F.exists(
        F.array(*positions(F.col("n"))),
        lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("c")),
    )
    # at most two bins per column and probability
    targets = bins.filter(holds_one).select("i", "bin", "before", "n", "lowest", "highest").toPandas()
    wanted = {i: np.sort(t["bin"].to_numpy()) for i, t in targets.groupby("i")}

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, chosen in wanted.items():
                values = known(batch, i)
                bin_of = order_key(values) >> shift
                values = values[np.isin(bin_of, chosen)]
                if len(values):
                    unique, n = np.unique(values, return_counts=True)
                    yield pd.DataFrame(
                        {"i": i, "bin": order_key(unique) >> shift, "v": unique, "c": n}
                    )

    described = F.broadcast(df.sparkSession.createDataFrame(
        [
            (int(t.i), columns[int(t.i)], int(t.bin), int(t.before), int(t.n), float(t.lowest), float(t.highest))
            for t in targets.itertuples()
        ],
        "i int, COLUMN string, bin long, before long, n long, lowest double, highest double",
    ))
    in_bin = Window.partitionBy("i", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        numbers.mapInPandas(inside, "i int, bin long, v double, c long")
        .groupBy("i", "bin", "v")
        .agg(F.sum("c").alias("c"))
        .withColumn("run", F.coalesce(F.sum("c").over(in_bin), F.lit(0)))
        .join(described, ["i", "bin"])
        .withColumn("below", F.col("before") + F.col("run"))
    )
    picks = [
        F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("c")), F.col("v")))
        for p in positions(F.col("n"))
    ]
    picked = placed.groupBy("COLUMN", "n", "lowest", "highest").agg(F.array(*picks).alias("picked"))
    values = interpolate(F.col("picked"), F.col("n"), probs)
    return picked.select(
        "COLUMN", F.col("n").alias("N"), F.col("lowest").alias("LOWEST"),
        F.col("highest").alias("HIGHEST"), *[v.alias(name) for v, name in zip(values, names)],
    )


def _group_codes(batch: pd.DataFrame, by: Sequence[str], known: dict[tuple, int]) -> np.ndarray:
    """Number of each row's group; groups not in ``known`` yet are added to it."""
    if not by:
        known.setdefault((), 0)
        return np.zeros(len(batch), np.int64)
    local, values = pd.MultiIndex.from_frame(batch[list(by)]).factorize()
    numbers = [known.setdefault(_plain(v), len(known)) for v in values]
    return np.array(numbers, np.int64)[local]


def _plain(values: tuple) -> tuple:
    return tuple(None if pd.isna(v) else v for v in values)


class _Moments:
    """Counts, means and squared deviations of many columns by group."""

    def __init__(self, columns: int):
        self.n = np.zeros((0, columns))
        self.mean, self.m2 = self.n.copy(), self.n.copy()

    def add(self, values: np.ndarray, codes: np.ndarray, groups: int) -> None:
        grow = ((0, groups - len(self.n)), (0, 0))
        self.n, self.mean, self.m2 = (np.pad(a, grow) for a in (self.n, self.mean, self.m2))
        order = np.argsort(codes, kind="stable")
        values, codes = values[order], codes[order]
        start = np.flatnonzero(np.diff(codes, prepend=-1))
        at = codes[start]
        missing = np.isnan(values)
        n = np.add.reduceat((~missing).astype(float), start, axis=0)
        rows = np.diff(start, append=len(codes))
        # Taken from a value of the group, so that equal values deviate by exactly nothing.
        base = np.nan_to_num(np.fmin.reduceat(values, start, axis=0))
        above = np.where(missing, 0.0, values - np.repeat(base, rows, axis=0))
        mean = base + np.add.reduceat(above, start, axis=0) / np.maximum(n, 1)
        apart = np.where(missing, 0.0, values - np.repeat(mean, rows, axis=0))
        m2 = np.add.reduceat(apart**2, start, axis=0)
        both = self.n[at] + n
        self.mean[at] = np.where(self.n[at] > 0, self.mean[at], mean)
        gap = mean - self.mean[at]
        share = n / np.maximum(both, 1)
        self.m2[at] += m2 + gap**2 * self.n[at] * share
        self.mean[at] += gap * share
        self.n[at] = both


# Sign, exponent and some mantissa bits first, then the rest of a double in steps.
RADIX_WIDTHS = (20, 16, 16, 12)


def _radix(values: np.ndarray, level: int) -> np.ndarray:
    """The bits of each value's order key that a level looks at."""
    key = (order_key(values).view(np.uint64)) ^ np.uint64(1 << 63)
    below = 64 - sum(RADIX_WIDTHS[: level + 1])
    mask = np.uint64((1 << RADIX_WIDTHS[level]) - 1)
    return ((key >> np.uint64(below)) & mask).astype(np.int64)


def _bin_counts(labels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins in order, values in each, different values in each)."""
    order = np.lexsort((values, labels))
    labels, values = labels[order], values[order]
    start = np.flatnonzero(np.diff(labels, prepend=labels[0] - 1))
    new = np.ones(len(labels), np.int64)
    new[1:] = (labels[1:] != labels[:-1]) | (values[1:] != values[:-1])
    return labels[start], np.diff(start, append=len(labels)), np.add.reduceat(new, start)


class _Chosen:
    """Bins of one column that were chosen level by level. ``find`` gives for each value
    the number of its bin at the last level, for those that are in one."""

    def __init__(self, groups: np.ndarray, bins: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.narrow(groups, bins)

    def narrow(self, parents: np.ndarray, bins: np.ndarray) -> None:
        self.levels.append((parents << RADIX_WIDTHS[len(self.levels)]) + bins)

    def find(self, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for level, chosen in enumerate(self.levels):
            label = (codes << RADIX_WIDTHS[level]) + _radix(values, level)
            at = np.searchsorted(chosen, label)
            there = chosen[np.minimum(at, len(chosen) - 1)] == label
            values, codes = values[there], at[there]
        return values, codes


def grouped_column_profile(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str],
    probs: Sequence[float],
    names: Sequence[str],
    *,
    most_targets: int = 1_000_000,
    most_in_bin: int = 100_000,
    store: Callable[[DataFrame, str], DataFrame] = settle,
) -> DataFrame | None:
    """``by``, COLUMN, N, MEAN, STD and one exact quantile for each probability.

    Like ``column_quantiles`` by group: rows are never melted. A radix selection: tasks
    send histograms and moments of (group, column), which are stored; while a bin that
    holds a wanted position may have more than ``most_in_bin`` different values (those of
    each batch are added up) it is cut by the next bits in a pass of its own, until one
    bin is one value; a last pass takes the values inside the bins. Those, two at most for each group, column and
    probability, go through the driver. None if there could be more than
    ``most_targets`` of them: use ``ranking.grouped_quantiles`` then. Columns without
    values in a group are left out.
    """
    outer, by, spark = list(by), [f"_by{i}" for i in range(len(by))], df.sparkSession
    numbers = df.select(
        *[F.col(c).cast("string").alias(name) for c, name in zip(outer, by)],
        *[finite(F.col(c).cast("double")).alias(f"_c{i}") for i, c in enumerate(columns)],
    )
    value_names = [f"_c{i}" for i in range(len(columns))]
    width = RADIX_WIDTHS[0]

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[tuple, int] = {}
        moments = _Moments(len(columns))
        held: list[list[tuple]] = [[] for _ in columns]

        def added(parts: list[tuple]) -> tuple:
            keys, counts, different = (list(x) for x in zip(*parts))
            return *_counted(keys, counts), _counted(keys, different)[1]

        for batch in batches:
            codes = _group_codes(batch, by, groups)
            values = batch[value_names].to_numpy(dtype=float, na_value=np.nan)
            moments.add(values, codes, len(groups))
            for i, parts in enumerate(held):
                there = ~np.isnan(values[:, i])
                if there.any():
                    some = values[there, i]
                    parts.append(_bin_counts((codes[there] << width) + _radix(some, 0), some))
                    if len(parts) > 50:
                        parts[:] = [added(parts)]
        labels = pd.DataFrame(list(groups), columns=by)

        def labelled(code: np.ndarray, **data) -> pd.DataFrame:
            out = pd.DataFrame(data)
            for c in by:
                out[c] = labels[c].to_numpy()[code]
            return out[[*by, "i", "bin", "c", "d", "mean", "m2"]]

        for i, parts in enumerate(held):
            if parts:
                unique, n, different = added(parts)
                yield labelled(unique >> width, i=i, bin=unique & ((1 << width) - 1), c=n,
                               d=different, mean=0.0, m2=0.0)
                code = np.flatnonzero(moments.n[:, i])
                yield labelled(code, i=i, bin=-1, c=moments.n[code, i].astype(np.int64), d=0,
                               mean=moments.mean[code, i], m2=moments.m2[code, i])

    by_schema = "".join(f"{c} string, " for c in by)
    partial = store(
        numbers.mapInPandas(histogram, by_schema + "i int, bin long, c long, d long, mean double, m2 double"),
        "column_histograms",
    )
    if by and partial.select(*by).distinct().count() * len(columns) * 2 * len(probs) > most_targets:
        return None

    positions = quantile_positions(probs)
    holds_one = F.exists(
        F.array(*positions(F.col("n"))),
        lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("c")),
    )
    whole = Window.partitionBy(*by, "i")
    earlier = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = partial.filter("bin >= 0").groupBy(*by, "i", "bin").agg(
        F.sum("c").alias("c"), F.sum("d").alias("d")
    ).withColumns(
        {"before": F.coalesce(F.sum("c").over(earlier), F.lit(0)), "n": F.sum("c").over(whole)})
    targets = bins.filter(holds_one).select(*by, "i", "bin", "before", "n", "d").toPandas()
    known: dict[tuple, int] = {}
    targets["g"] = _group_codes(targets, by, known) if len(targets) else 0
    targets = targets.drop(columns=by).astype(np.int64).assign(parent=lambda t: t["g"])
    chosen: dict[int, _Chosen] = {}

    def inside(emit: Callable[[np.ndarray, np.ndarray, int], pd.DataFrame]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                codes = _group_codes(batch, by, dict(known))
                for i, bins in chosen.items():
                    values = batch[f"_c{i}"].to_numpy(dtype=float, na_value=np.nan)
                    there = ~np.isnan(values)
                    values, at = bins.find(values[there], codes[there])
                    if len(values):
                        yield emit(values + 0.0, at, i)
        return run

    def placed_in(counts: DataFrame, order: str) -> DataFrame:
        """Counts within the targets, with the number of values before each."""
        within = Window.partitionBy("i", "at").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        described = spark.createDataFrame(
            targets[["i", "at", "g", "before", "n"]].astype(np.int64),
            "i long, at long, g long, before long, n long")
        return (
            counts.groupBy("i", "at", order).agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
            .withColumn("run", F.coalesce(F.sum("c").over(within), F.lit(0)))
            .join(F.broadcast(described), ["i", "at"])  # at most most_targets rows of numbers
            .withColumn("before", F.col("before") + F.col("run"))
        )

    for level in range(len(RADIX_WIDTHS)):
        targets = targets.sort_values(["i", "parent", "bin"], ignore_index=True)
        targets["at"] = targets.groupby("i").cumcount()
        for i, part in targets.groupby("i"):
            parents, found = part["parent"].to_numpy(), part["bin"].to_numpy()
            if level:
                chosen[int(i)].narrow(parents, found)
            else:
                chosen[int(i)] = _Chosen(parents, found)
        if targets.empty or targets["d"].max() <= most_in_bin or level + 1 == len(RADIX_WIDTHS):
            break

        def finer(values: np.ndarray, at: np.ndarray, i: int, level: int = level + 1) -> pd.DataFrame:
            label = (at << RADIX_WIDTHS[level]) + _radix(values, level)
            unique, n, different = _bin_counts(label, values)
            return pd.DataFrame({
                "i": i, "at": unique >> RADIX_WIDTHS[level],
                "bin": unique & ((1 << RADIX_WIDTHS[level]) - 1), "c": n, "d": different})

        counts = numbers.mapInPandas(inside(finer), "i long, at long, bin long, c long, d long")
        targets = placed_in(counts, "bin").filter(holds_one).select(
            "i", F.col("at").alias("parent"), "bin", "g", "before", "n", "d").toPandas()

    def values_of(values: np.ndarray, at: np.ndarray, i: int) -> pd.DataFrame:
        found = pd.DataFrame({"at": at, "v": values}).groupby(["at", "v"], sort=False).size()
        return found.rename("c").reset_index().assign(i=i, d=1)[["i", "at", "v", "c", "d"]]

    placed = placed_in(
        numbers.mapInPandas(inside(values_of), "i long, at long, v double, c long, d long"), "v")
    picks = [
        F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("c")), F.col("v")))
        for p in positions(F.col("n"))
    ]
    picked = placed.groupBy("g", "i", "n").agg(F.array(*picks).alias("picked"))
    labels = spark.createDataFrame(
        [(code, *values) for values, code in known.items()], "g long" + (", " + by_schema[:-2] if by else "")
    )
    center = partial.filter("bin < 0").groupBy(*by, "i").agg(
        F.sum("c").alias("N"),
        F.array_sort(F.collect_list(F.struct("mean", "c", "m2"))).alias("parts"),  # one for each task
    )
    base = F.get("parts", F.lit(0))["mean"]
    above = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["c"] * (p["mean"] - base))
    center = center.withColumn("MEAN", base + above / F.col("N"))
    apart = F.aggregate(
        "parts", F.lit(0.0),
        lambda a, p: a + p["m2"] + p["c"] * (p["mean"] - F.col("MEAN")) * (p["mean"] - F.col("MEAN")),
    )
    center = center.select(
        *by, F.col("i").cast("long").alias("i"), "N", "MEAN",
        F.when(F.col("N") > 1, F.sqrt(apart / (F.col("N") - 1))).alias("STD"),
    )
    values = interpolate(F.col("picked"), F.col("n"), probs)
    named = picked.join(F.broadcast(labels), "g").select(
        *by, "i", *[v.alias(name) for v, name in zip(values, names)])
    columns_of = F.get(F.array(*[F.lit(c) for c in columns]), F.col("i").cast("int"))
    return null_safe_join(center, named, [*by, "i"], "inner").select(
        *[F.col(name).cast(df.schema[c].dataType).alias(c) for c, name in zip(outer, by)], columns_of.alias("COLUMN"), "N",
        "MEAN", "STD", *names)
