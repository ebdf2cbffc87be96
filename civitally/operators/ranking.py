"""Group statistics, exact order statistics and ranks that survive hot groups.

A group may hold a third of all rows, so none of these operators sends a whole
large group to one task:

* plain aggregates use Spark's partial aggregation;
* order statistics of a hot group go through a value histogram: only the few
  bins that contain a wanted position are looked at in detail;
* ranks work on distinct values and split hot groups into value bins;
* joining a group's statistics back to its rows salts hot keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import Skew
from ..session import settle


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys match each other; right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    if how in ("left_semi", "left_anti"):
        return left.join(renamed, condition, how)
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def hot_keys(source: DataFrame, keys: Sequence[str], skew: Skew) -> DataFrame:
    """Keys of groups above ``hot_rows`` with the number of salts each needs.

    A hot group also holds at least one row in ``most_hot`` of all rows, so no
    more than ``most_hot`` keys can qualify, whatever the input: that bounds the
    broadcast. Operators given the same source and keys share one such exchange.
    """
    sizes = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.sum("_size")).scalar()
    least = F.greatest(F.lit(skew.hot_rows), F.coalesce(total, F.lit(0)) / skew.most_hot)
    return F.broadcast(
        sizes.filter(F.col("_size") > least).select(
            *keys, F.ceil(F.col("_size") / skew.hot_rows).cast("int").alias("_splits")
        )
    )


Store = Callable[[DataFrame, str], DataFrame]


def kept_stats(
    stats: DataFrame, label: str, store: Store | None, skew: Skew = Skew()
) -> tuple[DataFrame, bool]:
    """(statistics, whether they may be broadcast).

    With ``store`` they are written once and counted; up to ``skew.sent_rows``
    rows of a few numbers each are small enough to send to every task.
    """
    if store is None:
        return stats, False
    layer = store(stats, label)
    return layer, layer.count() <= skew.sent_rows


def attach_group_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    *,
    size: str,
    spread: str,
    source: DataFrame | None = None,
    skew: Skew = Skew(),
    small: bool = False,
    hashed: bool = False,
) -> DataFrame:
    """Left join per-group statistics onto rows.

    ``small`` statistics (see ``kept_stats``) are broadcast, so that the rows stay
    where they are. Else ``hashed`` asks for a hash table of each partition's
    statistics, so that wide rows need no sort; and hot groups are salted: ``size`` is the statistics column with the group's row count and ``spread``
    a row column whose hash distributes a hot group over its salts. ``source``
    is a cheap table with the same groups (default: the rows), from which hot
    groups are counted; a large group of NULL keys is salted as well.
    """
    keys = list(keys)
    if small:
        return null_safe_join(rows, F.broadcast(stats), keys, "left")
    hot = hot_keys(rows if source is None else source, keys, skew)
    salted_rows = null_safe_join(rows, hot, keys, "left").withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(F.col(spread)), F.col("_splits")).cast("int"), F.lit(0)),
    )
    copies = F.greatest(F.ceil(F.col(size) / skew.hot_rows), F.lit(1)).cast("int")
    salted_stats = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    if hashed:
        salted_stats = salted_stats.hint("shuffle_hash")
    return null_safe_join(
        salted_rows.drop("_splits"), salted_stats, [*keys, "_salt"], "left"
    ).drop("_salt")


def value_bin(value: Column, skew: Skew) -> Column:
    """Monotone bin number of a double: ``2**bin_bits`` bins per power of two."""
    scale = 2**skew.bin_bits
    magnitude = F.floor(F.log2(F.abs(value)) * F.lit(float(scale))) + F.lit(1100 * scale)
    return (
        F.when(value == 0, F.lit(0)).when(value > 0, magnitude).otherwise(-magnitude)
    ).cast("bigint")


@dataclass(frozen=True)
class Ranked:
    """Wanted 0-based positions in a group's sorted non-null values."""

    value: str
    positions: Callable[[Column], list[Column]]


def _linear_positions(n: Column, prob: float) -> tuple[Column, Column]:
    h = (n - 1) * F.lit(float(prob))
    return F.floor(h).cast("bigint"), F.ceil(h).cast("bigint")


def quantile_positions(probs: Sequence[float]) -> Callable[[Column], list[Column]]:
    return lambda n: [p for prob in probs for p in _linear_positions(n, prob)]


def interpolate(picked: Column, n: Column, probs: Sequence[float]) -> list[Column]:
    """Linear-interpolation quantiles from the values at quantile_positions."""
    out = []
    for i, prob in enumerate(probs):
        low = F.get(picked, F.lit(2 * i))
        high = F.get(picked, F.lit(2 * i + 1))
        h = (n - 1) * F.lit(float(prob))
        out.append(low + (high - low) * (h - F.floor(h)))
    return out


def grouped_profile(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    moments: Mapping[str, Column] | None = None,
    ranked: Mapping[str, Ranked] | None = None,
    skew: Skew = Skew(),
) -> DataFrame:
    """One row per group: GROUP_ROWS, plain aggregates, exact order statistics.

    Each entry of ``ranked`` gives ``<name>`` (array of the values at the
    wanted positions) and ``<name>_N`` (non-null count). Groups of up to
    ``hot_rows`` rows sort their values in one aggregate; larger groups use the
    histogram route.
    """
    keys = list(keys)
    moments = dict(moments or {})
    ranked = dict(ranked or {})
    aggregates = [F.count(F.lit(1)).alias("GROUP_ROWS")]
    aggregates += [c.alias(name) for name, c in moments.items()]
    if not ranked:
        return rows.groupBy(*keys).agg(*aggregates)

    tagged = null_safe_join(rows, hot_keys(rows, keys, skew), keys, "left")
    cold = F.col("_splits").isNull()
    for name, spec in ranked.items():
        value = F.col(spec.value).cast("double")
        aggregates.append(F.count(F.col(spec.value)).alias(f"{name}_N"))
        aggregates.append(
            F.sort_array(F.collect_list(F.when(cold, value))).alias(f"_{name}_sorted")
        )
    profile = tagged.groupBy(*keys).agg(*aggregates)
    for name, spec in ranked.items():
        n = F.col(f"{name}_N")
        picked = F.array(
            *[F.get(F.col(f"_{name}_sorted"), p.cast("int")) for p in spec.positions(n)]
        )
        profile = profile.withColumn(name, picked).drop(f"_{name}_sorted")
        hot = _hot_order_statistics(tagged.filter(~cold), keys, spec, skew)
        profile = null_safe_join(profile, hot, keys, "left")
        profile = profile.withColumn(
            name, F.when(F.col("_picked").isNotNull(), F.col("_picked")).otherwise(F.col(name))
        ).drop("_picked")
    return profile


def _hot_order_statistics(
    rows: DataFrame, keys: list[str], spec: Ranked, skew: Skew
) -> DataFrame:
    """Order statistics of hot groups: histogram first, then the wanted bins."""
    values = (
        rows.select(*keys, F.col(spec.value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .withColumn("_bin", value_bin(F.col("_v"), skew))
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        values.groupBy(*keys, "_bin")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        .withColumn("_n", F.sum("_c").over(group))
    )
    wanted_here = F.exists(
        F.array(*spec.positions(F.col("_n"))),
        lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_c")),
    )
    # at most one bin per wanted position and hot group; its size is left to the planner
    targets = bins.filter(wanted_here).select(*keys, "_bin", "_before", "_n")
    counts = (
        null_safe_join(values, targets, [*keys, "_bin"], "inner")
        .groupBy(*keys, "_bin", "_before", "_n", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    inside = (
        Window.partitionBy(*keys, "_bin")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counts.withColumn(
        "_below", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    )
    picks = [
        F.max(
            F.when(
                (F.col("_below") <= p) & (p < F.col("_below") + F.col("_c")), F.col("_v")
            )
        )
        for p in spec.positions(F.col("_n"))
    ]
    return placed.groupBy(*keys).agg(F.array(*picks).alias("_picked"))


def grouped_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, Sequence[float], Sequence[str]]],
    *,
    moments: Mapping[str, Column] | None = None,
    skew: Skew = Skew(),
) -> DataFrame:
    """Exact linear-interpolation quantiles per group.

    ``wanted`` maps a scratch name to (value column, probabilities, output
    names); ``<scratch>_N`` holds the non-null count.
    """
    profile = grouped_profile(
        rows,
        keys,
        moments=moments,
        ranked={
            name: Ranked(value, quantile_positions(probs))
            for name, (value, probs, _) in wanted.items()
        },
        skew=skew,
    )
    outputs: dict[str, Column] = {}
    for name, (_, probs, names) in wanted.items():
        columns = interpolate(F.col(name), F.col(f"{name}_N"), probs)
        outputs.update(zip(names, columns))
    return profile.withColumns(outputs).drop(*wanted)


def value_bins(
    counts: DataFrame, keys: Sequence[str], value: str, skew: Skew = Skew(), store: Store = settle
) -> DataFrame:
    """Distinct (keys, value) rows with ``_splits`` (NULL in groups that stay whole) and
    ``_path``, the value's bin: arrays in the order of the values.

    A bin of a large group that holds more than ``hot_rows`` values is cut into equal
    widths between its lowest and highest value, again and again, until it is small or
    holds one value. The crowded bins of a round are at most ``most_hot``, by the same
    bound as hot keys.
    """
    keys = list(keys)
    number = F.col(value).cast("double")
    if keys:
        binned = null_safe_join(counts, hot_keys(counts, keys, skew), keys, "left")
    else:
        binned = counts.withColumn("_splits", F.lit(1))
    first = F.when(F.col("_splits").isNotNull(), value_bin(number, skew)).otherwise(F.lit(0))
    binned = binned.withColumn("_path", F.array(first.cast("bigint")))
    total = counts.agg(F.count(F.lit(1))).scalar()
    least = F.greatest(F.lit(skew.hot_rows), F.coalesce(total, F.lit(0)) / skew.most_hot)
    for _ in range(4):  # 16 more bits each; a double has no more than this
        crowded = store(
            binned.filter(F.col("_splits").isNotNull()).groupBy(*keys, "_path").agg(
                F.count(F.lit(1)).alias("_values"), F.min(number).alias("_low"),
                F.max(number).alias("_high"),
            ).filter((F.col("_values") > least) & (F.col("_low") < F.col("_high"))).drop("_values"),
            "crowded_bins",
        )
        if crowded.isEmpty():
            break
        part = (number - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.lit(2.0**16)
        binned = null_safe_join(binned, F.broadcast(crowded), [*keys, "_path"], "left").withColumn(
            "_path",
            F.when(F.col("_low").isNull(), F.col("_path")).otherwise(
                F.concat("_path", F.array(F.floor(part).cast("bigint")))),
        ).drop("_low", "_high")
    return binned


def value_ranks(
    rows: DataFrame, keys: Sequence[str], value: str, skew: Skew = Skew(), store: Store | None = None
) -> DataFrame:
    """Distinct (keys, value) with CNT, BELOW (rows strictly smaller) and N. The
    distinct values are stored (``store``: ``settle``), as every step reads them."""
    keys, store = list(keys), store or settle
    counts = store(
        rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("CNT")),
        "distinct_values",
    )
    binned = value_bins(counts, keys, value, skew, store)
    large = binned.filter(F.col("_splits").isNotNull())
    in_bin = Window.partitionBy(*keys, "_path")
    earlier = in_bin.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = binned.withColumns(
        {
            "_inside": F.coalesce(F.sum("CNT").over(earlier), F.lit(0)),
            "_bin_rows": F.sum("CNT").over(in_bin),
        }
    )
    # Offsets in two levels: powers of two (some two thousand at most), then the
    # bins inside one, so that no task orders all bins.
    power = F.floor(F.get("_path", F.lit(0)) / F.lit(2**skew.bin_bits)).alias("_power")
    bins = large.groupBy(*keys, "_path").agg(F.sum("CNT").alias("_c")).select("*", power)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    powers = bins.groupBy(*keys, "_power").agg(F.sum("_c").alias("_pc")).select(
        *keys,
        "_power",
        F.coalesce(
            F.sum("_pc").over(
                group.orderBy("_power").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_below_power"),
        F.sum("_pc").over(group).alias("_n"),
    )
    within = Window.partitionBy(*keys, "_power").orderBy("_path").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = null_safe_join(
        bins.withColumn("_here", F.coalesce(F.sum("_c").over(within), F.lit(0))),
        powers, [*keys, "_power"], "left",
    ).select(*keys, "_path", (F.col("_below_power") + F.col("_here")).alias("_before"), "_n")
    return null_safe_join(local, offsets, [*keys, "_path"], "left").select(
        *keys,
        value,
        "CNT",
        (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_inside")).alias("BELOW"),
        F.coalesce(F.col("_n"), F.col("_bin_rows")).alias("N"),
    )


def average_percent(below: Column, count: Column, n: Column) -> Column:
    """Share of the group at or below the average rank of a tie, 0..1."""
    return (below + (count + 1) / 2.0) / n


def percent_rank_of(
    rows: DataFrame,
    value: str,
    out: str,
    *,
    spread: str,
    keys: Sequence[str] = (),
    scale: float = 100.0,
    skew: Skew = Skew(),
    store: Store | None = None,
) -> DataFrame:
    """Average-tie percentile rank of ``value`` within ``keys`` (or overall).

    Rows without a value get NULL and take no part in the shuffle.
    """
    keys = list(keys)
    known = rows.filter(F.col(value).isNotNull())
    missing = rows.filter(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    ranks = value_ranks(known, keys, value, skew, store).select(
        *keys,
        value,
        F.col("CNT").alias("_ties"),
        (average_percent(F.col("BELOW"), F.col("CNT"), F.col("N")) * scale).alias(out),
    )
    ranked = attach_group_stats(
        known, ranks, [*keys, value], size="_ties", spread=spread, skew=skew
    ).drop("_ties")
    return ranked.unionByName(missing)


def bounded_rank_table(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Percentile rank table of a score with few possible values.

    Rule and statistical scores are whole numbers 0..100, so the table has at
    most 101 rows whatever the data size.
    """
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("CNT"))
    one = Window.partitionBy(F.lit(0))
    below = F.coalesce(
        F.sum("CNT").over(one.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return counts.select(
        value,
        (average_percent(below, F.col("CNT"), F.sum("CNT").over(one)) * 100.0).alias(out),
    )


def running_number(
    rows: DataFrame, order: str, out: str, skew: Skew = Skew(), store: Store | None = None
) -> DataFrame:
    """Number rows 1..n by a unique numeric column without a global window."""
    ranks = value_ranks(rows, [], order, skew, store)
    return rows.join(
        ranks.select(F.col(order), (F.col("BELOW") + 1).alias(out)), order, "left"
    )


def first_per_key(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, last: bool = False
) -> DataFrame:
    """Keep one whole row per key: the first (or last) by ``order``.

    An aggregate of the row struct, so copies of a hot key collapse before the
    shuffle instead of being sorted in one task. NULL keys form one group. Keys and
    columns named in ``order`` are sent once; rows equal in ``order`` are told apart by
    their other columns.
    """
    types = {f.name: f.dataType for f in rows.schema.fields}
    # grouping makes one of -0.0 and 0.0, so a floating key stays in the row as well
    held = [k for k in keys if not isinstance(types[k], (T.DoubleType, T.FloatType))]
    order = [c for c in order if not (isinstance(c, str) and c in held)]
    named = {c: f"_o{i}" for i, c in enumerate(order) if isinstance(c, str)}
    rest = [c for c in rows.columns if c not in held and c not in named]
    first = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)]
    if any(_unordered(types[c]) for c in rest):
        named, rest = {}, [c for c in rows.columns if c not in held]
        pick = F.max_by if last else F.min_by
        best = pick(F.struct(*rest), F.struct(*first) if first else F.lit(0))
    elif first or rest:
        best = (F.max if last else F.min)(F.struct(*first, *rest))
    else:
        best = F.lit(0)
    kept = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(best.alias("_row"))
    row = F.col("_row")
    return kept.select(*[
        (F.col(f"_k_{c}") if c in held else row[named.get(c, c)]).alias(c) for c in rows.columns
    ])


def _unordered(kind: T.DataType) -> bool:
    """Whether values of the type cannot be compared."""
    return any(word in kind.simpleString() for word in ("map<", "variant", "interval"))
