"""Evaluation, ranking and residual aggregates as plain DataFrame operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: n, rmse, mae, r2. Rows with a null on either side don't count."""
    y, p = F.col(label), F.col(prediction)
    d = df.where(y.isNotNull() & p.isNotNull())
    return d.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and F1 weighted by the labels' frequencies, from one count of label and prediction."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n")).where("y is not null and p is not null")
    ends = cells.select("n", F.explode(F.array(F.struct(F.col("y").alias("k"), F.lit(1).alias("t"), F.lit(0).alias("q")), F.struct(F.col("p").alias("k"), F.lit(0).alias("t"), F.lit(1).alias("q")))).alias("e"), (F.col("y") == F.col("p")).alias("hit"))
    per = ends.groupBy("e.k").agg(F.sum(F.col("n") * F.col("e.t")).alias("t"), F.sum(F.col("n") * F.col("e.q")).alias("q"), F.sum(F.when(F.col("hit") & (F.col("e.t") == 1), F.col("n")).otherwise(0)).alias("tp"))
    f1 = F.when(F.col("t") + F.col("q") > 0, 2 * F.col("tp") / (F.col("t") + F.col("q"))).otherwise(0.0)
    return per.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), (F.sum(f1 * F.col("t")) / F.sum("t")).alias("weighted_f1"), F.sum("t").alias("n"))


def ranged(df: DataFrame, order: str, ranges: int = 64) -> DataFrame:
    """Adds __b, the number of the range of a numeric column that a row falls in; ranges hold about as many rows each."""
    cuts = df.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    number = F.lit(0)
    for c in sorted({float(c) for c in cuts}):
        number = number + (F.col(order) > c).cast("int")
    return df.withColumn("__b", number)


def running(df: DataFrame, order: str, value: str, to: str, ranges: int = 64) -> DataFrame:
    """Adds the sum of a column over all rows before, by a numeric column without ties; null: nothing before.

    Rows are dealt out by ranges: sums run within a range, and what lies before each comes from one row for each range.
    """
    by, upto = ranged(df, order, ranges), (Window.unboundedPreceding, -1)
    totals = by.groupBy("__b").agg(F.sum(value).alias("__n")).select("__b", F.sum("__n").over(Window.orderBy("__b").rowsBetween(*upto)).alias("__base"))
    within = F.sum(value).over(Window.partitionBy("__b").orderBy(order).rowsBetween(*upto))
    joined = by.withColumn("__within", within).join(F.broadcast(totals), "__b")  # one row for each range
    return joined.withColumn(to, F.coalesce(F.col("__base") + F.col("__within"), "__base", "__within")).drop("__b", "__base", "__within")


def auc(df: DataFrame, label: str, score: str, ranges: int = 64) -> DataFrame:
    """Area under the ROC curve by ranks of distinct scores; ties count half. Scores are counted before they are ranked."""
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s"))
    by = by.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"))
    below = F.coalesce("below", F.lit(0))
    return running(by, "s", "neg", "below", ranges).agg((F.sum(F.col("pos") * (below + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc_roc"))


#: Counts by value up to so many, as counted, are ranked in one place.
FEW_VALUES = 100_000


def _zones(brackets: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Closed brackets put together where they meet, in order."""
    out: list[tuple[float, float]] = []
    for a, b in sorted(brackets):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def order_statistics(rows: DataFrame, places: Sequence[tuple[int, float, float]]) -> list[float] | None:
    """Values of a column q at places (rank counted from 0, and two values that it lies between): one pass, in bounded memory.

    Rows between brackets are one count for each gap, rows within are counted by value; both come from one aggregation,
    which is kept while the places are looked up. None if a rank isn't in its bracket.
    """
    q, zones = F.col("q"), _zones([(a, b) for _, a, b in places])
    zone = F.lit(2 * len(zones))
    for j in reversed(range(len(zones))):
        a, b = zones[j]
        zone = F.when(q < a, 2 * j).when(q <= b, 2 * j + 1).otherwise(zone)
    by = rows.select(zone.alias("zone"), "q").groupBy("zone", F.when(F.col("zone") % 2 == 1, q).alias("q")).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        size = {r["zone"]: (r["n"], r["kinds"]) for r in by.groupBy("zone").agg(F.sum("n").alias("n"), F.count("q").alias("kinds")).collect()}  # a row for each zone
        before, total = {}, 0
        for k in sorted(size):
            before[k], total = total, total + size[k][0]
        at = [max((k for k in before if before[k] <= rank), default=0) for rank, _, _ in places]
        if any(k % 2 == 0 for k in at):
            return None
        used = sorted(set(at))
        base, total = {}, 0  # ranks among the rows of the zones in use
        for k in used:
            base[k], total = total, total + size[k][0]
        wanted = [rank - before[k] + base[k] for (rank, _, _), k in zip(places, at, strict=True)]
        inside = by.where(F.col("zone").isin(used)).select("q", "n")
        if sum(size[k][1] for k in used) <= FEW_VALUES:
            inside = inside.withColumn("r", F.sum("n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)))
        else:
            inside = running(inside, "q", "n", "r")
        inside, hit = inside.withColumn("r", F.coalesce("r", F.lit(0))), F.lit(False)
        for k in set(wanted):
            hit = hit | ((F.col("r") <= k) & (F.col("r") + F.col("n") > k))
        found = [(r["r"], r["r"] + r["n"], float(r["q"])) for r in inside.where(hit).collect()]  # a row for each place at most
    finally:
        by.unpersist()
    return [next(v for low, high, v in found if low <= k < high) for k in wanted]


def _near(shares: Sequence[float], accuracy: int) -> list[float]:
    """The shares that bracket each place: three times what the sketch may be off."""
    step = 3 / accuracy
    return [x for p in shares for x in (max(0.0, p - step), min(1.0, p + step))]


def quantiles(df: DataFrame, value: Column, shares: Sequence[float], between: bool = False, accuracy: int = 10_000) -> list[float | None]:
    """Exact quantiles: the value at which a share of the rows is reached, or between, weighed by place. Nulls don't count.

    Two passes: a sketch that brackets each place, and the places themselves (see order_statistics).
    """
    rows = df.select(value.cast("double").alias("q")).where("q is not null")
    n, low, high, sketch = rows.agg(F.count(F.lit(1)), F.min("q"), F.max("q"), F.percentile_approx("q", _near(shares, accuracy), accuracy)).first()
    if not n:
        return [None] * len(shares)
    places: list[tuple[int, float, float]] = []
    at = [p * (n - 1) for p in shares] if between else [float(max(0, math.ceil(p * n - 1e-9) - 1)) for p in shares]
    for i, x in enumerate(at):
        bracket = (low, high) if n <= accuracy else (float(sketch[2 * i]), float(sketch[2 * i + 1]))
        places += [(math.floor(x), *bracket), (math.ceil(x), *bracket)]
    # Should a place lie outside what the sketch says, the whole column is its bracket.
    values = order_statistics(rows, places) or order_statistics(rows, [(k, low, high) for k, _, _ in places])
    return [a + (x - math.floor(x)) * (b - a) for x, a, b in zip(at, values[::2], values[1::2], strict=True)]


def grouped_medians(df: DataFrame, by: Sequence[str], value: Column, accuracy: int = 10_000) -> DataFrame:
    """by, median, n: the exact median of each group (the mean of the middle two), in bounded state whatever a group's size.

    One sketch for each group brackets its middle; then rows below and above are counted, those within by value, and
    the middle ranks are found among these: at most the values of a group of so many rows, or of a share of six in
    accuracy of a larger one. Null values and null keys don't count.
    """
    keys, q = list(by), F.col("__q")
    rows = df.select(*keys, value.cast("double").alias("__q")).where("__q is not null")
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"), F.min("__q").alias("__low"), F.max("__q").alias("__high"), F.percentile_approx("__q", _near([0.5], accuracy), accuracy).alias("__b"))
    few = F.col("__all") <= accuracy
    ends = sketch.select(*keys, "__all", F.when(few, F.col("__low")).otherwise(F.col("__b")[0]).alias("__a"), F.when(few, F.col("__high")).otherwise(F.col("__b")[1]).alias("__z"))
    side = F.when(q < F.col("__a"), -1).when(q > F.col("__z"), 1).otherwise(0)
    counts = rows.join(ends, keys).groupBy(*keys, "__all", side.alias("__side"), F.when((q >= F.col("__a")) & (q <= F.col("__z")), q).alias("__q")).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__side", "__q"))
    ranked = counts.withColumn("__upto", upto).where("__side = 0")
    at = lambda k: F.max(F.when((F.col("__upto") > k) & (F.col("__upto") - F.col("__n") <= k), q))
    found = ranked.groupBy(*keys).agg(((at(F.floor((F.col("__all") - 1) / 2)) + at(F.floor(F.col("__all") / 2))) / 2).alias("median"), F.first("__all").alias("n"))
    checked = F.coalesce(F.col("median"), F.raise_error(F.lit("a median lies outside what the sketch of its group says")).cast("double"))
    return found.select(*keys, checked.alias("median"), "n")


_TAILS = {"p00_5": 0.005, "p01": 0.01, "p99": 0.99, "p99_5": 0.995}


def residual_summary(df: DataFrame, residual: Column, accuracy: int | None = 100_000) -> DataFrame:
    """Mean, deviation and four percentiles, in bounded memory: within a rank of one in accuracy, or exact (no accuracy)
    with places in between weighed, at the cost of some more passes."""
    r = df.select(residual.alias("r")).where("r is not null")
    plain = (F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    if accuracy is None:
        exact = quantiles(r, F.col("r"), list(_TAILS.values()), between=True)
        return r.agg(*plain, *(F.lit(v).cast("double").alias(name) for name, v in zip(_TAILS, exact, strict=True)))
    q = F.percentile_approx("r", F.array(*map(F.lit, _TAILS.values())), accuracy)
    return r.agg(*plain, q.alias("q")).select("n", "mean", "sd", *(F.col("q")[k].alias(name) for k, name in enumerate(_TAILS)))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) within the bounds; the upper one belongs to the last bin."""
    width = (high - low) / bins
    v = df.select(value.alias("v")).where((F.col("v") >= low) & (F.col("v") <= high))
    return v.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def grid_counts(df: DataFrame, x: Column, y: Column, cell: float) -> DataFrame:
    """(gx, gy, n): points by square cell, the numbers behind a density plot."""
    return df.groupBy(F.floor(x / cell).cast("int").alias("gx"), F.floor(y / cell).cast("int").alias("gy")).agg(F.count(F.lit(1)).alias("n"))


def range_histogram(df: DataFrame, value: Column, shares: tuple[float, float] = (0.01, 0.99), bins: int = 60) -> tuple[DataFrame, float, float]:
    """(bin, n) between two exact percentiles of the values, and these bounds: a few far-off rows don't set the scale."""
    low, high = (x if x is not None else 0.0 for x in quantiles(df, value, shares, between=True))
    return histogram(df, value, low, high, bins) if high > low else df.select(F.lit(0).alias("bin"), value.alias("v")).where("v is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n")), low, high


def hexagons(df: DataFrame, x: Column, y: Column, low: float, high: float, across: int = 45) -> DataFrame:
    """(lattice, hx, hy, cx, cy, n): points by regular hexagon, so many across the square from low to high.

    The centres of a honeycomb are two lattices of rectangles, one shifted by half a step both ways: a point belongs to
    the nearer of the two centres that it rounds to, distances up counting threefold. cx, cy: the centre. Points beyond
    the outermost hexagons are left out.
    """
    up = int(across / math.sqrt(3))
    pad = 1e-9 * (high - low)
    low, high = low - pad, high + pad
    sx, sy = (high - low) / across, (high - low) / up
    rows = df.select(((x - low) / sx).alias("x"), ((y - low) / sy).alias("y")).where("x is not null and y is not null")
    u, v = F.col("x"), F.col("y")
    whole = (F.floor(u + 0.5), F.floor(v + 0.5))
    half = (F.floor(u), F.floor(v))
    d1 = (u - whole[0]) * (u - whole[0]) + 3.0 * (v - whole[1]) * (v - whole[1])
    d2 = (u - half[0] - 0.5) * (u - half[0] - 0.5) + 3.0 * (v - half[1] - 0.5) * (v - half[1] - 0.5)
    first = d1 < d2
    at = rows.select(F.when(first, 1).otherwise(2).alias("lattice"), *(F.when(first, a).otherwise(b).cast("int").alias(n) for a, b, n in zip(whole, half, ("hx", "hy"), strict=True)))
    more = F.when(F.col("lattice") == 1, 0).otherwise(1)
    kept = at.where(F.col("hx").between(0, across - more) & F.col("hy").between(0, up - more))
    shift = more * 0.5
    return kept.groupBy("lattice", "hx", "hy").agg(F.count(F.lit(1)).alias("n")).select("lattice", "hx", "hy", ((F.col("hx") + shift) * sx + low).alias("cx"), ((F.col("hy") + shift) * sy + low).alias("cy"), "n")


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """With a rank: no sort of the whole input, only of k rows from each task."""
    best = df.orderBy(F.desc(by), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), tie)))


def running_share(df: DataFrame, order: str, value: str) -> DataFrame:
    """Adds cumulative, the sum of a column up to each row, by a numeric column without ties."""
    return running(df, order, value, "__before").withColumn("cumulative", F.coalesce("__before", F.lit(0)) + F.col(value)).drop("__before")


def fingerprint(df: DataFrame, digits: int = 6) -> DataFrame:
    """The exact sum of each numeric column, each value rounded to so many digits first: decimals, so the same for the
    same rows in any order and on any partitioning. NaN, infinities and nulls add nothing; multiset tells them apart."""
    return df.agg(*(F.sum(F.when(F.abs(F.col(c).cast("double")) < 1e24, F.col(c)).cast(f"decimal(38,{digits})")).alias(c) for c in df.columns))


def multiset(df: DataFrame) -> DataFrame:
    """One row (n, digest) that depends on the rows and how often each is there, not on their order: a sum of row hashes.

    Two hashes of 64 bits are summed modulo 2^64 each, so a row that is there twice counts twice.
    """
    half = lambda salt: F.sum(F.xxhash64(*df.columns, F.lit(salt)).cast("decimal(20,0)"))
    word = lambda c: F.lpad(F.lower(F.hex(F.expr(f"CAST(pmod({c}, 18446744073709551616) - IF(pmod({c}, 18446744073709551616) >= 9223372036854775808, 18446744073709551616, 0) AS BIGINT)"))), 16, "0")
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(half(1), F.lit(0)).cast("decimal(38,0)").alias("a"), F.coalesce(half(2), F.lit(0)).cast("decimal(38,0)").alias("b"))
    return sums.select("n", F.concat(word("a"), word("b")).alias("digest"))


def missing_keys(df: DataFrame, within: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys of a table are not in another. Zero: a subset."""
    return df.select(key).distinct().join(within.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
