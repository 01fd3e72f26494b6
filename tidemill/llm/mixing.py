"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import binary, cut, restrict, session, shared_dir

#: Weights of the sources in order of their names, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: Share of all sizes that the targets sum to, and how many times its source's size a target may be.
SHARE, MOST = Fraction(3, 2), 2
#: Units that one node of the reduction tree rounds: rows of the first level on average, residuals of later ones at most.
FAN = 256
#: Draws that the root of a tree tries; the one with the least words left to round at its end counts.
TRIES = 8
#: Sources of one partition of the table of sources.
SOURCES = 100_000
#: Salt of all draws: the same salt gives the same mix.
SALT = 11
_WORD = r"[^\x20\x09-\x0D]+"
_EXACT = "decimal(38,0)"
_UNIT = "struct<size:bigint,draw:bigint,doc_id:{},part:bigint,p:double>"


@dataclass(frozen=True)
class Level:
    """The water level of the targets: target = min(most * size, weight * rest / weights)."""

    rest: Fraction
    weights: int


def words(text: str | Column) -> Column:
    """Number of runs of characters that are not ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_order(sources: DataFrame, name: str = "source") -> DataFrame:
    """The table with place: from 0, by code points of the name, null last.

    Sorted by ranges, so that no task has all names; the driver sees a row count of each range. The table that comes back
    has a partition for each SOURCES names.
    """
    few = -(-max(1, sources.count()) // SOURCES)
    # A number that rises with the sort: the range in the upper bits, the row within it in the lower 33.
    ranged = cut(sources.orderBy(F.asc_nulls_last(name)).withColumn("place", F.monotonically_increasing_id()).coalesce(few))
    at, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["at"], r["n"]) for r in ranged.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for k, n in counts:
        before.append((k, total))
        total += n
    offsets = session(sources).createDataFrame(before, "at bigint, before bigint")
    return ranged.withColumn("at", at).join(F.broadcast(offsets), "at").withColumn("place", row + F.col("before")).select(*sources.columns, "place")


def water_level(sizes: DataFrame, share: Fraction = SHARE, most: int = MOST) -> Level:
    """The level at which targets by weight, none over most times its size, sum to a share of all sizes.

    sizes: size and weight, one row for each source. A round finds the sources that the present level fills, in one
    aggregation, and raises the level for the rest; it ends when no more are filled. The comparison is exact.
    """
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(_EXACT)
    size, weight = F.col("size").cast("decimal(18,0)"), F.col("weight").cast("decimal(9,0)")
    total, weights = (int(x) for x in sizes.agg(whole(size), whole(weight)).first())
    level, filled = Level(share * total, weights), -1
    while weights:
        num, den = level.rest.numerator, level.rest.denominator * level.weights
        full = F.lit(str(most * den)).cast("decimal(19,0)") * size <= F.lit(str(num)).cast("decimal(28,0)") * weight
        n, held, heavy = (int(x) for x in sizes.where(full).agg(F.count("*"), whole(size), whole(weight)).first())
        if n == filled or heavy == weights:
            break
        filled, level = n, Level(share * total - most * held, weights - heavy)
    return level


def source_targets(sizes: DataFrame, name: str = "source", weights: tuple = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """name, source_size, n, target, base, p for each source: a document is taken base times, and once more with chance p.

    sizes: name, size, n (rows) of each source.
    """
    ranked = source_order(sizes, name)
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    ranked = cut(ranked.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))))
    level = water_level(ranked, share, most)
    size = F.col("size").cast("double")
    if level.weights:
        # One rounding: product and divisor are exact in a double.
        target = F.least(size * most, F.col("weight") * F.lit(float(level.rest.numerator)) / F.lit(float(level.weights * level.rest.denominator)))
    else:
        target = size * most
    target = F.greatest(F.lit(0.0), target)
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(most)), target / size)).otherwise(F.lit(0.0))
    return ranked.select(F.col(name), F.col("size").alias("source_size"), "n", target.alias("target"), F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("p"))


def _draw(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _pivot(a: Column, b: Column, salt: Column) -> Column:
    """Words go from one unit to the other until a fraction is 0 or 1; struct(rest, done).

    The sum of p * size stays; each p stays in expectation. The draw is a hash of both units.
    """
    up_a, down_a = (1 - a["p"]) * a["size"], a["p"] * a["size"]
    up_b, down_b = (1 - b["p"]) * b["size"], b["p"] * b["size"]
    up, down = F.least(up_a, down_b), F.least(down_a, up_b)
    to_a = _draw(a["draw"], a["part"], b["draw"], b["part"], salt) * (up + down) < down
    within = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    unit = lambda x, p: F.struct(*(x[c].alias(c) for c in ("size", "draw", "doc_id", "part")), p.alias("p"))
    zero, one = F.lit(0.0), F.lit(1.0)
    end = lambda rest, p, done, bit: F.struct(unit(rest, within(p)).alias("rest"), unit(done, bit).alias("done"))
    return F.when(
        to_a,
        F.when(up_a <= down_b, end(b, b["p"] - up / b["size"], a, one)).otherwise(end(a, a["p"] + up / a["size"], b, zero)),
    ).otherwise(F.when(down_a <= up_b, end(b, b["p"] + down / b["size"], a, zero)).otherwise(end(a, a["p"] - down / a["size"], b, one)))


def _rounded(units: Column, kind: str, salt: Column) -> Column:
    """struct(rest, done) of a node: its units, largest first, meet the residual of those before them one by one."""
    unit = _UNIT.format(kind)
    start = F.struct(F.lit(None).cast(unit).alias("rest"), F.array().cast(f"array<{unit}>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        met = _pivot(acc["rest"], x, salt)
        first = F.struct(x.cast(unit).alias("rest"), acc["done"].alias("done"))
        return F.when(acc["rest"].isNull(), first).otherwise(F.struct(met["rest"].cast(unit).alias("rest"), F.concat(acc["done"], F.array(met["done"].cast(unit))).alias("done")))

    return F.aggregate(units, start, step)


def _best(units: Column, kind: str, salt: int, tries: int) -> Column:
    """Of so many roundings of a node, with draws of their own, the one whose residual is nearest to an integer in words."""
    found = F.transform(F.array(*(F.lit(salt + 2 + k) for k in range(tries))), lambda k: _rounded(units, kind, k))
    left = lambda rest: F.abs(F.round(rest["p"]) - rest["p"]) * rest["size"]
    return F.array_min(F.transform(found, lambda r, k: F.struct(left(r["rest"]).alias("left"), k.alias("k"), r.alias("r"))))["r"]


def round_units(units: DataFrame, source: str, fan: int = FAN, salt: int = SALT, tries: int = TRIES) -> DataFrame:
    """Integral p for every unit: (source, doc_id, draw, part, size, p).

    units: source, n (units of the source), doc_id, draw, part, size > 0, 0 < p < 1. A tree rounds each source: a node of
    the first level takes some fan units (of a small source, about as many as there are nodes), dealt out by hash, a node
    above the residuals of fan nodes, until one is left. The sum of p * size of a source stays but for the residual of the
    root, which goes to the nearer integer; the root tries several draws, so that few words are left there.
    """
    shared_dir(session(units))
    kind = units.schema["doc_id"].dataType.simpleString()
    n = F.col("n")
    nodes = F.when(n <= fan, F.lit(1)).otherwise(F.ceil(n / F.least(F.lit(fan), F.ceil(F.sqrt(n))))).cast("long")
    item = F.struct(*(F.col(c) for c in ("size", "draw", "doc_id", "part", "p")))
    level = units.withColumn("nodes", nodes).withColumn("node", F.pmod(F.xxhash64("draw", "part", F.lit(salt + 1)), F.col("nodes")))
    out = []
    while True:
        # Units of a node in an order of their own, whatever order they arrive in: by size, then by hash.
        order = F.sort_array(F.collect_list(item), asc=False)
        done = cut(level.groupBy(source, "node", "nodes").agg(order.alias("units")).select(source, "node", "nodes", F.when(F.col("nodes") == 1, _best(F.col("units"), kind, salt, tries)).otherwise(_rounded(F.col("units"), kind, F.lit(salt + 2))).alias("r")))
        out.append(done.select(source, F.explode("r.done").alias("u")))
        out.append(done.where("nodes = 1").select(source, F.col("r.rest").alias("u")).withColumn("u", F.col("u").withField("p", F.round("u.p"))))
        level = done.where("nodes > 1").select(source, "nodes", "node", "r.rest.*")
        if level.isEmpty():
            break
        level = level.withColumns({"node": F.floor(F.col("node") / F.lit(fan)).cast("long"), "nodes": F.ceil(F.col("nodes") / F.lit(fan)).cast("long")})
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows.select(source, "u.*")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: Fraction = SHARE, most: int = MOST, fan: int = FAN, salt: int = SALT) -> DataFrame:
    """One row per document: doc_id, source, draw, size, source_size, target, copies, taken (= copies * size).

    Texts are read once, for their sizes and hashes; what goes on is a short row for each document. A document of a
    source with target t and size s is taken floor(t / s) times, and once more if the rounding says so: chances of a
    source are rounded together, so that its words sum to its target but for at most half a document.

    Null text: size 0, taken 0. Null source: one source, the last. Null and repeated ids: documents of their own; draw, a
    hash of id and text, tells them apart, and rows that repeat both are numbered, so the rows of the answer are the same
    however the table is dealt out. A source without words has target 0. An empty table gives no rows.
    """
    draw = F.xxhash64(F.col(id_col), binary(text_col), F.lit(salt))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), draw.alias("draw"), words(text_col).alias("size")))
    per = cut(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    targets = cut(source_targets(per, "source", weights, share, most).withColumnRenamed("source", "s"))
    same = F.col("source").eqNullSafe(F.col("s"))
    small = targets.count() * 128 <= 32 << 20
    keyed = rows.groupBy("source", "doc_id", "draw", "size").agg(F.count("*").alias("times"))
    known = cut(keyed.join(F.broadcast(targets) if small else targets, same).drop("s"))
    each = known.withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    rounded = round_units(each.where(open_).select("source", "n", "doc_id", "draw", "part", "size", "p"), "source", fan, salt)
    head = targets.select("s", "source_size", "target", "base")
    met = rounded.join(F.broadcast(head) if small else head, same).select("doc_id", "source", "draw", "size", "source_size", "target", (F.col("base") + F.col("p")).cast("long").alias("copies"))
    plain = each.where(~open_).select("doc_id", "source", "draw", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("base")).otherwise(F.lit(0)).cast("long").alias("copies"))
    return plain.unionByName(met).withColumn("taken", F.col("copies") * F.col("size"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, one row per document (see mix_plan)."""
    return mix_plan(docs, **options).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", salt: int = SALT, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; all columns stay, in a row of their own kind.

    Rows that repeat source, id and text share the copies that these have together: the first so many have one more.
    Documents that are not taken go before any text is shuffled where the plan is small enough to be sent along.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, salt=salt, **options).groupBy("source", "draw").agg(F.count("*").alias("n"), F.sum("copies").alias("c"))
    plan = cut(plan.where("c > 0"))
    # The caller's row is one struct, so that its names can't clash with those used here.
    held = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), F.xxhash64(F.col(id_col), binary(text_col), F.lit(salt)).alias("draw"))
    held = held.withColumn("source", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    plan = plan.withColumn("source", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    found = restrict(held, plan, ["source", "draw"], "inner")
    alone = found.where("n = 1").select("row", F.col("c").alias("times"))
    twin = found.where("n > 1")
    if not plan.where("n > 1").isEmpty():
        from pyspark.sql import Window

        at = F.row_number().over(Window.partitionBy("source", "draw").orderBy(F.xxhash64("row")))
        base = F.floor(F.col("c") / F.col("n"))
        alone = alone.unionByName(twin.withColumn("at", at).select("row", (base + (F.col("at") <= F.col("c") - base * F.col("n")).cast("long")).alias("times")))
    return alone.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("row.*")
