"""Key-encoding drift: detect it, vote on what each code means, check the votes, refit what is left."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalar import EARTH_MILES, haversine_miles
from tidemill.operators.curate import small
from tidemill.operators.metrics import grouped_medians

NUMERIC = "^[0-9]+$"
#: Fixed values. Miles: a code whose median error is over SUSPECT is looked at again. A refit is taken up to FIT, if the
#: runner-up is MARGIN behind or RATIO times as far. Rounds of refitting.
SUSPECT, FIT, MARGIN, RATIO, FLOOR, ROUNDS = 25.0, 10.0, 25.0, 5.0, 0.5, 6
#: Degrees of a cell of the sphere, and how far from its ring a candidate is looked for, in turn; the last is everywhere.
CELL, RADII = 5, (400.0, 3200.0, 13000.0)


def is_numeric(*ends: str) -> Column:
    out = F.lit(False)
    for c in ends:
        out = out | F.coalesce(F.col(c).rlike(NUMERIC), F.lit(False))
    return out


def drift_report(df: DataFrame, period: str, origin: str, dest: str) -> DataFrame:
    """By period: rows with a numeric code at either end, and rows."""
    return df.groupBy(period).agg(F.sum(is_numeric(origin, dest).cast("long")).alias("numeric_rows"), F.count(F.lit(1)).alias("total_rows"))


def split_by_drift(df: DataFrame, report: DataFrame, period: str) -> tuple[DataFrame, DataFrame]:
    """(encoded, clean): all rows of periods with any numeric code, and all others."""
    bad = report.where("numeric_rows > 0").select(period)
    return df.join(small(bad), period, "left_semi"), df.join(small(bad), period, "left_anti")


def numeric_codes(df: DataFrame, origin: str, dest: str) -> DataFrame:
    ends = df.select(F.col(origin).alias("code")).unionByName(df.select(F.col(dest).alias("code")))
    return ends.where(F.col("code").rlike(NUMERIC)).distinct()


def one_directional(df: DataFrame, keys: list[str], origin: str, dest: str) -> DataFrame:
    """Rows of keys that go one way only: exactly one distinct origin>dest. Null keys match nothing."""
    way = F.concat_ws(">", origin, dest)
    single = df.groupBy(*keys).agg(F.min(way).alias("low"), F.max(way).alias("high")).where("low = high").select(*keys)
    return df.join(single, keys, "left_semi")


def listed(df: DataFrame) -> DataFrame:
    """A list of codes, periods or places, worked out once: some hundred rows by its nature, held in the plan."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def one_way(df: DataFrame, keys: list[str], origin: str, dest: str) -> DataFrame:
    """keys, origin, dest of the keys that go one way only: as one_directional, each once, without joining back."""
    way, ends = F.concat_ws(">", origin, dest), F.struct(F.col(origin).alias(origin), F.col(dest).alias(dest))
    single = df.na.drop("any", subset=keys).groupBy(*keys).agg(F.min(way).alias("__low"), F.max(way).alias("__high"), F.max(ends).alias("__e"))
    return single.where("__low = __high").select(*keys, "__e.*")


def vote_mapping(encoded: DataFrame, clean: DataFrame, keys: list[str], origin: str, dest: str) -> DataFrame:
    """dot_code, iata_code, votes, total, share: one vote for each key and end; ties go to the smaller code."""
    a, b = one_way(encoded, keys, origin, dest), one_way(clean, keys, origin, dest)

    def ends(df: DataFrame, to: str) -> DataFrame:
        """Both ends of each row at once, told apart by which they are."""
        both = F.explode(F.array(F.struct(F.lit(0).alias("__end"), F.col(origin).alias(to)), F.struct(F.lit(1).alias("__end"), F.col(dest).alias(to))))
        return df.select(*keys, both.alias("__e")).select(*keys, "__e.*")

    codes = ends(a, "dot_code").where(F.col("dot_code").rlike(NUMERIC))
    names = ends(b, "iata_code").where(~F.col("iata_code").rlike(NUMERIC))
    tally = codes.join(names, [*keys, "__end"]).groupBy("dot_code", "iata_code").agg(F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy("dot_code").orderBy(F.desc("votes"), "iata_code")
    ranked = tally.withColumns({"rn": F.row_number().over(best), "total": F.sum("votes").over(Window.partitionBy("dot_code"))})
    return ranked.where("rn = 1").select("dot_code", "iata_code", "votes", "total", (F.col("votes") / F.col("total")).alias("share"))


def route_counts(df: DataFrame, origin: str, dest: str, distance: str) -> DataFrame:
    return df.groupBy(F.col(origin).alias("origin"), F.col(dest).alias("dest"), F.col(distance).cast("double").alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def _placed(routes: DataFrame, mapping: DataFrame, coords: DataFrame) -> DataFrame:
    """Routes with the coordinates of both mapped ends, where known."""
    known = mapping.join(small(coords), mapping["iata_code"] == coords["iata"], "left").select("dot_code", "lat", "lon")
    o = known.select(F.col("dot_code").alias("origin"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    d = known.select(F.col("dot_code").alias("dest"), F.col("lat").alias("dlat"), F.col("lon").alias("dlon"))
    return routes.join(small(o), "origin").join(small(d), "dest")


def per_code_error(routes: DataFrame, mapping: DataFrame, coords: DataFrame) -> DataFrame:
    """(code, median_err): the median of |great circle - distance| over distinct routes at either end."""
    err = F.abs(haversine_miles("olat", "olon", "dlat", "dlon") - F.col("distance"))
    each = _placed(routes, mapping, coords).select("origin", "dest", err.alias("err")).where("err is not null")
    ends = each.select(F.explode(F.array("origin", "dest")).alias("code"), "err")
    return _medians(ends, ["code"], 2 * routes.count()).select("code", F.col("median").alias("median_err"))


#: Errors, counted beforehand, whose medians one aggregation may gather; more are found in bounded state.
FEW_ERRORS = 1_000_000


def _medians(each: DataFrame, by: list[str], most: int) -> DataFrame:
    """by, median, n of the column err, of which there are so many at most. The same either way."""
    if most <= FEW_ERRORS:
        return each.where("err is not null").groupBy(*by).agg(F.median("err").alias("median"), F.count("err").alias("n"))
    return grouped_medians(each, by, F.col("err"))


def suspects(codes: DataFrame, mapping: DataFrame, errors: DataFrame, most: float = SUSPECT) -> DataFrame:
    """Codes without a mapping, and those whose error is over the limit."""
    unmapped = codes.join(mapping.select(F.col("dot_code").alias("code")), "code", "left_anti").select("code")
    return unmapped.unionByName(errors.where(F.col("median_err") > most).select("code")).distinct()


def _cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Band and place in the band of a point, in cells of CELL degrees."""
    bands, around = 180 // CELL, 360 // CELL
    return F.least(F.floor((lat + 90) / CELL), F.lit(bands - 1)).cast("int"), F.pmod(F.floor((lon + 180) / CELL), F.lit(around)).cast("int")


def ring_cells(rows: DataFrame, lat: str, lon: str, distance: str, radius: float) -> DataFrame:
    """Adds __band and __place: each row once for every cell that may hold a point whose distance from (lat, lon) is at
    most a radius off the given one.

    A point of a band lies within half a band of the band's middle line, on which the distance grows with the
    difference of longitudes: so two arcs of that line, east and west, cover what the ring can reach of the band.
    """
    bands, around, half = 180 // CELL, 360 // CELL, EARTH_MILES * 3.141592653589793 / 180 * CELL / 2
    slack = radius + half + 1.0
    near, far = (F.greatest(F.lit(0.0), F.col(distance) - slack) / EARTH_MILES, F.least(F.lit(3.141592653589793), (F.col(distance) + slack) / EARTH_MILES))
    lowest, highest = (F.floor((F.col(lat) + sign * F.degrees(far) + 90) / CELL).cast("int") for sign in (-1, 1))
    each = rows.withColumn("__band", F.explode(F.sequence(F.greatest(F.lit(0), lowest), F.least(F.lit(bands - 1), F.greatest(F.lit(0), highest)))))
    at, here = F.radians(F.col(lat)), F.radians((F.col("__band") + 0.5) * CELL - 90)
    flat = F.greatest(F.cos(at) * F.cos(here), F.lit(1e-12))
    cosine = lambda x: (F.cos(x) - F.sin(at) * F.sin(here)) / flat
    wide = lambda x: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(x)))))
    inner, outer = F.greatest(F.lit(0.0), wide(near) - 0.01), F.least(F.lit(180.0), wide(far) + 0.01)
    cell = lambda x: F.floor((F.col(lon) + x + 180) / CELL).cast("int")
    arcs = F.concat(F.sequence(cell(inner), cell(outer)), F.sequence(cell(-outer), cell(-inner)))
    return each.where(cosine(far) <= 1.0 + 1e-9).withColumn("__place", F.explode(F.array_distinct(F.transform(arcs, lambda k: F.pmod(k, F.lit(around))))))


def _off(lat: str, lon: str) -> Column:
    return F.abs(haversine_miles(lat, lon, "tlat", "tlon") - F.col("distance"))


def _scores(obs: DataFrame, free: DataFrame, radius: float, most: int) -> DataFrame:
    """(code, iata, score, n_obs) of every place whose median error is within a radius.

    At least half of a code's observations are within the radius of such a place, so it lies in the cells of
    half of the rings; only places that do are measured against all observations of the code. most: how many such
    measurements there are if every place is one.
    """
    band, place = _cell(F.col("lat"), F.col("lon"))
    cells = small(free.withColumns({"__band": band, "__place": place}))
    rings = ring_cells(obs, "tlat", "tlon", "distance", radius) if radius < RADII[-1] else ring_cells(obs.dropDuplicates(["code"]), "tlat", "tlon", "distance", radius).withColumn("n_obs", F.lit(1))
    hits = rings.join(cells, ["__band", "__place"]).where(_off("lat", "lon") <= radius)
    pairs = hits.groupBy("code", "iata").agg(F.count(F.lit(1)).alias("k"), F.first("n_obs").alias("n_obs")).where("2 * k >= n_obs").select("code", "iata")
    each = pairs.join(small(free), "iata").join(obs, "code").select("code", "iata", _off("lat", "lon").alias("err"))
    found = _medians(each, ["code", "iata"], most).select("code", "iata", F.col("median").alias("score"), F.col("n").alias("n_obs"))
    return found.where(F.col("score") <= radius)


def score_candidates(routes: DataFrame, wanted: DataFrame, trusted: DataFrame, coords: DataFrame, within: float | None = None) -> DataFrame:
    """(code, iata, score, margin, runner_up, n_obs): best candidate of each wanted code by its routes to trusted ends.

    A route of a known length to a trusted end puts a code on a ring around it. Candidates are looked up by cell near
    these rings, first close to them, and farther out for the codes that don't have two candidates yet, so that best and
    runner-up are those of all free places. With within, only as far: codes without a candidate there are left out, and
    a runner-up beyond it counts as infinitely far.
    """
    t = trusted.join(small(coords), trusted["iata_code"] == coords["iata"]).select(F.col("dot_code").alias("other"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    out = routes.select(F.col("origin").alias("code"), F.col("dest").alias("other"), "distance").unionByName(routes.select(F.col("dest").alias("code"), F.col("origin").alias("other"), "distance"))
    obs = out.join(small(wanted), "code", "left_semi").join(small(t), "other").where("distance is not null")
    free = coords.join(small(trusted.select(F.col("iata_code").alias("iata"))), "iata", "left_anti").where("lat is not null and lon is not null")
    obs = obs.withColumn("n_obs", F.count(F.lit(1)).over(Window.partitionBy("code"))).persist()
    try:
        places = free.count()
        most = obs.count() * places
        if within is not None:
            scored = _scores(obs, free, within, most).collect()  # codes in doubt, and places near them
        else:
            enough, scored, left = min(2, places), [], obs
            for radius in RADII:
                found = _scores(left, free, radius, most).collect()
                done = {c for c, n in Counter(r["code"] for r in found).items() if n >= enough or radius == RADII[-1]}
                scored += [r for r in found if r["code"] in done]
                left = left.where(~F.col("code").isin(sorted(done))) if done else left
                if left.isEmpty():
                    break
    finally:
        obs.unpersist()
    by: dict[str, list] = {}
    for r in scored:
        by.setdefault(r["code"], []).append((r["score"], r["iata"], r["n_obs"]))
    rows = []
    for code, found in by.items():
        (score, iata, n), runner = min(found), sorted(found)[1][0] if len(found) > 1 else float("inf")
        rows.append((code, iata, score, runner - score, runner, n))
    return routes.sparkSession.createDataFrame(rows, "code string, iata string, score double, margin double, runner_up double, n_obs long")


def acceptable(score: float, margin: float, runner_up: float) -> bool:
    return score <= FIT and (margin >= MARGIN or runner_up >= RATIO * max(score, FLOOR))


def geometric_refit(routes: DataFrame, mapping: DataFrame, bad: DataFrame, coords: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """dot_code, iata_code, source, score: trusted votes and what geometry adds; codes still unknown are left out.

    Scoring is distributed, and goes no farther than a runner-up can matter. The greedy step needs one row for each unknown code, at most some hundreds
    by the nature of a code list, and takes best scores first while a candidate is still free.
    """
    spark = routes.sparkSession
    ddl = "dot_code string, iata_code string, source string, score double"
    left = {r["code"] for r in bad.collect()}
    rows = [(r["dot_code"], r["iata_code"], "vote", None) for r in mapping.select("dot_code", "iata_code").collect() if r["dot_code"] not in left]
    matters = FIT + max(MARGIN, (RATIO - 1) * max(FIT, FLOOR))
    for _ in range(rounds):
        if not left or not rows:
            break
        trusted = spark.createDataFrame(rows, ddl)
        wanted = spark.createDataFrame([(c,) for c in sorted(left)], "code string")
        taken, fixed = {r[1] for r in rows}, 0
        for r in sorted(score_candidates(routes, wanted, trusted, coords, matters).collect(), key=lambda r: (r["score"] if r["score"] is not None else float("inf"), r["code"])):
            if r["score"] is not None and r["iata"] not in taken and acceptable(r["score"], r["margin"], r["runner_up"]):
                rows.append((r["code"], r["iata"], "geometric", float(r["score"])))
                taken.add(r["iata"])
                left.discard(r["code"])
                fixed += 1
        if not fixed:
            break
    return spark.createDataFrame(rows, ddl)


def mapping_quality(df: DataFrame, mapping: DataFrame, origin: str, dest: str) -> DataFrame:
    """One row: codes, whether no two codes share a meaning, rows, and rows whose ends are both known."""
    known = mapping.agg(F.count(F.lit(1)).alias("codes"), (F.count_distinct("iata_code") == F.count("iata_code")).cast("int").alias("injective"))
    names = small(mapping.select(F.col("dot_code").alias("code")).distinct())
    ok = lambda c: F.col(f"__{c}").isNotNull() | ~F.col(c).rlike(NUMERIC)
    joined = df.select(origin, dest)
    for c in (origin, dest):
        joined = joined.join(names.withColumnRenamed("code", f"__{c}"), F.col(c) == F.col(f"__{c}"), "left")
    cover = joined.agg(F.count(F.lit(1)).alias("total_rows"), F.sum(F.when(ok(origin) & ok(dest), 1).otherwise(0)).cast("long").alias("joinable_rows"))
    codes, injective = known.first()
    return cover.select(F.lit(codes).alias("codes"), F.lit(injective).alias("injective"), "total_rows", "joinable_rows")


def code_map(df: DataFrame, coords: DataFrame, period: str, keys: list[str], origin: str, dest: str, distance: str) -> DataFrame:
    """The whole inference: dot_code, iata_code, source, median_err_mi (3 digits), sorted by code."""
    coords = listed(coords)
    encoded, clean = split_by_drift(df, listed(drift_report(df, period, origin, dest)), period)
    votes = listed(vote_mapping(encoded, clean, keys, origin, dest).join(small(coords.select(F.col("iata").alias("iata_code"))), "iata_code", "left_semi").select("dot_code", "iata_code"))
    numeric = encoded.where(F.col(origin).rlike(NUMERIC) & F.col(dest).rlike(NUMERIC))
    routes = route_counts(numeric, origin, dest, distance).persist()
    try:
        bad = listed(suspects(numeric_codes(encoded, origin, dest), votes, per_code_error(routes, votes, coords)))
        final = geometric_refit(routes, votes, bad, coords)
        errors = per_code_error(routes, final, coords)
        out = final.join(errors, final["dot_code"] == errors["code"], "left").select("dot_code", "iata_code", "source", F.round("median_err", 3).alias("median_err_mi")).orderBy("dot_code")
        return listed(out)
    finally:
        routes.unpersist()
