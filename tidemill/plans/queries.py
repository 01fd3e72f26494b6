"""One query for each operator over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import arrow
from tidemill.functions import scalar as S
from tidemill.ml import report, stages
from tidemill.operators import codemap, curate, metrics, split
from tidemill.plans.contract import LeakagePolicy
from tidemill.plans.views import DRIFT, EV, GEO, HAV, LEGS, drift, ev, geo, legs, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, and the SQL beside it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# --- projections, filters, scalar functions -------------------------------------------------------


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def project_subset(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_quantity")


_MIN = "((TRY_CAST(clock AS INTEGER) // 100) % 24) * 60 + TRY_CAST(clock AS INTEGER) % 100"


@query(f"WITH {EV} SELECT event_id, CAST({_MIN} AS DOUBLE) AS minutes FROM ev")
def hhmm_minutes(spark, sf):
    return ev(spark, sf).select("event_id", S.hhmm_to_minutes("clock").cast("double").alias("minutes"))


@query(
    f"""WITH {EV} SELECT event_id, CAST({_MIN} AS DOUBLE) AS dep_min, CAST(({_MIN}) // 60 AS DOUBLE) AS dep_hour, CAST(dow IN (6, 7) AS INTEGER) AS is_weekend,
    concat_ws('-', airline, CAST(place AS VARCHAR)) AS route FROM ev"""
)
def derive_features(spark, sf):
    m = S.hhmm_to_minutes("clock").cast("int")
    return ev(spark, sf).select("event_id", m.cast("double").alias("dep_min"), S.hour_of(m).cast("double").alias("dep_hour"), S.weekend_flag("dow").alias("is_weekend"), S.route_key("airline", F.col("place").cast("string")).alias("route"))


@query(f"WITH {EV} SELECT event_id, CAST(delay > 30 AS DOUBLE) AS label FROM ev")
def label_severe(spark, sf):
    return ev(spark, sf).select("event_id", S.severe_label("delay").alias("label"))


@query(f"WITH {EV} SELECT round(avg(CAST(delay > 30 AS DOUBLE)), 6) AS rate FROM ev")
def severe_rate(spark, sf):
    return ev(spark, sf).agg(r6(F.avg(S.severe_label("delay")), "rate"))


@query(f"WITH {EV} SELECT event_id, airline FROM ev WHERE cancelled = 0")
def filter_flags(spark, sf):
    return curate.completed(ev(spark, sf), ("cancelled",), ()).select("event_id", "airline")


@query(f"WITH {EV} SELECT event_id FROM ev WHERE delay IS NOT NULL AND place IS NOT NULL AND clock IS NOT NULL")
def filter_not_null(spark, sf):
    return curate.completed(ev(spark, sf), (), ("delay", "place", "clock")).select("event_id")


@query(f"WITH {EV} SELECT event_id, 'in' AS part FROM ev WHERE place IN (6, 7) UNION ALL SELECT event_id, 'out' FROM ev WHERE place NOT IN (6, 7)")
def filter_in_list(spark, sf):
    e = ev(spark, sf)
    inside = e.where(F.col("place").isin(6, 7)).select("event_id", F.lit("in").alias("part"))
    return inside.unionByName(e.where(~F.col("place").isin(6, 7)).select("event_id", F.lit("out").alias("part")))


@query(f"WITH {DRIFT} SELECT o_orderkey, regexp_matches(origin, '^[0-9]+$') AS is_code FROM drift")
def filter_regex(spark, sf):
    d = drift(spark, sf)
    numeric = d.where(F.col("origin").rlike(codemap.NUMERIC)).select("o_orderkey", F.lit(True).alias("is_code"))
    return numeric.unionByName(d.where(~F.col("origin").rlike(codemap.NUMERIC)).select("o_orderkey", F.lit(False).alias("is_code")))


@query(f"WITH {EV} SELECT event_id, round(delay, 6) AS delay, place FROM ev WHERE delay IS NOT NULL AND place IS NOT NULL")
def na_drop(spark, sf):
    return ev(spark, sf).select("event_id", r6(F.col("delay"), "delay"), "place").na.drop()


@query(f"WITH {EV} SELECT event_id, airline AS AIRLINE, dow AS DAY_OF_WEEK FROM ev")
def leakage_drop(spark, sf):
    policy = LeakagePolicy()
    e = ev(spark, sf).select("event_id", F.col("airline").alias("AIRLINE"), F.col("dow").alias("DAY_OF_WEEK"), F.col("delay").alias("ARRIVAL_DELAY"), F.col("cancelled").alias("CANCELLED"))
    out = policy.drop(e)
    policy.check(out, derived=("event_id",))
    return out


@query(f"WITH {LEGS} SELECT l_orderkey, l_linenumber, l_suppkey, round({HAV}, 6) AS miles FROM legs")
def haversine(spark, sf):
    return legs(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", r6(S.haversine_miles("olat", "olon", "dlat", "dlon"), "miles"))


@query(f"WITH {GEO} SELECT a.n_nationkey AS a, b.n_nationkey AS b, round({HAV.replace('olat', 'a.lat').replace('olon', 'a.lon').replace('dlat', 'b.lat').replace('dlon', 'b.lon')}, 6) AS miles FROM geo a JOIN geo b ON a.n_regionkey = b.n_regionkey")
def haversine_udf(spark, sf):
    g = geo(spark, sf)
    a = g.select(F.col("n_nationkey").alias("a"), F.col("lat").alias("olat"), F.col("lon").alias("olon"), "n_regionkey")
    b = g.select(F.col("n_nationkey").alias("b"), F.col("lat").alias("dlat"), F.col("lon").alias("dlon"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", r6(arrow.haversine_miles_udf("olat", "olon", "dlat", "dlon"), "miles"))


_SPEED = "CASE WHEN minutes > 0 THEN d / (minutes / 60.0) END"


@query(f"WITH {LEGS}, x AS (SELECT *, {HAV} AS d FROM legs) SELECT l_orderkey, l_linenumber, l_suppkey, round({_SPEED}, 6) AS mph FROM x")
def schedule_speed(spark, sf):
    return legs(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", r6(S.schedule_speed(S.haversine_miles("olat", "olon", "dlat", "dlon"), "minutes"), "mph"))


@query(f"WITH {LEGS}, x AS (SELECT *, {HAV} AS d FROM legs) SELECT l_orderkey, l_linenumber, l_suppkey, round({_SPEED}, 6) AS mph FROM x")
def schedule_speed_udf(spark, sf):
    return legs(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", r6(arrow.schedule_speed_udf(S.haversine_miles("olat", "olon", "dlat", "dlon"), F.col("minutes")), "mph"))


@query(f"WITH {LEGS}, x AS (SELECT *, {HAV} AS d FROM legs) SELECT l_orderkey, l_linenumber, l_suppkey, round(CASE WHEN d > 1 THEN (l_quantity * 100) / d ELSE 1.0 END, 6) AS detour FROM x")
def route_detour(spark, sf):
    return legs(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", r6(S.route_detour(F.col("l_quantity") * 100, S.haversine_miles("olat", "olon", "dlat", "dlon")), "detour"))


@query(f"WITH {EV} SELECT event_id, round(sign(delay) * ln(1 + abs(delay)), 6) AS slog FROM ev")
def signed_log1p(spark, sf):
    stage = stages.SignedLog1p(inputCols=["delay"], outputCols=["slog"])
    return stage.transform(ev(spark, sf)).select("event_id", r6(F.col("slog"), "slog"))


@query(f"WITH {EV} SELECT event_id, round(sqrt(value * value + CAST(user_id AS DOUBLE) * user_id), 6) AS h FROM ev")
def hypot_udf(spark, sf):
    return ev(spark, sf).select("event_id", r6(arrow.hypot_udf("value", F.col("user_id").cast("double")), "h"))


# --- joins and curation ----------------------------------------------------------------------------


@query(f"WITH {LEGS} SELECT l_orderkey, l_linenumber, l_suppkey, olat, olon, dlat, dlon, r_name FROM legs JOIN geo ON origin = place LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_enrich(spark, sf):
    facts = legs(spark, sf).drop("olat", "olon", "dlat", "dlon")
    places = geo(spark, sf).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    out = curate.enrich_places(facts, places, {"origin": ("olat", "olon"), "dest": ("dlat", "dlon")}, "place", "lat", "lon")
    out = curate.enrich_names(out, places, "origin", "place", "r_name", "r_name")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "olat", "olon", "dlat", "dlon", "r_name")


_MAP = "m AS (SELECT CAST(10000 + n_nationkey AS VARCHAR) AS dot_code, place AS iata_code FROM geo WHERE n_nationkey % 7 <> 0)"


@query(f"WITH {DRIFT}, {_MAP} SELECT o_orderkey, coalesce(a.iata_code, origin) AS origin, coalesce(b.iata_code, dest) AS dest FROM drift LEFT JOIN m a ON origin = a.dot_code LEFT JOIN m b ON dest = b.dot_code")
def repair_codes(spark, sf):
    m = geo(spark, sf).where("n_nationkey % 7 <> 0").select((F.col("n_nationkey") + 10000).cast("string").alias("dot_code"), F.col("place").alias("iata_code"))
    return curate.repair_codes(drift(spark, sf), m, ("origin", "dest")).select("o_orderkey", "origin", "dest")


@query(
    f"""WITH {EV} SELECT 0 AS step, 'all' AS name, count(*) AS "rows" FROM ev
    UNION ALL SELECT 1, 'flown', count(*) FROM ev WHERE cancelled = 0
    UNION ALL SELECT 2, 'delay', count(*) FROM ev WHERE cancelled = 0 AND delay IS NOT NULL
    UNION ALL SELECT 3, 'placed', count(*) FROM ev WHERE cancelled = 0 AND delay IS NOT NULL AND place IS NOT NULL"""
)
def curation_funnel(spark, sf):
    return curate.funnel(ev(spark, sf), [("flown", F.col("cancelled") == 0), ("delay", F.col("delay").isNotNull()), ("placed", F.col("place").isNotNull())])


# --- code map ------------------------------------------------------------------------------------

_NUM = "'^[0-9]+$'"


@query(f"WITH {DRIFT} SELECT month, CAST(sum(CAST(regexp_matches(origin, {_NUM}) OR regexp_matches(dest, {_NUM}) AS INTEGER)) AS BIGINT) AS numeric_rows, count(*) AS total_rows FROM drift GROUP BY month")
def drift_report(spark, sf):
    return codemap.drift_report(drift(spark, sf), "month", "origin", "dest").orderBy(F.desc("numeric_rows"), "month")


@query(f"WITH {DRIFT} SELECT origin AS code FROM drift WHERE regexp_matches(origin, {_NUM}) UNION SELECT dest FROM drift WHERE regexp_matches(dest, {_NUM})")
def distinct_codes(spark, sf):
    return codemap.numeric_codes(drift(spark, sf), "origin", "dest")


@query(f"WITH {LEGS}, one AS (SELECT l_orderkey FROM legs GROUP BY 1 HAVING count(DISTINCT concat_ws('>', origin, dest)) = 1) SELECT l_orderkey, l_linenumber, l_suppkey, o_custkey, origin, dest FROM legs WHERE l_orderkey IN (SELECT l_orderkey FROM one)")
def one_directional(spark, sf):
    return codemap.one_directional(legs(spark, sf), ["l_orderkey"], "origin", "dest").select("l_orderkey", "l_linenumber", "l_suppkey", "o_custkey", "origin", "dest")


_VOTES = f"""{DRIFT}, drifting AS (SELECT month FROM drift GROUP BY 1 HAVING sum(CAST(regexp_matches(origin, {_NUM}) OR regexp_matches(dest, {_NUM}) AS INTEGER)) > 0),
enc AS (SELECT * FROM drift WHERE month IN (SELECT month FROM drifting)), cln AS (SELECT * FROM drift WHERE month NOT IN (SELECT month FROM drifting)),
enc1 AS (SELECT * FROM enc WHERE o_custkey IN (SELECT o_custkey FROM enc GROUP BY o_custkey, distance HAVING count(DISTINCT concat_ws('>', origin, dest)) = 1)),
cln1 AS (SELECT * FROM cln WHERE o_custkey IN (SELECT o_custkey FROM cln GROUP BY o_custkey, distance HAVING count(DISTINCT concat_ws('>', origin, dest)) = 1)),
pairs AS (SELECT e.c AS dot_code, k.c AS iata_code FROM (SELECT DISTINCT o_custkey, distance, origin AS c FROM enc1 WHERE regexp_matches(origin, {_NUM})) e JOIN (SELECT DISTINCT o_custkey, distance, origin AS c FROM cln1) k USING (o_custkey, distance)
  UNION ALL SELECT e.c, k.c FROM (SELECT DISTINCT o_custkey, distance, dest AS c FROM enc1 WHERE regexp_matches(dest, {_NUM})) e JOIN (SELECT DISTINCT o_custkey, distance, dest AS c FROM cln1) k USING (o_custkey, distance)),
tally AS (SELECT dot_code, iata_code, count(*) AS votes FROM pairs GROUP BY ALL),
votes AS (SELECT dot_code, iata_code, votes, CAST(sum(votes) OVER (PARTITION BY dot_code) AS BIGINT) AS total, row_number() OVER (PARTITION BY dot_code ORDER BY votes DESC, iata_code) AS rn FROM tally)"""


def _votes(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = drift(spark, sf)
    encoded, clean = codemap.split_by_drift(d, codemap.drift_report(d, "month", "origin", "dest"), "month")
    return encoded, codemap.vote_mapping(encoded, clean, ["o_custkey", "distance"], "origin", "dest")


@query(f"WITH {_VOTES} SELECT dot_code, iata_code, votes, total, round(votes / total, 6) AS share FROM votes WHERE rn = 1")
def vote_mapping(spark, sf):
    return _votes(spark, sf)[1].withColumn("share", F.round("share", 6))


@query(f"WITH {DRIFT} SELECT origin, dest, distance, count(*) AS n FROM drift WHERE month = 10 GROUP BY ALL")
def route_counts(spark, sf):
    return codemap.route_counts(drift(spark, sf).where("month = 10"), "origin", "dest", "distance")


# Every fifth code stands for the wrong place, so that some errors are large.
_WRONG = "m AS (SELECT CAST(10000 + g.n_nationkey AS VARCHAR) AS dot_code, h.place AS iata_code FROM geo g JOIN geo h ON h.n_nationkey = CASE WHEN g.n_nationkey % 5 = 0 THEN (g.n_nationkey + 1) % 25 ELSE g.n_nationkey END WHERE g.n_nationkey <> 13)"
_ERRORS = f"""{DRIFT}, {_WRONG}, routes AS (SELECT DISTINCT origin, dest, distance FROM drift WHERE month = 10), k AS (SELECT dot_code, lat, lon FROM m JOIN geo ON iata_code = place),
each AS (SELECT origin, dest, abs({HAV} - distance) AS err FROM (SELECT r.*, o.lat AS olat, o.lon AS olon, d.lat AS dlat, d.lon AS dlon FROM routes r JOIN k o ON origin = o.dot_code JOIN k d ON dest = d.dot_code)),
errors AS (SELECT code, median(err) AS median_err FROM (SELECT origin AS code, err FROM each UNION ALL SELECT dest, err FROM each) GROUP BY code)"""


def _wrong(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = geo(spark, sf)
    k = F.col("n_nationkey")
    to = g.select(k.alias("t"), F.col("place").alias("iata_code"))
    m = g.where(k != 13).select((k + 10000).cast("string").alias("dot_code"), F.when(k % 5 == 0, (k + 1) % 25).otherwise(k).alias("t")).join(to, "t").select("dot_code", "iata_code")
    coords = g.select(F.col("place").alias("iata"), "lat", "lon")
    # Lists of some hundred rows: worked out once, as they are used again and again.
    return codemap.route_counts(drift(spark, sf).where("month = 10"), "origin", "dest", "distance"), codemap.listed(m), codemap.listed(coords)


@query(f"WITH {_ERRORS} SELECT code, round(median_err, 6) AS median_err FROM errors")
def per_code_error(spark, sf):
    return codemap.per_code_error(*_wrong(spark, sf)).select("code", r6(F.col("median_err"), "median_err"))


@query(f"WITH {_ERRORS}, codes AS (SELECT origin AS code FROM routes UNION SELECT dest FROM routes) SELECT code FROM codes WHERE code NOT IN (SELECT dot_code FROM m) UNION SELECT code FROM errors WHERE median_err > 25.0")
def suspect_codes(spark, sf):
    routes, m, coords = _wrong(spark, sf)
    codes = codemap.numeric_codes(drift(spark, sf).where("month = 10"), "origin", "dest")
    return codemap.suspects(codes, m, codemap.per_code_error(routes, m, coords))


_BAD = "bad AS (SELECT code FROM (SELECT origin AS code FROM routes UNION SELECT dest FROM routes) WHERE code NOT IN (SELECT dot_code FROM m) UNION SELECT code FROM errors WHERE median_err > 25.0)"
_SCORE = HAV.replace("olat", "lat").replace("olon", "lon").replace("dlat", "tlat").replace("dlon", "tlon")


def _scored(k: str) -> str:
    """Best candidate w{k} of each code of todo{k}, by its routes to the codes of t{k} (dot_code, iata_code)."""
    return f"""tr{k} AS (SELECT dot_code, iata_code, lat AS tlat, lon AS tlon FROM t{k} JOIN geo ON iata_code = place),
    obs{k} AS (SELECT code, tlat, tlon, distance FROM (SELECT origin AS code, dest AS other, distance FROM routes UNION ALL SELECT dest, origin, distance FROM routes) JOIN tr{k} ON other = dot_code WHERE code IN (SELECT code FROM todo{k})),
    sc{k} AS (SELECT code, place AS iata, median(abs({_SCORE} - distance)) AS score, count(*) AS n_obs FROM obs{k} JOIN geo ON place NOT IN (SELECT iata_code FROM t{k}) GROUP BY ALL),
    w{k} AS MATERIALIZED (SELECT *, coalesce(runner, 'Infinity'::DOUBLE) AS runner_up FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY score, iata) AS rn, lead(score) OVER (PARTITION BY code ORDER BY score, iata) AS runner FROM sc{k}) WHERE rn = 1)"""


def _refits(rounds: int) -> str:
    """t{rounds}: trusted votes of m, and what that many rounds of refitting add; bad has the codes in doubt."""
    out = ["t0 AS (SELECT dot_code, iata_code, 'vote' AS source, NULL::DOUBLE AS score FROM m WHERE dot_code NOT IN (SELECT code FROM bad))"]
    for k in range(rounds):
        out += [
            f"todo{k} AS (SELECT code FROM bad WHERE code NOT IN (SELECT dot_code FROM t{k}))",
            _scored(str(k)),
            f"""ok{k} AS (SELECT code, iata, score FROM w{k} WHERE score <= {codemap.FIT} AND (runner_up - score >= {codemap.MARGIN} OR runner_up >= {codemap.RATIO} * greatest(score, {codemap.FLOOR}))
            QUALIFY row_number() OVER (PARTITION BY iata ORDER BY score, code) = 1)""",
            f"t{k + 1} AS MATERIALIZED (SELECT * FROM t{k} UNION ALL SELECT code, iata, 'geometric', score FROM ok{k})",
        ]
    return ", ".join(out)


def _doubted(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    routes, m, coords = _wrong(spark, sf)
    routes = routes.persist()
    codes = codemap.numeric_codes(routes, "origin", "dest")
    return routes, m, coords, codemap.listed(codemap.suspects(codes, m, codemap.per_code_error(routes, m, coords)))


@query(
    f"""WITH {_ERRORS}, {_BAD}, t AS (SELECT dot_code, iata_code FROM m WHERE dot_code NOT IN (SELECT code FROM bad)), todo AS (SELECT code FROM bad), {_scored("")}
    SELECT code, iata, round(score, 6) AS score, round(coalesce(runner - score, -1), 6) AS margin, n_obs FROM w"""
)
def refit_scores(spark, sf):
    routes, m, coords, bad = _doubted(spark, sf)
    trusted = codemap.listed(m.join(bad, m["dot_code"] == bad["code"], "left_anti"))
    s = codemap.score_candidates(routes, bad, trusted, coords)
    routes.unpersist()
    margin = F.when(F.col("margin") == float("inf"), F.lit(-1.0)).otherwise(F.col("margin"))
    return s.select("code", "iata", r6(F.col("score"), "score"), r6(margin, "margin"), "n_obs")


@query(f"WITH {_ERRORS}, {_BAD}, {_refits(codemap.ROUNDS)} SELECT dot_code, iata_code, source, round(score, 6) AS score FROM t{codemap.ROUNDS}")
def geometric_refit(spark, sf):
    routes, m, coords, bad = _doubted(spark, sf)
    fitted = codemap.geometric_refit(routes, m, bad, coords).withColumn("score", F.round("score", 6))
    routes.unpersist()
    return fitted


@query(
    f"""WITH {DRIFT}, {_WRONG} SELECT (SELECT count(*) FROM m) AS codes, (SELECT CAST(count(DISTINCT iata_code) = count(iata_code) AS INTEGER) FROM m) AS injective, count(*) AS total_rows,
    CAST(sum(CASE WHEN (origin IN (SELECT dot_code FROM m) OR NOT regexp_matches(origin, {_NUM})) AND (dest IN (SELECT dot_code FROM m) OR NOT regexp_matches(dest, {_NUM})) THEN 1 ELSE 0 END) AS BIGINT) AS joinable_rows FROM drift"""
)
def mapping_quality(spark, sf):
    return codemap.mapping_quality(drift(spark, sf), _wrong(spark, sf)[1], "origin", "dest")


@query(
    f"""WITH {LEGS}, x AS (SELECT abs({HAV} - round({HAV} / 50) * 50) AS err FROM legs)
    SELECT round(quantile_disc(err, 0.5), 6) AS p50, round(quantile_disc(err, 0.99), 6) AS p99 FROM x"""
)
def haversine_error_pcts(spark, sf):
    miles = S.haversine_miles("olat", "olon", "dlat", "dlon")
    p50, p99 = metrics.quantiles(legs(spark, sf).select("olat", "olon", "dlat", "dlon"), F.abs(miles - F.round(miles / 50) * 50), (0.5, 0.99))
    return spark.range(1).select(r6(F.lit(p50), "p50"), r6(F.lit(p99), "p99"))


# --- learned stages --------------------------------------------------------------------------------

_FENCES = f"{EV}, q AS (SELECT quantile_disc(delay, 0.25) AS q1, quantile_disc(delay, 0.75) AS q3 FROM ev), f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"


def _clipper(e: DataFrame):
    return stages.IQRClip(inputCols=["delay"], outputCols=["clipped"], relativeError=0.0).fit(e)  # 0: exact, in bounded memory


@query(f"WITH {_FENCES} SELECT round(lo, 6) AS lower_fence, round(hi, 6) AS upper_fence FROM f")
def iqr_fences(spark, sf):
    lo, hi = _clipper(ev(spark, sf)).bounds()["delay"]
    return spark.range(1).select(r6(F.lit(lo), "lower_fence"), r6(F.lit(hi), "upper_fence"))


@query(f"WITH {_FENCES} SELECT event_id, round(least(greatest(delay, lo), hi), 6) AS clipped FROM ev, f")
def iqr_clip(spark, sf):
    e = ev(spark, sf)
    return _clipper(e).transform(e).select("event_id", r6(F.col("clipped"), "clipped"))


@query(f"WITH {_FENCES}, c AS (SELECT least(greatest(delay, lo), hi) AS x FROM ev, f) SELECT round(min(x), 6) AS least, round(max(x), 6) AS most FROM c")
def clip_bounds_check(spark, sf):
    e = ev(spark, sf)
    return _clipper(e).transform(e).agg(r6(F.min("clipped"), "least"), r6(F.max("clipped"), "most"))


_ENC = f"{EV}, p AS (SELECT avg(delay) AS prior FROM ev), t AS (SELECT CAST(place AS VARCHAR) AS key, (sum(delay) + 20 * any_value(prior)) / (count(*) + 20) AS e FROM ev, p WHERE place IS NOT NULL GROUP BY 1)"
_ENC2 = f"{_ENC}, u AS (SELECT airline AS key, (sum(delay) + 20 * any_value(prior)) / (count(*) + 20) AS e FROM ev, p GROUP BY 1)"


@query(f"WITH {_ENC2} SELECT 'place' AS col, key, round(e, 6) AS value FROM t UNION ALL SELECT 'airline', key, round(e, 6) FROM u")
def target_encode_fit(spark, sf):
    table, _ = stages.encode_table(ev(spark, sf), ["place", "airline"], "delay", 20.0)
    return table.select("col", "key", r6(F.col("value"), "value"))


def _encoder(e: DataFrame, inline: int):
    return stages.SmoothedTargetEncoder(inputCols=["place"], outputCols=["te"], labelCol="delay", maxInline=inline).fit(e)


_ENC_OUT = f"WITH {_ENC} SELECT event_id, round(coalesce(e, prior), 6) AS te FROM ev CROSS JOIN p LEFT JOIN t ON CAST(place AS VARCHAR) = key"


@query(_ENC_OUT)
def target_encode_map(spark, sf):
    e = ev(spark, sf)
    return _encoder(e, 20000).transform(e).select("event_id", r6(F.col("te"), "te"))


@query(_ENC_OUT)
def target_encode_join(spark, sf):
    e = ev(spark, sf)
    return _encoder(e, 0).transform(e).select("event_id", r6(F.col("te"), "te"))


@query(f"WITH {_ENC} SELECT round(prior, 6) AS te, count(*) AS n FROM ev, p GROUP BY 1")
def target_encode_unseen(spark, sf):
    e = ev(spark, sf)
    unseen = e.withColumn("place", F.col("place") + 1_000_000)
    return _encoder(e, 20000).transform(unseen).groupBy(r6(F.col("te"), "te")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV}, m AS (SELECT quantile_disc(delay, 0.5) AS med FROM ev) SELECT event_id, round(coalesce(delay, med), 6) AS delay FROM ev, m")
def impute_median(spark, sf):
    e = ev(spark, sf)
    return stages.ExactMedians(inputCols=["delay"], outputCols=["delay"]).fit(e).transform(e).select("event_id", r6(F.col("delay"), "delay"))


_IDX = f"{EV}, i AS (SELECT airline, CAST(row_number() OVER (ORDER BY count(*) DESC, airline) - 1 AS DOUBLE) AS idx FROM ev GROUP BY airline)"


@query(f"WITH {_IDX} SELECT event_id, idx FROM ev JOIN i USING (airline)")
def string_index(spark, sf):
    e = ev(spark, sf)
    return StringIndexer(inputCol="airline", outputCol="idx", handleInvalid="keep").fit(e).transform(e).select("event_id", "idx")


@query(f"WITH {EV} SELECT dow AS slot, count(*) AS n FROM ev GROUP BY dow")
def onehot_counts(spark, sf):
    e = ev(spark, sf)
    hot = OneHotEncoder(inputCols=["dow"], outputCols=["v"], handleInvalid="keep", dropLast=True).fit(e).transform(e)
    return hot.select(F.posexplode(vector_to_array("v")).alias("slot", "x")).where("x = 1").groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


def _assembled(e: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["value", "user_id", "dow"], outputCol="raw", handleInvalid="keep").transform(e)


@query(f"WITH {EV} SELECT 0 AS slot, round(stddev_samp(value), 6) AS sd FROM ev UNION ALL SELECT 1, round(stddev_samp(user_id), 6) FROM ev UNION ALL SELECT 2, round(stddev_samp(dow), 6) FROM ev")
def scaler_stats(spark, sf):
    model = StandardScaler(inputCol="raw", outputCol="z", withMean=False, withStd=True).fit(_assembled(ev(spark, sf)))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.std)], "slot int, sd double").select("slot", r6(F.col("sd"), "sd"))


@query(f"WITH {EV}, s AS (SELECT stddev_samp(value) AS a, stddev_samp(user_id) AS b, stddev_samp(dow) AS c FROM ev) SELECT event_id, round(value / a, 6) AS z0, round(user_id / b, 6) AS z1, round(dow / c, 6) AS z2 FROM ev, s")
def assemble_scale(spark, sf):
    d = _assembled(ev(spark, sf))
    z = vector_to_array(F.col("z"))
    return StandardScaler(inputCol="raw", outputCol="z", withMean=False, withStd=True).fit(d).transform(d).select("event_id", *(r6(z[i], f"z{i}") for i in range(3)))


@query(f"WITH {EV} SELECT event_id, round(value, 6) AS v0, CAST(user_id AS DOUBLE) AS v1 FROM ev")
def zero_variance(spark, sf):
    e = ev(spark, sf).withColumn("constant", F.lit(7.0))
    d = VectorAssembler(inputCols=["value", "constant", "user_id"], outputCol="raw").transform(e)
    out = VarianceThresholdSelector(featuresCol="raw", outputCol="kept", varianceThreshold=0.0).fit(d).transform(d)
    kept = vector_to_array("kept")
    return out.select("event_id", r6(kept[0], "v0"), kept[1].alias("v1"))


@query(f"WITH {EV} SELECT event_id, round(value, 6) AS value, round(value, 6) AS features FROM ev")
def sql_transformer(spark, sf):
    return SQLTransformer(statement="SELECT *, value AS features FROM __THIS__").transform(ev(spark, sf).select("event_id", r6(F.col("value"), "value")))


@query(f"WITH {EV} SELECT round(abs(least(min(delay), 0)) + 1, 6) AS glm_offset FROM ev")
def glm_offset(spark, sf):
    return ev(spark, sf).agg(r6(F.abs(F.least(F.min("delay"), F.lit(0.0))) + 1, "glm_offset"))


# --- splits ----------------------------------------------------------------------------------------

_BUCKET = "((event_id % 2147483648) * 2654435761 % 4294967296)"


@query(f"SELECT event_id, CASE WHEN {_BUCKET} % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM events")
def train_test_split(spark, sf):
    train, test = split.train_test_split(ev(spark, sf), "event_id")
    return train.select("event_id", F.lit("train").alias("part")).unionByName(test.select("event_id", F.lit("test").alias("part")))


def _salted(salt: int) -> str:
    return f"(((({_BUCKET} % 65536) * 40503 + {_BUCKET} // 65536 + {7919 * salt}) * {S.SALT_FACTORS[salt]} % 4294967296) // 64)"


@query(f"SELECT event_id, CAST({_salted(1)} % 5 AS INTEGER) AS fold FROM events")
def kfold_assign(spark, sf):
    return split.with_folds(ev(spark, sf), "event_id", 5).select("event_id", "fold")


@query(f"SELECT event_id FROM events WHERE {_salted(2)} % 1000 < 20")
def bernoulli_sample(spark, sf):
    return split.hash_sample(ev(spark, sf), "event_id", 20).select("event_id")


# --- metrics and reports -----------------------------------------------------------------------------

_PRED = f"{EV}, p AS (SELECT event_id, delay AS y, delay * 0.9 + (event_id % 7) - 3 AS f FROM ev WHERE delay IS NOT NULL)"


def _predicted(spark, sf) -> DataFrame:
    return ev(spark, sf).where("delay is not null").select("event_id", F.col("delay").alias("y"), (F.col("delay") * 0.9 + F.col("event_id") % 7 - 3).alias("f"))


@query(f"WITH {_PRED} SELECT count(*) AS n, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse, round(avg(abs(y - f)), 6) AS mae, round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2 FROM p")
def regression_metrics(spark, sf):
    m = metrics.regression_metrics(_predicted(spark, sf), "y", "f")
    return m.select("n", r6(F.col("rmse"), "rmse"), r6(F.col("mae"), "mae"), r6(F.col("r2"), "r2"))


@query(f"WITH {_PRED} SELECT round(sqrt(avg((y - f) * (y - f))), 6) AS rmse, round(avg(abs(y - f)), 6) AS mae, round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2 FROM p")
def regression_evaluator(spark, sf):
    d = _predicted(spark, sf)
    got = {m: RegressionEvaluator(labelCol="y", predictionCol="f", metricName=m).evaluate(d) for m in ("rmse", "mae", "r2")}
    return spark.range(1).select(*(r6(F.lit(v), k) for k, v in got.items()))


_CLS = f"{_PRED}, c AS (SELECT CAST(y > 30 AS DOUBLE) AS y, CAST(f > 25 AS DOUBLE) AS h, f FROM p)"
_F1 = "per AS (SELECT k, sum(t) AS t, sum(q) AS q, sum(tp) AS tp FROM (SELECT y AS k, 1 AS t, 0 AS q, CAST(y = h AS INTEGER) AS tp FROM c UNION ALL SELECT h, 0, 1, 0 FROM c) GROUP BY k)"


def _classified(spark, sf) -> DataFrame:
    return _predicted(spark, sf).select((F.col("y") > 30).cast("double").alias("y"), (F.col("f") > 25).cast("double").alias("h"), "f")


@query(f"WITH {_CLS}, {_F1} SELECT round(sum(tp) / sum(t), 6) AS accuracy, round(sum(2.0 * tp / (t + q) * t) / sum(t), 6) AS weighted_f1, CAST(sum(t) AS BIGINT) AS n FROM per")
def classification_metrics(spark, sf):
    m = metrics.classification_metrics(_classified(spark, sf), "y", "h")
    return m.select(r6(F.col("accuracy"), "accuracy"), r6(F.col("weighted_f1"), "weighted_f1"), "n")


@query(f"WITH {_CLS}, {_F1} SELECT round(sum(tp) / sum(t), 6) AS accuracy, round(sum(2.0 * tp / (t + q) * t) / sum(t), 6) AS f1 FROM per")
def classification_evaluator(spark, sf):
    d = _classified(spark, sf)
    got = {m: MulticlassClassificationEvaluator(labelCol="y", predictionCol="h", metricName=m).evaluate(d) for m in ("accuracy", "f1")}
    return spark.range(1).select(*(r6(F.lit(v), k) for k, v in got.items()))


@query(
    f"""WITH {_CLS}, g AS (SELECT f, sum(y) AS pos, sum(1 - y) AS neg FROM c GROUP BY f), b AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
    SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc_roc FROM b"""
)
def auc_roc(spark, sf):
    return metrics.auc(_classified(spark, sf), "y", "f").select(r6(F.col("auc_roc"), "auc_roc"))


@query(
    f"""WITH {_CLS}, g AS (SELECT f, sum(y) AS pos, sum(1 - y) AS neg FROM c GROUP BY f),
    b AS (SELECT f, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY f DESC ROWS UNBOUNDED PRECEDING)),
    x AS (SELECT tp / p AS r, tp / (tp + fp) AS q, coalesce(lag(tp) OVER w / p, 0) AS r0, coalesce(lag(tp / (tp + fp)) OVER w, tp / (tp + fp)) AS q0, fp / n AS e, coalesce(lag(fp) OVER w / n, 0) AS e0 FROM b WINDOW w AS (ORDER BY f DESC))
    SELECT round(sum((e - e0) * (r + r0) / 2), 6) AS "areaUnderROC", round(sum((r - r0) * (q + q0) / 2), 6) AS "areaUnderPR" FROM x"""
)
def binary_evaluator(spark, sf):
    d = _classified(spark, sf)
    # Every distinct score is a point of the curves; with bins, the areas are those of a coarser curve.
    got = {m: BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="f", metricName=m, numBins=0).evaluate(d) for m in ("areaUnderROC", "areaUnderPR")}
    return spark.range(1).select(*(r6(F.lit(v), k) for k, v in got.items()))


@query(
    f"""WITH {_PRED}, r AS (SELECT y - f AS r FROM p) SELECT count(*) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS sd, round(quantile_cont(r, 0.005), 6) AS p00_5, round(quantile_cont(r, 0.01), 6) AS p01,
    round(quantile_cont(r, 0.99), 6) AS p99, round(quantile_cont(r, 0.995), 6) AS p99_5 FROM r"""
)
def residual_summary(spark, sf):
    s = metrics.residual_summary(_predicted(spark, sf), F.col("y") - F.col("f"), accuracy=None)
    return s.select("n", *(r6(F.col(c), c) for c in s.columns[1:]))


@query(f"WITH {_PRED} SELECT CAST(least(floor((y - f + 60) / 2.0), 59) AS INTEGER) AS bin, count(*) AS n FROM p WHERE y - f BETWEEN -60 AND 60 GROUP BY 1")
def residual_histogram(spark, sf):
    return metrics.histogram(_predicted(spark, sf), F.col("y") - F.col("f"), -60.0, 60.0, 60)


@query(f"WITH {_PRED} SELECT CAST(floor(f / 10) AS INTEGER) AS gx, CAST(floor((y - f) / 10) AS INTEGER) AS gy, count(*) AS n FROM p GROUP BY ALL")
def residual_grid(spark, sf):
    return metrics.grid_counts(_predicted(spark, sf), F.col("f"), F.col("y") - F.col("f"), 10)


@query(
    f"""WITH {_PRED}, b AS (SELECT quantile_cont(y, 0.005) AS lo, quantile_cont(y, 0.995) AS hi FROM p), s AS (SELECT lo - 1e-9 * (hi - lo) AS low, (hi - lo) * (1 + 2e-9) / 45 AS sx, (hi - lo) * (1 + 2e-9) / 25 AS sy FROM b),
    u AS (SELECT (y - low) / sx AS x, (f - low) / sy AS y FROM p, s), d AS (SELECT *, pow(x - floor(x + 0.5), 2) + 3 * pow(y - floor(y + 0.5), 2) < pow(x - floor(x) - 0.5, 2) + 3 * pow(y - floor(y) - 0.5, 2) AS whole FROM u),
    h AS (SELECT CASE WHEN whole THEN 1 ELSE 2 END AS lattice, CAST(CASE WHEN whole THEN floor(x + 0.5) ELSE floor(x) END AS INTEGER) AS hx, CAST(CASE WHEN whole THEN floor(y + 0.5) ELSE floor(y) END AS INTEGER) AS hy FROM d)
    SELECT lattice, hx, hy, round((hx + (lattice - 1) * 0.5) * any_value(sx) + any_value(low), 5) AS cx, round((hy + (lattice - 1) * 0.5) * any_value(sy) + any_value(low), 5) AS cy, count(*) AS n FROM h, s
    WHERE hx BETWEEN 0 AND 46 - lattice AND hy BETWEEN 0 AND 26 - lattice GROUP BY lattice, hx, hy"""
)
def predicted_hexagons(spark, sf):
    """Predicted against actual, by hexagon, over the middle 99 % of what was actual."""
    p = _predicted(spark, sf)
    low, high = metrics.quantiles(p, F.col("y"), (0.005, 0.995), between=True)
    return metrics.hexagons(p, F.col("y"), F.col("f"), low, high).select("lattice", "hx", "hy", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), "n")


@query(f"WITH {_PRED}, b AS (SELECT quantile_cont(y - f, 0.01) AS lo, quantile_cont(y - f, 0.99) AS hi FROM p) SELECT CAST(least(floor((y - f - lo) / ((hi - lo) / 60)), 59) AS INTEGER) AS bin, count(*) AS n FROM p, b WHERE y - f BETWEEN lo AND hi GROUP BY 1")
def residual_range_histogram(spark, sf):
    """Sixty bins between the first and the last percentile."""
    return metrics.range_histogram(_predicted(spark, sf), F.col("y") - F.col("f"))[0]


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def ols_single_feature(spark, sf):
    from pyspark.ml.regression import LinearRegression

    d = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(read(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"))
    m = LinearRegression(labelCol="l_extendedprice", regParam=0.0, solver="normal").fit(d)
    return spark.range(1).select(F.round(F.lit(float(m.coefficients[0])), 6).alias("slope"), F.round(F.lit(float(m.intercept)), 4).alias("intercept"))


@query("SELECT event_id, round(value, 6) AS value, CAST(row_number() OVER (ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events QUALIFY row_number() OVER (ORDER BY value DESC, event_id) <= 15")
def topk(spark, sf):
    return metrics.top_k(read(spark, sf, "events").select("event_id", "value"), "value", 15, "event_id").select("event_id", r6(F.col("value"), "value"), "rank")


_PARTS = ("l_quantity", "l_discount * 100", "l_tax * 100", "l_extendedprice / 10000")


@query(
    "WITH v AS (" + " UNION ALL ".join(f"SELECT {k + 1} AS k, var_pop({c}) AS x FROM lineitem" for k, c in enumerate(_PARTS)) + """), s AS (SELECT k, x / sum(x) OVER () AS share FROM v)
    SELECT k, round(share, 6) AS share, round(sum(share) OVER (ORDER BY k), 6) AS cumulative FROM s"""
)
def cumulative_variance(spark, sf):
    each = read(spark, sf, "lineitem").agg(*(F.var_pop(F.expr(c)).alias(f"v{k}") for k, c in enumerate(_PARTS)))
    total = sum((F.col(f"v{k}") for k in range(1, len(_PARTS))), F.col("v0"))
    rows = each.select(F.explode(F.array(*(F.struct(F.lit(k + 1).alias("k"), (F.col(f"v{k}") / total).alias("share")) for k in range(len(_PARTS))))).alias("r")).select("r.*")
    return metrics.running_share(rows, "k", "share").select("k", r6(F.col("share"), "share"), r6(F.col("cumulative"), "cumulative"))


@query(
    """WITH v AS (SELECT p_brand || ' ' || p_type AS name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT name, value, CAST(row_number() OVER (ORDER BY value DESC, name) AS INTEGER) AS rank FROM v QUALIFY row_number() OVER (ORDER BY value DESC, name) <= 15"""
)
def importance_topk(spark, sf):
    parts = read(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("name"))
    sold = read(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("name")
    return metrics.top_k(sold.agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("value")), "value", 15, "name")


# Runs made of the events: one for each type and day, odd days on one arm and even ones on the other, some failed, some
# without an arm. A rerun of a name is another day's.
_DAYS = f"""{EV}, days AS (SELECT airline, CAST(day(ts) AS INTEGER) AS d, count(*) AS n, stddev_pop(ev.value) AS spread, avg(CAST(ev.value > 30 AS INTEGER)) AS share FROM ev JOIN events USING (event_id) GROUP BY ALL),
r AS (SELECT CASE WHEN airline = 'error' AND d % 4 = 0 THEN airline ELSE airline || '__' || CASE WHEN d % 2 = 0 THEN 'nopca' ELSE 'pca' END END AS name, airline AS model, CASE WHEN d % 2 = 0 THEN 'nopca' ELSE 'pca' END AS arm,
  CASE WHEN airline IN ('click', 'view') THEN 'classification' ELSE 'regression' END AS task, CASE WHEN n % 3 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS status, CAST(d AS DOUBLE) AS started,
  CASE WHEN airline NOT IN ('click', 'view') THEN round(spread, 6) END AS rmse, CASE WHEN airline IN ('click', 'view') THEN round(share, 6) END AS auc FROM days),
done AS (SELECT * FROM r WHERE status = 'FINISHED' AND contains(name, '__') QUALIFY row_number() OVER (PARTITION BY name ORDER BY started DESC) = 1)"""


def _runs(spark, sf) -> DataFrame:
    e = read(spark, sf, "events").select(F.col("event_type").alias("model"), F.dayofmonth("ts").alias("d"), "value")
    days = e.groupBy("model", "d").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("spread"), F.avg((F.col("value") > 30).cast("int")).alias("share"))
    arm, two = F.when(F.col("d") % 2 == 0, "nopca").otherwise("pca"), F.col("model").isin("click", "view")
    return days.select(
        F.when((F.col("model") == "error") & (F.col("d") % 4 == 0), F.col("model")).otherwise(F.concat_ws("__", "model", arm)).alias("name"),
        "model",
        arm.alias("arm"),
        F.when(two, "classification").otherwise("regression").alias("task"),
        F.when(F.col("n") % 3 == 0, "FAILED").otherwise("FINISHED").alias("status"),
        F.col("d").cast("double").alias("started"),
        F.when(~two, F.round("spread", 6)).alias("rmse"),
        F.when(two, F.round("share", 6)).alias("auc"),
    )


def _finished(spark, sf) -> DataFrame:
    from tidemill.ml.tracking import latest_finished

    kept = F.map_filter(F.create_map(F.lit("rmse"), F.col("rmse"), F.lit("auc"), F.col("auc")), lambda k, v: v.isNotNull())
    return latest_finished(_runs(spark, sf).withColumns({"run_id": F.col("name"), "metrics": kept})).drop("run_id", "metrics")


@query(f"WITH {_DAYS} SELECT name, started FROM done")
def resume_completed_arms(spark, sf):
    return _finished(spark, sf).select("name", "started")


@query(f"WITH {_DAYS} SELECT task, name, CAST(row_number() OVER (PARTITION BY task ORDER BY CASE WHEN task = 'regression' THEN rmse ELSE -auc END NULLS LAST, name) AS INTEGER) AS rank FROM done")
def tournament_table(spark, sf):
    return report.ranked(_finished(spark, sf)).select("task", "name", "rank")


@query(f"WITH {_DAYS} SELECT model, any_value(rmse) FILTER (arm = 'pca') AS pca, any_value(rmse) FILTER (arm = 'nopca') AS nopca FROM done GROUP BY model")
def arm_comparison(spark, sf):
    return report.arm_comparison(_finished(spark, sf), "rmse")


@query(f"WITH {_DAYS} SELECT arg_min(name, (rmse, name)) AS name, min(rmse) AS rmse FROM done WHERE task = 'regression'")
def tournament_winner(spark, sf):
    from tidemill.ml.tournament import winner

    rows = {r["name"]: {"task": r["task"], "metrics": {"rmse": r["rmse"]} if r["rmse"] is not None else {}} for r in _finished(spark, sf).collect()}  # one row for each arm
    best = winner(rows)
    return spark.createDataFrame([(best, rows[best]["metrics"]["rmse"])], "name string, rmse double")


@query("SELECT " + ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(38, 4))) AS DOUBLE) AS {c}" for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")) + " FROM lineitem")
def fingerprint(spark, sf):
    sums = metrics.fingerprint(read(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice"), 4)
    return sums.select(*(F.col(c).cast("double").alias(c) for c in sums.columns))


@query("SELECT 'orders' AS part, count(*) AS missing FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'lines', count(*) FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))")
def subset_check(spark, sf):
    lines, orders = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    one = metrics.missing_keys(lines, orders, "k").select(F.lit("orders").alias("part"), "missing")
    return one.unionByName(metrics.missing_keys(orders, lines, "k").select(F.lit("lines").alias("part"), "missing"))


_EACH = f"""each AS (SELECT origin, dest, abs({HAV} - distance) AS err FROM (SELECT r.*, o.lat AS olat, o.lon AS olon, d.lat AS dlat, d.lon AS dlon FROM routes r JOIN k o ON origin = o.dot_code JOIN k d ON dest = d.dot_code)),
errors AS (SELECT code, median(err) AS median_err FROM (SELECT origin AS code, err FROM each UNION ALL SELECT dest, err FROM each) GROUP BY code)"""
_LAST = _EACH.replace("each", "each2").replace("errors", "errors2").replace("JOIN k ", "JOIN k2 ")


@query(
    f"""WITH {_VOTES}, m AS (SELECT dot_code, iata_code FROM votes WHERE rn = 1 AND iata_code IN (SELECT place FROM geo)),
    numeric AS (SELECT * FROM enc WHERE regexp_matches(origin, {_NUM}) AND regexp_matches(dest, {_NUM})), routes AS (SELECT DISTINCT origin, dest, distance FROM numeric),
    k AS (SELECT dot_code, lat, lon FROM m JOIN geo ON iata_code = place), {_EACH},
    bad AS (SELECT code FROM (SELECT origin AS code FROM enc WHERE regexp_matches(origin, {_NUM}) UNION SELECT dest FROM enc WHERE regexp_matches(dest, {_NUM})) WHERE code NOT IN (SELECT dot_code FROM m)
      UNION SELECT code FROM errors WHERE median_err > {codemap.SUSPECT}),
    {_refits(codemap.ROUNDS)}, k2 AS (SELECT dot_code, lat, lon FROM t{codemap.ROUNDS} JOIN geo ON iata_code = place), {_LAST}
    SELECT dot_code, iata_code, source, round(median_err, 3) AS median_err_mi FROM t{codemap.ROUNDS} LEFT JOIN errors2 ON dot_code = code"""
)
def code_map(spark, sf):
    """The whole inference over the drifting feed: votes, errors and refits."""
    coords = geo(spark, sf).select(F.col("place").alias("iata"), "lat", "lon")
    return codemap.code_map(drift(spark, sf), coords, "month", ["o_custkey", "distance"], "origin", "dest", "distance")


# --- models, streaming, registry -------------------------------------------------


def _training(spark, sf) -> DataFrame:
    return ev(spark, sf).where("delay is not null and place is not null").select("event_id", "airline", "place", "dow", "month", "value", "delay", F.col("user_id").cast("double").alias("user_id"), S.severe_label("delay").alias("severe"))


def _small_chain(label: str, pca: bool) -> list:
    return [
        stages.IQRClip(inputCols=["value"], outputCols=["value_clip"]),
        stages.SignedLog1p(inputCols=["user_id"], outputCols=["user_log"]),
        stages.SmoothedTargetEncoder(inputCols=["place", "airline"], outputCols=["te_place", "te_airline"], labelCol=label),
        OneHotEncoder(inputCols=["dow"], outputCols=["dow_ohe"], handleInvalid="keep"),
        VectorAssembler(inputCols=["value_clip", "user_log", "te_place", "te_airline", "dow_ohe"], outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=False),
        VarianceThresholdSelector(featuresCol="scaled", outputCol="picked", varianceThreshold=0.0),
        PCA(k=3, inputCol="picked", outputCol="features") if pca else SQLTransformer(statement="SELECT *, picked AS features FROM __THIS__"),
    ]


def _fit(spark, sf, est, label: str) -> DataFrame:
    train, test = split.train_test_split(_training(spark, sf), "event_id")
    model = Pipeline(stages=[*_small_chain(label, False), est.setLabelCol(label).setFeaturesCol("features")]).fit(train)
    return model.transform(test).select("event_id", r6(F.col("prediction"), "prediction"))


_AXES = "l_quantity AS a, l_extendedprice / 1000 AS b"


@query(
    f"""WITH d AS (SELECT {_AXES} FROM lineitem), c AS (SELECT var_samp(a) AS x, var_samp(b) AS y, covar_samp(a, b) AS z FROM d), e AS (SELECT (x + y) / 2 AS mid, sqrt(pow((x - y) / 2, 2) + z * z) AS off, x + y AS total FROM c)
    SELECT 1 AS k, round((mid + off) / total, 6) AS share, round((mid + off) / total, 6) AS cumulative FROM e UNION ALL SELECT 2, round((mid - off) / total, 6), 1.0 FROM e"""
)
def pca_variance(spark, sf):
    d = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(read(spark, sf, "lineitem").selectExpr(*_AXES.split(", ")))
    model = PCA(k=2, inputCol="v", outputCol="pc").fit(d)
    rows = [(i + 1, float(x)) for i, x in enumerate(model.explainedVariance)]
    return metrics.running_share(spark.createDataFrame(rows, "k int, share double"), "k", "share").select("k", r6(F.col("share"), "share"), r6(F.col("cumulative"), "cumulative"))


@query(
    """WITH c AS (SELECT var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS by_,
      avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_extendedprice) AS y FROM lineitem), s AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS s0, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS s1 FROM c)
    SELECT round(s0, 4) AS quantity, round(s1, 2) AS discount, round(y - s0 * a - s1 * b, 3) AS intercept FROM s"""
)
def linear_fit(spark, sf):
    from pyspark.ml.regression import LinearRegression

    d = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(read(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"))
    m = LinearRegression(labelCol="l_extendedprice", regParam=0.0, solver="normal").fit(d)
    row = (*(float(x) for x in m.coefficients), float(m.intercept))
    return spark.range(1).select(*(F.round(F.lit(v), digits).alias(n) for v, digits, n in zip(row, (4, 2, 3), ("quantity", "discount", "intercept"), strict=True)))


# A model that can tell every weekday apart, and sees nothing else, has learned the mean label of each weekday: SQL gives
# that from the training part, for the rows of the test part.
_TRAIN = f"{EV}, t AS (SELECT event_id, dow, delay, CAST(delay > 30 AS DOUBLE) AS severe, {_BUCKET} % 100 < 80 AS learn FROM ev WHERE delay IS NOT NULL AND place IS NOT NULL)"


def _by_day(value: str, digits: int = 6, more: str = "") -> str:
    return f"WITH {_TRAIN}{more}, m AS (SELECT dow, {value} AS p FROM t WHERE learn GROUP BY dow) SELECT event_id, round(p, {digits}) AS prediction FROM t JOIN m USING (dow) WHERE NOT learn"


def _days(spark, sf, est, label: str, value=None) -> DataFrame:
    train, test = split.train_test_split(_training(spark, sf), "event_id")
    model = Pipeline(stages=[VectorAssembler(inputCols=["dow"], outputCol="features"), est.setLabelCol(label).setFeaturesCol("features")]).fit(train)
    return model.transform(test).select("event_id", r6(F.col("prediction") if value is None else value, "prediction"))


_ALL_ROWS = {"bootstrap": False, "featureSubsetStrategy": "all", "maxDepth": 6, "maxBins": 64, "seed": 7}


@query(_by_day("avg(delay + shift)", 4, ", s AS (SELECT abs(least(min(delay), 0)) + 1 AS shift FROM t WHERE learn)").replace("FROM t WHERE learn GROUP BY dow", "FROM t, s WHERE learn GROUP BY dow"))
def glm_fit(spark, sf):
    from pyspark.ml.regression import GeneralizedLinearRegression

    from tidemill.ml.tournament import label_shift

    train, test = split.train_test_split(_training(spark, sf), "event_id")
    shifted = train.withColumn("shifted", F.col("delay") + F.lit(label_shift(train, "delay")))
    est = GeneralizedLinearRegression(family="poisson", link="log", maxIter=50, tol=1e-12, regParam=0.0, labelCol="shifted", featuresCol="features")
    chain = [StringIndexer(inputCol="dow", outputCol="day"), OneHotEncoder(inputCols=["day"], outputCols=["features"], dropLast=True), est]
    return Pipeline(stages=chain).fit(shifted).transform(test).select("event_id", F.round("prediction", 4).alias("prediction"))


@query()
def svc_fit(spark, sf):
    """No closed form; the tests hold its loss against plain subgradient descent."""
    from pyspark.ml.classification import LinearSVC

    return _fit(spark, sf, LinearSVC(maxIter=10, regParam=0.1), "severe")


@query(_by_day("avg(delay)"))
def rf_fit(spark, sf):
    from pyspark.ml.regression import RandomForestRegressor

    return _days(spark, sf, RandomForestRegressor(numTrees=5, **_ALL_ROWS), "delay")


@query(_by_day("CASE WHEN avg(CAST(delay > LIMIT AS INTEGER)) > 0.5 THEN 1.0 ELSE 0.0 END").replace("LIMIT", "4.5"))
def rf_classifier_fit(spark, sf):
    """Whether most rows of the weekday are over a limit; trees drop splits that don't change that, so shares aren't compared."""
    from pyspark.ml.classification import RandomForestClassifier

    train, test = (d.withColumn("over", (F.col("delay") > 4.5).cast("double")) for d in split.train_test_split(_training(spark, sf), "event_id"))
    est = RandomForestClassifier(numTrees=5, labelCol="over", featuresCol="features", **_ALL_ROWS)
    model = Pipeline(stages=[VectorAssembler(inputCols=["dow"], outputCol="features"), est]).fit(train)
    return model.transform(test).select("event_id", "prediction")


@query(_by_day("avg(delay)"))
def gbt_fit(spark, sf):
    from pyspark.ml.regression import GBTRegressor

    return _days(spark, sf, GBTRegressor(maxIter=3, maxDepth=6, maxBins=64, seed=7), "delay")


@query(_by_day("avg(2 * severe - 1)"))
def gbt_classifier_fit(spark, sf):
    """The margin after one round: the mean of the labels as -1 and 1."""
    from pyspark.ml.classification import GBTClassifier

    return _days(spark, sf, GBTClassifier(maxIter=1, maxDepth=6, maxBins=64, seed=7), "severe", value=vector_to_array("rawPrediction")[1])


@query(f"WITH {EV} SELECT event_id, airline, round(value - 30, 6) AS prediction FROM ev WHERE delay IS NOT NULL AND place IS NOT NULL")
def stream_score(spark, sf):
    """Events written as JSON, scored as a stream, one file a batch, and read back. The model has learned what the delay is."""
    from pyspark.ml.regression import LinearRegression

    from tidemill.plans.contract import ServingContract
    from tidemill.sources.store import work_folder
    from tidemill.streaming.score import drain, start_scoring

    work = work_folder(spark, "stream")
    d = _training(spark, sf).drop("severe")
    chain = [VectorAssembler(inputCols=["value"], outputCol="features"), LinearRegression(labelCol="delay", regParam=0.0, solver="normal")]
    model = Pipeline(stages=chain).fit(d)
    d.drop("delay").coalesce(2).write.mode("overwrite").json(f"{work}/in")
    contract = ServingContract.of(d, ("delay",))
    drain(start_scoring(spark, f"{work}/in", contract, model, f"{work}/out", f"{work}/checkpoint", keep=("event_id", "airline")))
    return spark.read.parquet(f"{work}/out").select("event_id", "airline", r6(F.col("prediction"), "prediction"))


@query(
    f"""WITH {EV}, q AS (SELECT quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM ev), f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT 2 AS version, count(*) AS n, round(max(least(greatest(value, lo), hi)), 6) AS most FROM ev, f"""
)
def registry_lookup(spark, sf):
    """A model registered twice; the alias names the second version."""
    from tidemill.ml.tracking import Tracker
    from tidemill.sources.store import work_folder

    t = Tracker(spark, work_folder(spark, "registry"))
    d = ev(spark, sf).select("event_id", "value", "delay")
    for run, multiplier in (("a__pca", 0.5), ("b__nopca", 1.5)):
        model = Pipeline(stages=[stages.IQRClip(inputCols=["value"], outputCols=["clipped"], iqrMultiplier=multiplier, relativeError=0.0)]).fit(d)
        version = t.register("demo", run, model, {"run": run})
        t.set_alias("demo", "staging", version)
    loaded = t.load("demo", "production", "staging")
    return loaded.transform(d).agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("n"), r6(F.max("clipped"), "most"))


@query()
def full_chain(spark, sf):
    """The default feature chain over a curated table of full shape, fitted and measured."""
    from tidemill.plans.training import chain_metrics

    return chain_metrics(spark, sf)


@query()
def tournament(spark, sf):
    """A linear model on both arms, cross-validated; one row for each arm."""
    from pyspark.ml.regression import LinearRegression

    from tidemill.ml.specs import ModelSpec
    from tidemill.ml.tournament import Settings, run_tournament
    from tidemill.ml.tracking import Tracker
    from tidemill.plans.training import flights
    from tidemill.sources.store import work_folder

    tracker = Tracker(spark, work_folder(spark, "tournament"))
    spec = ModelSpec("linear_regression", "regression", "label_delay", lambda: LinearRegression(maxIter=20), (("regParam", (0.01, 0.1)),))
    out = run_tournament(flights(spark, sf), [spec], tracker, Settings("row_id", folds=2, pca_k=10, tune_per_mille=100))
    if out.failures:
        raise RuntimeError(str(out.failures))
    rows = [(n, r["task"], r["metrics"]["rmse"], r["metrics"]["r2"]) for n, r in sorted(out.results.items())]
    return spark.createDataFrame(rows, "arm string, task string, rmse double, r2 double")


from tidemill.plans import event_queries, model_queries  # noqa: E402,F401  they register their queries here
