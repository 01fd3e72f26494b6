"""Queries over event time: a stream that is fed out of order, with repeats and late rows, against SQL over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.queries import query
from tidemill.plans.views import read
from tidemill.sources.files import scan_csv
from tidemill.sources.sinks import keep_corrupt, split_corrupt
from tidemill.sources.store import work_folder
from tidemill.streaming import windows as W

#: Rows come in feeds of so many days; some come a feed or two late, and some twice.
DAYS, FEEDS = 6, 5
WHEN = W.EventTime("ts", "4 days")
SCHEMA = "event_id long, ts timestamp, user_id long, kind string, cents long"


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the feed that it comes in; every 17th comes again with the next one."""
    k = F.col("event_id")
    # The table's times have no zone; a watermark needs instants, and days are those of UTC.
    at = F.from_utc_timestamp(F.col("ts").cast("timestamp_ntz").cast("timestamp"), F.current_timezone())
    e = read(spark, sf, "events").withColumn("day", F.dayofmonth("ts")).select("event_id", "day", at.alias("ts"), "user_id", F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    late = F.when(k % 29 == 0, 2).when(k % 13 == 0, 1).otherwise(0)
    first = F.least(F.floor((F.col("day") - 1) / DAYS).cast("int"), F.lit(FEEDS - 1)) + late
    copies = F.when(k % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return e.withColumn("feed", F.explode(F.transform(copies, lambda c: F.least(first + c, F.lit(FEEDS - 1)))))


# wm: what the watermark is while a feed is read, and at the end; fed: rows that come in time for it, each event once.
_FED = f"""f AS (SELECT event_id, ts, user_id, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS cents, least(least((day(ts) - 1) // {DAYS}, {FEEDS - 1}) + CASE WHEN event_id % 29 = 0 THEN 2 WHEN event_id % 13 = 0 THEN 1 ELSE 0 END, {FEEDS - 1}) AS feed FROM events),
  top AS (SELECT feed, max(ts) AS t FROM (SELECT feed, ts FROM f UNION ALL SELECT least(feed + 1, {FEEDS - 1}), ts FROM f WHERE event_id % 17 = 0) GROUP BY feed),
  wm AS (SELECT k AS feed, date_trunc('milliseconds', (SELECT max(t) FROM top WHERE feed < k)) - INTERVAL 4 DAY AS w FROM range({FEEDS + 1}) r(k)),
  fed AS (SELECT f.* FROM f JOIN wm USING (feed) WHERE w IS NULL OR ts > w), done AS (SELECT w FROM wm WHERE feed = {FEEDS})"""


def streamed(spark: SparkSession, sf: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the feeds writes, one feed at a time: each is read by a new query that starts from the checkpoint."""
    work = work_folder(spark, "events")
    rows = arrivals(spark, sf).persist()
    try:
        for k in range(FEEDS):
            rows.where(F.col("feed") == k).drop("feed", "day").coalesce(1).write.mode("append").parquet(f"{work}/in")
            W.take_available(plan(W.scan_events(spark, f"{work}/in", SCHEMA, "parquet")), f"{work}/out", f"{work}/checkpoint")
    finally:
        rows.unpersist()
    return spark.read.parquet(f"{work}/out")


def _text(c: str):
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def _totals() -> dict:
    return {"n": F.count(F.lit(1)), "cents": F.sum("cents"), "largest": F.max("cents")}


_SUMS = "count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, max(cents) AS largest"
_SPAN = "strftime(begins, '%Y-%m-%d %H:%M:%S.%f') AS begins, strftime(ends, '%Y-%m-%d %H:%M:%S.%f') AS ends"


@query(f"WITH {_FED} SELECT event_id, cents FROM fed")
def stream_first_copies(spark, sf):
    """Repeated events known within the delay of the watermark."""
    return streamed(spark, sf, lambda e: W.first_copies(e, ["event_id"], WHEN)).select("event_id", "cents")


@query(f"WITH {_FED}, x AS (SELECT date_trunc('day', ts) AS begins, date_trunc('day', ts) + INTERVAL 1 DAY AS ends, kind, {_SUMS} FROM fed GROUP BY ALL) SELECT {_SPAN}, kind, n, cents, largest FROM x, done WHERE ends <= w")
def stream_tumbling(spark, sf):
    """Days of each kind of event, over events of which only the first copy counts: two operators with state."""
    out = streamed(spark, sf, lambda e: W.by_window(W.first_copies(e, ["event_id"], WHEN), WHEN, "1 day", ["kind"], _totals()))
    return out.select(_text("begins"), _text("ends"), "kind", "n", "cents", "largest")


@query(
    f"""WITH {_FED}, each AS (SELECT feed, kind, cents, begins, begins + INTERVAL 2 DAY AS ends FROM (SELECT *, date_trunc('day', ts) - INTERVAL 1 DAY * s AS begins
      FROM (SELECT * FROM f UNION ALL SELECT * REPLACE (least(feed + 1, {FEEDS - 1}) AS feed) FROM f WHERE event_id % 17 = 0), (VALUES (0), (1)) v(s))),
    x AS (SELECT begins, ends, kind, {_SUMS} FROM each JOIN wm USING (feed) WHERE w IS NULL OR ends > w GROUP BY ALL) SELECT {_SPAN}, kind, n, cents, largest FROM x, done WHERE ends <= w"""
)
def stream_sliding(spark, sf):
    """Two days of each kind, a day apart. A late row still counts in the windows that are open."""
    out = streamed(spark, sf, lambda e: W.by_window(W.accepted(e, WHEN), WHEN, "2 days", ["kind"], _totals(), "1 day"))
    return out.select(_text("begins"), _text("ends"), "kind", "n", "cents", "largest")


def _sessions(gap: str) -> str:
    """Sessions feed by feed: those still open and the rows that come in time, put together; the ones that ended are shut."""
    steps, last = [], "SELECT user_id, ts AS begins, ts AS ends, 0 AS n, 0 AS cents, 0 AS largest FROM f WHERE false"
    for k in range(FEEDS):
        steps += [
            f"""i{k} AS (SELECT user_id, begins, ends, n, cents, largest FROM ({last}) UNION ALL
            SELECT user_id, ts, ts + INTERVAL {gap}, 1, cents, cents FROM (SELECT * FROM f UNION ALL SELECT * REPLACE (least(feed + 1, {FEEDS - 1}) AS feed) FROM f WHERE event_id % 17 = 0) a JOIN wm USING (feed) WHERE feed = {k} AND (w IS NULL OR ts + INTERVAL {gap} > w))""",
            f"g{k} AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY begins, ends ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, coalesce(begins > max(ends) OVER (PARTITION BY user_id ORDER BY begins, ends ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM i{k}))",
            f"m{k} AS MATERIALIZED (SELECT user_id, min(begins) AS begins, max(ends) AS ends, sum(n) AS n, sum(cents) AS cents, max(largest) AS largest FROM g{k} GROUP BY user_id, s)",
        ]
        last = f"SELECT m{k}.* FROM m{k}, wm WHERE feed = {k + 1} AND ends > w"
    shut = " UNION ALL ".join(f"SELECT m{k}.* FROM m{k}, wm WHERE feed = {k + 1} AND ends <= w" for k in range(FEEDS))
    return f"WITH {_FED}, {', '.join(steps)} SELECT {_SPAN}, user_id, CAST(n AS BIGINT) AS n, CAST(cents AS BIGINT) AS cents, largest FROM ({shut})"


@query(_sessions("6 HOUR"))
def stream_sessions(spark, sf):
    """Runs of a user's events without a pause of six hours."""
    out = streamed(spark, sf, lambda e: W.by_session(W.accepted(e, WHEN), WHEN, "6 hours", ["user_id"], _totals()))
    return out.select(_text("begins"), _text("ends"), "user_id", "n", "cents", "largest")


@query("SELECT event_id, CASE WHEN event_id % 23 <> 0 AND event_id % 31 <> 0 THEN user_id END AS user_id, event_id % 23 <> 0 AND event_id % 31 <> 0 AS fits FROM events")
def malformed_lines(spark, sf):
    """Events as text lines, some with a word for a number and some cut short: those that fit, and those kept apart."""
    k, work = F.col("event_id"), work_folder(spark, "lines")
    user = F.when(k % 23 == 0, F.lit("nobody")).otherwise(F.col("user_id").cast("string"))
    lines = read(spark, sf, "events").select(F.concat_ws(",", k.cast("string"), F.when(k % 31 != 0, user), F.when(k % 31 != 0, F.col("event_type"))).alias("value"))
    lines.write.text(f"{work}/in")
    rows = scan_csv(spark, f"{work}/in", "event_id long, user_id long, kind string", header=False, corrupt=True)
    keep_corrupt(rows, f"{work}/bad")
    good, bad = split_corrupt(rows)[0], spark.read.parquet(f"{work}/bad")
    apart = bad.select(F.regexp_extract("record", "^([0-9]+)", 1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), F.lit(False).alias("fits"))
    return good.select("event_id", "user_id", F.lit(True).alias("fits")).unionByName(apart)


def _of(kind: str) -> str:
    """Rows of a kind, and while each feed is read the latest time of that kind before it."""
    return f"""{kind}_rows AS (SELECT * FROM (SELECT * FROM f UNION ALL SELECT * REPLACE (least(feed + 1, {FEEDS - 1}) AS feed) FROM f WHERE event_id % 17 = 0) WHERE kind = '{kind}'),
    {kind}_top AS (SELECT k AS feed, (SELECT max(ts) FROM {kind}_rows WHERE feed < k) AS t FROM range({FEEDS}) r(k))"""


@query(
    f"""WITH {_FED}, {_of("view")}, {_of("purchase")}, low AS (SELECT feed, date_trunc('milliseconds', least(v.t, p.t)) - INTERVAL 4 DAY AS w FROM view_top v JOIN purchase_top p USING (feed)),
    a AS (SELECT r.* FROM view_rows r JOIN low USING (feed) WHERE w IS NULL OR ts > w), b AS (SELECT r.* FROM purchase_rows r JOIN low USING (feed) WHERE w IS NULL OR ts > w)
    SELECT a.user_id, a.event_id AS view_id, b.event_id AS purchase_id, CAST(count(*) AS BIGINT) AS times FROM a JOIN b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOUR GROUP BY ALL"""
)
def stream_join(spark, sf):
    """Purchases within twelve hours of a view by the same user: a join of two streams, each with its watermark."""

    def plan(e: DataFrame) -> DataFrame:
        kind = lambda k: e.where(F.col("kind") == k).select("event_id", "ts", "user_id")
        return W.followed_by(kind("view"), kind("purchase"), "user_id", WHEN, "12 hours", ("view", "purchase"))

    pairs = streamed(spark, sf, plan).groupBy(F.col("view_user_id").alias("user_id"), F.col("view_event_id").alias("view_id"), F.col("purchase_event_id").alias("purchase_id"))
    return pairs.agg(F.count(F.lit(1)).alias("times"))
