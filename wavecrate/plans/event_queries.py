"""Queries over the events table; it stands for login failures, corrections and frame values (see each docstring)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrate.operators import events as E
from wavecrate.sources.tables import load, shared_path
from wavecrate.streaming.logins import as_of, failure_changes, keyed_state
from wavecrate.streaming.outbox import Outbox
from wavecrate.streaming.release import in_order

EVENTS_A_FILE = 500_000  # of a stream's input


def _failures(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", F.unix_timestamp(F.date_trunc("second", "ts")).alias("at_s"))


def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    """Errors as login failures of users; two days and a limit of 3, so that the rule fires on these data."""
    return E.failure_window(_failures(spark, d), "user_id", "at_s", 172_800, 3)


def login_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Errors as failures, purchases as successes; now is the newest event."""
    events = load(spark, d, "events").select("user_id", "event_type", F.unix_timestamp(F.date_trunc("second", "ts")).alias("at_s"))
    now = events.agg(F.max("at_s").alias("now"))
    return E.live_failures(events.crossJoin(F.broadcast(now)), "user_id", "at_s", F.col("event_type") == "error", F.col("event_type") == "purchase", F.col("now"), 2_592_000)


def _log(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def correction_latest(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of corrections keyed by user and type."""
    return E.latest_corrections(_log(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value", "place")


def correction_artist_rule(spark: SparkSession, d: str) -> DataFrame:
    """Users as artists, event types as genres."""
    return E.artist_rule(_log(spark, d), "user_id", "event_type", "event_id")


def correction_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tracks: customer modulo 200 as artist and order modulo 7 as title, corrected by events of that minute."""
    log = _log(spark, d).withColumn("title", F.minute("ts") % 7)
    by_track = E.latest_corrections(log, ["user_id", "title"], ["ts", "event_id"]).select("user_id", "title", "event_type").filter("title < 3")
    by_artist = E.artist_rule(log, "user_id", "event_type", "event_id")
    items = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("user_id"), (F.col("o_orderkey") % 7).cast("int").alias("title"))
    return E.corrected(items, by_track, by_artist, ["user_id", "title"], "user_id", "event_type").select("o_orderkey", "genre", "scope")


def unsent_queue(spark: SparkSession, d: str) -> DataFrame:
    """Events as queued entries; those whose id is divisible by 3 are acknowledged."""
    log = _log(spark, d)
    return E.unsent(log, log.filter("event_id % 3 = 0"), "event_id", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


def gated_mean(spark: SparkSession, d: str) -> DataFrame:
    """Values of users as block energies; floor 10, relative gate a half."""
    return E.gated_mean(_log(spark, d), ["user_id"], "value", 10.0, 0.5)


def sliding_best(spark: SparkSession, d: str) -> DataFrame:
    """The best mean of a user's windows of three days every day from the first event."""
    rows = _log(spark, d).select("user_id", "value", F.unix_timestamp(F.date_trunc("second", "ts")).alias("at_s"))
    means = E.sliding_windows(rows, "user_id", "at_s", 259_200, 86_400).groupBy("user_id", "window").agg(E.exact_mean(F.col("value")).alias("mean"))
    return means.groupBy("user_id").agg(F.max("mean").alias("best"), F.count("*").alias("n_windows"))


def hop_windows(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of windows of four events every two."""
    rows = E.hop_windows(_log(spark, d), "user_id", ["ts", "event_id"], 4, 2)
    return rows.groupBy("user_id", "window").agg(E.exact_mean(F.col("value")).alias("mean"), F.min("pos").cast("int").alias("first_pos"))


def onset_flux(spark: SparkSession, d: str) -> DataFrame:
    return E.rising_flux(_log(spark, d), "user_id", ["ts", "event_id"], "value").select("event_id", "flux")


def local_peaks(spark: SparkSession, d: str) -> DataFrame:
    return E.local_peaks(_log(spark, d), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "value")


def lookahead_min(spark: SparkSession, d: str) -> DataFrame:
    return E.lookahead_min(_log(spark, d), "user_id", ["ts", "event_id"], "value", 5).select("event_id", "ahead_min")


def range_feed(spark: SparkSession, d: str) -> DataFrame:
    """Event numbers as frames, fed into three overlapping ranges that together cover every event."""
    log = _log(spark, d)
    end = log.agg(F.coalesce(F.max("event_id"), F.lit(0)) + 1).first()[0]  # one number
    ranges = spark.createDataFrame([(0, 0, end // 2), (1, end // 4, end * 3 // 4), (2, end * 2 // 5, end)], "range_id int, start long, stop long")
    fed = E.range_feed(log, "event_id", ranges, max(256, end // 256))
    return fed.groupBy("range_id").agg(F.count("*").alias("n"), E.exact_mean(F.col("value")).alias("mean"))


def spread_mode(spark: SparkSession, d: str) -> DataFrame:
    """Window means as window tempi, folded to the user's first one."""
    means = hop_windows(spark, d).filter("mean > 0")
    first = means.groupBy("user_id").agg(F.min_by("mean", "window").alias("reference"))
    return E.tempo_mode(means.join(first, "user_id"), "user_id", "mean", "reference", 20.0).select("user_id", "n", "mode", "low", "high", "value")


def batch_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Done, failed and produced of each user's batch."""
    is_error = F.col("event_type") == "error"
    return load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("done"), F.count_if(is_error).alias("failed"), F.count_if(~is_error).alias("produced"))


def login_state(spark: SparkSession, d: str) -> DataFrame:
    """T2 as state with timers: a stream of errors and purchases, read at four points of the log's time; five days count."""
    events = load(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*events*").parquet(d.rstrip("/")).withColumn("ts", F.col("ts").cast("timestamp"))
    changes = failure_changes(stream, "user_id", "ts", F.col("event_type") == "error", F.col("event_type") == "purchase", 432_000, "0 seconds")
    path = shared_path(spark, "logins")
    with keyed_state(spark):
        changes.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/changes").awaitTermination()
    second = F.unix_timestamp(F.date_trunc("second", "ts"))
    span = events.agg(F.min(second).alias("low"), F.max(second).alias("high"))
    points = span.select(F.explode(F.expr("transform(sequence(1, 4), k -> low + (high - low) * k div 4)")).alias("point"))
    return as_of(spark.read.parquet(f"{path}/changes"), "user_id", points)


def outbox_delivery(spark: SparkSession, d: str) -> DataFrame:
    """T1 with versions: a user's events as edits of one entry; the newest is sent, all but every seventh is acknowledged, and refused ones are sent again at the end."""
    log = _log(spark, d).select("user_id", "event_id", "ts")

    def send(rows: DataFrame) -> DataFrame:
        # A send that holds refused ones alone is their second.
        others = F.count_if(F.col("user_id") % 7 != 0).over(Window.partitionBy("send"))
        return rows.withColumn("others", others).filter("user_id % 7 <> 0 or others = 0")

    box = Outbox(log.schema, "user_id", "event_id", ["ts", "event_id"], send, shared_path(spark, "outbox"), spark, wide=True)
    box.put(log, 0)
    box.drain()
    return box.acknowledged().select("user_id", "event_id")


def ordered_release(spark: SparkSession, d: str) -> DataFrame:
    """W11 as a stream: a user's events by place, come in four micro-batches that mix all places; each row leaves with the number of its release."""
    placed = _log(spark, d).select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("place"))
    path = shared_path(spark, "release")
    files = max(1, -(-load(spark, d, "events").count() // (4 * EVENTS_A_FILE)))  # one number: of a micro-batch
    placed.repartition(4 * files, F.xxhash64("event_id")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("user_id long, event_id long, place int").option("maxFilesPerTrigger", files).parquet(f"{path}/in")

    def told(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    with keyed_state(spark):
        released = in_order(stream, "user_id", "place", ["event_id"])
        released.writeStream.foreachBatch(told).outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    # Earlier batches hold earlier places, so the batches' sizes say how many were released before each row.
    before = rows.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("user_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before.select("user_id", "batch", "before", "first"), ["user_id", "batch"]).select("user_id", "event_id", (F.col("before") + F.col("place") - F.col("first")).alias("release"))


QUERIES = {f.__name__: f for f in (rate_limit_window, login_expiry, login_state, outbox_delivery, ordered_release, correction_latest, correction_artist_rule, correction_resolve, unsent_queue, gated_mean, sliding_best, hop_windows, onset_flux, local_peaks, lookahead_min, range_feed, spread_mode, batch_tallies)}

_AT = "CAST(floor(epoch(ts)) AS BIGINT)"
_HOPS = """p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        h AS (SELECT user_id, w AS window, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean, CAST(min(pos) AS INTEGER) AS first_pos
              FROM p, LATERAL (SELECT unnest(range(0, (n - 4) // 2 + 1)) AS w) WHERE n >= 8 AND pos >= w * 2 AND pos < w * 2 + 4 GROUP BY ALL)"""
ORACLE = {
    "rate_limit_window": f"""
        WITH f AS (SELECT event_id, user_id, {_AT} AS at_s FROM events WHERE event_type = 'error'),
        w AS (SELECT *, count(*) OVER r AS n, min(at_s) OVER r AS oldest FROM f WINDOW r AS (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN 172799 PRECEDING AND CURRENT ROW))
        SELECT *, CASE WHEN n >= 3 THEN greatest(1, oldest + 172800 - at_s) ELSE 0 END AS retry_after FROM w""",
    "login_expiry": f"""
        WITH e AS (SELECT user_id, event_type, {_AT} AS at_s, max({_AT}) OVER () AS now, max(CASE WHEN event_type = 'purchase' THEN {_AT} END) OVER (PARTITION BY user_id) AS ok FROM events)
        SELECT user_id, count(*) AS n, min(at_s) AS oldest FROM e WHERE event_type = 'error' AND at_s > now - 2592000 AND at_s > coalesce(ok, -1) GROUP BY user_id""",
    "login_state": f"""
        WITH e AS (SELECT user_id, event_type, {_AT} AS at_s FROM events), b AS (SELECT min(at_s) AS low, max(at_s) AS high FROM e),
        p AS (SELECT low + (high - low) * k // 4 AS point FROM b, (VALUES (1), (2), (3), (4)) v(k)),
        o AS (SELECT point, user_id, max(at_s) AS ok FROM e JOIN p ON at_s <= point WHERE event_type = 'purchase' GROUP BY ALL)
        SELECT point, user_id, count(*) AS n, min(at_s) AS oldest FROM e JOIN p ON at_s <= point AND at_s > point - 432000 LEFT JOIN o USING (point, user_id)
        WHERE event_type = 'error' AND at_s > coalesce(ok, -1) GROUP BY ALL""",
    "outbox_delivery": "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id",
    "ordered_release": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS release FROM events",
    "correction_latest": """
        SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, arg_min(event_id, (ts, event_id)) AS place FROM events GROUP BY user_id, event_type""",
    "correction_artist_rule": """
        WITH v AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS seen FROM events GROUP BY ALL HAVING count(*) >= 2)
        SELECT user_id, event_type, votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, seen) = 1""",
    "correction_resolve": """
        WITH l AS (SELECT *, minute(ts) % 7 AS title FROM events),
        t AS (SELECT user_id, title, arg_max(event_type, (ts, event_id)) AS g FROM l WHERE title < 3 GROUP BY ALL),
        v AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS seen FROM l GROUP BY ALL HAVING count(*) >= 2),
        a AS (SELECT user_id, event_type AS g FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, seen) = 1)
        SELECT o_orderkey, coalesce(t.g, a.g) AS genre, CASE WHEN t.g IS NOT NULL THEN 'track' WHEN a.g IS NOT NULL THEN 'artist' END AS scope
        FROM orders o LEFT JOIN t ON t.user_id = o.o_custkey % 200 AND t.title = o.o_orderkey % 7 LEFT JOIN a ON a.user_id = o.o_custkey % 200""",
    "unsent_queue": "SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 <> 0 ORDER BY ts, event_id LIMIT 200",
    "gated_mean": """
        WITH o AS (SELECT user_id, value FROM events WHERE value > 10.0),
        g AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS gate FROM o GROUP BY user_id)
        SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS gated, count(*) AS n_kept FROM o JOIN g USING (user_id) WHERE value > gate * 0.5::DOUBLE GROUP BY user_id""",
    "sliding_best": f"""
        WITH r AS (SELECT user_id, value, {_AT} AS at_s FROM events),
        s AS (SELECT user_id, min(at_s) AS b, max(at_s) AS f FROM r GROUP BY user_id),
        w AS (SELECT user_id, b + 86400 * k AS start, k FROM (SELECT *, unnest(range(0, CAST((f - b) // 86400 AS BIGINT) + 1)) AS k FROM s) WHERE b + 86400 * k + 259200 <= f),
        m AS (SELECT w.user_id, k, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean FROM w JOIN r ON r.user_id = w.user_id AND at_s >= start AND at_s < start + 259200 GROUP BY ALL)
        SELECT user_id, max(mean) AS best, count(*) AS n_windows FROM m GROUP BY user_id""",
    "hop_windows": f"WITH {_HOPS} SELECT * FROM h",
    "onset_flux": "SELECT event_id, CASE WHEN s IS NOT NULL THEN greatest(s, 0.0::DOUBLE) END AS flux FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events)",
    "local_peaks": "SELECT event_id, user_id, value FROM (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE value > b AND value > a",
    "lookahead_min": "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS ahead_min FROM events",
    "range_feed": """
        WITH m AS (SELECT max(event_id) + 1 AS e FROM events), r AS (SELECT 0 AS range_id, 0 AS start, e // 2 AS stop FROM m UNION ALL SELECT 1, e // 4, e * 3 // 4 FROM m UNION ALL SELECT 2, e * 2 // 5, e FROM m)
        SELECT range_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean
        FROM events JOIN r ON event_id >= start AND event_id < stop GROUP BY range_id""",
    "spread_mode": f"""
        WITH {_HOPS},
        g AS (SELECT * FROM h WHERE mean > 0), r AS (SELECT user_id, arg_min(mean, "window") AS ref FROM g GROUP BY user_id),
        f AS (SELECT user_id, ref, mean * pow(2.0::DOUBLE, greatest(0, ceil(log2(0.75::DOUBLE / (mean / ref)))) - greatest(0, ceil(log2(mean / ref / 1.5::DOUBLE)))) AS v FROM g JOIN r USING (user_id)),
        s AS (SELECT user_id, ref, count(*) AS n, min(v) AS low, max(v) AS high, median(v) AS mid FROM f GROUP BY ALL)
        SELECT user_id, n, CASE WHEN n < 2 OR high - low <= 20 THEN 'constant' ELSE 'dynamic' END AS mode, low, high, CASE WHEN n < 2 OR high - low <= 20 THEN ref ELSE mid END AS value FROM s""",
    "batch_tallies": "SELECT user_id, count(*) AS done, count_if(event_type = 'error')::BIGINT AS failed, count_if(event_type <> 'error')::BIGINT AS produced FROM events GROUP BY user_id",
}
