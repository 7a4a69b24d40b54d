"""Queries on jobs, progress and intervals, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalar as S
from quire.operators import aggregates as A
from quire.operators import folds as D
from quire.operators import intervals as I
from quire.operators import joins as J
from quire.streaming import watcher as W

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _jobs(events):
    """Events as jobs: their type as status, their time and value as life and share."""
    status = F.when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    ms = S.millis(F.col("ts"))
    return events.select(F.col("event_id").alias("id"), "user_id", status.alias("status"), ms.alias("created_at"), F.when(status != "running", ms + (F.col("value") * 1000).cast("long")).alias("ended_at"), F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("value") / 100)).alias("progress"))


JOBS = """j AS (SELECT event_id AS id, user_id, CASE WHEN event_type IN ('view', 'click') THEN 'running' WHEN event_type = 'purchase' THEN 'done' ELSE 'failed' END AS status, (epoch_us(ts) // 1000) AS created_at,
    CASE WHEN event_type NOT IN ('view', 'click') THEN (epoch_us(ts) // 1000) + CAST(trunc(value * 1000) AS BIGINT) END AS ended_at, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE least(1.0, value / 100) END AS progress FROM events)"""
NOW = 1_705_000_000_000


@query(f"""WITH {JOBS} SELECT count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status NOT IN ('running', 'done')) AS failed, round(coalesce(avg(progress), 0), 9) AS progress,
    CASE WHEN count(*) FILTER (status = 'running') > 0 THEN 'running' WHEN count(*) FILTER (status NOT IN ('running', 'done')) > 0 THEN 'failed' WHEN count(*) FILTER (status = 'done') > 0 THEN 'done' ELSE 'idle' END AS overall FROM j""")
def board_summary(spark, sf_dir):
    """AGG-7, AGG-8."""
    return A.job_summary(_jobs(table(spark, sf_dir, "events"))).withColumn("progress", F.round("progress", 9))


@query(f"WITH {JOBS} SELECT id, status FROM j ORDER BY created_at DESC, id DESC LIMIT 200")
def ledger_keep_last(spark, sf_dir):
    """WIN-8, SNK-6, SRT-1: the limit is the feature."""
    return A.keep_last(_jobs(table(spark, sf_dir, "events")), 200, ("created_at", "id")).select("id", "status")


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id ORDER BY ts DESC, user_id LIMIT 4")
def recent_paths(spark, sf_dir):
    """WIN-7: the limit is the feature."""
    return A.recent(table(spark, sf_dir, "events"), "user_id", "ts", 4)


_SEC = "floor(greatest(0, coalesce(ended_at, {now}) - created_at) / 1000 + 0.5)".format(now=NOW)


@query(f"""WITH {JOBS}, e AS (SELECT *, greatest(0, coalesce(ended_at, {NOW}) - created_at) AS elapsed, CAST({_SEC} AS BIGINT) AS s FROM j)
    SELECT id, CASE WHEN status = 'done' THEN 1.0 WHEN status = 'failed' THEN coalesce(progress, 0) WHEN progress > 0 THEN least(progress, 0.98) ELSE least(greatest(elapsed / 120000.0, 0.02), 0.15) END AS progress, CAST(elapsed AS BIGINT) AS elapsed,
    CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS label,
    strftime(make_timestamp(created_at * 1000) + INTERVAL 8 HOUR, '%m/%d %H:%M') AS beijing FROM e""")
def progress_estimate(spark, sf_dir):
    """MTH-2, DAT-1 to DAT-3."""
    j = _jobs(table(spark, sf_dir, "events")).withColumn("elapsed", S.elapsed_ms(F.col("created_at"), F.col("ended_at"), F.lit(NOW)))
    return j.select("id", S.progress(F.col("status"), F.col("progress"), F.col("elapsed")).alias("progress"), "elapsed", S.elapsed_label(F.col("elapsed")).alias("label"), S.beijing(F.col("created_at")).alias("beijing"))


@query("""SELECT p_partkey, CAST(coalesce(least(greatest(floor(p_retailprice + 0.5), 10), 1440), 240) AS INT) AS timeout, least(greatest(floor(p_size / 10.0 * 2 + 0.5) / 2, 0.0), 3.0) AS shrink,
    CASE WHEN p_partkey * 4096 >= 1048576 THEN format('{:.1f}', p_partkey * 4096 / 1048576) || 'M' ELSE CAST(floor(p_partkey * 4096 / 1024 + 0.5) AS BIGINT) || 'k' END AS context FROM part""")
def clamped_settings(spark, sf_dir):
    """MTH-1, DAT-4."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.clamp_timeout(F.col("p_retailprice")).alias("timeout"), S.clamp_shrink(F.col("p_size") / 10.0).alias("shrink"), S.context_label(F.col("p_partkey") * 4096).alias("context"))


_SPAN = "WITH s AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS lo, epoch_us(ts) / 1000000.0 + value * 60 AS hi FROM events), r AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM r), m AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY user_id, island)"


def _merged(spark, sf_dir):
    lo = S.micros(F.col("ts")) / 1_000_000.0
    e = table(spark, sf_dir, "events").select("user_id", lo.alias("lo"), (lo + F.col("value") * 60).alias("hi"))
    return I.merge(e, ["user_id"], slack=0.6)


@query(f"{_SPAN} SELECT user_id, round(lo, 3) AS lo, round(hi, 3) AS hi, n FROM m")
def interval_merge(spark, sf_dir):
    """AGG-F9."""
    return _merged(spark, sf_dir).select("user_id", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), "n")


_FIRST, _LAST = 1_704_067_200.0, 1_706_745_600.0


@query(f"""{_SPAN}, x AS (SELECT * FROM m WHERE hi > {_FIRST} AND lo < {_LAST}),
    g AS (SELECT user_id, greatest(coalesce(lag(hi) OVER (PARTITION BY user_id ORDER BY lo), {_FIRST}), {_FIRST}) AS lo, least(lo, {_LAST}) AS hi FROM x UNION ALL SELECT user_id, greatest(max(hi), {_FIRST}), {_LAST} FROM x GROUP BY user_id)
    SELECT user_id, round(lo, 3) AS lo, round(hi, 3) AS hi FROM g WHERE hi - lo >= 3.0""")
def window_complement(spark, sf_dir):
    """LAY-1 as gaps of a month between each user's merged spans."""
    m = _merged(spark, sf_dir).withColumns({"a": F.lit(_FIRST), "z": F.lit(_LAST)})
    return I.complement(m, ["user_id"], "a", "z", least=3.0).select("user_id", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


@query("""WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN 0 END AS ev FROM events)
    SELECT event_id, user_id, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS in_zone FROM e""")
def ref_zone_sticky(spark, sf_dir):
    """AGG-F10: errors open the zone, signups close it."""
    e = table(spark, sf_dir, "events")
    return D.sticky_zone(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup").select("event_id", "user_id", "in_zone")


def _records(events):
    """Each user as a job, with its events as records: results at every 97th, dead processes at every 5th."""
    ms = S.millis(F.col("ts"))
    stage = F.when(F.col("event_type") == "view", "extract").when(F.col("event_type") == "click", "translate").when(F.col("event_type") == "purchase", "render").when(F.col("event_type") == "error", "ocr")
    ok = F.when(F.col("event_id") % 97 == 0, F.col("event_id") % 2 == 0)
    r = events.select(F.col("user_id").cast("string").alias("job_id"), ms.alias("ts"), (F.col("event_id") % 5 != 0).alias("alive"), stage.alias("stage"), (F.col("event_id") % 20).alias("done"), F.lit(20).cast("long").alias("total"), ok.alias("ok"), F.col("props").alias("error"))
    jobs = events.groupBy("user_id").agg(F.min(ms).alias("created_at")).select(F.col("user_id").cast("string").alias("id"), F.lit("running").alias("status"), "created_at", F.when(F.col("user_id") % 7 == 0, NOW - 1).otherwise(NOW + 1).alias("timeout_at"))
    return jobs, r


@query(f"""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS id, user_id, (epoch_us(ts) // 1000) AS t, event_id, event_id % 5 <> 0 AS alive, CASE WHEN event_id % 97 = 0 THEN event_id % 2 = 0 END AS ok, props FROM events),
    l AS (SELECT id, arg_max(alive, t) AS alive, max(t) AS last, min(t) AS created, any_value(user_id) AS u FROM r GROUP BY id), k AS (SELECT id, arg_max(ok, t) AS ok, arg_max(props, t) AS props FROM r WHERE ok IS NOT NULL GROUP BY id),
    j AS (SELECT l.*, k.ok, k.props, CASE WHEN u % 7 = 0 THEN {NOW - 1} ELSE {NOW + 1} END AS lim FROM l LEFT JOIN k ON l.id = k.id)
    SELECT id, CASE WHEN {NOW} >= lim THEN 'failed' WHEN ok THEN 'done' WHEN NOT ok THEN 'failed' WHEN NOT alive AND {NOW} - last > 60000 THEN 'failed' ELSE 'running' END AS status,
    CASE WHEN {NOW} >= lim THEN 'timeout' WHEN ok IS NOT NULL THEN 'result' WHEN NOT alive AND {NOW} - last > 60000 THEN 'stale' ELSE 'progress' END AS reason, CASE WHEN {NOW} < lim AND NOT ok THEN left(props, 300) END AS error FROM j""")
def job_settle(spark, sf_dir):
    """STM-1 to STM-3, the batch twin of the stream."""
    jobs, records = _records(table(spark, sf_dir, "events"))
    return W.settle(jobs, records, F.lit(NOW)).select("id", "status", "reason", "error")


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS id, (epoch_us(ts) // 1000) AS t, CASE event_type WHEN 'view' THEN 'extract' WHEN 'click' THEN 'translate' WHEN 'purchase' THEN 'render' WHEN 'error' THEN 'ocr' END AS stage, event_id % 20 AS done FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, stage, done) AS k FROM e WHERE stage IS NOT NULL),
    r AS (SELECT id, 0::BIGINT AS k, 0.0::DOUBLE AS share FROM (SELECT DISTINCT id FROM e)
        UNION ALL SELECT r.id, s.k, CASE WHEN abs(CASE s.stage WHEN 'extract' THEN 0.03 WHEN 'render' THEN 0.95 WHEN 'translate' THEN 0.05 + 0.87 * least(1.0, s.done / 20.0) ELSE r.share END - r.share) >= 0.005 THEN CASE s.stage WHEN 'extract' THEN 0.03 WHEN 'render' THEN 0.95 WHEN 'translate' THEN 0.05 + 0.87 * least(1.0, s.done / 20.0) ELSE r.share END ELSE r.share END FROM r JOIN s ON s.id = r.id AND s.k = r.k + 1),
    f AS (SELECT id, arg_max(share, k) AS share FROM r GROUP BY id), x AS (SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_id % 2 = 0, ts) FILTER (event_id % 97 = 0) AS ok, min(epoch_us(ts) // 1000) AS created FROM events GROUP BY user_id)
    SELECT f.id, round(CASE WHEN x.ok THEN 1.0 ELSE share END, 6) AS progress FROM f JOIN x ON x.id = f.id""")
def job_shares(spark, sf_dir):
    """STM-2 folded over each job's records."""
    jobs, records = _records(table(spark, sf_dir, "events"))
    return W.settle(jobs, records, F.lit(0)).select("id", F.round("progress", 6).alias("progress"))


@query(f"""WITH {JOBS} SELECT DISTINCT c.c_custkey FROM customer c JOIN j ON j.user_id = c.c_custkey AND j.status = 'running'""")
def duplicate_guard(spark, sf_dir):
    """FLT-30: customers standing for wanted paths, users for those of running jobs."""
    jobs = _jobs(table(spark, sf_dir, "events")).withColumnRenamed("user_id", "pdf_path")
    return J.already_running(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pdf_path")), jobs).select(F.col("pdf_path").alias("c_custkey"))


@query("""WITH w AS (SELECT p_name AS name, p_brand AS dir, CAST(substr(p_brand, 7) AS INT) AS ord FROM part) SELECT name, arg_min(dir || '/' || name, ord) AS path FROM w GROUP BY name""")
def first_existing(spark, sf_dir):
    """JOIN-15, SRC-8, SRT-6: names standing for files, brands for directories in the order of their numbers."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("dir")).distinct()
    return J.first_existing(p.withColumn("ord", F.substring("dir", 7, 9).cast("int")), p)
