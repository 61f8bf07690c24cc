"""Queries of batching, commits and assignment (B, C and G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assignment, batching, commits, positions
from ..sources import log as logs
from .base import query
from .log_queries import commits_of


def _log(spark, sf_dir):
    return logs.load(spark, sf_dir)


@query("B01_count_batch", 'SELECT partition, "offset" // 100 AS batch_no, count(*) AS n, min("offset") AS first_offset, max("offset") AS last_offset FROM log GROUP BY 1, 2')
def b01(spark, sf_dir):
    rows = batching.by_count(_log(spark, sf_dir), 100)
    return rows.groupBy("partition", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query("B03_time_span_batch")
def b03(spark, sf_dir):
    return batching.by_span(_log(spark, sf_dir), 3600.0)


@query("B03b_aligned_span_batch", "SELECT partition, date_trunc('hour', ts) AS start, count(*) AS n FROM log GROUP BY 1, 2")
def b03b(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("partition", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query("B04_drain", 'SELECT partition, n % 100 AS rest FROM sizes WHERE n % 100 > 0')
def b04(spark, sf_dir):
    last = batching.by_count(_log(spark, sf_dir), 100).groupBy("partition", "batch_no").agg(F.count(F.lit(1)).alias("rest"))
    return last.where("rest < 100").select("partition", "rest")


@query("B05_stream_limit", 'SELECT partition, "offset" AS log_offset, event_id FROM (SELECT * FROM log ORDER BY ts, event_id LIMIT 500)')
def b05(spark, sf_dir):
    return batching.first_events(_log(spark, sf_dir), 500, ["ts", "event_id"]).select("partition", F.col("offset").alias("log_offset"), "event_id")


@query("B06_subscription_limit", 'SELECT partition, count(*) AS n, max("offset") AS last FROM (SELECT * FROM log ORDER BY ts, event_id LIMIT 37) GROUP BY 1')
def b06(spark, sf_dir):
    log = _log(spark, sf_dir)
    start = logs.sizes(log).select("partition", F.lit(-1).cast("long").alias("committed"))
    rows = batching.within_window(log, start, 37, ["ts", "event_id"])
    return rows.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last"))


_SLOTS = ", s AS (SELECT partition, date_diff('hour', TIMESTAMP '2024-01-01', ts) // 12 AS slot, count(*) AS n FROM log WHERE event_type = 'error' GROUP BY 1, 2), z AS (SELECT min(date_diff('hour', TIMESTAMP '2024-01-01', ts) // 12) AS a, max(date_diff('hour', TIMESTAMP '2024-01-01', ts) // 12) AS b FROM log), g AS (SELECT p.partition, slots.slot, coalesce(s.n, 0) AS n FROM sizes p CROSS JOIN (SELECT unnest(range(a, b + 1)) AS slot FROM z) AS slots LEFT JOIN s ON s.partition = p.partition AND s.slot = slots.slot)\n"


@query("B07_keep_alive", _SLOTS + "SELECT partition, max(slot) - coalesce(max(slot) FILTER (n > 0), min(slot) - 1) AS empties FROM g GROUP BY 1")
def b07(spark, sf_dir):
    log = _log(spark, sf_dir)
    slot = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 43200)
    full = log.where("event_type = 'error'").groupBy("partition", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    ends = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(slot).alias("a"), F.max(slot).alias("b")).first()
    grid = logs.sizes(log).select("partition", F.explode(F.sequence(F.lit(ends["a"] or 0), F.lit(ends["b"] or 0))).alias("slot"))
    return batching.idle_runs(grid.join(full, ["partition", "slot"], "left").fillna(0, ["n"]), "partition", "slot", "n")


@query("B08_uncommitted_cap", 'SELECT partition, "offset" AS log_offset, event_id FROM log JOIN commits USING (partition) WHERE "offset" > committed ORDER BY ts, event_id LIMIT 10 - 3')
def b08(spark, sf_dir):
    log = _log(spark, sf_dir)
    return batching.within_window(log, commits_of(log), 10, ["ts", "event_id"], uncommitted=3).select("partition", F.col("offset").alias("log_offset"), "event_id")


@query("B09_memory_flush", ", b AS (SELECT partition, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM log GROUP BY 1) SELECT partition, bytes FROM b ORDER BY bytes DESC, partition LIMIT 1")
def b09(spark, sf_dir):
    return batching.heaviest(_log(spark, sf_dir), F.octet_length("props"))


@query("B11_visibility", ", t AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'sub' || (event_id % 3) END AS tag FROM log) SELECT partition, count(*) AS n FROM t WHERE (tag IS NULL OR tag = 'sub1') AND user_id % 50 <> 3 GROUP BY 1")
def b11(spark, sf_dir):
    tagged = _log(spark, sf_dir).withColumn("tag", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("sub"), F.col("event_id") % 3)))
    denied = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 50 = 3").select("user_id").distinct()
    return batching.visible(tagged, "sub1", denied, ["user_id"]).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


@query("B12_retention_skip", """, r AS (SELECT partition, min("offset") - 1 AS before_first FROM log WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1) SELECT partition, greatest(committed, before_first) AS resume, greatest(before_first - committed, 0) AS skipped FROM commits JOIN r USING (partition)""")
def b12(spark, sf_dir):
    log = _log(spark, sf_dir)
    stats = positions.statistics(log.where("ts >= TIMESTAMP_NTZ'2024-01-20'"), ["partition"])
    return batching.skip_lost(commits_of(log), stats)


@query("B13_start_position", ", r AS (SELECT partition, 'BEGIN' AS read_from, CAST(-1 AS BIGINT) AS at FROM sizes UNION ALL SELECT partition, 'END', n - 1 FROM sizes UNION ALL SELECT partition, 'CURSORS', committed FROM commits) SELECT * FROM r")
def b13(spark, sf_dir):
    log = _log(spark, sf_dir)
    stats = positions.statistics(log, ["partition"]).join(commits_of(log), "partition")
    starts = F.array(*[F.struct(F.lit(n).alias("read_from"), F.col(c).alias("at")) for n, c in (("BEGIN", "before_first"), ("END", "last"), ("CURSORS", "committed"))])
    return stats.select("partition", F.explode(starts).alias("s")).select("partition", "s.read_from", "s.at")


_REQUESTS = ', q AS (SELECT partition, event_id AS seq, (event_id * 37) % n AS c_offset FROM log JOIN sizes USING (partition) )\n'


def _requests(log):
    return log.join(F.broadcast(logs.sizes(log)), "partition").select("partition", F.col("event_id").alias("seq"), ((F.col("event_id") * 37) % F.col("n")).alias("c_offset"))


@query("C01_commit", _REQUESTS + ", b AS (SELECT q.*, greatest(committed, coalesce(max(c_offset) OVER (PARTITION BY q.partition ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) AS before FROM q JOIN commits USING (partition)) SELECT partition, seq, c_offset, c_offset > before AS moved, greatest(before, c_offset) AS after FROM b")
def c01(spark, sf_dir):
    log = _log(spark, sf_dir)
    return commits.commit(_requests(log), commits_of(log))


@query("C01b_commits_after", _REQUESTS + "SELECT partition, greatest(committed, max(c_offset)) AS committed FROM commits LEFT JOIN q USING (partition) GROUP BY partition, committed")
def c01b(spark, sf_dir):
    log = _log(spark, sf_dir)
    return commits.new_commits(_requests(log), commits_of(log))


_U = "'00000000-0000-0000-0000-00000000000' || "


@query("C02_commit_validation", f", q AS (SELECT partition, CASE WHEN partition = 7 THEN 'oops' ELSE {_U}(partition % 4) END AS stream_id FROM sizes) SELECT partition, stream_id, CASE WHEN partition = 7 THEN 'NOT_A_UUID' WHEN partition % 4 = 3 THEN 'NO_SESSION' WHEN partition % 4 <> partition % 3 THEN 'NOT_ASSIGNED' END AS error FROM q")
def c02(spark, sf_dir):
    ids = lambda c: F.concat(F.lit("00000000-0000-0000-0000-00000000000"), c.cast("string"))
    parts = logs.sizes(_log(spark, sf_dir)).select("partition")
    requests = parts.withColumn("stream_id", F.when(F.col("partition") == 7, "oops").otherwise(ids(F.col("partition") % 4)))
    topology = parts.withColumn("session", ids(F.col("partition") % 3))
    sessions = spark.range(3).select(ids(F.col("id")).alias("session"))
    return commits.validate_requests(requests, sessions, topology).select("partition", "stream_id", "error")


@query("C03_commit_effect", """, s AS (SELECT partition, committed, committed + 20 AS sent, committed + (partition - 3) * 10 AS asked FROM commits)
SELECT partition, CASE WHEN asked < committed THEN 'REWIND' WHEN asked > sent THEN 'SEEK' ELSE 'ADVANCE' END AS action, asked AS new_commit, CASE WHEN asked < committed THEN asked ELSE greatest(sent, asked) END AS new_sent, CASE WHEN asked < committed THEN 0 ELSE asked - committed END AS advanced FROM s""")
def c03(spark, sf_dir):
    state = commits_of(_log(spark, sf_dir)).select("partition", "committed", (F.col("committed") + 20).alias("sent"), (F.col("committed") + (F.col("partition") - 3) * 10).alias("asked"))
    return commits.apply_commit(state).drop("committed", "sent", "asked")


@query("C04_reset_cursors", "SELECT partition, CASE WHEN partition IN (2, 5) THEN partition * 3 ELSE committed END AS committed FROM commits")
def c04(spark, sf_dir):
    given = spark.createDataFrame([(2, 6), (5, 15)], "partition int, committed long")
    return commits.reset(commits_of(_log(spark, sf_dir)), given)


@query("C05_list_cursors", 'SELECT partition, lpad(CAST(committed AS VARCHAR), 18, \'0\') AS committed_text FROM commits')
def c05(spark, sf_dir):
    from ..functions import scalars

    return commits_of(_log(spark, sf_dir)).select("partition", scalars.offset_text(F.col("committed")).alias("committed_text"))


_RANGES = ", k AS (SELECT partition, \"offset\", \"offset\" - row_number() OVER (PARTITION BY partition ORDER BY \"offset\") AS island FROM log WHERE event_type IN ('click', 'view')), r AS (SELECT partition, min(\"offset\") AS first, max(\"offset\") AS last FROM k GROUP BY partition, island)\n"


def _ranges(log):
    return commits.skipped_ranges(log.where("event_type in ('click', 'view')"))


@query("C06_skipped_ranges", _RANGES + "SELECT partition, first, last FROM r")
def c06(spark, sf_dir):
    return _ranges(_log(spark, sf_dir))


@query("C07_autocommit", _RANGES + ", f AS (SELECT r.partition, committed, min(first) AS first, arg_min(last, first) AS last FROM r JOIN commits USING (partition) WHERE last > committed GROUP BY 1, 2) SELECT partition, last AS suggested FROM f WHERE committed >= first - 1")
def c07(spark, sf_dir):
    log = _log(spark, sf_dir)
    return commits.autocommit(_ranges(log), commits_of(log))


@query("C08_unconfirmed", "SELECT partition, n - 1 - committed AS unconfirmed, n - 1 <= committed AS committed_all FROM commits JOIN sizes USING (partition)")
def c08(spark, sf_dir):
    log = _log(spark, sf_dir)
    both = commits_of(log).join(positions.statistics(log, ["partition"]), "partition")
    return both.select("partition", (F.col("last") - F.col("committed")).alias("unconfirmed"), (F.col("last") <= F.col("committed")).alias("committed_all"))


@query("C09_failed_commits", ", s AS (SELECT partition, partition % 3 AS failed, committed, committed + partition % 2 * 5 AS sent, partition = 4 AS committed_now FROM commits) SELECT partition, CASE WHEN committed_now THEN 0 WHEN sent > committed THEN failed + 1 ELSE failed END AS failed_after FROM s")
def c09(spark, sf_dir):
    state = commits_of(_log(spark, sf_dir)).select("partition", (F.col("partition") % 3).alias("failed"), "committed", (F.col("committed") + F.col("partition") % 2 * 5).alias("sent"), (F.col("partition") == 4).alias("committed_now"))
    return commits.failed_commits(state, 3).select("partition", "failed_after")


@query("C11_dead_letters", "SELECT 'sub-1' AS subscription_id, event_type, CAST(partition AS VARCHAR) AS partition, lpad(CAST(\"offset\" AS VARCHAR), 18, '0') AS log_offset, 'failed 3 times' AS error_message, props AS event FROM log WHERE event_type = 'error'")
def c11(spark, sf_dir):
    return commits.dead_letters(_log(spark, sf_dir).where("event_type = 'error'"), "sub-1", F.lit("failed 3 times"))


@query("C12_dead_letter_annotations", """, a(name, most, policy) AS (VALUES ('a', '3', 'SKIP_EVENT'), ('b', '1', 'SKIP_EVENT'), ('c', NULL, 'SKIP_EVENT'), ('d', '4', NULL), ('e', '10', 'DEAD_LETTER_QUEUE'), ('f', 'x', 'SKIP_EVENT'), ('g', '2', 'OTHER'), ('h', NULL, NULL))
SELECT name, CASE WHEN (most IS NULL) <> (policy IS NULL) THEN 'INCOMPLETE' WHEN most IS NULL THEN NULL WHEN coalesce(TRY_CAST(most AS INTEGER), 0) NOT BETWEEN 2 AND 10 THEN 'BAD_COUNT' WHEN policy NOT IN ('SKIP_EVENT', 'DEAD_LETTER_QUEUE') THEN 'BAD_POLICY' END AS error FROM a""")
def c12(spark, sf_dir):
    rows = [("a", "3", "SKIP_EVENT"), ("b", "1", "SKIP_EVENT"), ("c", None, "SKIP_EVENT"), ("d", "4", None), ("e", "10", "DEAD_LETTER_QUEUE"), ("f", "x", "SKIP_EVENT"), ("g", "2", "OTHER"), ("h", None, None)]
    table = spark.createDataFrame([(n, {k: v for k, v in (("max-send-count", m), ("policy", p)) if v}) for n, m, p in rows], "name string, annotations map<string,string>")
    most, policy = F.col("annotations")["max-send-count"], F.col("annotations")["policy"]
    error = (
        F.when(most.isNull() != policy.isNull(), "INCOMPLETE").when(most.isNull(), None).when(~F.coalesce(most.try_cast("int").between(2, 10), F.lit(False)), "BAD_COUNT")
        .when(~policy.isin("SKIP_EVENT", "DEAD_LETTER_QUEUE"), "BAD_POLICY")
    )
    return table.select("name", error.alias("error"))


@query("C13_redrive_attach", ", i AS (SELECT DISTINCT 'sub' || (event_id % 5) AS sub FROM log WHERE event_type = 'error'), x AS (SELECT 'sub1' AS sub, partition FROM sizes WHERE partition < 4) SELECT i.sub, p.partition, 'UNASSIGNED' AS state FROM i CROSS JOIN (SELECT partition FROM sizes) p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.sub = i.sub AND x.partition = p.partition)")
def c13(spark, sf_dir):
    log = _log(spark, sf_dir)
    named = log.where("event_type = 'error'").select(F.concat(F.lit("sub"), F.col("event_id") % 5).alias("sub")).distinct()
    attached = spark.createDataFrame([("sub1", p) for p in range(4)], "sub string, partition int")
    parts = F.sequence(F.lit(0), F.lit(logs.PARTITIONS - 1))
    return named.select("sub", F.explode(parts).alias("partition")).join(attached, ["sub", "partition"], "left_anti").withColumn("state", F.lit("UNASSIGNED"))


@query("G01_equal_split", ", s AS (SELECT 'g' || g AS grp, s AS k, 's' || s AS session FROM range(3) a(g), range(3) b(s)), p AS (SELECT 'g' || g AS grp, partition, row_number() OVER (PARTITION BY g ORDER BY partition) - 1 AS r FROM range(3) a(g), sizes) SELECT p.grp, partition, session FROM p JOIN s ON s.grp = p.grp AND p.r % 3 = s.k")
def g01(spark, sf_dir):
    groups = spark.range(3).select(F.concat(F.lit("g"), F.col("id")).alias("grp"))
    sessions = groups.select("grp", F.explode(F.array(*[F.lit(f"s{k}") for k in range(3)])).alias("session"))
    parts = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("partition"))
    return assignment.equal_split(sessions, parts, "grp")


@query("G02_rebalance")
def g02(spark, sf_dir):
    parts = logs.sizes(_log(spark, sf_dir)).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("subscription"), F.col("partition").cast("string").alias("partition"), F.when(F.col("partition") < 5, "x").alias("session"), F.lit(None).cast("string").alias("next_session"), F.when(F.col("partition") < 5, "ASSIGNED").otherwise("UNASSIGNED").alias("state"))
    rows = [("a", "x", 1, None), ("a", "y", 1, None), ("a", "z", 2, None), ("b", "x", 1, None), ("b", "w", 1, ["6", "7"])]
    return assignment.rebalance(parts, spark.createDataFrame(rows, "subscription string, id string, weight int, requested array<string>"))


_TOPOLOGY = ", t AS (SELECT partition, CASE partition % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE 'gone' END AS session, CASE WHEN partition = 1 THEN 'y' WHEN partition = 2 THEN 'lost' END AS next_session, CASE WHEN partition % 4 = 0 THEN 'UNASSIGNED' WHEN partition IN (1, 2) THEN 'REASSIGNING' ELSE 'ASSIGNED' END AS state FROM sizes)\n"


def _topology(spark, sf_dir):
    p = F.col("partition")
    return logs.sizes(_log(spark, sf_dir)).select(
        "partition", F.when(p % 4 == 1, "x").when(p % 4 == 2, "y").when(p % 4 == 3, "gone").alias("session"), F.when(p == 1, "y").when(p == 2, "lost").alias("next_session"),
        F.when(p % 4 == 0, "UNASSIGNED").when(p.isin(1, 2), "REASSIGNING").otherwise("ASSIGNED").alias("state"),
    )


@query("G03_move_partition", _TOPOLOGY + "SELECT partition, CASE WHEN now THEN 'ASSIGNED' ELSE 'REASSIGNING' END AS state, CASE WHEN now THEN 'y' ELSE session END AS session, CASE WHEN NOT now THEN 'y' END AS next_session FROM (SELECT *, state = 'UNASSIGNED' OR session NOT IN ('x', 'y') OR session = 'y' AS now FROM t)")
def g03(spark, sf_dir):
    moved = assignment.move(F.col("state"), F.col("session"), F.lit("y"), F.col("session").isin("x", "y"))
    return _topology(spark, sf_dir).select("partition", moved.alias("m")).select("partition", "m.*")


@query("G04_must_rebalance", _TOPOLOGY + "SELECT * FROM t WHERE session IS NULL OR session = 'gone' OR next_session = 'lost'")
def g04(spark, sf_dir):
    return assignment.must_rebalance(_topology(spark, sf_dir), spark.createDataFrame([("x",), ("y",)], "session string"))


@query("G05_transfer", _TOPOLOGY + "SELECT partition, CASE WHEN m THEN 'ASSIGNED' ELSE state END AS state, CASE WHEN m THEN next_session ELSE session END AS session, CASE WHEN NOT m THEN next_session END AS next_session FROM (SELECT *, state = 'REASSIGNING' AND coalesce(session = 'x', false) AS m FROM t)")
def g05(spark, sf_dir):
    return assignment.transfer(_topology(spark, sf_dir), "x")


@query("G06_slot_check", _TOPOLOGY + "SELECT 6 AS auto_sessions, count(*) AS partitions, count(*) FILTER (partition IN (3, 4)) AS direct, 6 < count(*) - count(*) FILTER (partition IN (3, 4)) AS free FROM t")
def g06(spark, sf_dir):
    counted = _topology(spark, sf_dir).agg(F.count(F.lit(1)).alias("partitions"), F.count_if(F.col("partition").isin(3, 4)).alias("direct"))
    return counted.select(F.lit(6).alias("auto_sessions"), "partitions", "direct", (F.lit(6) < F.col("partitions") - F.col("direct")).alias("free"))


@query("G07_topology_init", "SELECT partition, CAST(NULL AS VARCHAR) AS session, 'UNASSIGNED' AS state, 0 AS failed FROM commits")
def g07(spark, sf_dir):
    return commits_of(_log(spark, sf_dir)).select("partition", F.lit(None).cast("string").alias("session"), F.lit("UNASSIGNED").alias("state"), F.lit(0).alias("failed"))


@query("G08_topology_refresh", _TOPOLOGY + ", h AS (SELECT partition, CASE WHEN partition % 2 = 1 THEN 'STREAMING' WHEN partition = 2 THEN 'RELEASING' END AS held FROM sizes WHERE partition IN (1, 2, 3, 7)) SELECT partition, change FROM (SELECT t.partition, CASE WHEN held IS NULL AND session = 'x' AND state <> 'REASSIGNING' THEN 'NEW' WHEN held IS NOT NULL AND coalesce(session, '') <> 'x' THEN 'REMOVED' WHEN held = 'STREAMING' AND session = 'x' AND state = 'REASSIGNING' THEN 'RELEASING' WHEN held = 'RELEASING' AND session = 'x' AND state <> 'REASSIGNING' THEN 'RETURNED' END AS change FROM t LEFT JOIN h USING (partition)) WHERE change IS NOT NULL")
def g08(spark, sf_dir):
    held = spark.createDataFrame([(1, "STREAMING"), (2, "RELEASING"), (3, "STREAMING"), (7, "STREAMING")], "partition int, held string")
    return assignment.refresh(held, _topology(spark, sf_dir), "x")


@query("G09_topology_upsert", _TOPOLOGY + "SELECT * FROM t WHERE partition NOT IN (0, 3) UNION ALL VALUES (0, 'x', NULL, 'ASSIGNED'), (3, 'y', NULL, 'ASSIGNED'), (9, NULL, NULL, 'UNASSIGNED')")
def g09(spark, sf_dir):
    changed = spark.createDataFrame([(0, "x", None, "ASSIGNED"), (3, "y", None, "ASSIGNED"), (9, None, None, "UNASSIGNED")], "partition int, session string, next_session string, state string")
    return assignment.upsert(_topology(spark, sf_dir), changed, ["partition"])


@query("G10_sessions_hash", ", s AS (SELECT DISTINCT partition, 'u' || (user_id % 20) AS session FROM log) SELECT partition, md5(string_agg(session, '' ORDER BY session)) AS sessions_hash FROM s GROUP BY 1")
def g10(spark, sf_dir):
    sessions = _log(spark, sf_dir).select("partition", F.concat(F.lit("u"), F.col("user_id") % 20).alias("session")).distinct()
    return assignment.sessions_hash(sessions, "partition")
