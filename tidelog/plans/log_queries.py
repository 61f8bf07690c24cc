"""Queries of scans, positions and statistics (S and L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import positions
from ..sources import log as logs
from .base import cursor, query


def cursors_of(lines: DataFrame) -> DataFrame:
    """A cursor in each timeline that holds events."""
    at = (7 * F.col("partition") + 3 * F.col("tl_order")) % F.col("size")
    return lines.where("size > 0").select("partition", F.col("tl_order").alias("c_order"), at.cast("long").alias("c_offset"))


def commits_of(log: DataFrame) -> DataFrame:
    """A committed offset for each partition."""
    return logs.sizes(log).select("partition", ((7 * F.col("partition") * F.col("partition")) % F.col("n")).cast("long").alias("committed"))


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = logs.load(spark, sf_dir)
    return log, logs.timelines(log)


@query("S01_log_scan", 'SELECT g.partition, g."offset" AS log_offset, event_id FROM log g JOIN commits c USING (partition) WHERE g."offset" > committed')
def s01(spark, sf_dir):
    log = logs.load(spark, sf_dir)
    return logs.scan(log, commits_of(log).withColumnRenamed("committed", "cursor")).select("partition", F.col("offset").alias("log_offset"), "event_id")


@query("S02_multi_timeline_scan", "SELECT partition, tl_order, tl_offset, event_id FROM tlog JOIN (SELECT * FROM cursors WHERE c_order = 3) USING (partition) WHERE (tl_order > c_order OR tl_order = c_order AND tl_offset > c_offset) AND event_id % 17 <> 0")
def s02(spark, sf_dir):
    log, lines = _log(spark, sf_dir)
    rows = logs.on_timelines(log, lines).withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("props")))
    return logs.scan_timelines(rows, cursors_of(lines).where("c_order = 3")).select("partition", "tl_order", "tl_offset", "event_id")


@query("S03_low_level_source", 'SELECT partition, "offset" AS log_offset, event_id FROM log JOIN sizes USING (partition) WHERE "offset" > n - 6')
def s03(spark, sf_dir):
    log = logs.load(spark, sf_dir)
    newest = logs.sizes(log).select("partition", (F.col("n") - 6).alias("cursor"))
    return logs.scan(log, newest).select("partition", F.col("offset").alias("log_offset"), "event_id")


@query("S05_json_batch_parse", "SELECT event_id // 50 AS batch_id, CAST(event_id % 50 AS INTEGER) AS idx, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s05(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bodies = events.groupBy((F.floor(F.col("event_id") / 50)).alias("batch_id")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda r: r["props"]), ",\n "), F.lit("]")).alias("body"))
    items = bodies.select("batch_id", F.posexplode(F.from_json("body", "array<variant>")).alias("idx", "item"))
    return items.select("batch_id", "idx", F.variant_get("item", "$.k", "bigint").alias("k"))


@query("S07_log_append", "SELECT event_type, partition, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM log GROUP BY 1, 2")
def s07(spark, sf_dir):
    path = work_path(spark, "appended")
    rows = logs.load(spark, sf_dir).select("event_type", "partition", "offset", "event_id", F.col("props").alias("value"))
    logs.append(rows.where("event_id % 2 = 0"), path)
    logs.append(rows.where("event_id % 2 = 1"), path)
    return logs.read(spark, path).groupBy("event_type", "partition").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a query's own files: below the shared folder if the session has one, else in the warehouse."""
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/tidelog-{name}-{uuid.uuid4().hex}"



@query(
    "S09_json_stream_sink",
    """, b AS (SELECT partition, "offset" // 20 AS batch_no, "offset", props FROM log WHERE event_type <> 'error' OR event_id % 2 = 0)
SELECT partition, batch_no, '{"cursor":{"partition":"' || partition || '","offset":"' || lpad(CAST(max("offset") AS VARCHAR), 18, '0') || '"},"events":[' || string_agg(props, ',' ORDER BY "offset") || ']}' AS line FROM b GROUP BY partition, batch_no
UNION ALL SELECT partition, -1, '{"cursor":{"partition":"' || partition || '","offset":"' || lpad(CAST(n - 1 AS VARCHAR), 18, '0') || '"}}' FROM sizes""",
)
def s09(spark, sf_dir):
    from ..operators import batching

    log = logs.load(spark, sf_dir)
    rows = log.where("event_type <> 'error' or event_id % 2 = 0").withColumn("batch_no", F.floor(F.col("offset") / 20).cast("long"))
    lines = batching.json_lines(rows, ["partition", "batch_no"], "props")
    idle = logs.sizes(log).select("partition", F.lit(-1).cast("long").alias("batch_no"), batching.cursor_line(F.col("partition"), F.col("n") - 1).alias("line"))
    return lines.unionByName(idle)


@query("S12_catalog_scan", "WITH t AS (SELECT o_orderpriority AS name, count(*) AS n_orders, CAST(min(o_orderkey) AS BIGINT) AS first_key FROM orders GROUP BY 1) SELECT * FROM t WHERE n_orders > 0")
def s12(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n_orders"), F.min("o_orderkey").cast("long").alias("first_key"))


_PAIRS = ", p AS (SELECT a.partition, a.c_order AS o1, a.c_offset AS f1, b.c_order AS o2, b.c_offset AS f2, x.start + a.c_offset AS p1, y.start + b.c_offset AS p2 FROM cursors a JOIN cursors b ON a.partition = b.partition JOIN lines x ON x.partition = a.partition AND x.tl_order = a.c_order JOIN lines y ON y.partition = b.partition AND y.tl_order = b.c_order)\n"


def _pairs(spark, sf_dir):
    _, lines = _log(spark, sf_dir)
    one = positions.locate(cursors_of(lines), lines).select("partition", F.col("c_order").alias("o1"), F.col("c_offset").alias("f1"), F.col("position").alias("p1"))
    two = one.select("partition", F.col("o1").alias("o2"), F.col("f1").alias("f2"), F.col("p1").alias("p2"))
    return one.join(two, "partition")


@query("L01_cursor_compare", _PAIRS + "SELECT partition, o1, f1, o2, f2, CAST(sign(p1 - p2) AS INTEGER) AS compared FROM p")
def l01(spark, sf_dir):
    return _pairs(spark, sf_dir).select("partition", "o1", "f1", "o2", "f2", positions.compare(F.col("p1"), F.col("p2")).alias("compared"))


@query("L02_cursor_distance", _PAIRS + "SELECT partition, o1, f1, o2, f2, p2 - p1 AS distance FROM p")
def l02(spark, sf_dir):
    return _pairs(spark, sf_dir).select("partition", "o1", "f1", "o2", "f2", (F.col("p2") - F.col("p1")).alias("distance"))


@query(
    "L03_cursor_shift",
    """, m AS (SELECT c.partition, c_order, c_offset, delta, start + c_offset + delta AS position, delta >= 0 AS fwd FROM cursors c JOIN lines l ON l.partition = c.partition AND l.tl_order = c_order, (VALUES (-100000), (-40), (0), (60), (100000)) AS b(delta))
SELECT m.partition, c_order, c_offset, delta, tl_order AS to_order, position - start AS to_offset, CASE WHEN position < -1 THEN 'UNAVAILABLE' END AS error FROM m LEFT JOIN lines l ON l.partition = m.partition AND CASE WHEN fwd THEN (position > start - 1 OR position = -1 AND tl_order = 1) AND (position <= start + size - 1 OR is_open) ELSE position >= start - 1 AND (position < start + size - 1 OR is_open) AND size > 0 END""",
)
def l03(spark, sf_dir):
    _, lines = _log(spark, sf_dir)
    moves = positions.locate(cursors_of(lines), lines).withColumn("delta", F.explode(F.array(*[F.lit(x) for x in (-100000, -40, 0, 60, 100000)])))
    moved = positions.place(moves.withColumn("position", F.col("position") + F.col("delta")), lines, F.col("delta") >= 0)
    return moved.select("partition", "c_order", "c_offset", "delta", F.col("tl_order").alias("to_order"), F.col("tl_offset").alias("to_offset"), "error")


@query("L04_cursor_lag", f", e AS (SELECT partition, arg_max({cursor('tl_order', 'last_offset')}, tl_order) FILTER (size > 0) AS newest, CAST(sum(size) - 1 AS BIGINT) AS fin FROM lines GROUP BY partition) SELECT c.partition, c_order, c_offset, newest, fin - start - c_offset AS unconsumed FROM cursors c JOIN lines l ON l.partition = c.partition AND tl_order = c_order JOIN e ON e.partition = c.partition")
def l04(spark, sf_dir):
    _, lines = _log(spark, sf_dir)
    return positions.lag(cursors_of(lines), lines).select("partition", "c_order", "c_offset", "newest", "unconsumed")


@query("L05_encode_cursor", f"SELECT partition, {cursor('c_order', 'c_offset')} AS cursor_text FROM cursors UNION ALL SELECT partition, {cursor('tl_order', '-1')} FROM lines")
def l05(spark, sf_dir):
    _, lines = _log(spark, sf_dir)
    own = cursors_of(lines).select("partition", scalars.cursor_text(F.col("c_order"), F.col("c_offset")).alias("cursor_text"))
    return own.unionByName(lines.select("partition", scalars.cursor_text(F.col("tl_order"), F.lit(-1).cast("long")).alias("cursor_text")))


_DAMAGED = f", t AS (SELECT partition, c_order, CASE c_order WHEN 3 THEN replace(s, '001', '00x') WHEN 1 THEN CASE WHEN partition % 2 = 0 THEN substr(s, 1, 12) ELSE s END ELSE s END AS text FROM (SELECT partition, c_order, {cursor('c_order', 'c_offset')} AS s FROM cursors))\n"


@query("L06_decode_cursor", _DAMAGED + "SELECT partition, text, CASE WHEN ok THEN CAST('0x' || split_part(text, '-', 2) AS INTEGER) END AS c_order, CASE WHEN ok THEN CAST(split_part(text, '-', 3) AS BIGINT) END AS c_offset, CASE WHEN NOT ok THEN 'INVALID_FORMAT' END AS error FROM (SELECT *, regexp_full_match(text, '001-[0-9a-f]{4}-[0-9]{18}') AS ok FROM t)")
def l06(spark, sf_dir):
    _, lines = _log(spark, sf_dir)
    s = scalars.cursor_text(F.col("c_order"), F.col("c_offset"))
    text = F.when(F.col("c_order") == 3, F.replace(s, F.lit("001"), F.lit("00x"))).when((F.col("c_order") == 1) & (F.col("partition") % 2 == 0), F.substring(s, 1, 12)).otherwise(s)
    rows = cursors_of(lines).select("partition", text.alias("text"))
    error = F.when(~scalars.is_cursor(F.col("text")), F.lit("INVALID_FORMAT"))
    return rows.select("partition", "text", scalars.cursor_order(F.col("text")).alias("c_order"), scalars.cursor_offset(F.col("text")).alias("c_offset"), error.alias("error"))


@query(
    "L07_roll_forward",
    """, e AS (SELECT partition, tl_order AS c_order, last_offset AS c_offset FROM lines WHERE NOT is_open UNION ALL SELECT * FROM cursors),
f AS (SELECT a.partition, a.tl_order, min(b.tl_order) AS nxt FROM lines a JOIN lines b ON a.partition = b.partition AND b.tl_order > a.tl_order AND (b.size > 0 OR b.is_open) WHERE NOT a.is_open GROUP BY 1, 2)
SELECT e.partition, c_order, c_offset, CASE WHEN NOT is_open AND c_offset = last_offset THEN nxt ELSE c_order END AS r_order, CASE WHEN NOT is_open AND c_offset = last_offset THEN -1 ELSE c_offset END AS r_offset FROM e JOIN lines l ON l.partition = e.partition AND l.tl_order = c_order LEFT JOIN f ON f.partition = e.partition AND f.tl_order = c_order""",
)
def l07(spark, sf_dir):
    _, lines = _log(spark, sf_dir)
    ends = lines.where("not is_open").select("partition", F.col("tl_order").alias("c_order"), F.col("last_offset").alias("c_offset"))
    return positions.roll_forward(ends.unionByName(cursors_of(lines)), lines)


@query("L08_batched_decode", _DAMAGED + "SELECT row_number() OVER (ORDER BY partition, c_order) - 1 AS idx, CASE WHEN regexp_full_match(text, '001-[0-9a-f]{4}-[0-9]{18}') THEN CAST(split_part(text, '-', 3) AS BIGINT) END AS c_offset FROM t")
def l08(spark, sf_dir):
    from pyspark.sql import Window

    _, lines = _log(spark, sf_dir)
    s = scalars.cursor_text(F.col("c_order"), F.col("c_offset"))
    text = F.when(F.col("c_order") == 3, F.replace(s, F.lit("001"), F.lit("00x"))).when((F.col("c_order") == 1) & (F.col("partition") % 2 == 0), F.substring(s, 1, 12)).otherwise(s)
    rows = cursors_of(lines).select("partition", "c_order", text.alias("text"))
    # one request's cursors: as many rows as it has partitions
    return rows.select((F.row_number().over(Window.orderBy("partition", "c_order")) - 1).cast("long").alias("idx"), scalars.cursor_offset(F.col("text")).alias("c_offset"))


@query("L09_partition_statistics", "SELECT partition, tl_order, min(tl_offset) AS first, max(tl_offset) AS last, min(tl_offset) - 1 AS before_first FROM tlog GROUP BY 1, 2")
def l09(spark, sf_dir):
    log, lines = _log(spark, sf_dir)
    return positions.statistics(logs.on_timelines(log, lines), ["partition", "tl_order"], "tl_offset")


@query("L10_end_statistics", 'SELECT w.p AS partition, max("offset") AS last FROM (VALUES (1), (3), (11)) AS w(p) LEFT JOIN log ON log.partition = w.p GROUP BY 1')
def l10(spark, sf_dir):
    asked = spark.createDataFrame([(1,), (3,), (11,)], "partition int")
    ends = positions.statistics(logs.load(spark, sf_dir).where(F.col("partition").isin(1, 3, 11)), ["partition"]).select("partition", "last")
    return asked.join(ends, "partition", "left")


@query(
    "L11_cursor_validation",
    """, c AS (SELECT partition, CAST(-1 AS BIGINT) AS c_offset FROM sizes UNION ALL SELECT partition, n FROM sizes UNION ALL SELECT partition, NULL FROM sizes UNION ALL VALUES (99, CAST(0 AS BIGINT)), (NULL, CAST(0 AS BIGINT)) UNION ALL SELECT partition, -2 FROM sizes)
SELECT c.partition, c_offset, CASE WHEN c.partition IS NULL THEN 'NULL_PARTITION' WHEN n IS NULL THEN 'PARTITION_NOT_FOUND' WHEN c_offset IS NULL THEN 'NULL_OFFSET' WHEN c_offset < -1 OR c_offset > n - 1 THEN 'UNAVAILABLE' END AS error FROM c LEFT JOIN sizes USING (partition)""",
)
def l11(spark, sf_dir):
    log = logs.load(spark, sf_dir)
    n = logs.sizes(log)
    at = lambda c: n.select("partition", c.cast("long").alias("c_offset"))
    odd = spark.createDataFrame([(99, 0), (None, 0)], "partition int, c_offset long")
    cursors = at(F.lit(-1)).unionByName(at(F.col("n"))).unionByName(at(F.lit(None))).unionByName(at(F.lit(-2))).unionByName(odd)
    return positions.validate(cursors, positions.statistics(log, ["partition"]))


_LISTING = f", e AS (SELECT partition, {cursor('min(tl_order)', '0')} AS oldest, arg_max({cursor('tl_order', 'last_offset')}, tl_order) FILTER (size > 0) AS newest, CAST(sum(size) - 1 AS BIGINT) AS fin FROM lines GROUP BY partition)\n"


@query("L12_partition_listing", _LISTING + "SELECT partition, oldest, newest FROM e")
def l12(spark, sf_dir):
    return positions.listing(_log(spark, sf_dir)[1])


@query("L13_partition_listing_with_cursors", _LISTING + ", u AS (SELECT c.partition, start + c_offset AS position FROM cursors c JOIN lines l ON l.partition = c.partition AND tl_order = c_order WHERE c_order = 3 AND c.partition % 2 = 0) SELECT e.partition, oldest, newest, fin - position AS unconsumed FROM e LEFT JOIN u USING (partition)")
def l13(spark, sf_dir):
    _, lines = _log(spark, sf_dir)
    given = cursors_of(lines).where("c_order = 3 and partition % 2 = 0")
    behind = positions.lag(given, lines).select("partition", "oldest", "newest", "unconsumed")
    plain = positions.listing(lines).join(given, "partition", "left_anti").withColumn("unconsumed", F.lit(None).cast("long"))
    return plain.unionByName(behind)


@query("L14_single_partition", _LISTING + "SELECT partition, oldest, newest FROM e WHERE partition = 5")
def l14(spark, sf_dir):
    return positions.listing(_log(spark, sf_dir)[1].where("partition = 5"))


@query("L15_active_timeline", "SELECT partition, max(tl_order) AS active, CAST(count(*) FILTER (NOT is_open AND size > 0) AS BIGINT) AS closed_with_events FROM lines GROUP BY 1")
def l15(spark, sf_dir):
    return _log(spark, sf_dir)[1].groupBy("partition").agg(F.max("tl_order").alias("active"), F.count_if(F.expr("not is_open and size > 0")).alias("closed_with_events"))


@query("L16_timeline_switch", "SELECT max(tl_order) + 1 AS new_order, string_agg(CAST(last_offset AS VARCHAR), ',' ORDER BY partition) AS frozen, TIMESTAMP '2024-02-01' + INTERVAL 7 DAY AS cleanup_at FROM lines WHERE is_open")
def l16(spark, sf_dir):
    open_ = _log(spark, sf_dir)[1].where("is_open")
    frozen = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("partition", "last_offset"))), lambda r: r["last_offset"].cast("string")), ",")
    return open_.agg((F.max("tl_order") + 1).alias("new_order"), frozen.alias("frozen")).withColumn("cleanup_at", F.expr("TIMESTAMP_NTZ'2024-02-01' + INTERVAL 7 DAYS"))


@query("L17_expired_timelines", "SELECT partition, tl_order, TIMESTAMP '2024-01-01' + to_days(CAST(5 * tl_order + partition AS INTEGER)) AS cleanup_at FROM lines WHERE NOT is_open AND 5 * tl_order + partition < 15")
def l17(spark, sf_dir):
    due = F.expr("timestampadd(DAY, 5 * tl_order + partition, TIMESTAMP_NTZ'2024-01-01')")
    return _log(spark, sf_dir)[1].where("not is_open").withColumn("cleanup_at", due).where("cleanup_at < TIMESTAMP_NTZ'2024-01-16'").select("partition", "tl_order", "cleanup_at")


@query("L18_retention_update", "SELECT partition, tl_order, TIMESTAMP '2024-01-01' + to_days(CAST(5 * tl_order + partition + (9 - 4) AS INTEGER)) AS cleanup_at FROM lines WHERE NOT is_open")
def l18(spark, sf_dir):
    old, new = 4, 9
    due = F.expr("timestampadd(DAY, 5 * tl_order + partition, TIMESTAMP_NTZ'2024-01-01')")
    rows = _log(spark, sf_dir)[1].where("not is_open").withColumn("cleanup_at", due)
    return rows.select("partition", "tl_order", F.expr(f"timestampadd(DAY, {new} - {old}, cleanup_at)").alias("cleanup_at"))


@query("L19_repartition", "SELECT tl_order, string_agg(CAST(last_offset AS VARCHAR), ',' ORDER BY partition) || ',-1,-1' AS padded FROM lines WHERE NOT is_open GROUP BY 1")
def l19(spark, sf_dir):
    ends = _log(spark, sf_dir)[1].where("not is_open").groupBy("tl_order").agg(F.transform(F.array_sort(F.collect_list(F.struct("partition", "last_offset"))), lambda r: r["last_offset"]).alias("ends"))
    grown = F.concat("ends", F.array_repeat(F.lit(-1).cast("long"), 2))
    return ends.select("tl_order", F.array_join(F.transform(grown, lambda x: x.cast("string")), ",").alias("padded"))


@query("L20_compaction", 'SELECT partition, key, "offset" AS log_offset, event_id FROM log g WHERE "offset" = (SELECT max("offset") FROM log x WHERE x.partition = g.partition AND x.key = g.key) AND (event_type <> \'error\' OR ts >= TIMESTAMP \'2024-02-01\' - INTERVAL 3 DAY)')
def l20(spark, sf_dir):
    log = logs.load(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "error", F.col("props")))
    return positions.compact(log, F.expr("TIMESTAMP_NTZ'2024-02-01'"), 3).select("partition", "key", F.col("offset").alias("log_offset"), "event_id")


@query("L20b_retention", "SELECT partition, count(*) AS n, min(event_id) AS first_id FROM log WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY GROUP BY 1")
def l20b(spark, sf_dir):
    return positions.retain(logs.load(spark, sf_dir), F.expr("TIMESTAMP_NTZ'2024-02-01'"), 10).groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("L21_size_statistics", ", r AS (SELECT partition, event_type, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM log GROUP BY 1, 2) SELECT partition, max(bytes) AS size FROM r GROUP BY 1")
def l21(spark, sf_dir):
    replicas = logs.load(spark, sf_dir).groupBy("partition", "event_type").agg(F.sum(F.octet_length("props")).alias("bytes"))
    return replicas.groupBy("partition").agg(F.max("bytes").alias("size"))


_ASSIGNED = ", o AS (SELECT DISTINCT partition, event_type FROM log WHERE partition < 5), w AS (SELECT DISTINCT partition, event_type FROM log WHERE partition > 2)\n"


@query("L22_assignment_difference", _ASSIGNED + "SELECT partition, event_type, 'added' AS change FROM (SELECT * FROM w EXCEPT SELECT * FROM o) UNION ALL SELECT partition, event_type, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM w)")
def l22(spark, sf_dir):
    rows = logs.load(spark, sf_dir).select("partition", "event_type").distinct()
    return positions.added_and_removed(rows.where("partition < 5"), rows.where("partition > 2"), ["partition", "event_type"])


@query("L23_misplaced_events", "SELECT partition, count(*) AS n FROM log WHERE event_type = CASE partition % 2 WHEN 0 THEN 'click' ELSE 'view' END GROUP BY 1")
def l23(spark, sf_dir):
    expected = F.when(F.col("partition") % 2 == 0, "click").otherwise("view")
    return logs.load(spark, sf_dir).where(F.col("event_type") == expected).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


@query("L24_version_barrier", "SELECT partition, min(user_id % 7) AS lowest, min(user_id % 7) >= 1 AS passed FROM log GROUP BY 1")
def l24(spark, sf_dir):
    return logs.load(spark, sf_dir).groupBy("partition").agg(F.min(F.col("user_id") % 7).alias("lowest")).withColumn("passed", F.col("lowest") >= 1)


@query("L25_cache_changes", "SELECT DISTINCT event_type FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = e.event_type AND x.user_id = e.user_id AND x.event_id % 2 = 1)")
def l25(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id", "event_id")
    new, seen = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    return new.join(seen, ["event_type", "user_id"], "left_anti").select("event_type").distinct()


@query("L26_change_compaction", "SELECT event_type, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r, max(ts) OVER (PARTITION BY event_type) AS newest FROM events) WHERE r > 1 OR newest < TIMESTAMP '2024-02-01' - INTERVAL 2 DAY")
def l26(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return positions.changes_to_remove(rows, F.expr("TIMESTAMP_NTZ'2024-02-01'"), 2).select("event_type", "id")
