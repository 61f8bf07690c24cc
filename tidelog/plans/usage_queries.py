"""Queries of lookups, metrics and pages (J, A and K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metrics, paging, positions
from ..sources import log as logs
from .base import query
from .log_queries import commits_of, cursors_of


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark, sf_dir):
    return logs.load(spark, sf_dir)


@query("J01_inner_equi_join", "WITH x AS (SELECT 1) SELECT CAST(s_suppkey AS BIGINT) AS supplier, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j01(spark, sf_dir):
    suppliers, nations = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    return suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"]).select(F.col("s_suppkey").cast("long").alias("supplier"), "n_name")


_ACL = "WITH acl AS (SELECT event_id, [{'data_type': 'user', 'value': CAST(user_id % 20 AS VARCHAR)}, {'data_type': 'service', 'value': event_type}] AS writers FROM events)\n"


def _acl(spark, sf_dir):
    pair = lambda t, v: F.struct(F.lit(t).alias("data_type"), v.alias("value"))
    return _table(spark, sf_dir, "events").select("event_id", F.array(pair("user", (F.col("user_id") % 20).cast("string")), pair("service", F.col("event_type"))).alias("writers"))


@query("J02_lateral_unnest", _ACL + "SELECT event_id FROM acl, unnest(writers) AS u(w) WHERE w.data_type = 'user' AND w.value = '7'")
def j02(spark, sf_dir):
    return _acl(spark, sf_dir).where(F.exists("writers", lambda w: (w["data_type"] == "user") & (w["value"] == "7"))).select("event_id")


@query("J03_lookup_join", ', a AS (SELECT partition, min("offset") AS first FROM log GROUP BY 1), b AS (SELECT partition, max("offset") AS last FROM log GROUP BY 1) SELECT * FROM a JOIN b USING (partition)')
def j03(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.groupBy("partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))


@query("J04_left_lookup", "SELECT partition, n - 1 - CASE WHEN partition % 3 > 0 THEN committed END AS distance FROM sizes JOIN commits USING (partition)")
def j04(spark, sf_dir):
    log = _log(spark, sf_dir)
    return metrics.unconsumed(positions.statistics(log, ["partition"]), commits_of(log).where("partition % 3 > 0")).select("partition", F.col("unconsumed").alias("distance"))


@query("J05_session_state", ", s(session, kind) AS (VALUES ('s0', 'auto'), ('s1', 'direct')) SELECT partition, CASE WHEN kind IS NULL THEN 'UNASSIGNED' ELSE 'ASSIGNED' END AS state, s.session AS stream_id, kind FROM sizes LEFT JOIN s ON lower('S' || (partition % 3)) = s.session")
def j05(spark, sf_dir):
    parts = logs.sizes(_log(spark, sf_dir)).select("partition", F.concat(F.lit("S"), F.col("partition") % 3).alias("held_by"))
    sessions = spark.createDataFrame([("s0", "auto"), ("s1", "direct")], "session string, kind string")
    joined = parts.join(F.broadcast(sessions), F.lower("held_by") == F.lower("session"), "left")
    return joined.select("partition", F.when(F.col("kind").isNull(), "UNASSIGNED").otherwise("ASSIGNED").alias("state"), F.col("session").alias("stream_id"), "kind")


@query("J06_missing", "WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 20 = 0)")
def j06(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.join(events.where("event_id % 20 = 0"), "user_id", "left_anti").select("user_id").distinct()


@query("J07_containment", "WITH x AS (SELECT 1) SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_id % 100 = 0)")
def j07(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.join(events.where("event_id % 100 = 0").select("user_id"), "user_id", "left_semi").select("event_id")


@query("J08_range_lookup", 'SELECT event_id, tl_order FROM tlog')
def j08(spark, sf_dir):
    log = _log(spark, sf_dir)
    return logs.on_timelines(log, logs.timelines(log)).select("event_id", "tl_order")


_LAG = ", nx AS (SELECT partition, arg_min(ts, \"offset\") AS next_ts FROM log JOIN commits USING (partition) WHERE \"offset\" > committed GROUP BY 1), lag AS (SELECT partition, coalesce(CAST(floor((epoch_us(TIMESTAMP '2024-02-02') - epoch_us(next_ts)) / 1000000) AS BIGINT), 0) AS lag_seconds FROM commits LEFT JOIN nx USING (partition))\n"
_AS_OF = "TIMESTAMP_NTZ'2024-02-02'"


@query("J09_next_event", _LAG + "SELECT partition, lag_seconds FROM lag")
def j09(spark, sf_dir):
    log = _log(spark, sf_dir)
    return metrics.next_event_lag(log, commits_of(log), F.expr(_AS_OF))


@query("J10_cross_join", "WITH x AS (SELECT 1) SELECT r_name, n_name FROM region, nation WHERE n_nationkey < 5")
def j10(spark, sf_dir):
    return _table(spark, sf_dir, "region").select("r_name").crossJoin(_table(spark, sf_dir, "nation").where("n_nationkey < 5").select("n_name"))  # two metadata tables


@query("J11_permission_difference", "WITH o AS (SELECT DISTINCT user_id FROM events WHERE event_id % 40 = 0 AND user_id <> 1), w AS (SELECT DISTINCT user_id FROM events WHERE event_id % 60 = 0 AND user_id <> 1) SELECT user_id, 'added' AS change FROM (SELECT * FROM w EXCEPT SELECT * FROM o) UNION ALL SELECT user_id, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM w)")
def j11(spark, sf_dir):
    users = lambda c: _table(spark, sf_dir, "events").where(c).where("user_id <> 1").select("user_id").distinct()
    return positions.added_and_removed(users("event_id % 40 = 0"), users("event_id % 60 = 0"), ["user_id"])


@query("A01_consumption_kpi", "WITH x AS (SELECT 1) SELECT epoch(ts)::BIGINT // 30 * 30 AS window_start, event_type, count(*) AS n_events, CAST(sum(strlen(props)) AS BIGINT) AS n_bytes FROM (SELECT date_trunc('second', ts) AS ts, event_type, props FROM events) GROUP BY 1, 2")
def a01(spark, sf_dir):
    return metrics.windowed_totals(_table(spark, sf_dir, "events"), 30, ["event_type"], F.octet_length("props"))


_BATCH = "WITH b AS (SELECT event_id // 50 AS batch_id, count(*) AS n_events, CAST(sum(strlen(props)) AS BIGINT) AS event_bytes FROM events GROUP BY 1)\n"


@query("A02_publishing_kpi", "WITH b AS (SELECT event_id // 50 AS batch_id, count(*) AS n_events, CAST(sum(strlen(props)) AS BIGINT) AS n_bytes, bool_or(event_id % 173 = 0) AS failed FROM events GROUP BY 1) SELECT batch_id, n_events, n_bytes, sha256('salt' || 'app' || (batch_id % 3)) AS app_hashed FROM b WHERE NOT failed")
def a02(spark, sf_dir):
    batches = _table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 50).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.octet_length("props")).alias("n_bytes"), F.bool_or(F.col("event_id") % 173 == 0).alias("failed")
    )
    app = F.concat(F.lit("app"), F.col("batch_id") % 3)
    return batches.where(~F.col("failed")).select("batch_id", "n_events", "n_bytes", scalars.salted_hash(app, "salt").alias("app_hashed"))


@query("A03_access_log", "WITH r AS (SELECT event_type, CASE event_id % 10 WHEN 0 THEN 503 WHEN 1 THEN 207 WHEN 2 THEN 422 ELSE 200 END AS status FROM events) SELECT event_type, count(*) AS requests, count(*) FILTER (status >= 500 OR status = 207) AS server_errors FROM r GROUP BY 1")
def a03(spark, sf_dir):
    m = F.col("event_id") % 10
    status = F.when(m == 0, 503).when(m == 1, 207).when(m == 2, 422).otherwise(200)
    return _table(spark, sf_dir, "events").withColumn("status", status).groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_if((F.col("status") >= 500) | (F.col("status") == 207)).alias("server_errors"))


@query("A04_publishing_metrics", _BATCH + "SELECT batch_id, n_events, event_bytes + n_events + 1 AS batch_bytes, event_bytes // n_events AS avg_bytes FROM b")
def a04(spark, sf_dir):
    return metrics.publishing_sizes(_table(spark, sf_dir, "events"), F.floor(F.col("event_id") / 50), F.octet_length("props"))


@query("A05_distinct_gauge", "SELECT count(DISTINCT (event_type, partition)) AS pairs FROM log")
def a05(spark, sf_dir):
    return _log(spark, sf_dir).agg(F.count_distinct("event_type", "partition").alias("pairs"))


@query("A06_unconsumed", "SELECT partition, n - 1 - committed AS unconsumed FROM commits JOIN sizes USING (partition)")
def a06(spark, sf_dir):
    log = _log(spark, sf_dir)
    return metrics.unconsumed(positions.statistics(log, ["partition"]), commits_of(log)).select("partition", "unconsumed")


@query("A07_consumer_lag", _LAG + "SELECT max(lag_seconds) AS worst, min(lag_seconds) AS best FROM lag")
def a07(spark, sf_dir):
    log = _log(spark, sf_dir)
    return metrics.next_event_lag(log, commits_of(log), F.expr(_AS_OF)).agg(F.max("lag_seconds").alias("worst"), F.min("lag_seconds").alias("best"))


@query("A08_subscription_stats", _LAG + ", u AS (SELECT partition, n - 1 - committed AS unconsumed FROM commits JOIN sizes USING (partition)) SELECT 'events' AS event_type, string_agg(partition || ':' || unconsumed || ':' || lag_seconds, ' ' ORDER BY CAST(partition AS VARCHAR)) AS stats FROM u JOIN lag USING (partition)")
def a08(spark, sf_dir):
    log = _log(spark, sf_dir)
    committed = commits_of(log)
    rows = metrics.unconsumed(positions.statistics(log, ["partition"]), committed).join(metrics.next_event_lag(log, committed, F.expr(_AS_OF)), "partition")
    one = F.struct(F.col("partition").cast("string").alias("p"), F.concat_ws(":", "partition", "unconsumed", "lag_seconds").alias("t"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"]), " ").alias("stats")).select(F.lit("events").alias("event_type"), "stats")


@query("A09_size_buckets", "WITH b AS (SELECT CASE WHEN strlen(text) < 5000 THEN '<5K' WHEN strlen(text) > 50000 THEN '>50K' ELSE '5K-50K' END AS bucket FROM documents) SELECT bucket, count(*) AS n FROM b GROUP BY 1")
def a09(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(scalars.size_bucket(F.octet_length("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("A10_count_rows", "WITH x AS (SELECT 1) SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a10(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("A11_duplicate_partitions", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM c WHERE n > 1")
def a11(spark, sf_dir):
    return metrics.duplicates(_table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("A12_positions_by_storage", "SELECT 'st' || (partition % 3) AS storage, string_agg(partition || '@' || c_order || '/' || c_offset, ' ' ORDER BY partition, c_order) AS positions FROM cursors GROUP BY 1")
def a12(spark, sf_dir):
    rows = cursors_of(logs.timelines(_log(spark, sf_dir)))
    text = F.concat("partition", F.lit("@"), "c_order", F.lit("/"), "c_offset").alias("t")
    return rows.groupBy(F.concat(F.lit("st"), F.col("partition") % 3).alias("storage")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("partition", "c_order", text))), lambda s: s["t"]), " ").alias("positions"))


@query("A13_direct_partitions", ", s AS (SELECT user_id % 10 AS session, partition FROM log WHERE user_id % 10 < 4 AND partition < 6) SELECT count(DISTINCT partition) AS direct FROM s")
def a13(spark, sf_dir):
    asked = _log(spark, sf_dir).where("user_id % 10 < 4 and partition < 6").groupBy((F.col("user_id") % 10).alias("session")).agg(F.collect_set("partition").alias("requested"))
    return asked.select(F.explode("requested").alias("p")).agg(F.count_distinct("p").alias("direct"))


@query("A14_duplicate_attributes", "WITH a AS (SELECT event_type, 'user' AS data_type, CAST(user_id AS VARCHAR) AS value FROM events), d AS (SELECT event_type, data_type || ':' || value AS attr FROM a GROUP BY event_type, data_type, value HAVING count(*) > 1) SELECT event_type, string_agg(attr, ',' ORDER BY attr) AS duplicated FROM d GROUP BY 1")
def a14(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_type", F.concat(F.lit("user:"), "user_id").alias("attr"))
    return metrics.duplicates(rows, ["event_type", "attr"]).groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("attr")), ",").alias("duplicated"))


@query("A15_order_violations", ', v AS (SELECT *, event_id % 29 = 0 AS failed FROM log), w AS (SELECT *, bool_or(failed) OVER (PARTITION BY partition, key ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v) SELECT partition, key, count(*) AS n FROM w WHERE before AND NOT failed GROUP BY 1, 2')
def a15(spark, sf_dir):
    found = metrics.order_violations(_log(spark, sf_dir), ["partition", "key"], "offset", F.col("event_id") % 29 == 0)
    return found.groupBy("partition", "key").agg(F.count(F.lit(1)).alias("n"))


@query("A16b_aligned_micro_batches", "WITH s AS (SELECT event_type, epoch_us(ts) // 600000000 AS slot, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 600000000 ORDER BY ts, event_id) - 1 AS rn FROM events) SELECT event_type, slot, rn // 100 AS part, count(*) AS n FROM s GROUP BY 1, 2, 3")
def a16(spark, sf_dir):
    from ..operators import batching

    rows = batching.micro_batches(_table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 100, 600)
    return rows.groupBy("event_type", "slot", "part").agg(F.count(F.lit(1)).alias("n"))


@query("A17_partition_variance", "SELECT round(var_pop(n), 3) AS spread FROM sizes")
def a17(spark, sf_dir):
    return metrics.variance(_log(spark, sf_dir))


@query("A18_audit_records", "WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS before FROM orders WHERE o_orderkey % 3 > 0), w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS after FROM orders WHERE o_orderkey % 7 > 0), j AS (SELECT id, before, after, CASE WHEN before IS NULL THEN 'C' WHEN after IS NULL THEN 'D' WHEN before <> after THEN 'U' END AS data_op FROM o FULL JOIN w USING (id)) SELECT CAST(id AS BIGINT) AS id, before, after, data_op FROM j WHERE data_op IS NOT NULL")
def a18(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("content"))
    new = orders.where("id % 7 > 0").withColumn("content", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("content")))
    return metrics.change_records(orders.where("id % 3 > 0"), new, "id", "content")


@query("K01_filtered_sort", "WITH x AS (SELECT 1) SELECT p_name AS name FROM part WHERE p_brand = 'Brand#12' ORDER BY p_name")
def k01(spark, sf_dir):
    return _table(spark, sf_dir, "part").where("p_brand = 'Brand#12'").select(F.col("p_name").alias("name")).orderBy("name")


@query("K02_offset_page", "WITH x AS (SELECT 1) SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def k02(spark, sf_dir):
    return paging.offset_page(_table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 50, 25).select("event_id")


@query("K03_page_links", "WITH x AS (SELECT 1) SELECT event_id, CAST(75 AS BIGINT) AS next_offset, CAST(25 AS BIGINT) AS prev_offset FROM events ORDER BY event_id LIMIT 25 OFFSET 50")
def k03(spark, sf_dir):
    page, links = paging.page_links(_table(spark, sf_dir, "events"), ["event_id"], 50, 25)
    return page.select("event_id", F.lit(links["next"]).cast("long").alias("next_offset"), F.lit(links["prev"]).cast("long").alias("prev_offset"))


@query("K04_keyset_page", "WITH i AS (SELECT lpad(CAST(event_id AS VARCHAR), 8, '0') AS id FROM events) SELECT * FROM (SELECT id, 'F' AS token FROM i WHERE id > '00000500' ORDER BY id LIMIT 10) UNION ALL SELECT * FROM (SELECT id, 'B' FROM i WHERE id < '00000500' ORDER BY id DESC LIMIT 10)")
def k04(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 8, "0").alias("id"))
    page = lambda t: paging.keyset_page(rows, "id", f"{t}00000500", 10).withColumn("token", F.lit(t))
    return page("F").unionByName(page("B"))


_SUBS = "WITH s AS (SELECT user_id, list(DISTINCT event_type) AS ets FROM events GROUP BY 1)\n"


@query("K05_array_containment", _SUBS + "SELECT user_id FROM s WHERE list_contains(ets, 'click') AND list_contains(ets, 'purchase')")
def k05(spark, sf_dir):
    subs = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("ets"))
    return paging.containing_all(subs, "ets", ["click", "purchase"]).select("user_id")


@query("K06_key_lookup", "WITH x AS (SELECT 1) SELECT event_id, event_type FROM events WHERE user_id = 7 AND event_type = 'view'")
def k06(spark, sf_dir):
    return _table(spark, sf_dir, "events").where("user_id = 7 and event_type = 'view'").select("event_id", "event_type")


@query("K07_latest_by_type", "WITH x AS (SELECT 1) SELECT event_type, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1")
def k07(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("K08_default_storage", "WITH x AS (SELECT 1) SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey LIMIT 1")
def k08(spark, sf_dir):
    return _table(spark, sf_dir, "nation").where("n_regionkey = 2").orderBy("n_nationkey").limit(1).select("n_name")


@query("K09_argmax_partition", "SELECT partition, n FROM sizes ORDER BY n DESC, partition LIMIT 1")
def k09(spark, sf_dir):
    return logs.sizes(_log(spark, sf_dir)).agg(F.max_by("partition", F.struct("n", -F.col("partition"))).alias("partition"), F.max("n").alias("n"))


@query("K11_default_switch", "WITH x AS (SELECT 1) SELECT n_name, n_name = 'FRANCE' AS is_default FROM nation")
def k11(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_name", (F.col("n_name") == "FRANCE").alias("is_default"))


@query("F01_string_hash", "SELECT key, CAST((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS INTEGER) AS hashed FROM (SELECT DISTINCT key, h FROM hashed)")
def f01(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key")).distinct().withColumn("hashed", scalars.string_hash(F.col("key")))


@query("F02_json_path", "WITH x AS (SELECT 1) SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f02(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", scalars.json_path(F.col("props"), "k").alias("k"))


@query("F05_date_time_check", "WITH v(t) AS (VALUES ('2024-01-01T00:00:00Z'), ('2024-01-01T00:00:00+01:00'), ('2024-01-01 00:00:00'), ('2024-13-01T00:00:00Z'), ('2024-01-01T00:00:00'), ('yesterday'), ('2024-02-29T23:59:59.123Z')) SELECT t, regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})') AND TRY_CAST(substr(t, 1, 10) AS DATE) IS NOT NULL AS valid FROM v")
def f05(spark, sf_dir):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+01:00", "2024-01-01 00:00:00", "2024-13-01T00:00:00Z", "2024-01-01T00:00:00", "yesterday", "2024-02-29T23:59:59.123Z"]
    return spark.createDataFrame([(t,) for t in texts], "t string").withColumn("valid", scalars.is_date_time(F.col("t")))


_CODE = "chr(65 + CAST(o_orderkey % 26 AS INTEGER)) || chr(65 + CAST(o_orderkey // 26 % 26 AS INTEGER)) || chr(65 + CAST(o_orderkey // 676 % 26 AS INTEGER))"


@query("F06_currency_check", f"WITH v AS (SELECT o_orderkey, {_CODE} AS t FROM orders) SELECT o_orderkey, t, t IN ({', '.join(repr(c) for c in scalars.CURRENCIES)}) AS valid FROM v")
def f06(spark, sf_dir):
    letter = lambda k: F.chr((F.lit(65) + F.floor(F.col("o_orderkey") / 26**k) % 26).cast("long"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(letter(0), letter(1), letter(2)).alias("t"))
    return rows.withColumn("valid", scalars.is_currency(F.col("t")))


@query("F07_uuid_check", "WITH v AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END || '00000000-0000-0000-0000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS t FROM events) SELECT event_id, event_id % 5 <> 0 AS valid FROM v")
def f07(spark, sf_dir):
    text = F.concat(F.when(F.col("event_id") % 5 == 0, "x").otherwise(""), F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return _table(spark, sf_dir, "events").select("event_id", scalars.is_uuid(text).alias("valid"))


@query("F08_salted_hash", "WITH x AS (SELECT 1) SELECT DISTINCT user_id, sha256('salt' || user_id) AS hashed FROM events")
def f08(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("user_id").distinct().withColumn("hashed", scalars.salted_hash(F.col("user_id").cast("string"), "salt"))


@query("F09_fields_hash", _SUBS + "SELECT user_id, md5('app' || 'default' || array_to_string(list_sort(ets), '')) AS hashed FROM s")
def f09(spark, sf_dir):
    subs = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("ets"))
    return subs.select("user_id", scalars.fields_hash(F.lit("app"), F.lit("default"), F.array_join("ets", "")).alias("hashed"))


@query("F10_byte_length", "WITH x AS (SELECT 1) SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def f10(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query("F13_json_pointer", "WITH v(p) AS (VALUES ('a'), ('a.b'), ('foo.bar.baz')) SELECT p, '/' || replace(p, '.', '/') AS pointer FROM v")
def f13(spark, sf_dir):
    return spark.createDataFrame([("a",), ("a.b",), ("foo.bar.baz",)], "p string").withColumn("pointer", scalars.json_pointer(F.col("p")))


@query("F14_version_parts", "WITH v(t) AS (VALUES ('1.0.0'), ('2.13.4'), ('1.0'), ('x')) SELECT t, CASE WHEN regexp_full_match(t, '[0-9]+\\.[0-9]+\\.[0-9]+') THEN CAST(split_part(t, '.', 2) AS INTEGER) END AS minor FROM v")
def f14(spark, sf_dir):
    return spark.createDataFrame([("1.0.0",), ("2.13.4",), ("1.0",), ("x",)], "t string").withColumn("minor", scalars.version_parts(F.col("t"))["minor"])


@query("F16_lag_seconds", "WITH x AS (SELECT 1) SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-02-02') - epoch_us(ts)) / 1000000) AS BIGINT) AS lag_seconds FROM events")
def f16(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", scalars.lag_seconds(F.col("ts"), F.expr(_AS_OF)).alias("lag_seconds"))


@query("F17_attribute_parse", "WITH v(t) AS (VALUES ('user:jane'), ('service:a:b'), ('user'), (':x')) SELECT t, CASE WHEN regexp_full_match(t, '[^:]+:.+') THEN split_part(t, ':', 1) END AS data_type, CASE WHEN regexp_full_match(t, '[^:]+:.+') THEN substr(t, strpos(t, ':') + 1) END AS value FROM v")
def f17(spark, sf_dir):
    rows = spark.createDataFrame([("user:jane",), ("service:a:b",), ("user",), (":x",)], "t string")
    return rows.withColumn("a", scalars.attribute(F.col("t"))).select("t", "a.data_type", "a.value")


@query("F18_name_check", "WITH v(t) AS (VALUES ('a.b-c_d'), ('order.created'), ('1a'), ('a..b'), ('a b')) SELECT t, regexp_full_match(t, '[a-zA-Z][-0-9a-zA-Z_]*(\\.[0-9a-zA-Z][-0-9a-zA-Z_]*)*') AS valid FROM v")
def f18(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in ("a.b-c_d", "order.created", "1a", "a..b", "a b")], "t string").withColumn("valid", scalars.is_event_type_name(F.col("t")))


@query("F03_left_pad", "WITH x AS (SELECT 1) SELECT event_id, CASE WHEN length(t) >= 4 THEN t ELSE lpad(t, 4, '0') END AS padded FROM (SELECT event_id, CAST(event_id AS VARCHAR) AS t FROM events)")
def f03(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", scalars.pad_left(F.col("event_id").cast("string"), 4).alias("padded"))


@query("F04_hexadecimal_order", "WITH x AS (SELECT 1) SELECT event_id, CASE WHEN length(t) >= 4 THEN t ELSE lpad(t, 4, '0') END AS order_text, event_id AS order_number FROM (SELECT event_id, lower(hex(event_id)) AS t FROM events)")
def f04(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", scalars.order_text(F.col("event_id")).alias("order_text"))
    return rows.withColumn("order_number", scalars.order_of(F.col("order_text")))


@query("F11_joined_keys", "WITH x AS (SELECT 1) SELECT event_id, user_id || ',' || event_type AS joined FROM events")
def f11(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", "user_id", "event_type").alias("joined"))


@query("F15_compact_json", """WITH x AS (SELECT 1) SELECT event_id, '{"a b":"x  \\" y","u":[' || user_id || ',2],"t":"' || event_type || '"}' AS compact FROM events""")
def f15(spark, sf_dir):
    text = F.concat(F.lit('{ "a b" :\t"x  \\" y",\n "u": [ '), "user_id", F.lit(' ,2 ], "t":"'), "event_type", F.lit('" }\r\n'))
    return _table(spark, sf_dir, "events").select("event_id", scalars.compact_json(text).alias("compact"))
