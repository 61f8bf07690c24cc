"""Queries of the ingest pipeline (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import ingest
from .base import query

#: The items: events as JSON texts, some damaged on purpose.
_ITEMS = """WITH i AS (SELECT event_id, event_id // 50 AS batch_id, CAST(event_id % 50 AS INTEGER) AS idx, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
event_id % 97 = 3 AS broken, event_id % 89 = 5 AS undated, event_id % 83 = 7 AS nameless, event_id % 79 = 9 AS large FROM events),
v AS (SELECT *, broken OR NOT broken AND (nameless OR k > 95) AS unfit FROM i),
w AS (SELECT *, CASE WHEN unfit THEN 'VALIDATING' WHEN undated AND NOT broken THEN 'VALIDATING' WHEN large AND NOT broken THEN 'ENRICHING' END AS fails FROM v)
"""

SCHEMA = {
    "type": "object", "required": ["user", "k"], "additionalProperties": False,
    "definitions": {"count": {"type": "integer", "minimum": 0, "maximum": 95}},
    "properties": {"user": {"type": "string", "pattern": "^u[0-9]+$", "maxLength": 12}, "k": {"$ref": "#/definitions/count"}, "metadata": {"type": "object"}, "pad": {"anyOf": [{"type": "string"}, {"type": "null"}]}},
}


def items_of(spark, sf_dir):
    """batch_id, idx and the JSON text of each item."""
    e = F.col("event_id")
    lit = F.lit
    dated = F.when(e % 89 == 5, "yesterday").otherwise("2024-01-05T10:00:00Z")
    meta = F.concat(lit('{"metadata":{"eid":"00000000-0000-0000-0000-'), F.lpad(e.cast("string"), 12, "0"), lit('","occurred_at":"'), dated, lit('","parent_eids":["a","b"],"n":5}'))
    user = F.when(e % 83 == 7, "").otherwise(F.concat(lit(',"user":"u'), "user_id", lit('"')))
    pad = F.when(e % 79 == 9, F.concat(lit(',"pad":"'), F.repeat(lit("x"), 300), lit('"'))).otherwise("")
    k = F.get_json_object("props", "$.k")
    text = F.when(e % 97 == 3, F.lit('{"user":')).otherwise(F.concat(meta, user, lit(',"k": '), k, pad, lit("}")))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.floor(e / 50).alias("batch_id"), (e % 50).cast("int").alias("idx"), "event_id", "user_id", "event_type", text.alias("text"))


def _results(spark, sf_dir):
    items = items_of(spark, sf_dir)
    unfit = ingest.violations(SCHEMA, F.col("text")).isNotNull()
    undated = ~scalars.is_date_time(scalars.json_path(F.col("text"), "metadata.occurred_at"))
    large = ingest.too_large(F.col("text"), 300)
    step = F.when(unfit | undated, "VALIDATING").otherwise("ENRICHING")
    return ingest.publish(items, unfit | undated | large, step)


_RESULTS = _ITEMS + """, f AS (SELECT batch_id, min(idx) AS pos, arg_min(fails, idx) AS step FROM w WHERE fails IS NOT NULL GROUP BY 1),
r AS (SELECT w.batch_id, idx, CASE WHEN pos IS NULL THEN 'SUBMITTED' WHEN idx = pos THEN 'FAILED' ELSE 'ABORTED' END AS status, CASE WHEN pos IS NULL THEN 'PUBLISHING' WHEN idx <= pos THEN f.step ELSE 'NONE' END AS step FROM w LEFT JOIN f USING (batch_id))
"""


@query("P01_publish_pipeline", _RESULTS + "SELECT batch_id, idx, status, step FROM r")
def p01(spark, sf_dir):
    return _results(spark, sf_dir).select("batch_id", "idx", "status", "step")


@query("P02_response_codes", _RESULTS + ", b AS (SELECT batch_id, bool_or(status = 'FAILED') AS stopped, bool_or((batch_id * 50 + idx) % 173 = 0) AS lost FROM r GROUP BY 1) SELECT CASE WHEN stopped THEN 422 WHEN lost THEN 207 ELSE 200 END AS code, count(*) AS n FROM b GROUP BY 1")
def p02(spark, sf_dir):
    batches = ingest.publish_status(ingest.appended(_results(spark, sf_dir), F.col("event_id") % 173 == 0))
    return batches.groupBy(ingest.response_code(F.col("status")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


#: Texts, whether they are strict, and whether they are with something behind them.
_TEXTS = (
    ('{"a":1}', True, True), ('{"a":1} x', False, True), ('{"a":1}{"b":2}', False, True), ('{"a":1}}', False, True), ('{"a":1}]', False, True), ('{"a":1},{"b":2}', False, True),
    ('{"a":1,}', False, False), ('{"a":[1,]}', False, False), ('{"a":1,"a":2}', False, False), ("[1]", False, False), ('{"a":"b\tc"}', False, False), ('{\t"a":\n1}', True, True),
    ("{}", True, True), ('{"a":tru}', False, False), ("", False, False), ('{"a":",}"}', True, True), ('{"a":"x, ]"}', True, True), ('{"a":01}', True, True), ('{"a":-0}', True, True),
    ('{"a":9223372036854775807}', True, True), ('{"a":9223372036854775808}', False, False), ('{"a":1e308}', True, True), ('{"a":1e309}', False, False), ('{"a":1.}', True, True),
    ('{"a":.5}', False, False), ('{"a":"\\\'"}', True, True), ('{"a":"\\x"}', False, False), ('{"a":{"b":[null,true,{}]}}', True, True), ('{"a":{"b":1,"b":1}}', False, False), ('{"01":1,"1":2}', True, True),
)


def _cases(values) -> str:
    return "CASE event_id % {} {} END".format(len(_TEXTS), " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)))


@query("P03_strict_parse", f"WITH x AS (SELECT 1) SELECT event_id, {_cases([t[1] for t in _TEXTS])} AS strict, {_cases([t[2] for t in _TEXTS])} AS strict_in_front FROM events")
def p03(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in _TEXTS]), (F.col("event_id") % len(_TEXTS) + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("t"))
    return rows.select("event_id", ingest.is_strict(F.col("t")).alias("strict"), ingest.is_strict(F.col("t"), allow_more=True).alias("strict_in_front"))


@query("P04_schema_validation", _ITEMS + "SELECT event_id, NOT unfit AS valid FROM w")
def p04(spark, sf_dir):
    return items_of(spark, sf_dir).select("event_id", ingest.violations(SCHEMA, F.col("text")).isNull().alias("valid"))


@query("P05_timestamp_check", _ITEMS + "SELECT event_id, NOT undated AND NOT broken AS dated FROM w")
def p05(spark, sf_dir):
    return items_of(spark, sf_dir).select("event_id", scalars.is_date_time(scalars.json_path(F.col("text"), "metadata.occurred_at")).alias("dated"))


@query("P06_size_filter", "WITH x AS (SELECT 1) SELECT doc_id FROM documents WHERE strlen(text) > 5000")
def p06(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(ingest.too_large(F.col("text"), 5000)).select("doc_id")


@query("P07_delete_guard", _ITEMS + "SELECT event_id, CAST(NULL AS VARCHAR) AS value, event_type IN ('click', 'view') AS allowed FROM w")
def p07(spark, sf_dir):
    rows = items_of(spark, sf_dir)
    return rows.select("event_id", F.lit(None).cast("string").alias("value"), F.col("event_type").isin("click", "view").alias("allowed"))


@query("P08_event_type_match", "WITH s(event_type, version) AS (VALUES ('click', 0), ('click', 1), ('view', 0)) SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM s WHERE s.event_type = e.event_type AND s.version = e.event_id % 3)")
def p08(spark, sf_dir):
    schemas = spark.createDataFrame([("click", 0), ("click", 1), ("view", 0)], "event_type string, version long")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("version", F.col("event_id") % 3)
    return rows.join(F.broadcast(schemas), ["event_type", "version"], "left_semi").select("event_id")


@query("P09_check_fanout", _ITEMS + ", f AS (SELECT batch_id, min(idx) AS pos FROM w WHERE large GROUP BY 1) SELECT batch_id, idx, CASE WHEN idx = pos THEN 'FAILED' ELSE 'ABORTED' END AS status, CASE WHEN idx > pos THEN 'NONE' ELSE 'VALIDATING' END AS step FROM w JOIN f USING (batch_id)")
def p09(spark, sf_dir):
    return ingest.check_fanout(items_of(spark, sf_dir).select("batch_id", "idx", "event_id"), F.col("event_id") % 79 == 9, "VALIDATING").drop("event_id")


@query("P10_path_access", _ITEMS + "SELECT event_id, CASE WHEN NOT broken THEN '00000000-0000-0000-0000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS eid FROM w")
def p10(spark, sf_dir):
    return items_of(spark, sf_dir).select("event_id", scalars.json_path(F.col("text"), "metadata.'eid'").alias("eid"))


@query("P11_key_extraction", _ITEMS + "SELECT event_id, CASE WHEN NOT broken AND NOT nameless THEN 'u' || user_id END AS k1, CASE WHEN NOT broken THEN CAST(k AS VARCHAR) END AS k2 FROM w")
def p11(spark, sf_dir):
    one, two = ingest.key_fields(F.col("text"), ["user", "k"])
    return items_of(spark, sf_dir).select("event_id", one.alias("k1"), two.alias("k2"))


@query("P12_record_key", _ITEMS + "SELECT event_id, CASE WHEN NOT broken THEN CASE WHEN nameless THEN CAST(k AS VARCHAR) ELSE 'u' || user_id || ',' || k END END AS record_key FROM w")
def p12(spark, sf_dir):
    keys = ingest.key_fields(F.col("text"), ["user", "k"])
    return items_of(spark, sf_dir).select("event_id", ingest.record_key(keys, False, F.col("text")).alias("record_key"))


@query("P13_hash_partition", "SELECT event_id, partition FROM log")
def p13(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalars.partition_of([F.col("user_id").cast("string")], 8).alias("partition"))


@query("P14_order_override", "SELECT event_id, 7 - partition AS partition FROM log")
def p14(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalars.partition_of([F.col("user_id").cast("string")], 8, list(range(7, -1, -1))).alias("partition"))


@query("P15_user_defined_partition", "WITH t AS (SELECT event_id, CAST(event_id % 10 AS VARCHAR) AS p FROM events) SELECT event_id, CASE WHEN p < '8' THEN p END AS partition, CASE WHEN p >= '8' THEN 'UNKNOWN_PARTITION' END AS error FROM t")
def p15(spark, sf_dir):
    text = F.concat(F.lit('{"metadata":{"partition":"'), F.col("event_id") % 10, F.lit('"}}'))
    partition, error = ingest.user_partition(F.col("t"), [str(k) for k in range(8)])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("t")).select("event_id", partition.alias("partition"), error.alias("error"))


@query("P16_random_partition")
def p16(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ingest.random_partition(8, 42).alias("partition"))


@query("P17_strategy_check", "WITH s(strategy, category, n_keys) AS (VALUES ('hash', 'BUSINESS', 1), ('hash', 'BUSINESS', 0), ('random', 'UNDEFINED', 0), ('user_defined', 'UNDEFINED', 0), ('user_defined', 'DATA', 0), ('magic', 'DATA', 1)) SELECT strategy, category, n_keys, CASE WHEN strategy = 'magic' THEN 'UNKNOWN_STRATEGY' WHEN strategy = 'hash' AND n_keys = 0 THEN 'KEYS_MISSING' WHEN strategy = 'user_defined' AND category = 'UNDEFINED' THEN 'NOT_FOR_UNDEFINED' END AS error FROM s")
def p17(spark, sf_dir):
    rows = spark.createDataFrame([("hash", "BUSINESS", 1), ("hash", "BUSINESS", 0), ("random", "UNDEFINED", 0), ("user_defined", "UNDEFINED", 0), ("user_defined", "DATA", 0), ("magic", "DATA", 1)], "strategy string, category string, n_keys int")
    s = F.col("strategy")
    error = F.when(~s.isin("hash", "random", "user_defined"), "UNKNOWN_STRATEGY").when((s == "hash") & (F.col("n_keys") == 0), "KEYS_MISSING").when((s == "user_defined") & (F.col("category") == "UNDEFINED"), "NOT_FOR_UNDEFINED")
    return rows.withColumn("error", error)


@query("P18_partition_count", "WITH x AS (SELECT 1) SELECT event_id, CAST(CASE WHEN greatest(r, w) <= 0 THEN 1 ELSE least(greatest(r, w), 8) END AS BIGINT) AS partitions FROM (SELECT event_id, event_id % 13 - 3 AS r, event_id % 5 - 2 AS w FROM events)")
def p18(spark, sf_dir):
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ingest.planned_partitions(e % 13 - 3, e % 5 - 2, 8, 1).cast("long").alias("partitions"))


_META = """'{"eid":"00000000-0000-0000-0000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '","occurred_at":"' || CASE WHEN undated THEN 'yesterday' ELSE '2024-01-05T10:00:00Z' END || '","parent_eids":["a","b"],"n":5,"published_by":"app-1'"""


@query("P19_metadata_enrichment", _ITEMS + f"""SELECT event_id, {_META} || '","received_at":"2024-02-01T00:00:00Z","event_type":"' || event_type || '","flow_id":"flow","partition":"' || (event_id % 8) || '","version":"1.0.0"}}' AS metadata FROM w WHERE NOT broken""")
def p19(spark, sf_dir):
    fields = {
        "published_by": F.lit("app-1"), "received_at": F.lit("2024-02-01T00:00:00Z"), "event_type": F.col("event_type"), "flow_id": F.lit("flow"),
        "partition": (F.col("event_id") % 8).cast("string"), "version": F.lit("1.0.0"),
    }
    rows = items_of(spark, sf_dir).where("event_id % 97 <> 3")
    return rows.select("event_id", F.to_json(ingest.enrich(F.col("text"), fields)).alias("metadata"))


@query("P20_enrichment_rules", "WITH s(category, n, d) AS (VALUES ('UNDEFINED', 0, 0), ('UNDEFINED', 1, 1), ('DATA', 1, 1), ('DATA', 0, 0), ('BUSINESS', 2, 1)) SELECT category, n, CASE WHEN category = 'UNDEFINED' AND n > 0 THEN 'NOT_FOR_UNDEFINED' WHEN category <> 'UNDEFINED' AND n = 0 THEN 'MISSING' WHEN n > d THEN 'REPEATED' END AS error FROM s")
def p20(spark, sf_dir):
    m = "metadata_enrichment"
    rows = spark.createDataFrame([("UNDEFINED", []), ("UNDEFINED", [m]), ("DATA", [m]), ("DATA", []), ("BUSINESS", [m, m])], "category string, strategies array<string>")
    undefined, n = F.col("category") == "UNDEFINED", F.size("strategies")
    error = F.when(undefined & (n > 0), "NOT_FOR_UNDEFINED").when(~undefined & ~F.array_contains("strategies", m), "MISSING").when(n > F.size(F.array_distinct("strategies")), "REPEATED")
    return rows.select("category", n.alias("n"), error.alias("error"))


@query("P21_metadata_injection", _ITEMS + f"""SELECT event_id, '{{"metadata":' || {_META} || '"}}' || CASE WHEN nameless THEN '' ELSE ',"user":"u' || user_id || '"' END || ',"k":' || k || CASE WHEN large THEN ',"pad":"' || repeat('x', 300) || '"' ELSE '' END || '}}' AS event FROM w WHERE NOT broken""")
def p21(spark, sf_dir):
    rows = items_of(spark, sf_dir).where("event_id % 97 <> 3")
    return rows.select("event_id", ingest.with_metadata(F.col("text"), ingest.enrich(F.col("text"), {"published_by": F.lit("app-1")})).alias("event"))


@query("F12_metadata_merge", "WITH x AS (SELECT 1) SELECT event_id, '{\"flow_id\":' || CASE WHEN event_id % 3 = 0 THEN '\"own\"' ELSE '\"f\"' END || ',\"span\":{\"a\":[1,2]},\"event_type\":\"' || event_type || '\"}' AS merged FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, '{\"span\":{\"a\":[1,2]},\"flow_id\":\"f\",\"event_type\":\"' || event_type || '\"}' FROM events WHERE event_id % 3 <> 0")
def f12(spark, sf_dir):
    flow = F.when(F.col("event_id") % 3 == 0, '"flow_id":"own",').when(F.col("event_id") % 3 == 1, '"flow_id":"",').otherwise("")
    text = F.concat(F.lit('{"metadata":{'), flow, F.lit('"span":{"a":[1, 2]}}}'))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.to_json(ingest.enrich(text, {"flow_id": F.lit("f"), "event_type": F.col("event_type")})).alias("merged"))


@query("P22_owner", _ITEMS + "SELECT event_id, CASE WHEN NOT broken AND NOT nameless THEN 'user' END AS owner_name, CASE WHEN NOT broken AND NOT nameless THEN 'u' || user_id END AS owner_value FROM w")
def p22(spark, sf_dir):
    rows = items_of(spark, sf_dir).select("event_id", ingest.owner(F.col("text"), "PATH", "user", "user").alias("o"))
    return rows.select("event_id", F.col("o.name").alias("owner_name"), F.col("o.value").alias("owner_value"))


_U = "00000000-0000-0000-0000-000000000001"
_HEADERS = [f"CONSUMER_SUBSCRIPTION_ID={_U}", f" CONSUMER_SUBSCRIPTION_ID = {_U} ", "CONSUMER_SUBSCRIPTION_ID", "OTHER=1", f"CONSUMER_SUBSCRIPTION_ID={_U},CONSUMER_SUBSCRIPTION_ID={_U}", "CONSUMER_SUBSCRIPTION_ID=x"]


@query("P23_consumer_tags", f"WITH v(n, tag, error) AS (VALUES (0, '{_U}', NULL), (1, '{_U}', NULL), (2, NULL, 'ILL_FORMED'), (3, NULL, 'UNKNOWN_TAG'), (4, NULL, 'REPEATED_TAG'), (5, NULL, 'NOT_A_UUID')) SELECT * FROM v")
def p23(spark, sf_dir):
    tags, error = ingest.consumer_tags(F.col("h"))
    return spark.createDataFrame(list(enumerate(_HEADERS)), "n int, h string").select("n", tags[ingest.TAG].alias("tag"), error.alias("error"))


@query("P24_blacklist", "WITH x AS (SELECT 1) SELECT event_id FROM events WHERE NOT (event_type = 'click' AND user_id % 4 = 1 OR event_type = 'view' AND user_id % 4 = 2)")
def p24(spark, sf_dir):
    listed = spark.createDataFrame([("click", 1), ("view", 2)], "event_type string, app long")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("app", F.col("user_id") % 4)
    return ingest.not_blocked(rows, listed, ["event_type", "app"]).select("event_id")


@query("P26_binary_status", "WITH r AS (SELECT event_id // 20 AS batch_id, CASE WHEN event_id % 211 = 0 THEN 'FAILED' WHEN event_id % 61 = 0 THEN 'ABORTED' ELSE 'SUBMITTED' END AS status FROM events) SELECT batch_id, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' WHEN bool_or(status = 'ABORTED') THEN 'ABORTED' ELSE 'SUBMITTED' END AS status FROM r GROUP BY 1")
def p26(spark, sf_dir):
    e = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(e / 20).alias("batch_id"), F.when(e % 211 == 0, "FAILED").when(e % 61 == 0, "ABORTED").otherwise("SUBMITTED").alias("status"))
    return ingest.batch_status(rows)


@query("P27_generated_metadata")
def p27(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'")
    return rows.select("event_id", F.uuid().alias("eid"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"))


@query("P25_internal_checks", "SELECT partition, count(*) AS n, count(DISTINCT key) AS keys FROM log GROUP BY 1")
def p25(spark, sf_dir):
    key = F.col("user_id").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(scalars.partition_of([key], 8).alias("partition"), key.alias("key"))
    return rows.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))
