"""Queries of schema evolution and the catalog (R). Orders stand for properties of the schema of their customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evolution, schemas
from .base import query

_NODES = """
WITH o AS (SELECT o_custkey AS schema_id, '#/properties/f' || CAST(o_orderkey % 7 AS VARCHAR) AS path, o_orderkey AS k, o_orderpriority AS d, CASE o_orderstatus WHEN 'F' THEN 'any' WHEN 'O' THEN 'integer' ELSE 'string' END AS t FROM orders),
old AS (SELECT schema_id, path, min(t) AS type, min(d) AS description FROM o WHERE k % 3 > 0 GROUP BY ALL),
new AS (SELECT schema_id, path, min(CASE WHEN k % 11 = 0 THEN 'number' ELSE t END) AS type, min(d) AS description FROM o WHERE k % 5 > 0 GROUP BY ALL),
j AS (SELECT schema_id, path, old.type AS was, new.type AS "is", old.description AS said, new.description AS says FROM old FULL JOIN new USING (schema_id, path)),
ch AS (SELECT schema_id, path, CASE WHEN was IS NULL THEN 'PROPERTIES_ADDED' WHEN "is" IS NULL THEN 'PROPERTY_REMOVED' WHEN was = 'any' THEN 'TYPE_NARROWED' ELSE 'TYPE_CHANGED' END AS change FROM j WHERE was IS DISTINCT FROM "is"
       UNION ALL SELECT schema_id, path, 'DESCRIPTION_CHANGED' FROM j WHERE was IS NOT NULL AND "is" IS NOT NULL AND said <> says),
modes AS (SELECT DISTINCT schema_id, CASE schema_id % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'FORWARD' ELSE 'COMPATIBLE' END AS mode FROM o),
lv AS (SELECT ch.*, mode, CASE WHEN change IN ('PROPERTY_REMOVED', 'TYPE_CHANGED') THEN 0 WHEN change = 'TYPE_NARROWED' THEN CASE mode WHEN 'COMPATIBLE' THEN 0 ELSE 1 END WHEN change = 'PROPERTIES_ADDED' THEN 1 ELSE 2 END AS r FROM ch JOIN modes USING (schema_id)),
w AS (SELECT schema_id, min(r) AS r, count(*) AS n FROM lv GROUP BY 1),
v AS (SELECT schema_id, mode, CASE r WHEN 0 THEN 'MAJOR' WHEN 1 THEN 'MINOR' WHEN 2 THEN 'PATCH' ELSE 'NO_CHANGES' END AS level, coalesce(n, 0) AS n_changes, NOT (mode <> 'NONE' AND coalesce(r = 0, false)) AS allowed FROM modes LEFT JOIN w USING (schema_id))
"""


def _orders(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "any").when(F.col("o_orderstatus") == "O", "integer").otherwise("string")
    path = F.concat(F.lit("#/properties/f"), (F.col("o_orderkey") % 7).cast("string"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("schema_id"), path.alias("path"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("d"), kind.alias("t"))


def _nodes(rows):
    return rows.groupBy("schema_id", "path").agg(F.min("t").alias("type"), F.min("d").alias("description"))


def _old(spark, sf_dir):
    return _nodes(_orders(spark, sf_dir).where("k % 3 > 0"))


def _new(spark, sf_dir):
    return _nodes(_orders(spark, sf_dir).where("k % 5 > 0").withColumn("t", F.when(F.col("k") % 11 == 0, "number").otherwise(F.col("t"))))


def _changes(spark, sf_dir):
    return evolution.diff(_old(spark, sf_dir), _new(spark, sf_dir))


def _modes(spark, sf_dir):
    mode = F.element_at(F.array(*map(F.lit, ("NONE", "FORWARD", "COMPATIBLE"))), (F.col("schema_id") % 3 + 1).cast("int"))
    return _orders(spark, sf_dir).select("schema_id").distinct().withColumn("mode", mode)


def _verdicts(spark, sf_dir):
    return evolution.judge(_changes(spark, sf_dir), _modes(spark, sf_dir))


@query("R02b_flat_diff", _NODES + "SELECT * FROM ch")
def r02(spark, sf_dir):
    return _changes(spark, sf_dir)


@query("R03_change_levels", _NODES + "SELECT schema_id, path, change, CASE r WHEN 0 THEN 'MAJOR' WHEN 1 THEN 'MINOR' ELSE 'PATCH' END AS level FROM lv")
def r03(spark, sf_dir):
    named = _changes(spark, sf_dir).join(_modes(spark, sf_dir), "schema_id")
    return named.join(F.broadcast(evolution.levels(spark)), ["change", "mode"]).select("schema_id", "path", "change", "level")


@query("R04_overall_level", _NODES + "SELECT schema_id, level, n_changes FROM v")
def r04(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("schema_id", "level", "n_changes")


@query("R05_version_bump", _NODES + "SELECT schema_id, CASE level WHEN 'MAJOR' THEN '2.0.0' WHEN 'MINOR' THEN '1.' || (schema_id % 4 + 1) || '.0' WHEN 'PATCH' THEN '1.' || (schema_id % 4) || '.4' ELSE '1.' || (schema_id % 4) || '.3' END AS version FROM v")
def r05(spark, sf_dir):
    before = F.concat(F.lit("1."), (F.col("schema_id") % 4).cast("string"), F.lit(".3"))
    return _verdicts(spark, sf_dir).select("schema_id", evolution.bump(before, F.col("level")).alias("version"))


@query("R06_compatibility_verdict", _NODES + "SELECT schema_id, mode, allowed FROM v")
def r06(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("schema_id", "mode", "allowed")


@query("R06b_mode_migration", _NODES + "SELECT schema_id, string_agg(change, ',' ORDER BY change) AS forbidden FROM (SELECT DISTINCT schema_id, change FROM ch WHERE change IN ('PROPERTY_REMOVED', 'TYPE_CHANGED', 'TYPE_NARROWED')) GROUP BY 1")
def r06b(spark, sf_dir):
    return evolution.migration_errors(_changes(spark, sf_dir))


@query("R12_version_by_content", _NODES + "SELECT content, min(schema_id) AS first_schema, count(*) AS n FROM (SELECT schema_id, md5(string_agg(path || ':' || type, '|' ORDER BY path || ':' || type)) AS content FROM old GROUP BY 1) GROUP BY 1")
def r12(spark, sf_dir):
    keyed = evolution.content_key(_old(spark, sf_dir))
    return keyed.groupBy("content").agg(F.min("schema_id").alias("first_schema"), F.count(F.lit(1)).alias("n"))


@query("R15_annotation_keys", "WITH k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'example.org/' || replace(p_brand, '#', '_') WHEN 1 THEN p_brand WHEN 2 THEN 'Bad Prefix/x' ELSE repeat('a', 62 + p_partkey % 5) END AS key FROM part) SELECT p_partkey, key, regexp_matches(key, '^([-.a-z0-9]+/)?[A-Za-z0-9]([A-Za-z0-9_.-]*[A-Za-z0-9])?$') AND length(split_part('/' || key, '/', -1)) <= 63 AS valid FROM k")
def r15(spark, sf_dir):
    n = F.col("p_partkey") % 4
    long = F.repeat(F.lit("a"), (62 + F.col("p_partkey") % 5).cast("int"))
    key = F.when(n == 0, F.concat(F.lit("example.org/"), F.replace("p_brand", F.lit("#"), F.lit("_")))).when(n == 1, F.col("p_brand")).when(n == 2, "Bad Prefix/x").otherwise(long)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", key.alias("key")).withColumn("valid", evolution.valid_key(F.col("key")))


_SUBS = "WITH s AS (SELECT o_orderkey, 'app' || CAST(o_custkey % 10 AS VARCHAR) AS app, o_orderpriority AS grp, CASE WHEN o_orderkey % 2 = 0 THEN ['a', 'b'] ELSE ['b', 'a'] END AS ets FROM orders) "


def _subscriptions(spark, sf_dir):
    types = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("app"), (F.col("o_custkey") % 10).cast("string")).alias("app"), F.col("o_orderpriority").alias("grp"), types.alias("ets"))


@query("R17_subscription_dedup", _SUBS + "SELECT md5(app || grp || array_to_string(list_sort(ets), '')) AS hash, min(o_orderkey) AS first_order, count(*) AS n FROM s GROUP BY 1")
def r17(spark, sf_dir):
    keyed = _subscriptions(spark, sf_dir).withColumn("hash", evolution.subscription_key(F.col("app"), F.col("grp"), F.col("ets")))
    return keyed.groupBy("hash").agg(F.min("o_orderkey").alias("first_order"), F.count(F.lit(1)).alias("n"))


@query("R18_subscription_checks", "WITH x AS (SELECT 1) SELECT o_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS partitions, sum(l_linenumber) > 10 AS too_many, bool_or(p_partkey IS NULL) AS missing_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5 GROUP BY 1")
def r18(spark, sf_dir):
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    types = table("part").where("p_size > 5").select("p_partkey")
    asked = table("orders").join(table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return asked.join(types, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("o_orderkey").agg(
        F.sum("l_linenumber").cast("long").alias("partitions"), (F.sum("l_linenumber") > 10).alias("too_many"), F.bool_or(F.col("p_partkey").isNull()).alias("missing_type")
    )


#: Pairs of schemas, and how they differ: path and change, by lines.
_PAIRS = (
    ('{"id":"a","title":"t","description":"d"}', '{"id":"b","title":"u","description":"e"}', "#/ ID_CHANGED,#/ TITLE_CHANGED,#/ DESCRIPTION_CHANGED"),
    ('{"type":"object"}', '{"type":"string"}', "#/ TYPE_CHANGED"),
    ('{"properties":{"x":{}}}', '{"properties":{"x":{"type":"integer"}}}', "#/properties/x TYPE_NARROWED"),
    ('{"properties":{"x":{"type":"string","maxLength":5}}}', '{"properties":{"x":{"type":"string","maxLength":6,"minLength":1},"y":{"type":"null"}}}', "#/properties/x/maxLength ATTRIBUTE_VALUE_CHANGED,#/properties PROPERTIES_ADDED"),
    ('{"properties":{"x":{"type":"integer"},"y":{"enum":[1,2]}}}', '{"properties":{"y":{"enum":[2,3]}}}', "#/properties/x PROPERTY_REMOVED,#/properties/y/enum ENUM_ARRAY_CHANGED"),
    ('{"properties":{"y":{"enum":[1,"a"]}}}', '{"properties":{"y":{"enum":["a",1]}}}', ""),
    ('{"type":["string","null"]}', '{"type":["string","null","number"]}', "#/ SUB_SCHEMA_CHANGED"),
    ('{"oneOf":[{"type":"number","minimum":1},{"type":"null"}]}', '{"oneOf":[{"type":"number","minimum":2},{"type":"null"}]}', "#/oneOf/0/minimum ATTRIBUTE_VALUE_CHANGED"),
    ('{"allOf":[{"type":"null"}]}', '{"oneOf":[{"type":"null"}]}', "#/ COMPOSITION_METHOD_CHANGED"),
    ('{"type":"array","items":{"type":"object","properties":{"z":{"type":"string"}}},"minItems":1}', '{"type":"array","items":{"type":"object","properties":{"z":{"type":"boolean"}}},"minItems":2}', "#/items/properties/z TYPE_CHANGED,#/minItems ATTRIBUTE_VALUE_CHANGED"),
    ('{"type":"array","items":[{"type":"null"},{"type":"string"}]}', '{"type":"array","items":[{"type":"null"}]}', "#/ NUMBER_OF_ITEMS_CHANGED"),
    ('{"type":"array","items":[{"type":"null"},{"type":"string"}]}', '{"type":"array","items":[{"type":"null"},{"type":"array"}],"additionalItems":false}', "#/items/1 TYPE_CHANGED,#/additionalItems ADDITIONAL_ITEMS_CHANGED"),
    ('{"type":"array","items":{"type":"null"},"uniqueItems":true}', '{"type":"array","items":[]}', "#/items SCHEMA_REMOVED,#/uniqueItems ATTRIBUTE_VALUE_CHANGED"),
    ('{"type":"object","additionalProperties":true}', '{"type":"object","additionalProperties":{"type":"string"}}', "#/additionalProperties ADDITIONAL_PROPERTIES_NARROWED"),
    ('{"type":"object","additionalProperties":{"type":"string"}}', '{"type":"object","additionalProperties":false,"maxProperties":3}', "#/additionalProperties ADDITIONAL_PROPERTIES_CHANGED,#/maxProperties ATTRIBUTE_VALUE_CHANGED"),
    ('{"required":["a","b"]}', '{"required":["b","a","c"]}', "#/required REQUIRED_ARRAY_EXTENDED"),
    ('{"required":["a","b"]}', '{"required":["a"]}', "#/required REQUIRED_ARRAY_CHANGED"),
    ('{"dependencies":{"a":["b","c"],"d":{"type":"string"}}}', '{"dependencies":{"a":["c"],"d":{"type":"number"}}}', "#/dependencies/a DEPENDENCY_ARRAY_CHANGED,#/dependencies/d TYPE_CHANGED"),
    ('{"dependencies":{"a":["b"],"d":{"type":"string"}}}', '{"dependencies":{"a":["b"],"e":{"type":"string"}}}', "#/dependencies DEPENDENCY_SCHEMA_CHANGED"),
    ('{"definitions":{"n":{"properties":{"next":{"$ref":"#/definitions/n"},"v":{"type":"string"}}}},"properties":{"head":{"$ref":"#/definitions/n"}}}', '{"definitions":{"n":{"properties":{"next":{"$ref":"#/definitions/n"},"v":{"type":"number"}}}},"properties":{"head":{"$ref":"#/definitions/n"}}}', "#/properties/head/$ref/properties/v TYPE_CHANGED"),
    ('{"properties":{"a":{"properties":{"b":{"properties":{"c":{"properties":{"d":{"title":"x"}}}}}}}}}', '{"properties":{"a":{"properties":{"b":{"properties":{"c":{"properties":{"d":{"title":"y"}}}}}}}}}', "#/properties/a/properties/b/properties/c/properties/d TITLE_CHANGED"),
    ('{"type":"string","pattern":"^a"}', '{"type":"string","pattern":"^b"}', "#/pattern ATTRIBUTE_VALUE_CHANGED"),
)
_EXPECTED = "WITH d(n, path, change) AS (VALUES {}),\np AS (SELECT o_orderkey, o_orderkey % {} AS n FROM orders), ch AS (SELECT o_orderkey, path, change FROM p JOIN d USING (n))\n".format(
    ", ".join(f"({k}, '{x.split(' ')[0]}', '{x.split(' ')[1]}')" for k, (_, _, found) in enumerate(_PAIRS) for x in found.split(",") if x), len(_PAIRS)
)
_LEVEL_OF = "CASE change {} END".format(" ".join(f"WHEN '{c}' THEN CASE mode WHEN 'COMPATIBLE' THEN {('MAJOR', 'MINOR', 'PATCH').index(y)} ELSE {('MAJOR', 'MINOR', 'PATCH').index(x)} END" for c, x, y in evolution.LEVELS))


def _schema_changes(spark, sf_dir):
    pick = lambda side: F.element_at(F.array(*[F.lit(p[side]) for p in _PAIRS]), (F.col("n") + 1).cast("int"))
    # as many pairs as there are: each order has one of them
    changes = schemas.diff(spark.range(len(_PAIRS)).toDF("n").select("n", pick(0).alias("old_schema"), pick(1).alias("new_schema")), "n")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % len(_PAIRS)).alias("n"))
    return orders.join(changes, "n").select("o_orderkey", "path", "change")


@query("R02_structural_diff", _EXPECTED + "SELECT * FROM ch")
def r02_schemas(spark, sf_dir):
    return _schema_changes(spark, sf_dir)


@query(
    "R13_compatibility_check",
    _EXPECTED + f""", m AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'FORWARD' ELSE 'COMPATIBLE' END AS mode FROM orders),
w AS (SELECT o_orderkey, min({_LEVEL_OF}) AS r FROM ch JOIN m USING (o_orderkey) GROUP BY 1)
SELECT o_orderkey, mode, NOT (mode <> 'NONE' AND coalesce(r = 0, false)) AS compatible, CASE r WHEN 0 THEN '3.0.0' WHEN 1 THEN '2.5.0' WHEN 2 THEN '2.4.2' ELSE '2.4.1' END AS next_version FROM m LEFT JOIN w USING (o_orderkey)""",
)
def r13(spark, sf_dir):
    mode = F.element_at(F.array(*map(F.lit, ("NONE", "FORWARD", "COMPATIBLE"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    modes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("schema_id"), mode.alias("mode"))
    verdicts = evolution.judge(_schema_changes(spark, sf_dir).withColumnRenamed("o_orderkey", "schema_id"), modes)
    return verdicts.select(F.col("schema_id").alias("o_orderkey"), "mode", F.col("allowed").alias("compatible"), evolution.bump(F.lit("2.4.1"), F.col("level")).alias("next_version"))


@query("R07_type_evolution", "WITH t AS (SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'JSON' ELSE 'AVRO' END AS was, CASE o_orderkey // 2 % 2 WHEN 0 THEN 'JSON' ELSE 'AVRO' END AS becomes, o_orderkey // 4 % 2 = 0 AS same FROM orders) SELECT o_orderkey, CASE WHEN was = 'AVRO' AND becomes = 'JSON' THEN 'FORBIDDEN' WHEN was = 'JSON' AND becomes = 'AVRO' THEN 'MAJOR' WHEN was = 'AVRO' THEN CASE WHEN same THEN 'NO_CHANGES' ELSE 'MAJOR' END END AS level FROM t")
def r07(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = lambda odd: F.when(odd == 0, "JSON").otherwise("AVRO")
    level = evolution.type_level(kind(k % 2), kind(F.floor(k / 2) % 2), F.floor(k / 4) % 2 == 0)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", level.alias("level"))


def _pick(values: tuple, place):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def _pick_sql(values: tuple, place: str) -> str:
    return f"list_extract([{', '.join('NULL' if v is None else repr(v) for v in values)}], CAST(({place}) % {len(values)} AS INTEGER) + 1)"


_MODES, _CATEGORIES, _STRATEGIES = ("NONE", "FORWARD", "COMPATIBLE"), ("DATA", "DATA", "BUSINESS"), ("random", "hash", "user_defined")


@query(
    "R09_evolution_constraints",
    f"""WITH u AS (SELECT l_orderkey, l_linenumber, {_pick_sql(_CATEGORIES, 'l_partkey')} AS c0, {_pick_sql(_CATEGORIES, 'l_suppkey')} AS c1, {_pick_sql(_MODES, 'l_orderkey')} AS m0, {_pick_sql(_MODES, 'l_partkey // 3')} AS m1,
{_pick_sql(_STRATEGIES, 'l_linenumber')} AS s0, {_pick_sql(_STRATEGIES, 'l_orderkey // 3')} AS s1, l_partkey % 2 AS n_keys, l_suppkey % 4 > 0 AS same, l_orderkey % 7 = 0 AS admin, l_orderkey % 5 = 0 AS type_admin FROM lineitem),
e AS (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN c0 <> c1 THEN 'CATEGORY_CHANGED' END, CASE WHEN NOT (m0 = m1 OR m0 = 'FORWARD' AND m1 = 'COMPATIBLE' OR m0 = 'NONE' AND m1 = 'FORWARD') AND NOT admin AND NOT type_admin THEN 'MODE_CHANGED' END,
CASE WHEN s0 <> 'random' AND s0 <> s1 AND NOT admin THEN 'STRATEGY_CHANGED' END, CASE WHEN s1 = 'hash' AND n_keys = 0 THEN 'KEYS_MISSING' END, CASE WHEN NOT same THEN 'ENRICHMENT_CHANGED' END]) AS error FROM u)
SELECT l_orderkey, l_linenumber, error FROM e WHERE error IS NOT NULL""",
)
def r09(spark, sf_dir):
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    keys = F.when(p % 2 == 1, F.array(F.lit("id"))).otherwise(F.array().cast("array<string>"))
    enrichment = F.array(F.lit("metadata_enrichment"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", _pick(_CATEGORIES, p).alias("old_category"), _pick(_CATEGORIES, s).alias("new_category"), _pick(_MODES, o).alias("old_mode"), _pick(_MODES, F.floor(p / 3)).alias("new_mode"),
        _pick(_STRATEGIES, n).alias("old_strategy"), _pick(_STRATEGIES, F.floor(o / 3)).alias("new_strategy"), keys.alias("new_keys"), enrichment.alias("old_enrichment"),
        F.when(s % 4 > 0, enrichment).otherwise(F.array().cast("array<string>")).alias("new_enrichment"), (o % 7 == 0).alias("admin"), (o % 5 == 0).alias("type_admin"),
    )
    return rows.select("l_orderkey", "l_linenumber", F.explode(evolution.constraint_errors(F.col("admin"), F.col("type_admin"))).alias("error"))


_POLICIES, _AUDIENCES = ("DELETE", "COMPACT", "COMPACT_AND_DELETE"), (None, "internal", "public")


@query(
    "R14_catalog_constraints",
    f"""WITH u AS (SELECT l_orderkey, l_linenumber, {_pick_sql(_POLICIES, 'l_partkey')} AS p0, {_pick_sql(_POLICIES, 'l_suppkey')} AS p1, {_pick_sql(('UNDEFINED', 'DATA', 'BUSINESS'), 'l_orderkey')} AS c, l_partkey % 4 AS t0, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 4 END AS t1,
{_pick_sql(_AUDIENCES, 'l_linenumber')} AS a0, {_pick_sql(_AUDIENCES, 'l_orderkey // 3')} AS a1, CAST(l_quantity AS BIGINT) * 100 AS r FROM lineitem),
e AS (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN c = 'UNDEFINED' AND p1 <> 'DELETE' THEN 'COMPACTION_OF_UNDEFINED' END, CASE WHEN p0 <> p1 AND NOT (p0 = 'DELETE' AND p1 = 'COMPACT_AND_DELETE') THEN 'POLICY_CHANGED' END,
CASE WHEN t1 IS NOT NULL AND t0 <> t1 THEN 'STATISTIC_CHANGED' END, CASE WHEN a0 IS NOT NULL AND a1 IS NULL THEN 'AUDIENCE_REMOVED' END, CASE WHEN r > 4500 THEN 'RETENTION_TOO_LONG' END, CASE WHEN r < 500 THEN 'RETENTION_TOO_SHORT' END]) AS error FROM u)
SELECT l_orderkey, l_linenumber, error FROM e WHERE error IS NOT NULL""",
)
def r14(spark, sf_dir):
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", _pick(_POLICIES, p).alias("old_policy"), _pick(_POLICIES, s).alias("new_policy"), _pick(("UNDEFINED", "DATA", "BUSINESS"), o).alias("category"),
        (p % 4).alias("old_statistic"), F.when(s % 5 > 0, s % 4).alias("new_statistic"), _pick(_AUDIENCES, n).alias("old_audience"), _pick(_AUDIENCES, F.floor(o / 3)).alias("new_audience"),
        (F.col("l_quantity").cast("long") * 100).alias("retention"),
    )
    return rows.select("l_orderkey", "l_linenumber", F.explode(evolution.catalog_errors(500, 4500)).alias("error"))
