"""Every query that SQL expresses, against DuckDB on the same tables, and small cases of the operators."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.operators import assignment, batching, evolution, ingest, positions, schemas
from tidelog.plans import catalog
from tidelog.sources import log as logs

DIR = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return "nan" if math.isnan(value) else repr(round(float(value), 6))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return str(sorted((k, plain(v)) for k, v in value.items()))
    return str([plain(v) for v in value]) if isinstance(value, list | tuple) else repr(value)


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for path in DIR.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DIR))
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted(tuple(plain(row[k]) for k in order) for row in result.fetchall())


@pytest.mark.parametrize("items, weights, parts", [(5, [2, 3], [2, 3]), (10, [1, 1, 2], [3, 3, 4]), (8, [1, 3], [2, 6])])
def test_split_by_weight(items, weights, parts):
    assert assignment.split_by_weight(items, weights) == parts


@pytest.mark.parametrize("times, sizes, rest", [([1, 4, 8, 9, 15, 15, 21, 40], [2, 2, 2, 1, 1], []), ([3, 7, 4, 3, 5, 8, 2], [], [7]), ([0, 6, 6, 6], [1], [3]), ([], [], [])])
def test_span_fold(times, sizes, rest):
    assert batching.span_fold(times, 6) == sizes
    assert batching.span_fold(times, 6, drain=True) == sizes + rest


def test_span_batches_equal_the_fold(spark):
    log = logs.load(spark, str(DIR)).select("partition", "offset", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    times = {}
    for r in log.orderBy("partition", "offset").collect():
        times.setdefault(r.partition, []).append(r.t)
    found = {}
    for r in catalog.QUERIES["B03_time_span_batch"](spark, str(DIR)).orderBy("partition", "batch_no").collect():
        assert (r.batch_no, r.first_offset) == (len(found.get(r.partition, [])), sum(found.get(r.partition, []))) and r.last_offset == r.first_offset + r.n - 1
        found.setdefault(r.partition, []).append(r.n)
    assert found == {p: batching.span_fold(t, 3600.0, drain=True) for p, t in times.items()}


def test_window_cap_holds_for_the_whole_stream(spark):
    log = spark.createDataFrame([(p, o, 10 * o + p) for p in (0, 1, 2) for o in range(20)], "partition int, offset long, ts int")
    committed = spark.createDataFrame([(0, -1), (1, 4), (2, 30)], "partition int, committed long")
    got = batching.within_window(log, committed, 10, ["ts"], uncommitted=3).collect()
    assert sorted((r.partition, r.offset) for r in got) == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 5)]
    assert batching.within_window(log, committed, 10, ["ts"], uncommitted=12).count() == 0


def test_running_maximum_over_buckets(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    rows = spark.createDataFrame([("g", k, v) for k, v in enumerate(values)] + [("h", 0, 7)], "g string, seq long, v long")
    for width in (1, 3, 100):
        got = {(r.g, r.seq): r.m for r in positions.running_max_before(rows, ["g"], "seq", F.floor(F.col("seq") / width), "v", "m").collect()}
        assert got == {("g", k): max(values[:k], default=None) for k in range(len(values))} | {("h", 0): None}


def test_schema_diff_of_odd_schemas(spark):
    pairs = [
        (1, "{}", "{}"), (2, '{"properties":{"a":{"$ref":"#"}}}', '{"properties":{"a":{"$ref":"#"}},"title":"x"}'), (3, '{"type":"integer"}', '{"type":"number"}'),
        (4, '{"properties":{"a.b":{"type":"string"},"":{}}}', '{"properties":{"a.b":{"type":"null"},"":{}}}'),
    ]
    got = schemas.diff(spark.createDataFrame(pairs, "n int, old_schema string, new_schema string"), "n").collect()
    assert sorted((r.n, r.path, r.change) for r in got) == [(2, "#/", "TITLE_CHANGED"), (2, "#/properties/a/$ref", "TITLE_CHANGED"), (4, "#/properties/a.b", "TYPE_CHANGED")]


def test_change_levels_depend_on_the_mode(spark):
    old = spark.createDataFrame([(1, "#/a", "any", "x"), (2, "#/a", "any", "x"), (3, "#/a", "any", "x"), (3, "#/b", "string", None)], "schema_id int, path string, type string, description string")
    new = spark.createDataFrame([(1, "#/a", "string", "x"), (2, "#/a", "string", "x"), (3, "#/a", "any", "y"), (3, "#/b", "string", None)], old.schema)
    modes = spark.createDataFrame([(1, "FORWARD"), (2, "COMPATIBLE"), (3, "COMPATIBLE"), (4, "NONE")], "schema_id int, mode string")
    found = {r.schema_id: (r.level, r.n_changes, r.allowed) for r in evolution.judge(evolution.diff(old, new), modes).collect()}
    assert found == {1: ("MINOR", 1, True), 2: ("MAJOR", 1, False), 3: ("PATCH", 1, True), 4: ("NO_CHANGES", 0, True)}


def test_version_bump(spark):
    rows = spark.createDataFrame([("1.2.3", "MAJOR"), ("1.2.3", "MINOR"), ("1.2.3", "PATCH"), ("1.2.3", "NO_CHANGES")], "v string, l string")
    assert [r[0] for r in rows.select(evolution.bump(F.col("v"), F.col("l"))).collect()] == ["2.0.0", "1.3.0", "1.2.4", "1.2.3"]


def test_schema_messages_and_that_a_text_is_parsed_once(spark):
    schema = {
        "type": "object", "required": ["a", "z"], "additionalProperties": False,
        "properties": {"a": {"type": "integer", "maximum": 5, "enum": [1, 9]}, "b": {"type": ["string", "null"], "pattern": "^x", "minLength": 2}, "c": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "d": {"type": "array", "items": {"type": "integer"}, "maxItems": 1}},
    }
    texts = ['{"a":1,"z":0}', '{"a":9,"b":"y","c":3,"d":[1,"x"]}', "[1]", "{", None, '{"a":1,"z":null,"b":null}']
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", ingest.violations(schema, F.col("t")).alias("v"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("parse") == 1
    assert {r.n: r.v for r in rows.collect()} == {
        0: "#: extraneous key", 1: "#: required key [z] not found\n#/a: breaks maximum 5\n#/b: doesn't match ^x\n#/b: breaks minLength 2\n#/c: breaks anyOf\n#/d: an item has the wrong type\n#/d: breaks maxItems 1",
        2: "#: expected type object", 3: "not strict JSON", 4: "not strict JSON", 5: "#: extraneous key",
    }


def test_publish_works_out_failures_once(spark):
    marked = F.sha2(F.col("text"), 256).startswith("0")
    items = spark.createDataFrame([(b, k, f"{b} {k}") for b in range(9) for k in range(20)], "batch_id long, idx int, text string")
    got = ingest.publish(items, marked, F.lit("VALIDATING"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    bad = {(r.batch_id, r.idx) for r in items.where(marked).collect()}
    first = {b: min(k for c, k in bad if c == b) for b in {b for b, _ in bad}}
    for r in got.collect():
        at = first.get(r.batch_id)
        assert (r.status, r.step) == (("SUBMITTED", "PUBLISHING") if at is None else ("FAILED" if r.idx == at else "ABORTED", "VALIDATING" if r.idx <= at else "NONE"))
