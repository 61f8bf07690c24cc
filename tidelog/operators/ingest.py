"""The ingest pipeline: parse, validate, partition, key, enrich, and the outcome of batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def parse(text: Column) -> Column:
    """A JSON text as a variant; null if it isn't strict JSON (duplicate keys, trailing commas and control characters are refused)."""
    return F.try_parse_json(text)


_STRING = r'"(?:[^"\\]|\\[\s\S])*"'


def is_strict(text: Column, allow_more: bool = False) -> Column:
    """Whether a text is one strict JSON object with nothing behind it, or with anything behind it if ``allow_more``.

    Refused: control characters in strings, trailing commas, repeated keys, whole numbers beyond 64 bits and infinite ones.
    Allowed beyond plain JSON: leading zeros, a number that ends in its point, and the escape of a single quote.
    """
    plain = F.regexp_replace(text, rf"({_STRING})|(?<![0-9.])0+(?=[0-9])", "$1")
    plain = F.regexp_replace(plain, r"(?<=[0-9])\.(?=[eE,}\]\s]|$)", ".0")
    plain = F.regexp_replace(plain, r"(?<!\\)((?:\\\\)*)\\'", "$1'")
    bare = F.regexp_replace(text, _STRING, '""')
    whole = F.regexp_extract_all(bare, F.lit(r"(?<![0-9.eE+-])(-?[0-9]+)(?![0-9.eE+-])"), F.lit(1))
    broken = F.regexp_extract_all(bare, F.lit(r"(?<![0-9.eE+-])(-?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)(?![0-9.eE+-])"), F.lit(1))
    in_range = ~F.exists(whole, lambda n: n.try_cast("bigint").isNull()) & ~F.exists(broken, lambda n: F.abs(n.try_cast("double")) == F.lit(float("inf")))
    parses = F.try_parse_json(plain).isNotNull()
    if not allow_more:  # what follows the object would break one of these
        parses = parses & F.try_parse_json(F.concat(F.lit("["), plain, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), plain, F.lit("}"))).isNotNull()
    return F.coalesce(text.rlike(r"^\s*\{") & parses & in_range, F.lit(False))


_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def compile_schema(schema: dict, value: Column, path: str = "#", root: dict | None = None) -> Column:
    """An array of messages where ``value`` (a variant) breaks the schema, with nulls where it doesn't.

    Keywords: type, required, properties, additionalProperties (false), enum, pattern, minLength, maxLength, minimum, maximum,
    items (by type), minItems, maxItems, anyOf, allOf, oneOf, and $ref to definitions that don't refer to themselves.
    """
    root = root or schema
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        return compile_schema(target, value, path, root)
    return _once(value, lambda v: _once(F.schema_of_variant(v), lambda kind: _messages(schema, v, kind, path, root)))


def _messages(schema: dict, value: Column, kind: Column, path: str, root: dict) -> Column:
    out: list[Column] = [F.array().cast("array<string>")]
    say = lambda broken, what: out.append(F.array(F.when(value.isNotNull() & F.coalesce(broken, F.lit(False)), F.lit(f"{path}: {what}"))))
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        say(~kind.rlike("|".join(_KINDS[k] for k in kinds)), f"expected type {'|'.join(kinds)}")
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    number = F.when(kind.rlike(_KINDS["number"]), F.try_variant_get(value, "$", "double"))
    if "enum" in schema:
        say(~F.to_json(value).isin([json.dumps(v) for v in schema["enum"]]), "not one of the values")
    if "pattern" in schema:
        say(~text.rlike(schema["pattern"]), f"doesn't match {schema['pattern']}")
    for word, broken in (("minLength", lambda n: F.length(text) < n), ("maxLength", lambda n: F.length(text) > n), ("minimum", lambda n: number < n), ("maximum", lambda n: number > n)):
        if word in schema:
            say(broken(schema[word]), f"breaks {word} {schema[word]}")
    for name in schema.get("required", []):
        say(kind.rlike("^OBJECT") & F.try_variant_get(value, f'$["{name}"]', "variant").isNull(), f"required key [{name}] not found")
    for name, own in schema.get("properties", {}).items():
        out.append(compile_schema(own, F.try_variant_get(value, f'$["{name}"]', "variant"), f"{path}/{name}", root))
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>")
        say(F.size(F.array_except(F.json_object_keys(F.to_json(value)), known)) > 0, "extraneous key")
    items = F.try_variant_get(value, "$", "array<variant>")
    if "items" in schema and "type" in schema["items"]:
        wanted = _KINDS[schema["items"]["type"]]
        say(F.exists(items, lambda x: ~F.schema_of_variant(x).rlike(wanted)), "an item has the wrong type")
    for word, broken in (("minItems", lambda n: F.size(items) < n), ("maxItems", lambda n: F.size(items) > n)):
        if word in schema:
            say(kind.rlike("^ARRAY") & broken(schema[word]), f"breaks {word} {schema[word]}")
    for word in ("anyOf", "allOf", "oneOf"):
        if word in schema:
            fits = sum(F.when(F.size(F.array_compact(compile_schema(s, value, path, root))) == 0, 1).otherwise(0) for s in schema[word])
            need = {"anyOf": fits < 1, "allOf": fits < len(schema[word]), "oneOf": fits != 1}[word]
            say(need, f"breaks {word}")
    return F.flatten(F.array(*out))


def violations(schema: dict, text: Column) -> Column:
    """All messages of a JSON text against a schema, one to a line; null if it is valid."""

    def said(value: Column) -> Column:
        found = F.array_compact(F.concat(F.array(F.when(value.isNull(), "not strict JSON")), compile_schema(schema, value)))
        return _once(found, lambda f: F.when(F.size(f) > 0, F.array_join(f, "\n")))

    return _once(parse(text), said)


def too_large(text: Column, most: int = 999_000) -> Column:
    """Whether an event has more than ``most`` bytes of UTF-8."""
    return F.octet_length(text) > most


def key_fields(text: Column, fields: Sequence[str], data_event: bool = False) -> list[Column]:
    """The partition key fields of an event; those of a data-change event lie below ``data``."""
    return [scalars.json_path(text, f"data.{f}" if data_event else f) for f in fields]


def record_key(keys: Sequence[Column], compacted: bool, text: Column) -> Column:
    """A record's key: the compaction key of a compacted type, else the key fields joined by commas, else null."""
    if compacted:
        return scalars.json_path(text, "metadata.partition_compaction_key")
    if not keys:
        return F.lit(None).cast("string")
    return F.when(F.coalesce(*keys).isNotNull(), F.concat_ws(",", *keys))


def user_partition(text: Column, names: Sequence[str]) -> tuple[Column, Column]:
    """The partition that an event asks for, and an error if there is none of that name."""
    asked = scalars.json_path(text, "metadata.partition")
    known = F.coalesce(asked.isin(*names), F.lit(False))
    return F.when(known, asked), F.when(~known, F.lit("UNKNOWN_PARTITION"))


def random_partition(count: int, seed: int) -> Column:
    """A partition at random."""
    return F.lit(0) if count == 1 else F.floor(F.rand(seed) * count).cast("int")


def planned_partitions(read: Column, write: Column, most: int, default: int) -> Column:
    """How many partitions the read and write parallelism ask for."""
    wanted = F.greatest(read, write)
    return F.when(wanted.isNull() | (wanted <= 0), F.lit(default)).otherwise(F.least(wanted, F.lit(most)))


def enrich(text: Column, fields: dict[str, Column]) -> Column:
    """The metadata of the event with ``fields`` set, as a map of variants, so arrays, objects and numbers stay what they are.

    Its flow_id stays if it has one.
    """
    old = F.coalesce(F.from_json(F.get_json_object(text, "$.metadata"), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    new = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("variant"))])
    has_flow = F.coalesce(F.try_variant_get(F.element_at(old, "flow_id"), "$", "string"), F.lit("")) != ""
    wanted = F.map_filter(new, lambda k, _: ~((k == "flow_id") & has_flow))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(wanted), k)), wanted)


def with_metadata(text: Column, metadata: Column) -> Column:
    """The event's text with its metadata replaced; insignificant white space goes, and keys come in no fixed order."""
    rest = F.to_json(F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, _: k != "metadata"))
    head = F.concat(F.lit('{"metadata":'), F.to_json(metadata))
    return F.when(rest == "{}", F.concat(head, F.lit("}"))).otherwise(F.concat(head, F.lit(","), F.substring(rest, F.lit(2), F.length(rest))))


def publish(items: DataFrame, failure: Column, step: Column) -> DataFrame:
    """Status and step of every item of (batch_id, idx): one failing item stops its batch.

    Only the first failing item of each batch is needed: a small aggregation, combined before the shuffle.
    """
    marked = items.withColumn("_step", F.when(failure, step))
    # no filter of rows: it would work out ``failure`` once more, below the projection
    failing = F.when(F.col("_step").isNotNull(), F.struct("idx", F.col("_step").alias("at")))
    first = marked.groupBy("batch_id").agg(F.min(failing).alias("f")).where("f is not null")
    joined = marked.join(first, "batch_id", "left")
    failed = F.col("f").isNotNull()
    status = F.when(~failed, "SUBMITTED").when(F.col("idx") == F.col("f.idx"), "FAILED").otherwise("ABORTED")
    reached = F.when(~failed, "PUBLISHING").when(F.col("idx") <= F.col("f.idx"), F.col("f.at")).otherwise("NONE")
    return joined.select(*items.columns, status.alias("status"), reached.alias("step"))


def batch_status(results: DataFrame) -> DataFrame:
    """Each batch's status: FAILED if any item failed, else ABORTED if any was, else SUBMITTED."""
    any_ = lambda s: F.bool_or(F.col("status") == s)
    return results.groupBy("batch_id").agg(F.when(any_("FAILED"), "FAILED").when(any_("ABORTED"), "ABORTED").otherwise("SUBMITTED").alias("status"))


def appended(results: DataFrame, lost: Column) -> DataFrame:
    """Results of :func:`publish` after the append: items that the log lost are FAILED at PUBLISHING."""
    return results.withColumn("status", F.when((F.col("step") == "PUBLISHING") & lost, "FAILED").otherwise(F.col("status")))


def publish_status(results: DataFrame) -> DataFrame:
    """Each batch's outcome by its items' status and step: FAILED if the log lost items, ABORTED if it was stopped before the log, else SUBMITTED."""
    lost = F.bool_or((F.col("status") == "FAILED") & (F.col("step") == "PUBLISHING"))
    stopped = F.bool_or(F.col("step") != "PUBLISHING")
    return results.groupBy("batch_id").agg(F.when(lost, "FAILED").when(stopped, "ABORTED").otherwise("SUBMITTED").alias("status"))


def response_code(status: Column) -> Column:
    """The HTTP code of a batch's outcome."""
    return F.when(status == "SUBMITTED", 200).when(status == "ABORTED", 422).otherwise(207)


def owner(text: Column, kind: str, name: str, value: str) -> Column:
    """Whose event it is: STATIC, or at a PATH of the event; null where the path leads nowhere."""
    found = F.lit(value) if kind == "STATIC" else scalars.json_path(text, value)
    return F.when(found.isNotNull(), F.struct(F.lit(name).alias("name"), found.alias("value")))


TAG = "CONSUMER_SUBSCRIPTION_ID"


def consumer_tags(header: Column) -> tuple[Column, Column]:
    """The tags of a header ``k=v,k=v`` as a map, and an error for unknown, repeated or ill-formed ones."""
    parts = F.transform(F.split(F.regexp_replace(header, r"\s", ""), ","), lambda p: F.split(p, "=", 2))
    names = F.transform(parts, lambda p: p[0])
    error = (
        F.when(F.exists(parts, lambda p: F.size(p) < 2), "ILL_FORMED").when(F.exists(names, lambda n: n != TAG), "UNKNOWN_TAG")
        .when(F.size(names) > F.size(F.array_distinct(names)), "REPEATED_TAG").when(F.exists(parts, lambda p: ~p[1].rlike(scalars.UUID)), "NOT_A_UUID")
    )
    return F.when(error.isNull(), F.map_from_arrays(names, F.transform(parts, lambda p: p[1]))), error


def not_blocked(rows: DataFrame, blacklist: DataFrame, on: list[str]) -> DataFrame:
    """Rows that no blacklist entry names."""
    return rows.join(F.broadcast(blacklist), on, "left_anti")


def check_fanout(items: DataFrame, bad: Column, step: str) -> DataFrame:
    """Results of one failed check: before the first bad record ABORTED at the step, it FAILED, after it ABORTED at NONE."""
    marked = items.withColumn("_bad", bad)
    first = marked.where("_bad").groupBy("batch_id").agg(F.min("idx").alias("_f"))
    joined = marked.join(first, "batch_id")
    at = F.when(F.col("idx") > F.col("_f"), "NONE").otherwise(step)
    return joined.select(*items.columns, F.when(F.col("idx") == F.col("_f"), "FAILED").otherwise("ABORTED").alias("status"), at.alias("step"))
