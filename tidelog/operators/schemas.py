"""Structural diff of JSON Schema texts, level by level: each node of a pair of schemas is a row, and each step
turns it into its own changes and into rows for the nodes below it. Nothing is exchanged between tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATE = ("path", "change", "old", "new", "seen")
#: Keywords that tell a schema without a type apart (fixed values).
_ARRAY_WORDS = ("items", "additionalItems", "minItems", "maxItems", "uniqueItems")
_OBJECT_WORDS = ("properties", "required", "minProperties", "maxProperties", "dependencies", "patternProperties", "additionalProperties")
_STRING_WORDS, _NUMBER_WORDS = ("minLength", "maxLength", "pattern", "format"), ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")
_COMPOSED = ("anyOf", "allOf", "oneOf")


def _get(v: Column, word: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f'$["{word}"]', kind)


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is an OBJECT, ARRAY or BOOLEAN."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _any(v: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [_get(v, w).isNotNull() for w in words])


def kind_of(v: Column) -> Column:
    """What a schema describes: ref, enum, combined, string, number, object, array, boolean, null or empty; null for none."""
    named = _get(v, "type", "string")
    return (
        F.when(v.isNull(), None).when(_get(v, "$ref").isNotNull(), "ref").when(_get(v, "enum").isNotNull(), "enum")
        .when(_any(v, _COMPOSED) | _is(_get(v, "type"), "ARRAY"), "combined")
        .when(named == "integer", "number").when(_is(_get(v, "type"), "STRING"), named)
        .when(_any(v, _ARRAY_WORDS), "array").when(_any(v, _OBJECT_WORDS), "object").when(_any(v, _NUMBER_WORDS), "number").when(_any(v, _STRING_WORDS), "string")
        .otherwise("empty")
    )


def _map(v: Column, word: str) -> Column:
    return F.coalesce(_get(v, word, "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _list(v: Column, word: str, of: str = "variant") -> Column:
    return F.coalesce(_get(v, word, f"array<{of}>"), F.array().cast(f"array<{of}>"))


def _at(path: Column, *names: Column | str) -> Column:
    return F.concat_ws("/", F.when(path != "", path), *[F.lit(n) if isinstance(n, str) else n for n in names])


def _row(path: Column, old: Column, new: Column, seen: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(None).cast("string").alias("change"), old.alias("old"), new.alias("new"), seen.alias("seen"))


def _changed(path: Column, change: Column | str) -> Column:
    none = F.parse_json(F.lit(None).cast("string"))
    named = F.lit(change) if isinstance(change, str) else change
    return F.struct(path.alias("path"), named.alias("change"), none.alias("old"), none.alias("new"), F.array().cast("array<string>").alias("seen"))


def _when(broken: Column, path: Column, change: str) -> Column:
    """An array of one change, or an empty one."""
    one = F.array(_changed(path, change))
    return F.when(F.coalesce(broken, F.lit(False)), one).otherwise(F.slice(one, 1, 0))


def _differ(a: Column, b: Column, word: str, kind: str = "double") -> Column:
    return ~_get(a, word, kind).eqNullSafe(_get(b, word, kind))


def _same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def _texts(values: Column) -> Column:
    return F.transform(values, lambda x: F.to_json(x))


def _first_of(path: Column, *pairs: tuple[str, Column]) -> Column:
    """The first attribute that differs."""
    found = F.slice(F.array(_changed(path, "")), 1, 0)
    for word, broken in reversed(pairs):
        found = F.when(F.coalesce(broken, F.lit(False)), F.array(_changed(_at(path, word), "ATTRIBUTE_VALUE_CHANGED"))).otherwise(found)
    return found


def _object(path: Column, a: Column, b: Column, seen: Column) -> list[Column]:
    old, new = _map(a, "properties"), _map(b, "properties")
    arrays = lambda m: F.map_filter(m, lambda _, v: _is(v, "ARRAY"))
    schemas = lambda m: F.map_filter(m, lambda _, v: ~_is(v, "ARRAY"))
    deps_a, deps_b = _map(a, "dependencies"), _map(b, "dependencies")
    names = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>"))
    lost = F.filter(F.map_keys(arrays(deps_a)), lambda k: ~F.coalesce(_same_set(names(deps_a[k]), names(arrays(deps_b)[k])), F.lit(False)) | ~F.map_contains_key(arrays(deps_b), k))
    same_deps = _same_set(F.map_keys(schemas(deps_a)), F.map_keys(schemas(deps_b)))
    more_a, more_b = _get(a, "additionalProperties"), _get(b, "additionalProperties")
    allows = lambda v: F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(True))
    schema = lambda v: F.when(_is(v, "OBJECT"), v)
    more = _at(path, "additionalProperties")
    closed = allows(more_a) != allows(more_b)
    narrowed = ~closed & schema(more_a).isNull() & schema(more_b).isNotNull()
    must_a, must_b = _list(a, "required", "string"), _list(b, "required", "string")
    holds = F.size(F.array_except(must_a, must_b)) == 0
    both = F.array(_row(more, schema(more_a), schema(more_b), seen))
    return [
        F.transform(F.map_keys(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))), lambda k: _changed(_at(path, "properties", k), "PROPERTY_REMOVED")),
        F.transform(F.map_keys(F.map_filter(old, lambda k, _: F.map_contains_key(new, k))), lambda k: _row(_at(path, "properties", k), old[k], new[k], seen)),
        _when(F.size(new) > F.size(old), _at(path, "properties"), "PROPERTIES_ADDED"),
        F.transform(lost, lambda k: _changed(_at(path, "dependencies", k), "DEPENDENCY_ARRAY_CHANGED")),
        _when(~same_deps, _at(path, "dependencies"), "DEPENDENCY_SCHEMA_CHANGED"),
        F.transform(F.when(same_deps, F.map_keys(schemas(deps_a))).otherwise(F.array().cast("array<string>")), lambda k: _row(_at(path, "dependencies", k), deps_a[k], deps_b[k], seen)),
        _when(closed, more, "ADDITIONAL_PROPERTIES_CHANGED"),
        _when(narrowed, more, "ADDITIONAL_PROPERTIES_NARROWED"),
        F.when(~closed & ~narrowed, both).otherwise(F.slice(both, 1, 0)),
        _when(holds & (F.size(must_a) != F.size(must_b)), _at(path, "required"), "REQUIRED_ARRAY_EXTENDED"),
        _when(~holds, _at(path, "required"), "REQUIRED_ARRAY_CHANGED"),
        *[_when(_differ(a, b, w), _at(path, w), "ATTRIBUTE_VALUE_CHANGED") for w in ("maxProperties", "minProperties")],
    ]


def _array(path: Column, a: Column, b: Column, seen: Column) -> list[Column]:
    all_items = lambda v: F.when(_is(_get(v, "items"), "OBJECT"), _get(v, "items"))
    each_a, each_b = _list(a, "items"), _list(b, "items")
    number = F.size(each_a) != F.size(each_b)
    places = F.when(~number & (F.size(each_a) > 0), F.sequence(F.lit(0), F.size(each_a) - 1)).otherwise(F.array().cast("array<int>"))
    more_a, more_b = _get(a, "additionalItems"), _get(b, "additionalItems")
    allows = lambda v: F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(True))
    schema = lambda v: F.when(_is(v, "OBJECT"), v)
    more = _at(path, "additionalItems")
    below = F.array(_row(more, schema(more_a), schema(more_b), seen))
    unique = lambda v: F.coalesce(_get(v, "uniqueItems", "boolean"), F.lit(False))
    return [
        F.array(_row(_at(path, "items"), all_items(a), all_items(b), seen)),
        _when(number, path, "NUMBER_OF_ITEMS_CHANGED"),
        F.transform(places, lambda k: _row(_at(path, "items", k.cast("string")), F.get(each_a, k), F.get(each_b, k), seen)),
        _when(allows(more_a) != allows(more_b), more, "ADDITIONAL_ITEMS_CHANGED"),
        F.when(allows(more_a) == allows(more_b), below).otherwise(F.slice(below, 1, 0)),
        *[_when(_differ(a, b, w), _at(path, w), "ATTRIBUTE_VALUE_CHANGED") for w in ("maxItems", "minItems")],
        _when(unique(a) != unique(b), _at(path, "uniqueItems"), "ATTRIBUTE_VALUE_CHANGED"),
    ]


def _combined(path: Column, a: Column, b: Column, seen: Column) -> list[Column]:
    typed = lambda v: F.transform(_get(v, "type", "array<string>"), lambda t: F.parse_json(F.concat(F.lit('{"type":"'), t, F.lit('"}'))))
    parts = lambda v: F.coalesce(*[_get(v, w, "array<variant>") for w in _COMPOSED], typed(v), F.array().cast("array<variant>"))
    method = lambda v: F.coalesce(*[F.when(_get(v, w).isNotNull(), w) for w in _COMPOSED], F.lit("anyOf"))
    number, other = F.size(parts(a)) != F.size(parts(b)), method(a) != method(b)
    places = F.when(~number & ~other & (F.size(parts(a)) > 0), F.sequence(F.lit(0), F.size(parts(a)) - 1)).otherwise(F.array().cast("array<int>"))
    return [
        _when(number, path, "SUB_SCHEMA_CHANGED"),
        _when(~number & other, path, "COMPOSITION_METHOD_CHANGED"),
        F.transform(places, lambda k: _row(_at(path, method(a), k.cast("string")), F.get(parts(a), k), F.get(parts(b), k), seen)),
    ]


def _reference(path: Column, a: Column, b: Column, seen: Column) -> list[Column]:
    """The schemas that two references mean: of the definitions, or the whole schema. One that is being compared already isn't entered again."""
    name = _get(a, "$ref", "string")
    meant = lambda v, root: F.when(_get(v, "$ref", "string") == "#", root).otherwise(_map(root, "definitions")[F.substring_index(_get(v, "$ref", "string"), "/", -1)])
    below = F.array(_row(_at(path, "$ref"), meant(a, F.col("root_old")), meant(b, F.col("root_new")), F.array_append(seen, name)))
    return [F.when(~F.array_contains(seen, name), below).otherwise(F.slice(below, 1, 0))]


def _step(rows: DataFrame, key: str) -> DataFrame:
    """Each node replaced by its changes and the nodes below it."""
    path, a, b, seen = (F.col(c) for c in ("path", "old", "new", "seen"))
    was, is_ = F.col("was"), F.col("is")
    text = lambda words: F.coalesce(*[_get(F.col(words[0]), w, "string") for w in words[1]])
    common = [
        _when(~text(("old", ("id", "$id"))).eqNullSafe(text(("new", ("id", "$id")))), path, "ID_CHANGED"),
        _when(_differ(a, b, "title", "string"), path, "TITLE_CHANGED"),
        _when(_differ(a, b, "description", "string"), path, "DESCRIPTION_CHANGED"),
    ]
    pattern = (_get(a, "pattern", "string") != _get(b, "pattern", "string"))
    own = {
        "string": [_first_of(path, ("maxLength", _differ(a, b, "maxLength")), ("minLength", _differ(a, b, "minLength")), ("pattern", pattern))],
        "number": [_first_of(path, *[(w, _differ(a, b, w)) for w in ("maximum", "minimum", "multipleOf")])],
        "enum": [_when(~_same_set(_texts(_list(a, "enum")), _texts(_list(b, "enum"))), _at(path, "enum"), "ENUM_ARRAY_CHANGED")],
        "combined": _combined(path, a, b, seen), "object": _object(path, a, b, seen), "array": _array(path, a, b, seen), "ref": _reference(path, a, b, seen),
    }
    deeper = reduce(lambda w, k: w.when(is_ == k, F.concat(*common, *own[k])), own, F.when(F.lit(False), common[0])).otherwise(F.concat(*common))
    alone = lambda change: F.array(_changed(path, change))
    result = (
        F.when(F.col("change").isNotNull(), F.array(F.struct(*_STATE)))
        .when(was.isNull() & is_.isNull(), F.slice(alone(""), 1, 0))
        .when(was.isNull() | is_.isNull(), alone("SCHEMA_REMOVED"))
        .when((was == is_) | ((was == "empty") & (is_ == "object")), deeper)
        .when(was == "empty", alone("TYPE_NARROWED"))
        .otherwise(alone("TYPE_CHANGED"))
    )
    kinds = F.explode(F.array(F.struct(kind_of(a).alias("was"), kind_of(b).alias("is"))))
    known = rows.select("*", kinds.alias("k")).select(*rows.columns, "k.was", "k.is")
    return known.select(key, "root_old", "root_new", F.explode(result).alias("r")).select(key, "root_old", "root_new", *[F.col(f"r.{c}").alias(c) for c in _STATE])


def diff(pairs: DataFrame, key: str, old: str = "old_schema", new: str = "new_schema") -> DataFrame:
    """``key``, path and change of every difference between two JSON Schema texts.

    Steps go on until no node is left to compare; a schema that refers to itself ends where it comes round.
    """
    roots = pairs.select(key, F.parse_json(old).alias("root_old"), F.parse_json(new).alias("root_new"))
    rows = roots.select("*", F.lit("").alias("path"), F.lit(None).cast("string").alias("change"), F.col("root_old").alias("old"), F.col("root_new").alias("new"), F.array().cast("array<string>").alias("seen"))
    before = None
    while True:
        rows = _step(rows, key).persist()  # a step reads what the one before has found, not its plan again
        left = rows.where("change is null").count()
        if before is not None:
            before.unpersist()
        before = rows
        if not left:
            return rows.select(key, F.concat(F.lit("#/"), "path").alias("path"), "change")
