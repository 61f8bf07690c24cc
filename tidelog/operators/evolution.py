"""Schema evolution on flat schemas: one row for each path of a schema, so that a diff is a join and a verdict an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of change, their level under FORWARD and NONE, and under COMPATIBLE.
LEVELS = (
    ("ID_CHANGED", "MAJOR", "MAJOR"),
    ("DESCRIPTION_CHANGED", "PATCH", "PATCH"),
    ("TITLE_CHANGED", "PATCH", "PATCH"),
    ("PROPERTIES_ADDED", "MINOR", "MINOR"),
    ("SCHEMA_REMOVED", "MAJOR", "MAJOR"),
    ("TYPE_CHANGED", "MAJOR", "MAJOR"),
    ("TYPE_NARROWED", "MINOR", "MAJOR"),
    ("NUMBER_OF_ITEMS_CHANGED", "MAJOR", "MAJOR"),
    ("PROPERTY_REMOVED", "MAJOR", "MAJOR"),
    ("DEPENDENCY_ARRAY_CHANGED", "MAJOR", "MAJOR"),
    ("DEPENDENCY_SCHEMA_CHANGED", "MAJOR", "MAJOR"),
    ("COMPOSITION_METHOD_CHANGED", "MAJOR", "MAJOR"),
    ("ATTRIBUTE_VALUE_CHANGED", "MAJOR", "MAJOR"),
    ("ENUM_ARRAY_CHANGED", "MAJOR", "MAJOR"),
    ("SUB_SCHEMA_CHANGED", "MAJOR", "MAJOR"),
    ("DEPENDENCY_SCHEMA_REMOVED", "MAJOR", "MAJOR"),
    ("REQUIRED_ARRAY_CHANGED", "MAJOR", "MAJOR"),
    ("REQUIRED_ARRAY_EXTENDED", "MINOR", "MAJOR"),
    ("ADDITIONAL_PROPERTIES_CHANGED", "MAJOR", "MAJOR"),
    ("ADDITIONAL_PROPERTIES_NARROWED", "MINOR", "MAJOR"),
    ("ADDITIONAL_ITEMS_CHANGED", "MAJOR", "MAJOR"),
)
#: What a schema may change on its way from FORWARD to COMPATIBLE.
MIGRATION_ALLOWS = ("DESCRIPTION_CHANGED", "TITLE_CHANGED", "PROPERTIES_ADDED", "REQUIRED_ARRAY_EXTENDED", "ADDITIONAL_PROPERTIES_CHANGED", "ADDITIONAL_ITEMS_CHANGED")
#: What a key of labels and annotations must match.
KEY_RULES = (r"^([-.a-z0-9]{0,253}/)?[^/]*$", r"^([-.a-z0-9]+/)?[^/]{0,63}$", r"^([^/]+/)?[a-zA-Z0-9]([a-zA-Z0-9_.-]*[a-zA-Z0-9])?$")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """schema_id, path and change of every path that differs; both sides have schema_id, path, type and description.

    A path has one change for its type at most and one for its description. Type ``any`` becoming another is a narrowing.
    """
    a, b = old.alias("a"), new.alias("b")
    keys = ["schema_id", "path"]
    both = a.join(b, keys, "full").select(*keys, F.col("a.type").alias("was"), F.col("b.type").alias("is"), F.col("a.description").alias("said"), F.col("b.description").alias("says"))
    kind = (
        F.when(F.col("was").isNull(), "PROPERTIES_ADDED")
        .when(F.col("is").isNull(), "PROPERTY_REMOVED")
        .when(F.col("was") == F.col("is"), None)
        .when(F.col("was") == "any", "TYPE_NARROWED")
        .otherwise("TYPE_CHANGED")
    )
    stays = F.col("was").isNotNull() & F.col("is").isNotNull()
    text = F.when(stays & ~F.col("said").eqNullSafe(F.col("says")), "DESCRIPTION_CHANGED")
    return both.select(*keys, F.explode(F.array_compact(F.array(kind, text))).alias("change"))


def levels(spark: SparkSession) -> DataFrame:
    """change, mode and level: the table of fixed values, a row for each mode."""
    rows = [(c, m, y if m == "COMPATIBLE" else x) for c, x, y in LEVELS for m in ("NONE", "FORWARD", "COMPATIBLE")]
    return spark.createDataFrame(rows, "change string, mode string, level string")


def judge(changes: DataFrame, modes: DataFrame) -> DataFrame:
    """schema_id, mode, level (the most severe), n_changes and allowed, for every row of ``modes`` (schema_id, mode)."""
    named = changes.join(modes, "schema_id").join(F.broadcast(levels(changes.sparkSession)), ["change", "mode"])
    worst = named.groupBy("schema_id").agg(F.count(F.lit(1)).alias("n"), F.min(rank(F.col("level"))).alias("rank"))
    level = F.when(F.col("rank") == 0, "MAJOR").when(F.col("rank") == 1, "MINOR").when(F.col("rank") == 2, "PATCH").otherwise("NO_CHANGES")
    forbids = F.col("mode").isin("FORWARD", "COMPATIBLE") & (F.col("level") == "MAJOR")
    return modes.join(worst, "schema_id", "left").select("schema_id", "mode", level.alias("level"), F.coalesce("n", F.lit(0)).cast("long").alias("n_changes")).withColumn("allowed", ~forbids)


def rank(level: Column) -> Column:
    """0 for MAJOR, 1 for MINOR, 2 for PATCH."""
    return F.when(level == "MAJOR", 0).when(level == "MINOR", 1).when(level == "PATCH", 2)


def bump(version: Column, level: Column) -> Column:
    """The version after a change of a level: lower parts restart at 0."""
    part = [F.split(version, r"\.")[k].cast("int") for k in range(3)]
    parts = (
        F.when(level == "MAJOR", F.array(part[0] + 1, F.lit(0), F.lit(0)))
        .when(level == "MINOR", F.array(part[0], part[1] + 1, F.lit(0)))
        .when(level == "PATCH", F.array(part[0], part[1], part[2] + 1))
        .otherwise(F.array(*part))
    )
    return F.array_join(parts.cast("array<string>"), ".")


def migration_errors(changes: DataFrame) -> DataFrame:
    """Schemas that can't become COMPATIBLE, with the kinds of change that forbid it, sorted."""
    return changes.where(~F.col("change").isin(*MIGRATION_ALLOWS)).groupBy("schema_id").agg(F.array_join(F.array_sort(F.collect_set("change")), ",").alias("forbidden"))


def content_key(nodes: DataFrame) -> DataFrame:
    """schema_id and a hash of a schema's paths and types, whatever their order."""
    return nodes.groupBy("schema_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "type"))), "|").cast("binary")).alias("content"))


def valid_key(key: Column) -> Column:
    """Whether a label's or annotation's key keeps all rules."""
    ok = F.lit(True)
    for rule in KEY_RULES:
        ok = ok & key.rlike(rule)
    return ok


def subscription_key(app: Column, group: Column, event_types: Column) -> Column:
    """What a subscription is unique by."""
    return F.md5(F.concat(app, group, F.array_join(F.array_sort(event_types), "")).cast("binary"))


#: Which compatibility mode may become which.
MODE_CHANGES = (("COMPATIBLE", "COMPATIBLE"), ("FORWARD", "FORWARD"), ("FORWARD", "COMPATIBLE"), ("NONE", "NONE"), ("NONE", "FORWARD"))


def type_level(was: Column, is_: Column, equal: Column) -> Column:
    """The level of a change between schema types JSON and AVRO, or FORBIDDEN; null between two JSON ones, which their diff decides."""
    return (
        F.when((was == "AVRO") & (is_ == "JSON"), "FORBIDDEN").when((was == "JSON") & (is_ == "AVRO"), "MAJOR")
        .when((was == "AVRO") & (is_ == "AVRO"), F.when(equal, "NO_CHANGES").otherwise("MAJOR"))
    )


def constraint_errors(admin: Column, type_admin: Column) -> Column:
    """What an update of an event type breaks: an array of names. Columns old_* and new_* of category, mode, strategy, keys and enrichment.

    Administrators may change mode and strategy, those of the event type the mode alone.
    """
    modes = [(F.col("old_mode") == a) & (F.col("new_mode") == b) for a, b in MODE_CHANGES]
    allowed = modes[0]
    for m in modes[1:]:
        allowed = allowed | m
    found = {
        "CATEGORY_CHANGED": F.col("old_category") != F.col("new_category"),
        "MODE_CHANGED": ~allowed & ~admin & ~type_admin,
        "STRATEGY_CHANGED": (F.col("old_strategy") != "random") & (F.col("new_strategy") != F.col("old_strategy")) & ~admin,
        "KEYS_MISSING": (F.col("new_strategy") == "hash") & (F.size("new_keys") == 0),
        "ENRICHMENT_CHANGED": F.col("old_enrichment") != F.col("new_enrichment"),
    }
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in found.items()]))


def catalog_errors(min_retention: int, max_retention: int) -> Column:
    """What an update breaks in the catalog: an array of names. Columns old_* and new_* of policy, statistic and audience; category and retention."""
    policy, before = F.col("new_policy"), F.col("old_policy")
    found = {
        "COMPACTION_OF_UNDEFINED": (F.col("category") == "UNDEFINED") & policy.isin("COMPACT", "COMPACT_AND_DELETE"),
        "POLICY_CHANGED": (policy != before) & ~((before == "DELETE") & (policy == "COMPACT_AND_DELETE")),
        "STATISTIC_CHANGED": F.col("new_statistic").isNotNull() & ~F.col("new_statistic").eqNullSafe(F.col("old_statistic")),
        "AUDIENCE_REMOVED": F.col("old_audience").isNotNull() & F.col("new_audience").isNull(),
        "RETENTION_TOO_LONG": F.col("retention") > max_retention,
        "RETENTION_TOO_SHORT": F.col("retention") < min_retention,
    }
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in found.items()]))
