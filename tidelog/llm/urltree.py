"""URL filters: explicit rules first, then a path-template tree with labelled purity.

A url's host and path are looked up in rules (a host with its subdomains, and the
start of a path); the longest rule that fits gives the verdict. Other urls are
judged by a tree of path templates for each host:

1. Paths are counted. Segments that are numbers, hashes or dates by their form
   become wildcards of that form at once, so few different paths remain.
2. The tree grows level by level. A child stays a branch of its own if it is
   frequent, or if it has ``evidence`` labels or more and they are statistically unlike
   those of all the node's children (z above ``z``). Of the others, rare ones
   merge into ``*``; if most children were seen once or in a small
   share of the node's urls, they are values of a variable, and all with less than twice the mean do.
3. A template's purity is the share of its labelled urls that are labelled
   block, smoothed with the purity of the same template in the host's domain, that
   with its purity over all hosts, and that with the purity of all urls.
   Templates of at least ``reject`` are blocked.

Labels are the verdicts of the explicit rules here; a caller may give its own.
Each level is an aggregation of counts (combined before the shuffle) and an
equi-join, so a host with a third of all urls is split by its paths, and the
verdicts come back to the urls through a join that Spark can split.

The tree is as deep as the paths are. A null
url, or one without ``://``, has an empty host and path and is judged as such; a null key stays null.
Repeated rows are judged alike. Of rules of equal length one fits at most; a purity of ``reject`` itself is blocked. An empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Forms of segments: pattern and wildcard. An ending such as .html is kept.
FORMS = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}"),
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9]+(\.[A-Za-z]+)$", "{n}$1"),
    (r"^[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}$", "{hex}"),
    (r"^(?=.*[0-9])[0-9a-fA-F]{8,}$", "{hex}"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def match_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest (verdict, host/path) rule that fits the columns host and path, as its text, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        host, path = _split_rule(rule)
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _form(segment: Column) -> Column:
    kind = segment
    for pattern, wildcard in reversed(FORMS):
        kind = F.when(segment.rlike(pattern), F.regexp_replace(segment, pattern, wildcard)).otherwise(kind)
    return kind


def segments(path: Column) -> Column:
    """The path's segments with wildcards for their forms."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    ending = F.when(F.endswith(path, F.lit("/")) & (F.length(path) > 1), F.array(F.lit("{/}"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(parts, _form), ending)


def grow(paths: DataFrame, variable: float = 0.5, least: int = 8, frequent: float = 0.1, z: float = 1.96, seldom: float = 0.01, evidence: int = 5) -> DataFrame:
    """A template for each (host, segments) of ``paths``, which has n, labelled and blocked counts.

    Branches of fewer than ``least`` paths end at once, as nothing below them can merge, and segments that all paths of a branch
    share are passed in one step; so there are no more levels than there are forks.
    """
    columns = ["host", "segments", "n", "labelled", "blocked", "template"]
    level, grown = paths.select(*columns[:-1], F.lit("").alias("template"), F.lit(0).alias("at")), []
    while True:
        branches = level.groupBy("host", "template").agg(F.count(F.lit(1)).alias("paths"), F.min("segments").alias("lowest"), F.max("segments").alias("highest"))
        # the lowest and the highest path share what all paths between them share
        same = F.zip_with("lowest", "highest", lambda x, y: x.eqNullSafe(y))
        fork = F.array_position(same, F.lit(False))  # 0 if one of them is the beginning of the other
        shared = F.when(fork > 0, fork - 1).otherwise(F.least(F.size("lowest"), F.size("highest")))
        # how many segments a path has passed then: all, or those that its branch shares
        ahead = F.greatest(shared, F.col("at"))
        until = F.when(F.col("paths") < least, F.size("segments")).otherwise(ahead).cast("int")
        stepped = level.join(branches, ["host", "template"]).withColumn("until", until).select(
            *columns[:-1], "paths", F.concat("template", F.array_join(F.transform(F.slice("segments", F.col("at") + 1, F.col("until") - F.col("at")), lambda s: F.concat(F.lit("/"), s)), "")).alias("template"), F.col("until").alias("at")
        )
        child = F.coalesce(F.get(F.col("segments"), F.col("at")), F.lit(""))
        level = scratch.keep(stepped.withColumn("child", child), "url-branches")
        grown.append(level.where("child = ''").select(*columns))
        level = level.where("child <> ''")
        nodes = level.groupBy("host", "template", "child").agg(*[F.sum(c).alias(f"c_{c}") for c in ("n", "labelled", "blocked")])
        sums = nodes.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("children"),
            *[F.sum(f"c_{c}").alias(f"t_{c}") for c in ("n", "labelled", "blocked")],
        )
        known = nodes.join(sums, ["host", "template"])
        seldom_seen = F.col("c_n") <= F.greatest(F.lit(1.0), seldom * F.col("t_n"))
        whole = known.groupBy("host", "template").agg(F.sum(F.when(seldom_seen, 1).otherwise(0)).alias("few"))
        rate = F.col("t_blocked") / F.greatest("t_labelled", F.lit(1))
        own = F.col("c_blocked") / F.greatest("c_labelled", F.lit(1))
        error = F.sqrt(rate * (1 - rate) / F.greatest("c_labelled", F.lit(1)))
        alike = (F.col("c_labelled") < evidence) | (F.abs(own - rate) <= z * error + 1e-9)
        few_of_many = F.col("c_n") < 2 * F.col("t_n") / F.col("children")
        is_variable = F.col("few") >= variable * F.col("children")
        rare = F.col("c_n") < frequent * F.col("t_n")
        fixed = F.col("child").rlike(r"^\{")
        merged = (F.col("children") >= least) & alike & (rare | (is_variable & few_of_many))
        token = F.when(~fixed & merged, F.lit("*")).otherwise(F.col("child"))
        named = known.join(whole, ["host", "template"]).select("host", "template", "child", token.alias("token"))
        level = scratch.keep(level.join(named, ["host", "template", "child"]).select(
            *columns[:-1], F.concat("template", F.lit("/"), "token").alias("template"), (F.col("at") + 1).alias("at"),
        ), "url-level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, grown)


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]] = (), key: str = "page_id", label: str | None = None, reject: float = 0.5, weight: float = 4.0) -> DataFrame:
    """``key``, host, path, rule, verdict, template and purity of every row of ``urls``.

    ``label``: a column of block, allow or null to learn from instead of the rules' verdicts.
    ``weight``: how many labelled urls the wider purity counts for.
    """
    verdicts = {r: v for v, r in rules}
    said = reduce(lambda w, r: w.when(F.col("rule") == r, F.lit(verdicts[r])), verdicts, F.when(F.lit(False), F.lit("")))
    host, path = host_and_path(F.col("url"))
    rows = (
        urls.select(F.col(key), F.col("url"), *([F.col(label).alias("_label")] if label else []))
        .select(F.col(key), host.alias("host"), path.alias("path"), *(["_label"] if label else []))
        .withColumn("rule", match_rule(rules))
        .withColumn("said", said)
    )
    taught = F.col("_label") if label else F.col("said")
    counted = (
        rows.groupBy("host", segments(F.col("path")).alias("segments"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(taught.isNotNull(), 1).otherwise(0)).alias("labelled"),
            F.sum(F.when(taught == "block", 1).otherwise(0)).alias("blocked"),
        )
    )
    tree = scratch.keep(grow(scratch.keep(counted, "url-paths")), "url-tree")
    domain = F.when(F.size(F.split("host", r"\.")) > 2, F.substring_index("host", ".", -2)).otherwise(F.col("host"))
    sums = lambda by: tree.withColumn("domain", domain).groupBy(*by).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    all_ = tree.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    base = (all_["blocked"] or 0) / max(all_["labelled"] or 0, 1)
    smooth = lambda wider: (F.col("blocked") + weight * wider) / (F.col("labelled") + weight)
    anywhere = sums(["template"]).select("template", smooth(F.lit(base)).alias("p_anywhere"))
    in_domain = sums(["domain", "template"]).join(anywhere, "template").select("domain", "template", smooth(F.col("p_anywhere")).alias("p_domain"))
    own = (
        sums(["domain", "host", "template"])
        .join(in_domain, ["domain", "template"])
        .select("host", "template", smooth(F.col("p_domain")).alias("purity"))
    )
    judged = tree.select("host", F.col("segments"), "template").join(own, ["host", "template"])
    return (
        rows.withColumn("segments", segments(F.col("path")))
        .join(judged, ["host", "segments"], "left")
        .select(
            key, "host", "path", "rule",
            F.coalesce("said", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            "template", "purity",
        )
    )
