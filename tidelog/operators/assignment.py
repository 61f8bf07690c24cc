"""Assignment of partitions to the sessions of a consumer group."""

from __future__ import annotations

from itertools import cycle

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_by_weight(items: int, weights: list[int]) -> list[int]:
    """How many of ``items`` each session gets: whole shares by weight, at least one, then the rest in turns of up to a weight."""
    if any(w <= 0 for w in weights) or items < len(weights):
        raise ValueError("each session needs a weight and an item")
    share = items // sum(weights)
    counts = [share * w for w in weights] if share else [1] * len(weights)
    left = items - sum(counts)
    turns = cycle(enumerate(weights))
    while left:
        k, weight = next(turns)
        more = min(left, weight)
        counts[k] += more
        left -= more
    return counts


def equal_split(sessions: DataFrame, partitions: DataFrame, group: str) -> DataFrame:
    """Partitions dealt to equal sessions in order, in one join: rank modulo the number of sessions."""
    from pyspark.sql import Window

    ranked = sessions.withColumn("_s", F.row_number().over(Window.partitionBy(group).orderBy("session")) - 1)
    counts = sessions.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    dealt = partitions.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy("partition")) - 1).join(counts, group)
    return dealt.withColumn("_s", (F.col("_p") % F.col("_n")).cast("int")).join(ranked, [group, "_s"]).select(group, "partition", "session")


def must_rebalance(topology: DataFrame, sessions: DataFrame) -> DataFrame:
    """Partitions without a session, with a dead one, or on their way to a dead one."""
    alive = lambda name, flag: F.broadcast(sessions.select(F.col("session").alias(name), F.lit(True).alias(flag)))
    joined = topology.join(alive("session", "_own"), "session", "left").join(alive("next_session", "_next"), "next_session", "left")
    dead_next = F.col("next_session").isNotNull() & F.col("_next").isNull()
    return joined.where(F.col("session").isNull() | F.col("_own").isNull() | dead_next).select("partition", "session", "next_session", "state")


def move(state: Column, session: Column, to: Column, alive: Column) -> Column:
    """A partition's (state, session, next_session) after it is given to ``to``."""
    at_once = (state == "UNASSIGNED") | ~F.coalesce(alive, F.lit(False)) | (session == to)
    return F.struct(
        F.when(at_once, "ASSIGNED").otherwise("REASSIGNING").alias("state"), F.when(at_once, to).otherwise(session).alias("session"),
        F.when(~at_once, to).alias("next_session"),
    )


def transfer(topology: DataFrame, session: str) -> DataFrame:
    """Topology after a session hands over what it has to release."""
    mine = (F.col("state") == "REASSIGNING") & (F.col("session") == session)
    return topology.select(
        "partition", F.when(mine, "ASSIGNED").otherwise(F.col("state")).alias("state"), F.when(mine, F.col("next_session")).otherwise(F.col("session")).alias("session"),
        F.when(~mine, F.col("next_session")).alias("next_session"),
    )


def upsert(topology: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """Topology with rows of the same key replaced and new ones added."""
    return topology.join(changed, key, "left_anti").unionByName(changed)


def sessions_hash(sessions: DataFrame, group: str) -> DataFrame:
    """MD5 over each group's sorted session ids."""
    return sessions.groupBy(group).agg(F.md5(F.array_join(F.array_sort(F.collect_list("session")), "").cast("binary")).alias("sessions_hash"))


def refresh(held: DataFrame, topology: DataFrame, session: str) -> DataFrame:
    """What a topology change means for a stream: NEW, RELEASING, RETURNED or REMOVED partitions of ``session``."""
    joined = held.join(topology, "partition", "full")
    mine, leaving = F.col("session") == session, F.col("state") == "REASSIGNING"
    change = (
        F.when(F.col("held").isNull() & mine & ~leaving, "NEW").when(F.col("held").isNotNull() & ~F.coalesce(mine, F.lit(False)), "REMOVED")
        .when((F.col("held") == "STREAMING") & mine & leaving, "RELEASING").when((F.col("held") == "RELEASING") & mine & ~leaving, "RETURNED")
    )
    return joined.select("partition", change.alias("change")).where("change is not null")


REBALANCED = "subscription string, partition string, session string, next_session string, state string"


def _rebalance(partitions: list[dict], sessions: list[dict]) -> list[dict]:
    ids = {s["id"] for s in sessions}
    asked: dict[str, str] = {}
    for s in sessions:
        for p in s["requested"] or []:
            if asked.setdefault(p, s["id"]) != s["id"]:
                raise ValueError(f"partition {p} is requested twice")
    out = {p["partition"]: dict(p) for p in partitions}

    def owner(p: dict) -> str | None:
        return p["next_session"] if p["state"] == "REASSIGNING" and p["next_session"] else p["session"]

    def give(p: dict, to: str) -> None:
        if p["state"] == "UNASSIGNED" or p["session"] not in ids or p["session"] == to:
            p.update(state="ASSIGNED", session=to, next_session=None)
        else:
            p.update(state="REASSIGNING", next_session=to)

    for name, to in asked.items():
        if name in out and owner(out[name]) != to:
            give(out[name], to)
    weighted = sorted((s["id"], s["weight"]) for s in sessions if not s["requested"])
    free = sorted(n for n in out if n not in asked)
    if not weighted or not free:
        return list(out.values())
    wanted = dict(zip((i for i, _ in weighted), split_by_weight(len(free), [w for _, w in weighted])))
    held: dict[str, list[str]] = {i: [] for i, _ in weighted}
    loose = []
    for n in free:
        (held[owner(out[n])] if owner(out[n]) in held else loose).append(n)
    for i, names in held.items():
        while len(names) > wanted[i]:
            moving = next((n for n in names if out[n]["state"] == "REASSIGNING"), names[-1])
            names.remove(moving)
            loose.append(moving)
    for i, names in held.items():
        while len(names) < wanted[i]:
            n = loose.pop(0)
            give(out[n], i)
            names.append(n)
    return list(out.values())


def rebalance(partitions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sticky weighted rebalance of every subscription. A subscription has at most a hundred partitions, so each is one small group.

    ``partitions``: subscription, partition, session, next_session, state; ``sessions``: subscription, id, weight, requested.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = left.astype(object).where(left.notna(), None).to_dict("records")
        own = [{"id": r["id"], "weight": int(r["weight"]), "requested": None if r["requested"] is None else list(r["requested"])} for r in right.to_dict("records")]
        return pd.DataFrame(_rebalance(rows, own), columns=["subscription", "partition", "session", "next_session", "state"])

    return partitions.groupBy("subscription").cogroup(sessions.groupBy("subscription")).applyInPandas(run, REBALANCED)
