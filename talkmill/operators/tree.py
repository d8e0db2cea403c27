"""Message trees: leaves, forks, paths and newest leaves.

The walks up and down run in one pass over each conversation, which gets only keys, dates and positions, never texts.
Conversations of more than ``LARGE`` messages are never held by a task: their ancestors are found by doubling, in written tables
of each message's 1st, 2nd, 4th ... ancestor, so a chain of n messages takes log2(n) joins. Everything stays inside the
conversation. A dangling parent ends a walk as a head does; a cycle ends it at the first message met twice, and has no path.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import preview
from talkmill.sources.shared import cut

#: Messages of a conversation up to which one task walks it.
LARGE = 50_000


def leaves(messages: DataFrame) -> DataFrame:
    """Messages that are no message's parent within their conversation."""
    parents = messages.filter("parent_uuid is not null").select("conv_uuid", F.col("parent_uuid").alias("uuid")).distinct()
    return messages.join(parents, ["conv_uuid", "uuid"], "left_anti")


def heads(messages: DataFrame) -> DataFrame:
    return messages.filter("parent_uuid is null")


def default_leaf(messages: DataFrame) -> DataFrame:
    """(conv_uuid, leaf): the newest leaf of each conversation; a dated one before an undated one."""
    order = F.struct(F.col("created_at").isNotNull(), F.coalesce("created_at", F.lit(0).cast("timestamp")), "seq")
    return leaves(messages).groupBy("conv_uuid").agg(F.max_by("uuid", order).alias("leaf"))


def walked(frame: pd.DataFrame) -> tuple[dict, dict, dict]:
    """Parents, children and order keys of one conversation's messages."""
    dates = frame["created_at"]
    key = {u: (not pd.isna(t), t.value if not pd.isna(t) else 0, int(s)) for u, t, s in zip(frame["uuid"], dates, frame["seq"], strict=True)}
    parent = {u: p if p in key else None for u, p in zip(frame["uuid"], frame["parent_uuid"], strict=True)}
    children: dict[str, list[str]] = {}
    for u, p in parent.items():
        if p is not None:
            children.setdefault(p, []).append(u)
    return parent, children, key


def newest_leaf_of(frame: pd.DataFrame) -> pd.DataFrame:
    """(conv_uuid, uuid, leaf): the newest leaf below each message, climbing from the leaves, newest first."""
    parent, children, key = walked(frame)
    found: dict[str, str] = {}
    for leaf in sorted((u for u in key if u not in children), key=key.__getitem__, reverse=True):
        at: str | None = leaf
        while at is not None and at not in found:
            found[at] = leaf
            at = parent[at]
    rows = [(u, found[u]) for u in key if u in found]
    conv = frame["conv_uuid"].iloc[0]
    return pd.DataFrame([(conv, *row) for row in rows], columns=["conv_uuid", "uuid", "leaf"])


def path_of(frame: pd.DataFrame) -> pd.DataFrame:
    """(conv_uuid, leaf, depth, uuid): the messages from a head to each wanted leaf."""
    parent, _, _ = walked(frame)
    out = []
    for leaf in frame["uuid"][frame["wanted"]]:
        path, at, seen = [], leaf, set()
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = parent[at]
        if at is None:
            out += [(leaf, depth, u) for depth, u in enumerate(reversed(path))]
    conv = frame["conv_uuid"].iloc[0]
    return pd.DataFrame([(conv, *row) for row in out], columns=["conv_uuid", "leaf", "depth", "uuid"])


def slim(messages: DataFrame) -> DataFrame:
    return messages.select("conv_uuid", "uuid", "parent_uuid", "created_at", "seq")


def large_ones(messages: DataFrame, large: int) -> DataFrame | None:
    """(conv_uuid, n) of the conversations of more than ``large`` messages; None if there are none."""
    sizes = messages.groupBy("conv_uuid").agg(F.count("*").alias("n")).filter(F.col("n") > large)
    return cut(sizes, "large") if sizes.limit(1).count() else None


def jumps(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Written tables (conv_uuid, uuid, up): each message's ancestor 2**k steps above it, for all k until none has one.

    In conversations of ``most`` messages at most, whoever has one ``most`` steps above leads into a cycle; there tables end.
    """
    inside = nodes.select("conv_uuid", F.col("uuid").alias("up"))
    tables = [cut(nodes.select("conv_uuid", "uuid", F.col("parent_uuid").alias("up")).filter("up is not null").join(inside, ["conv_uuid", "up"], "left_semi").select("conv_uuid", "uuid", "up"), "jumps")]
    while tables[-1].limit(1).count() and 2 ** (len(tables) - 1) < most:
        near = tables[-1]
        far = near.select("conv_uuid", F.col("uuid").alias("up"), F.col("up").alias("beyond"))
        tables.append(cut(near.join(far, ["conv_uuid", "up"]).select("conv_uuid", "uuid", F.col("beyond").alias("up")), "jumps"))
    return tables


def newest_leaf_by_doubling(messages: DataFrame, most: int) -> DataFrame:
    """(conv_uuid, uuid, leaf): in each round a message hands the newest leaf it knows of to the ancestor 2**k above it."""
    nodes = slim(messages)
    key = F.struct(F.col("created_at").isNotNull().alias("dated"), F.coalesce("created_at", F.lit(0).cast("timestamp")).alias("at"), F.col("seq").alias("seq"), F.col("uuid").alias("leaf"))
    best = cut(leaves(nodes).select("conv_uuid", "uuid", key.alias("best")), "newest")
    for table in jumps(nodes, most):
        told = best.join(table, ["conv_uuid", "uuid"]).select("conv_uuid", F.col("up").alias("uuid"), "best")
        best = cut(best.unionByName(told).groupBy("conv_uuid", "uuid").agg(F.max("best").alias("best")), "newest")
    return best.select("conv_uuid", "uuid", "best.leaf")


def paths_by_doubling(messages: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(conv_uuid, leaf, depth, uuid) of the paths to (conv_uuid, leaf): in each round the messages known of a path bring
    those 2**k above them."""
    nodes = slim(messages)
    known = nodes.select("conv_uuid", F.col("uuid").alias("leaf"))
    path = wanted.select("conv_uuid", "leaf").distinct().join(known, ["conv_uuid", "leaf"], "left_semi").select("conv_uuid", "leaf", F.col("leaf").alias("uuid"), F.lit(0).alias("steps"))
    tables = jumps(nodes, most)
    if 2 ** (len(tables) - 1) >= most:  # who is still going up leads into a cycle
        path = path.join(tables[-1].select("conv_uuid", F.col("uuid").alias("leaf")), ["conv_uuid", "leaf"], "left_anti")
    path = cut(path, "paths")
    for k, table in enumerate(tables):
        more = path.join(table, ["conv_uuid", "uuid"]).select("conv_uuid", "leaf", F.col("up").alias("uuid"), (F.col("steps") + 2**k).alias("steps"))
        path = cut(path.unionByName(more), "paths")
    last = path.groupBy("conv_uuid", "leaf").agg(F.max("steps").alias("last"))
    return path.join(last, ["conv_uuid", "leaf"]).select("conv_uuid", "leaf", (F.col("last") - F.col("steps")).cast("int").alias("depth"), "uuid")


def newest_leaf_per_node(messages: DataFrame, large: int = LARGE) -> DataFrame:
    """(conv_uuid, uuid, leaf): the newest leaf below each message."""
    many = large_ones(messages, large)
    rows = messages if many is None else messages.join(many, "conv_uuid", "left_anti")
    walks = slim(rows).groupBy("conv_uuid").applyInPandas(newest_leaf_of, "conv_uuid string, uuid string, leaf string")
    if many is None:
        return walks
    most = many.agg(F.max("n")).first()[0]
    return walks.unionByName(newest_leaf_by_doubling(messages.join(many, "conv_uuid", "left_semi"), most))


def newest_leaf_for(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """For the given messages (uuid) only; other conversations are left out before the walk."""
    own = messages.join(ids, "uuid", "left_semi").select("conv_uuid").distinct()
    return newest_leaf_per_node(messages.join(own, "conv_uuid", "left_semi")).join(ids, "uuid", "left_semi")


def paths_to(messages: DataFrame, wanted: DataFrame, large: int = LARGE) -> DataFrame:
    """Paths to the messages in (conv_uuid, leaf); an unknown leaf, or one of another conversation, has none."""
    many = large_ones(messages.join(wanted.select("conv_uuid").distinct(), "conv_uuid", "left_semi"), large)
    if many is not None:
        most = many.agg(F.max("n")).first()[0]
        of = lambda df, how: df.join(many, "conv_uuid", how)
        return paths_to(of(messages, "left_anti"), of(wanted, "left_anti"), most).unionByName(paths_by_doubling(of(messages, "left_semi"), of(wanted, "left_semi"), most))
    marked = slim(messages).join(wanted.select("conv_uuid", F.col("leaf").alias("uuid"), F.lit(True).alias("wanted")).distinct(), ["conv_uuid", "uuid"], "left")
    marked = marked.withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    return marked.groupBy("conv_uuid").applyInPandas(path_of, "conv_uuid string, leaf string, depth int, uuid string")


def default_paths(messages: DataFrame) -> DataFrame:
    """The path to each conversation's newest leaf; of a conversation without leaves all messages by position."""
    leaf = default_leaf(messages)
    found = paths_to(messages, leaf)
    bare = messages.join(found.select("conv_uuid").distinct(), "conv_uuid", "left_anti")
    order = Window.partitionBy("conv_uuid").orderBy("seq")
    rest = bare.select("conv_uuid", F.lit(None).cast("string").alias("leaf"), (F.row_number().over(order) - 1).alias("depth"), "uuid")
    return found.unionByName(rest)


def fork_siblings(messages: DataFrame) -> DataFrame:
    """(conv_uuid, parent_uuid, uuid, index, total): drafts of each slot with several, oldest first; heads are a slot."""
    slot = Window.partitionBy("conv_uuid", "parent_uuid")
    order = slot.orderBy(F.asc_nulls_last("created_at"), "seq")
    ranked = messages.select("conv_uuid", "parent_uuid", "uuid", "created_at", "seq", "text", F.row_number().over(order).alias("index"), F.count("*").over(slot).cast("int").alias("total"))
    return ranked.filter("total > 1")


def branch_nav(messages: DataFrame) -> DataFrame:
    """Drafts of the forks with a preview and the newest leaf of each."""
    nav = fork_siblings(messages).withColumn("preview", preview(F.col("text")))
    return nav.join(newest_leaf_per_node(messages), ["conv_uuid", "uuid"], "left").select("conv_uuid", "parent_uuid", "uuid", "index", "total", "preview", "leaf")


def branch_switchers(messages: DataFrame) -> DataFrame:
    """For each message of the default path at a fork: its place, and the newest leaves of the drafts beside it."""
    nav = branch_nav(messages)
    order = Window.partitionBy("conv_uuid", "parent_uuid").orderBy("index")
    beside = nav.withColumns({"previous_leaf": F.lag("leaf").over(order), "next_leaf": F.lead("leaf").over(order)})
    return beside.join(default_paths(messages).select("conv_uuid", "uuid"), ["conv_uuid", "uuid"], "left_semi").select("conv_uuid", "uuid", F.col("parent_uuid").alias("anchor"), "index", "total", "previous_leaf", "next_leaf")


def deep_links(hits: DataFrame, messages: DataFrame) -> DataFrame:
    """Hits (conv_uuid, msg_uuid) with the tip of the message's branch and whether that is off the default branch."""
    own = messages.join(hits.select("conv_uuid").distinct(), "conv_uuid", "left_semi")
    tips = newest_leaf_per_node(own).select(F.col("uuid").alias("msg_uuid"), F.col("leaf").alias("deep_leaf"))
    usual = default_leaf(own).withColumnRenamed("leaf", "usual")
    found = hits.join(tips, "msg_uuid", "left").join(usual, "conv_uuid", "left")
    return found.withColumn("side_branch", F.col("deep_leaf").isNotNull() & ~F.col("deep_leaf").eqNullSafe(F.col("usual"))).drop("usual")


def branch_count(messages: DataFrame) -> DataFrame:
    return leaves(messages).groupBy("conv_uuid").agg(F.count("*").alias("branches"))
