"""Operator 11: a Merkle manifest of a dataset, as a trie over the ranks of its rows.

Ranks need no global sort. A digit of a doc_id is 12 of its bits; histograms of the leading digits, from the finest
buckets (of ``2**LOW`` ids) up to the first digit, are sums of one another, and a bucket's first rank is what stands before it
under its own parent, plus the parent's first rank. Within a bucket rows are ranked among themselves.

A rank written in base ``FANOUT`` is a path in the trie of its group. Nodes are reduced by their longest prefixes first: a
pass takes the nodes that share all but the last ``STEPS`` digits, which are at most ``FANOUT ** STEPS``, and leaves one node
in place of them; passes go on until each group has one. Proofs come down the same way: each node hands its children
their siblings and its own proof.

Nothing larger than such a block is ever held by a task. Rows equal in all columns are one row with a count, so many
copies are a range of ranks, cut at the blocks' borders. The groups themselves (languages, some thousands at most by
their nature) are ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import cut, only

#: Nodes that become one, digits of a rank that a pass reduces, and nodes of a block.
FANOUT, STEPS = 8, 3
BLOCK = FANOUT**STEPS
#: Bits of an id within the finest bucket, of a digit above it, and of an id.
LOW, DIGIT, BITS = 8, 12, 64
#: Bits that a shift by a block takes off a rank.
SHIFT = BLOCK.bit_length() - 1
PATH = "array<struct<before:string,after:string>>"


def told(value: Column) -> Column:
    """``-`` for null, else its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(told, values)), 256)


def lowered(text: Column) -> Column:
    """With A to Z in lower case, and no other letter changed."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, altered, copies): each different row of ``docs``; altered is the leaf after tampering, or null."""
    rows = only(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = rows.select(
        F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("grp"),
        "doc_id",
        F.unhex(leaf(*own, F.col("text"))).alias("leaf"),
        F.when(tampered, F.unhex(leaf(*own, lowered(F.col("text"))))).alias("altered"),
    )
    return made.groupBy("grp", "doc_id", "leaf", "altered").agg(F.count("*").alias("copies"))


def bucket_starts(nodes: DataFrame) -> DataFrame:
    """(grp, bucket, start, n): the first rank of each bucket of ids in its group, and the group's rows."""
    finest = nodes.groupBy("grp", F.shiftright("key", LOW).alias("d")).agg(F.sum("copies").alias("n"))
    levels = [cut(finest, "digits")]
    for _ in range(LOW + DIGIT, BITS, DIGIT):
        levels.append(levels[-1].groupBy("grp", F.shiftright("d", DIGIT).alias("d")).agg(F.sum("n").alias("n")))

    def before(*parent: Column) -> Column:
        over = Window.partitionBy("grp", *parent).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(over), F.lit(0))

    total = levels[-1].groupBy("grp").agg(F.sum("n").alias("total"))
    known = levels[-1].withColumn("start", before()).join(total, "grp").select("grp", F.col("d").alias("up"), "start", "total")
    for level in reversed(levels[:-1]):
        own = level.withColumn("up", F.shiftright("d", DIGIT)).withColumn("inner", before(F.col("up")))
        known = own.join(known, ["grp", "up"]).select("grp", F.col("d").alias("up"), (F.col("start") + F.col("inner")).alias("start"), "total")
    return known.withColumnRenamed("up", "bucket")


def ranked(found: DataFrame) -> DataFrame:
    """(grp, total, first, copies, doc_id, leaf, altered): ranks by doc_id, nulls first, then by leaf."""
    nodes = found.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    starts = cut(bucket_starts(nodes), "bucket-starts")
    order = Window.partitionBy("grp", "bucket").orderBy(F.asc_nulls_first("doc_id"), "leaf").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.withColumn("bucket", F.shiftright("key", LOW)).withColumn("inner", F.coalesce(F.sum("copies").over(order), F.lit(0)))
    return placed.join(starts, ["grp", "bucket"]).select("grp", "total", (F.col("start") + F.col("inner")).alias("first"), "copies", "doc_id", "leaf", "altered")


def blocks(rows: DataFrame) -> DataFrame:
    """(grp, total, block, items): the rows of each block, in order, each copy by itself; an item has doc_id, leaf and altered."""
    last = F.col("first") + F.col("copies") - 1
    parts = rows.withColumn("block", F.explode(F.sequence(F.shiftright("first", SHIFT), F.shiftright(last, SHIFT))))
    low, high = F.greatest("first", F.col("block") * BLOCK), F.least(last, F.col("block") * BLOCK + BLOCK - 1)
    item = F.struct(low.alias("at"), (high - low + 1).cast("int").alias("times"), "doc_id", "leaf", "altered")
    held = parts.groupBy("grp", "total", "block").agg(F.array_sort(F.collect_list(item)).alias("r"))
    copies = F.transform("r", lambda x: F.array_repeat(F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), x["altered"].alias("altered")), x["times"]))
    return held.select("grp", "total", "block", F.flatten(copies).alias("items"))


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def parents(nodes: Column) -> Column:
    """The hashes of every ``FANOUT`` consecutive nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def levels(held: DataFrame) -> DataFrame:
    """``held`` (l0, and m, the nodes of its group) with l1, l2 ...: null where the group needs no such level; and ``top``."""
    for k in range(STEPS):
        held = held.withColumn(f"l{k + 1}", F.when(F.col("m") > FANOUT**k, parents(F.col(f"l{k}"))))
    tops = [F.get(f"l{k}", F.lit(0)) for k in range(STEPS, -1, -1)]
    return held.withColumn("top", F.coalesce(*tops))


def siblings(j: Column) -> Column:
    """The path of node ``j`` of a block up to the block's top: what stands before and after it in its run, by level."""
    steps = []
    for k in range(STEPS):
        at = F.floor(j / FANOUT**k).cast("int")
        begin = F.floor(at / FANOUT).cast("int") * FANOUT
        nodes = F.col(f"l{k}")
        step = F.struct(F.array_join(F.slice(nodes, begin + 1, at - begin), "").alias("before"), F.array_join(F.slice(nodes, at + 2, begin + FANOUT - 1 - at), "").alias("after"))
        steps.append(F.when(F.col("m") > FANOUT**k, step))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def raised(held: DataFrame, most: int) -> list[DataFrame]:
    """Passes (grp, total, block, l0 ..., top) over ``held``, until each group, of ``most`` nodes at most, is one node."""
    passes = [held]
    while most > BLOCK:
        most = -(-most // BLOCK)
        below = passes[-1]
        node = F.struct(F.col("block").alias("at"), "top")
        above = below.groupBy("grp", "total", F.shiftright("block", SHIFT).alias("above")).agg(F.array_sort(F.collect_list(node))["top"].alias("l0"))
        nodes = F.ceil(F.col("total") / F.lit(BLOCK ** len(passes)).cast("double")).cast("long")
        passes.append(cut(levels(above.withColumnRenamed("above", "block").withColumn("m", nodes)), "trie"))
    return passes


def lowered_paths(passes: list[DataFrame], paths: DataFrame) -> DataFrame:
    """(grp, block, path): from each block of the first pass up to the root, given the ``path`` above each group."""
    known = paths.select("grp", F.lit(0).cast("long").alias("block"), "path")
    for held in reversed(passes[1:]):
        own = F.transform("l0", lambda _, j: F.struct((F.col("block") * BLOCK + j).alias("block"), F.concat(siblings(j), F.col("path")).alias("path")))
        known = held.join(known, ["grp", "block"]).select("grp", F.explode(own).alias("x")).select("grp", "x.block", "x.path")
    return known


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified): a row for each row of ``docs``.

    Leaves of a language ascend by doc_id, nulls first, and by leaf where a doc_id repeats; a null language is a group of
    its own, the first one. Rows equal in all columns are leaves of their own, next to each other. A null doc_id is never
    tampered with; null texts stay null. Only doc_id, source, lang, n_chars and text count, whatever other columns there
    are. An empty table gives no rows.
    """
    rows = ranked(cut(leaves(docs), "leaves"))
    found = blocks(rows).withColumns({"m": F.col("total"), "l0": F.transform("items", lambda x: as_text(x["leaf"]))})
    held = cut(levels(found), "trie")
    most = held.agg(F.max("total")).first()[0] or 0
    passes = raised(held, most)
    # the groups' own trie: one group, of as many nodes as there are languages
    whole = Window.orderBy("grp")
    subroots = cut(passes[-1].select("grp", F.col("top").alias("subroot")), "subroots")
    ranks = subroots.withColumn("rank", F.row_number().over(whole) - 1)
    groups = cut(ranks.withColumns({"name": F.col("grp"), "block": F.shiftright("rank", SHIFT).cast("long")}), "groups")
    langs = groups.count()
    node = F.struct("rank", "subroot", "name")
    top = groups.groupBy(F.lit("").alias("grp"), F.lit(langs).cast("long").alias("total"), "block").agg(F.array_sort(F.collect_list(node)).alias("r"))
    tops = raised(cut(levels(top.select("grp", "total", "block", "r", F.col("total").alias("m"), F.col("r.subroot").alias("l0"))), "trie"), langs)
    above = lowered_paths(tops, tops[-1].select("grp", F.array().cast(PATH).alias("path")))
    named = F.transform("r", lambda x, j: F.struct(x["name"].alias("name"), x["subroot"].alias("subroot"), F.concat(siblings(j), F.col("path")).alias("path")))
    root = tops[-1].select("top").first()  # one row, or none
    told_groups = tops[0].join(above, ["grp", "block"]).select(F.explode(named).alias("x"))
    known = cut(told_groups.select(F.col("x.name").alias("grp"), "x.subroot", "x.path", F.lit(root.top if root else None).cast("string").alias("root")), "group-paths")
    down = lowered_paths(passes, known)

    def proven(x: Column, j: Column) -> Column:
        path = F.concat(siblings(j), F.col("path"))
        own = as_text(F.coalesce(x["altered"], x["leaf"]))
        folded = F.aggregate(path, own, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
        proof = F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)
        return F.struct(x["doc_id"].alias("doc_id"), as_text(x["leaf"]).alias("leaf"), proof.alias("proof_sha256"), folded.alias("folded_root"))

    made = held.join(down, ["grp", "block"]).select("grp", F.explode(F.transform("items", proven)).alias("x"))
    full = made.join(known.select("grp", "subroot", "root"), "grp")
    lang = F.when(F.col("grp") != "0", F.substring("grp", 2, 2**31 - 1))
    return full.select("x.doc_id", lang.alias("lang"), "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("root")).alias("verified"))
