"""Operator 6: secret scans by fixed patterns and by two character Markov models. Built-in functions only.

Patterns give the base spans. Further tokens that look like keys are scored by the log-likelihood ratio of two
order-1 character models: one of random strings, trained from the values that the patterns find in all documents
(the labelled secrets), one of ordinary identifiers, trained from the words of a bounded sample of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import cut, only, sample, sized

# The patterns of the base kinds, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
#: A run shorter than 18 (16) characters fails as a whole, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: What the models look at: tokens of a key's alphabet; ordinary identifiers.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_-]{5,}"
#: Documents (those of the smallest hashes) that train the model of identifiers; letters of a key's alphabet;
#: pseudo-count of each pair; evidence needed, in all and for each character, in nats.
TRAIN_DOCS, ALPHABET, PSEUDO = 2000, 66, 0.5
EVIDENCE, EVIDENCE_EACH = 12.0, 0.5
MASK = "[SECRET]"
GATHERED = 100
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Leftmost non-overlapping matches, as spans in code points. ``value`` is the group that holds the value.

    Spark gives no positions; the lengths of the gaps between the matches and of the matches add up to them.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("values"))

    def place(p: Column) -> Column:
        each = F.transform(p["found"], lambda m, i: F.struct(F.length(F.get(p["gaps"], i)).alias("gap"), F.length(m).alias("own"), F.get(p["values"], i).alias("value")))
        zero = lambda at: F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["own"]).alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["own"]).alias("end"), x["value"].alias("value")))).alias("out"))
        # spans are gathered by the hundred, since an array that grows by one is copied each time
        parts = lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / GATHERED).cast("int")), lambda k: F.slice(e, k * GATHERED + 1, GATHERED))
        grow = lambda acc, part: F.transform(F.array(F.aggregate(part, zero(acc["at"]), step)), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]
        return F.transform(F.array(each), lambda e: F.when(F.size(e) > 0, F.flatten(F.aggregate(parts(e), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), grow)["out"])).otherwise(F.array().cast(SPAN)))[0]

    return F.when(text.rlike(pattern), F.transform(F.array(parts), place)[0]).otherwise(F.array().cast(SPAN))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, other) of each row: base spans in order, and tokens that lie in none of them."""
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, doc_id="long", text="string").select("doc_id", text.alias("text"))
    assign = F.filter(matches(F.col("text"), ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    found = F.concat(assign, matches(F.col("text"), ACCESS, 1), matches(F.col("text"), HEX, 2))
    in_order = lambda spans: F.array_sort(spans, lambda x, y: F.when(F.struct(x["start"], x["kind"]) < F.struct(y["start"], y["kind"]), -1).when(F.struct(x["start"], x["kind"]) > F.struct(y["start"], y["kind"]), 1).otherwise(0))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").alias("n"), in_order(found).alias("base"), matches(F.col("text"), CANDIDATE, 3).alias("other"))
    apart = F.filter("other", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return rows.select("doc_id", "text_hash", "base", apart.alias("other"))


def pairs(words: DataFrame) -> DataFrame:
    """(pair) of each two neighbouring characters in each row's ``value``."""
    return words.filter(F.length("value") > 1).select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))).alias("pair"))


def trained(secrets: DataFrame, words: DataFrame) -> DataFrame:
    """(first, second, weight): the log-likelihood ratio of each pair of characters; second is null for any other one.

    The table is bounded by the square of the alphabet.
    """
    both = pairs(secrets.select("value", F.lit(1).alias("own"))).unionByName(pairs(words.select("value", F.lit(0).alias("own"))))
    counts = both.groupBy("pair").agg(F.sum("own").alias("random"), F.sum(1 - F.col("own")).alias("plain")).select(F.substring("pair", 1, 1).alias("first"), F.substring("pair", 2, 1).alias("second"), "random", "plain")
    counts = counts.unionByName(counts.groupBy("first").agg(F.lit(None).cast("string").alias("second"), F.lit(0).cast("bigint").alias("random"), F.lit(0).cast("bigint").alias("plain")))
    totals = counts.groupBy("first").agg(F.sum("random").alias("all_random"), F.sum("plain").alias("all_plain"))
    share = lambda n, total: (F.col(n) + PSEUDO) / (F.col(total) + PSEUDO * ALPHABET)
    return counts.join(totals, "first").select("first", "second", F.log(share("random", "all_random") / share("plain", "all_plain")).alias("weight"))


def likely(tokens: DataFrame, model: DataFrame) -> DataFrame:
    """(value, evidence): the distinct tokens that look random."""
    seen = model.filter("second is not null").select(F.concat("first", "second").alias("pair"), "weight")
    unseen = model.filter("second is null").select("first", F.col("weight").alias("other"))
    each = pairs(tokens.select("value").distinct()).join(F.broadcast(seen), "pair", "left").withColumn("first", F.substring("pair", 1, 1)).join(F.broadcast(unseen), "first", "left")
    sums = each.groupBy("value").agg(F.sum(F.coalesce("weight", "other", F.lit(0.0))).alias("evidence"))
    return sums.filter(F.col("evidence") >= F.greatest(F.lit(EVIDENCE), EVIDENCE_EACH * F.length("value")))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def found_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row: doc_id, text_hash, base and spans (arrays of kind, start, end, value, in order).

    A null text counts as empty and has none; repeated rows give repeated rows; a null doc_id stays null; other
    columns are left out. An empty table gives no rows.
    """
    scan = cut(scanned(docs), "secrets")
    secrets = scan.select(F.explode("base").alias("s")).select("s.value")
    few = sample(only(docs, text="string").dropna().filter("text != ''"), F.col("text"), TRAIN_DOCS)
    # copies hash alike: they count once
    words = few.dropDuplicates(["text"]).select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("value")).filter(~F.col("value").rlike(r"[0-9a-f]{16}"))
    tokens = scan.filter(F.size("other") > 0).select("doc_id", "text_hash", F.explode("other").alias("o")).select("doc_id", "text_hash", "o", F.col("o.value").alias("value"))
    random = cut(likely(tokens, cut(trained(secrets, words), "markov")), "random")
    more = tokens.distinct().join(sized(random), "value").groupBy("doc_id", "text_hash").agg(F.collect_list("o").alias("more"))
    more = cut(more, "more").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "more")
    both = scan.join(sized(more), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    key = lambda x: F.struct(x["start"], x["kind"])
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))), lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0))
    return both.select("doc_id", "text_hash", "base", spans.alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in its text replaced by ``MASK`` (and n_chars set anew, where there is one).

    All rows stay; null and empty texts as they are; rows equal in doc_id and text are masked alike.
    """
    spans = found_secrets(docs).filter(F.size("spans") > 0).groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(F.first("spans").alias("found_spans"))
    spans = cut(spans, "masks")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("own_hash"))
    joined = whole.join(sized(spans), F.col("own_id").eqNullSafe(F.col("found_id")) & (F.col("own_hash") == F.col("found_hash")), "left")
    text = F.col("row.text")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).alias("parts"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))
    done = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text) - acc["at"]))
    new = F.when(F.col("found_spans").isNull(), text).otherwise(F.aggregate("found_spans", zero, step, done))
    out = joined.select("row", new.alias("new_text"))
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("new_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("new_text").isNull(), F.col("row.n_chars")).otherwise(F.length("new_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[columns[c].alias(c) for c in docs.columns])
