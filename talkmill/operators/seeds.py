"""Seed words of many categories, found by one automaton: a single pass over each text for all categories and layers.

Built-in patterns (``classify.keyword_proposals``) look at a text once for each category and layer, which suits a few categories. The
automaton's time for a text hardly depends on how many words it knows.
"""

from __future__ import annotations

import unicodedata
from functools import cached_property

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.operators.classify import BODY, LEAST_BODIES, PURPOSE, STRONG, Seeds

LAYERS = ("strong", "purpose", "body")


class Folded(dict):
    """Each letter as either case of it is compared: lower case of upper case, where both are one letter."""

    def __missing__(self, code: int) -> int:
        upper = chr(code).upper()
        upper = upper if len(upper) == 1 else chr(code)
        lower = upper.lower()
        self[code] = found = ord(lower) if len(lower) == 1 else ord(upper)
        return found


class WordLetters(dict):
    """Whether a character is part of a word: letters, digits, marks, connectors and joiners."""

    def __missing__(self, c: str) -> bool:
        self[c] = found = c.isalnum() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Pc", "Nl") or c in "‌‍"
        return found


class Automaton:
    """All seeds as whole words in either case; a group is a category and a layer, 3 * category + layer."""

    def __init__(self, categories: list[Seeds]):
        words = WordLetters()
        groups: dict[str, set[int]] = {}
        for i, s in enumerate(categories):
            for k, layer in enumerate(LAYERS):
                for term in getattr(s, layer):
                    # a term must begin and end with a word's letter to match at all
                    if term and words[term[0]] and words[term[-1]]:
                        groups.setdefault(term.translate(Folded()), set()).add(3 * i + k)
        self.groups = {t: (len(t), tuple(sorted(g))) for t, g in groups.items()}

    def __getstate__(self) -> dict:
        return {"groups": self.groups}  # workers build the automaton themselves

    @cached_property
    def machine(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for term, told in self.groups.items():
            made.add_word(term, told)
        made.make_automaton()
        return made

    @cached_property
    def tables(self) -> tuple[Folded, WordLetters]:
        return Folded(), WordLetters()

    def found(self, text: str | None) -> list[int]:
        """The groups that have a word in the text."""
        if not text or not self.groups:
            return []
        folded, words = self.tables
        low, out = text.translate(folded), set()
        for end, (n, groups) in self.machine.iter(low):
            begin = end - n + 1
            if (begin == 0 or not words[low[begin - 1]]) and (end + 1 == len(low) or not words[low[end + 1]]):
                out.update(groups)
        return sorted(out)


def groups_of(automaton: Automaton):
    """A pandas UDF: the groups of each text."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(automaton.found)

    return run


def seed_proposals(conversations: DataFrame, messages: DataFrame, categories: list[Seeds]) -> DataFrame:
    """The different proposals (conv_uuid, slug, confidence, method, pass) of the strong, purpose and body seeds of all categories.

    The rules are those of ``classify.keyword_proposals``; a null or empty text has no seeds.
    """
    spark = conversations.sparkSession
    automaton = Automaton(categories)
    look = groups_of(automaton)
    rows = [(i, s.slug, s.scope, s.date_start, s.date_end) for i, s in enumerate(categories)]
    known = F.broadcast(spark.createDataFrame(rows, "category int, slug string, scope string, date_start string, date_end string"))  # the taxonomy
    dates = F.col("date_start").isNull() | F.col("date_end").isNull() | (F.col("date_start") == "") | (F.col("date_end") == "")
    gated = dates | F.coalesce(F.to_date("created_at").between(F.to_date("date_start"), F.to_date("date_end")), F.lit(False))

    def told(df: DataFrame, group: Column) -> DataFrame:
        return df.withColumns({"category": F.floor(group / 3).cast("int"), "layer": group % 3}).join(known, "category")

    fields = F.array(*[F.struct(F.lit(c == "name").alias("title"), look(c).alias("groups")) for c in ("name", "summary")])
    met = conversations.select(F.col("uuid").alias("conv_uuid"), "created_at", F.explode(fields).alias("f")).select("conv_uuid", "created_at", "f.title", F.explode("f.groups").alias("group"))
    met = told(met, F.col("group")).filter(gated & (F.col("layer") < 2) & ((F.col("layer") == 1) | F.col("title") | (F.col("scope") != "title")))
    strong = F.col("layer") == 0
    first = met.select("conv_uuid", "slug", F.when(strong, STRONG).otherwise(PURPOSE).alias("confidence"), F.when(strong, "keyword").otherwise("keyword-purpose").alias("method"), F.when(strong, 1).otherwise(2).alias("pass"))
    said = told(messages.select("conv_uuid", F.explode(look("text")).alias("group")), F.col("group"))
    said = said.filter((F.col("layer") == 2) | ((F.col("layer") == 0) & (F.col("scope") == "all"))).groupBy("conv_uuid", "slug", "layer", "date_start", "date_end").agg(F.count("*").alias("n"))
    bodies = said.filter((F.col("layer") == 2) & (F.col("n") >= LEAST_BODIES)).select("conv_uuid", "slug", F.lit(BODY).alias("confidence"), F.lit("keyword").alias("method"), F.lit(3).alias("pass"))
    deep = said.filter("layer = 0").join(conversations.select(F.col("uuid").alias("conv_uuid"), "created_at"), "conv_uuid").filter(gated)
    deep = deep.select("conv_uuid", "slug", F.lit(STRONG).alias("confidence"), F.lit("keyword").alias("method"), F.lit(1).alias("pass"))
    return first.unionByName(bodies).unionByName(deep).distinct()
