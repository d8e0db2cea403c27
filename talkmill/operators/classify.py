"""The layered classifier: keywords, date-routed topics, centroids. Each layer yields proposals of tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import word_pattern

#: Days of a window without an end, and the confidences of the layers.
OPEN_SPAN = 10**9
STRONG, PURPOSE, BODY, TOPIC = 0.9, 0.7, 0.75, 0.78
LEAST_BODIES, LEAST_TOPIC, LEAST_SIM = 3, 2, 0.6


@dataclass
class Seeds:
    """Seed words of one category and where its strong ones are looked for: title, meta or all."""

    slug: str
    strong: list[str]
    purpose: list[str]
    body: list[str]
    scope: str = "meta"
    date_start: str | None = None
    date_end: str | None = None


def in_window(day: Column, start: Column, end: Column) -> Column:
    """Inside a window with both ends; a window that lacks one never gates, a null day fails a bounded one."""
    return start.isNull() | end.isNull() | F.coalesce(day.between(start, end), F.lit(False))


def window_span(start: Column, end: Column) -> Column:
    return F.coalesce(F.date_diff(end, start), F.lit(OPEN_SPAN))


def gate(s: Seeds) -> Column:
    if not (s.date_start and s.date_end):
        return F.lit(True)
    return F.coalesce(F.to_date("created_at").between(F.lit(s.date_start).cast("date"), F.lit(s.date_end).cast("date")), F.lit(False))


def named(columns: list[str], terms: list[str]) -> Column:
    pattern = word_pattern(terms)
    if pattern is None:
        return F.lit(False)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return out


def keyword_proposals(conversations: DataFrame, messages: DataFrame, categories: list[Seeds]) -> DataFrame:
    """Proposals of the strong, purpose and body seeds of all categories, from one scan of each table.

    Strong and purpose seeds obey the category's dates, body seeds don't; those need three messages.
    """
    hits = []
    for s in categories:
        where = ["name"] if s.scope == "title" else ["name", "summary"]
        hits.append(F.when(named(where, s.strong) & gate(s), F.struct(F.lit(s.slug).alias("slug"), F.lit(STRONG).alias("confidence"), F.lit("keyword").alias("method"), F.lit(1).alias("pass"))))
        hits.append(F.when(named(["name", "summary"], s.purpose) & gate(s), F.struct(F.lit(s.slug).alias("slug"), F.lit(PURPOSE).alias("confidence"), F.lit("keyword-purpose").alias("method"), F.lit(2).alias("pass"))))
    out = conversations.select(F.col("uuid").alias("conv_uuid"), F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("conv_uuid", "h.*")
    bodies = [F.when(named(["text"], s.body), F.lit(s.slug)) for s in categories if s.body]
    if bodies:
        any_body = word_pattern([t for s in categories for t in s.body])
        met = messages.filter(F.col("text").rlike(any_body)).select("conv_uuid", F.explode(F.filter(F.array(*bodies), lambda h: h.isNotNull())).alias("slug"))
        met = met.groupBy("conv_uuid", "slug").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_BODIES)
        out = out.unionByName(met.select("conv_uuid", "slug", F.lit(BODY).alias("confidence"), F.lit("keyword").alias("method"), F.lit(3).alias("pass")))
    deep = [s for s in categories if s.scope == "all" and s.strong]
    if deep:
        some = [F.when(named(["text"], s.strong), F.lit(s.slug)) for s in deep]
        met = messages.filter(F.col("text").rlike(word_pattern([t for s in deep for t in s.strong]))).select("conv_uuid", F.explode(F.filter(F.array(*some), lambda h: h.isNotNull())).alias("slug")).distinct()
        gated = F.lit(False)
        for s in deep:
            gated = gated | ((F.col("slug") == s.slug) & gate(s))
        dated = met.join(conversations.select(F.col("uuid").alias("conv_uuid"), "created_at"), "conv_uuid").filter(gated)
        out = out.unionByName(dated.select("conv_uuid", "slug", F.lit(STRONG).alias("confidence"), F.lit("keyword").alias("method"), F.lit(1).alias("pass")))
    return out


def topic_outcomes(messages: DataFrame, conversations: DataFrame, tags: DataFrame, terms: list[str], routing: dict[str, str | None], windows: DataFrame) -> DataFrame:
    """(conv_uuid, outcome, slug): conversations with the vocabulary in two messages, by the day they began.

    ``routing`` names the slugs ``mid``, ``early`` and ``late`` and the day ``late_start``. In mid's window: mid; else in
    early's: early; from late_start on: late. Windows that lack an end never match here.
    """
    pattern = word_pattern(terms)
    met = messages.filter(F.col("text").rlike(pattern) if pattern else F.lit(False)).groupBy("conv_uuid").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_TOPIC)
    day = F.to_date("created_at")
    spans = {r.slug: (r.date_start, r.date_end) for r in windows.select("slug", "date_start", "date_end").collect()}  # the taxonomy is small

    def inside(slug: str | None) -> Column:
        a, b = spans.get(slug, (None, None))
        return F.coalesce(day.between(F.lit(a), F.lit(b)), F.lit(False)) if slug and a and b else F.lit(False)

    late = (day >= F.lit(routing["late_start"]).cast("date")) if routing.get("late") and routing.get("late_start") else F.lit(False)
    slug = F.when(inside(routing.get("mid")), routing.get("mid")).when(inside(routing.get("early")), routing.get("early")).when(late, routing.get("late"))
    dated = met.join(conversations.select(F.col("uuid").alias("conv_uuid"), "created_at"), "conv_uuid").select("conv_uuid", slug.alias("slug"))
    own = tags.select("conv_uuid", F.lit(True).alias("own")).distinct()
    told = dated.join(own, "conv_uuid", "left")
    outcome = F.when(F.col("own").isNotNull(), "already tagged").when(F.col("slug").isNull(), "out of window").otherwise("proposed")
    return told.select("conv_uuid", outcome.alias("outcome"), "slug")


def topic_proposals(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("outcome = 'proposed'").select("conv_uuid", "slug", F.lit(TOPIC).alias("confidence"), F.lit("topic").alias("method"), F.lit(1).alias("pass"))


def pass_counts(keywords: DataFrame, outcomes: DataFrame, decisions: DataFrame, slugs: list[str]) -> DataFrame:
    """(layer, what, n): conversations that the keyword layer matched, by category (0 where none), that the topic layer
    proposed, by category, or left, by reason, and that the semantic layer proposed, by category."""
    every = keywords.sparkSession.createDataFrame([(s,) for s in slugs], "what string")
    matched = keywords.groupBy(F.col("slug").alias("what")).agg(F.count_distinct("conv_uuid").alias("n"))
    keyword = every.join(matched, "what", "left").select(F.lit("keyword").alias("layer"), "what", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    routed = outcomes.select(F.lit("topic").alias("layer"), F.when(F.col("outcome") == "proposed", F.col("slug")).otherwise(F.col("outcome")).alias("what"))
    told = routed.unionByName(decisions.select(F.lit("semantic").alias("layer"), F.col("slug").alias("what")))
    return keyword.unionByName(told.groupBy("layer", "what").agg(F.count("*").alias("n")))


def seed_sets(tags: DataFrame) -> DataFrame:
    """Seeds of the centroids: tags given by keywords, topics or users."""
    return tags.filter(F.col("method").isin("keyword", "topic", "user")).select("conv_uuid", "slug").distinct()


def excluded(tags: DataFrame, curation: DataFrame) -> DataFrame:
    """Conversations that are no candidates: those with a tag that isn't semantic, and locked ones."""
    return tags.filter("method != 'semantic'").select("conv_uuid").union(curation.filter("locked").select("conv_uuid")).distinct()


def semantic_decisions(scores: DataFrame, conversations: DataFrame, taxonomy: DataFrame, split_groups: list[list[str]] | None = None) -> DataFrame:
    """(conv_uuid, slug, sim): the best category whose window holds the conversation's day, ties to the smaller slug.

    If it belongs to a split group, the group's eligible member with the narrowest window takes its place (ties to the
    order listed), with the group's best similarity. ``sim`` is rounded to four places.
    """
    groups = [(slug, g, i) for g, group in enumerate(split_groups or []) for i, slug in enumerate(group)]
    member = scores.sparkSession.createDataFrame(groups, "slug string, grp int, place int")
    kinds = taxonomy.select("slug", "date_start", "date_end").join(member, "slug", "left")
    dated = scores.join(conversations.select(F.col("uuid").alias("conv_uuid"), "created_at"), "conv_uuid").join(kinds, "slug")
    fit = dated.filter(in_window(F.to_date("created_at"), F.col("date_start"), F.col("date_end")))
    best = fit.groupBy("conv_uuid").agg(F.min_by(F.struct("slug", "grp", "sim"), F.struct(-F.col("sim"), "slug")).alias("b"))
    narrow = fit.filter("grp is not null").groupBy("conv_uuid", "grp").agg(F.min_by("slug", F.struct(window_span(F.col("date_start"), F.col("date_end")), "place")).alias("narrow"))
    out = best.select("conv_uuid", "b.*").join(narrow, ["conv_uuid", "grp"], "left")
    return out.select("conv_uuid", F.coalesce("narrow", "slug").alias("slug"), F.round("sim", 4).alias("sim"))


def semantic_proposals(decisions: DataFrame, taxonomy: DataFrame, threshold: float = LEAST_SIM) -> DataFrame:
    """Decisions that reach the category's own threshold, or the general one."""
    bars = taxonomy.select("slug", F.coalesce("semantic_threshold", F.lit(threshold)).alias("bar"))
    return decisions.join(bars, "slug").filter("sim >= bar").select("conv_uuid", "slug", F.col("sim").alias("confidence"), F.lit("semantic").alias("method"), F.lit(1).alias("pass"))
