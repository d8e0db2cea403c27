"""Search by keywords, by trigrams and by vectors: hits of all fields, best hit of each conversation, pages."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from talkmill.functions.english import lexeme, lexemes
from talkmill.functions.text import cosine, tokens, trigrams
from talkmill.operators.browse import HIT_SORTS, date_window, sender_scope, sorted_page
from talkmill.sources.shared import cut, new_path

#: Boosts of title and summary; characters of tool text that are searched; characters of a snippet.
TITLE, SUMMARY, TITLE_FUZZY = 3.0, 2.0, 1.5
TOOL_CHARS, SNIPPET = 500_000, 300
#: Weight of a plain lexeme, and the sum of 1/k**2 over all k, to which a term's score is set in proportion.
WEIGHT, ZETA2 = 0.1, 1.64493406685
STRICT_LEAST, COSINE_LEAST = 0.5, 0.4
#: Places from which on two words add nothing to a score.
FAR = 100
#: Query vectors that go to all tasks at once, vectors that they meet at once, and queries of one product.
QUERIES, BLOCK, SLAB = 20_000, 1_000, 2_000
#: Results of a page; fields that a search looks through, by its mode; those of a search that names none that apply.
PER_PAGE = 50
FIELDS = {"word": ["title", "summary", "you", "assistant", "tools"], "char": ["title", "summary", "you", "assistant", "tools"], "semantic": ["you", "assistant"]}
DEFAULT_FIELDS = ["you", "assistant"]


@dataclass
class Query:
    """Clauses that all must hold; each is a list of alternatives, each of these a phrase of one or more words."""

    clauses: list[list[list[str]]] = field(default_factory=list)
    without: list[list[str]] = field(default_factory=list)


def parse_websearch(text: str) -> Query:
    """Words, "phrases", OR between two of them, and -negation. Words split as texts do; an OR at an end is ignored."""
    query, either = Query(), False
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if plain.lower() == "or" and not minus:
            either = bool(query.clauses)
            continue
        words = re.findall(r"[^\W_]+", (quoted or plain).lower())
        if not words:
            continue
        if minus:
            query.without.append(words)
        elif either:
            query.clauses[-1].append(words)
        else:
            query.clauses.append([words])
        either = False
    return query


def english(query: Query) -> Query:
    """The query in lexemes. Stop words ask for nothing: within a phrase they are places of any word, else they go."""

    def kept(phrase: list[str]) -> list[str]:
        own = [lexeme(w) for w in phrase]
        told = [i for i, w in enumerate(own) if w]
        return own[told[0] : told[-1] + 1] if told else []

    clauses = [[p for p in map(kept, clause) if p] for clause in query.clauses]
    return Query([c for c in clauses if c], [p for p in map(kept, query.without) if p])


def has_phrase(words: Column, phrase: list[str]) -> Column:
    """Whether the words stand next to each other somewhere in the array; '' in a phrase stands for any word."""
    found = F.array_contains(words, phrase[0])
    if len(phrase) == 1:
        return found

    def begins(i: Column) -> Column:
        out = F.lit(True)
        for j, word in enumerate(phrase):
            if word:
                out = out & F.coalesce(F.get(words, i + j) == word, F.lit(False))
        return out

    rest = F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - len(phrase), F.lit(0))), begins)
    return found & (F.size(words) >= len(phrase)) & rest


def matches(words: Column, query: Query) -> Column:
    """Whether an array of words satisfies the query; a query of negations only matches whatever lacks them."""
    out = F.lit(True)
    for clause in query.clauses:
        one = F.lit(False)
        for phrase in clause:
            one = one | has_phrase(words, phrase)
        out = out & one
    for phrase in query.without:
        out = out & ~has_phrase(words, phrase)
    return out if query.clauses or query.without else F.lit(False)


def places(words: Column, term: str) -> Column:
    """1-based positions of a word."""
    return F.filter(F.transform(words, lambda w, i: F.when(w == term, i + 1)), lambda i: i.isNotNull())


def nearness(a: np.ndarray, b: np.ndarray) -> float:
    """What is left of 1 after the pairs of places of two words, each taking the more the nearer they are.

    Pairs more than ``FAR`` places apart take less than a double can tell, so each place meets only those around it.
    """
    if len(a) > len(b):
        a, b = b, a
    low, high = np.searchsorted(b, a - FAR), np.searchsorted(b, a + FAR, side="right")
    left = 1.0
    for at in range(0, len(a), 100_000):
        n = (high - low)[at : at + 100_000]
        begins = np.repeat(low[at : at + 100_000] - (np.cumsum(n) - n), n)
        gaps = np.abs(np.repeat(a[at : at + 100_000], n) - b[begins + np.arange(n.sum())])
        left *= float(np.prod(1 - WEIGHT * np.sqrt(1.0 / (1.005 + 0.05 * np.exp(gaps / 1.5 - 2)))))
    return left


@F.pandas_udf(DoubleType())
def near_score(places: pd.Series) -> pd.Series:
    """The score of terms that all must hold, of their places in a text, by the distances of their occurrences."""
    out = []
    for own in places:
        left, own = 1.0, [] if own is None else [np.asarray(p, np.int64) for p in own]
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                left *= nearness(a, b)
        out.append(1 - left)
    return pd.Series(out, dtype="float64")


def often_score(counts: Column) -> Column:
    """What the occurrences of terms add up to, of how often each stands."""
    each = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, k: a + F.when(k <= n, 1.0 / (k * k).cast("double")).otherwise(F.lit(0.0)))
    return F.aggregate(counts, F.lit(0.0), lambda a, n: a + each(n))


def scored(places: Column, every: Column, terms: Column) -> Column:
    """Our fixed form of the relevance score, of the places of a query's terms in a text: terms that all must hold (``every``)
    combine over the distances of their occurrences, others add up by how often they stand, over the number of terms."""
    often = often_score(F.transform(places, lambda p: F.size(p))) * F.lit(WEIGHT / ZETA2) / F.greatest(terms, F.lit(1))
    return F.when(every, near_score(F.when(every, places))).otherwise(often)


def rank(words: Column, query: Query) -> Column:
    """The relevance score of an array of words."""
    terms = list(dict.fromkeys(w for clause in query.clauses for phrase in clause for w in phrase if w))
    own = F.array(*[places(words, t) for t in terms]).cast("array<array<int>>")
    if all(len(clause) == 1 for clause in query.clauses) and len(terms) > 1:
        return near_score(own)
    return often_score(F.transform(own, lambda p: F.size(p))) * (WEIGHT / ZETA2 / max(1, len(terms)))


def fan_out(messages: DataFrame, conversations: DataFrame, fields: set[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """(conv_uuid, msg_uuid, field, text) of all the fields asked for; titles and summaries ignore the dates."""
    scope, inside = sender_scope(fields), date_window(F.col("created_at"), start, end)
    parts = []
    if scope is not None:
        parts.append(F.when(scope & (F.col("text") != ""), F.struct(F.lit("prose").alias("field"), F.col("text").alias("text"))))
    if "tools" in fields:
        parts.append(F.when(F.col("tool_text").isNotNull(), F.struct(F.lit("tools").alias("field"), F.substring("tool_text", 1, TOOL_CHARS).alias("text"))))
    out = None
    if parts:  # one scan of the messages for both
        out = messages.filter(inside).select("conv_uuid", F.col("uuid").alias("msg_uuid"), F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).select("conv_uuid", "msg_uuid", "x.field", "x.text")
    own = [F.when(F.col(c).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(c).alias("text"))) for f, c in (("title", "name"), ("summary", "summary")) if f in fields]
    if own:
        told = conversations.select(F.col("uuid").alias("conv_uuid"), F.lit(None).cast("string").alias("msg_uuid"), F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("x")).select("conv_uuid", "msg_uuid", "x.field", "x.text")
        out = told if out is None else out.unionByName(told)
    return out


def boosted(score: Column, title: float, summary: float) -> Column:
    return score * F.when(F.col("field") == "title", title).when(F.col("field") == "summary", summary).otherwise(1.0)


def best_hits(hits: DataFrame) -> DataFrame:
    """Of each conversation the hit of the largest score; ties to title and summary, then the larger message uuid."""
    order = F.struct("score", F.col("msg_uuid").isNull(), F.coalesce("msg_uuid", "field"))
    best = hits.groupBy("conv_uuid").agg(F.max_by(F.struct("score", "msg_uuid", "field", "text"), order).alias("b"))
    return best.select("conv_uuid", "b.*")


def told_hits(hits: DataFrame, conversations: DataFrame) -> DataFrame:
    """The best hit of each conversation, with the conversation."""
    meta = conversations.select(F.col("uuid").alias("conv_uuid"), "name", "created_at", "updated_at", "n_messages")
    return best_hits(hits).join(meta, "conv_uuid")


def paged(hits: DataFrame, conversations: DataFrame, sort: str = "best", limit: int = 50, offset: int = 0) -> DataFrame:
    """Best hits with their conversations, one page of them."""
    return sorted_page(told_hits(hits, conversations), HIT_SORTS, sort, "best", "conv_uuid", limit, offset)


def written_forms(source: DataFrame, query: Query) -> dict[str, str]:
    """The words of the texts whose lexemes the query asks for, with these; each different word is stemmed once.

    The driver gets the spellings of a few lexemes only.
    """
    wanted = sorted({w for phrases in [*query.clauses, query.without] for phrase in phrases for w in (phrase if isinstance(phrase, list) else [phrase]) if w})
    words = source.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).distinct()
    told = words.withColumn("lexeme", F.get(lexemes(F.array("word")), F.lit(0))).filter(F.col("lexeme").isin(wanted))
    return {r.word: r.lexeme for r in told.collect()}


def fulltext_hits(source: DataFrame, query: Query, stemmed: bool = False) -> DataFrame:
    """Hits of the query, by words as they are written, or by English lexemes.

    For these the spellings of the query's lexemes are looked up first; texts are then matched by built-in expressions.
    """
    words = tokens(F.col("text"))
    if stemmed:
        query = english(query)
        forms = written_forms(source, query)
        told = F.create_map(*[F.lit(x) for pair in sorted(forms.items()) for x in pair]) if forms else F.create_map().cast("map<string,string>")
        words = F.transform(words, lambda w: F.coalesce(F.element_at(told, w), F.lit("")))
    words = source.withColumn("words", words).filter(matches(F.col("words"), query))
    return words.select("conv_uuid", "msg_uuid", "field", "text", boosted(rank(F.col("words"), query), TITLE, SUMMARY).alias("score"))


def covers(hits: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """The smallest stretches (first and last place) that hold all the words among ``hits`` (place, word), which are in order."""
    missing, left, out = len({w for _, w in hits}), 0, []
    held: dict[str, int] = {}
    for last, word in hits:
        held[word] = held.get(word, 0) + 1
        missing -= held[word] == 1
        while not missing:
            first, gone = hits[left]
            held[gone] -= 1
            left += 1
            if not held[gone]:
                out.append((first, last))
                missing = 1
    return out


def fragments_of(hits: list[tuple[int, str]], n: int, around: int, before: int, most: int) -> list[tuple[int, int]]:
    """Up to ``most`` stretches of ``around`` words from ``before`` words ahead of a cover on: of the shortest covers first, then of
    single hits; in the order of the text, without overlaps."""
    chosen: list[tuple[int, int]] = []
    for first, _ in chain(sorted(covers(hits), key=lambda c: (c[1] - c[0], c[0])), ((i, i) for i, _ in hits)):
        if len(chosen) == most:
            break
        if any(low <= first < high for low, high in chosen):
            continue
        begin = max(0, first - before)
        low = max([begin, *[h for _, h in chosen if h <= first]])
        high = min([n, begin + around, *[x for x, _ in chosen if x > first]])
        chosen.append((low, high))
    return sorted(chosen)


def snippet(text: str, wanted: set[str], stemmed: bool, around: int, before: int, most: int) -> str:
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    words = [text[a:b].lower() for a, b in spans]
    told = [lexeme(w) for w in words] if stemmed else words
    hits = [(i, w if w in wanted else t) for i, (w, t) in enumerate(zip(words, told, strict=True)) if w in wanted or t in wanted]
    marked = {i for i, _ in hits}
    parts = []
    for low, high in fragments_of(hits, len(spans), around, before, most):
        piece, at = "", spans[low][0]
        for j in range(low, high):
            a, b = spans[j]
            piece += text[at:a] + (f"[{text[a:b]}]" if j in marked else text[a:b])
            at = b
        parts.append(piece)
    return " … ".join(parts) if parts else " ".join(text[a:b] for a, b in spans[:around])


def headline(words_around: int = 22, least: int = 8, fragments: int = 2, stemmed: bool = False):
    """A pandas UDF (text, words) -> up to two fragments around matching words, which stand in [ ]; for one page only.

    Fragments show the shortest stretches with all the words that a text has. A null or empty text has an empty one.
    """

    @F.pandas_udf("string")
    def make(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([snippet(t, set(own), stemmed, words_around, least, fragments) if t else "" for t, own in zip(texts, wanted, strict=True)])

    return make


@lru_cache(maxsize=16)
def word_trigrams(text: str) -> list[tuple[str, bool, bool]]:
    """The trigrams of a text in order; whether each begins, and whether it ends, a word."""
    out = []
    for word in re.findall(r"[^\W_]+", text.lower()):
        padded = f"  {word} "
        n = len(padded) - 2
        out += [(padded[i : i + 3], i == 0, i == n - 1) for i in range(n)]
    return out


def word_similarities(query: str, text: str, least: float = STRICT_LEAST) -> tuple[float, float]:
    """The best overlap of the query's trigrams with a stretch of the text's: of whole words only, and of any; 0 below ``least``.

    One pass from the text's end to its beginning. The trigrams that follow a place are kept in the order of their next
    occurrence, up to as many as a stretch at ``least`` can have, so the work for a place doesn't grow with the text. Places
    are looked at only while enough of the query's trigrams are among these.
    """
    wanted, grams = {g for g, _, _ in word_trigrams(query)}, word_trigrams(text)
    if not wanted:
        return 0.0, 0.0
    ends = [i for i, (_, _, ends) in enumerate(grams) if ends]
    most, need = int(len(wanted) / least) + 1, ceil(least * len(wanted) - 1e-9)
    if len(wanted.intersection(g for g, _, _ in grams)) < need:
        return 0.0, 0.0
    ahead: list[str] = []
    places: list[int] = []
    strict = loose = 0.0
    inside = 0
    for i in range(len(grams) - 1, -1, -1):
        gram, begins, _ = grams[i]
        own = gram in wanted
        if gram in ahead:
            at = ahead.index(gram)
            del ahead[at], places[at]
        else:
            inside += own
        ahead.insert(0, gram)
        places.insert(0, i)
        if len(ahead) > most:
            inside -= ahead.pop() in wanted
            places.pop()
        if inside < need or not (own or begins):
            continue
        common, n = 0, len(ahead)
        for k in range(n):
            if ahead[k] in wanted:
                common += 1
                found = common / (len(wanted) + k + 1 - common)
                if own and found > loose:
                    loose = found
            elif not common:
                continue
            else:
                found = common / (len(wanted) + k + 1 - common)
            # a word must end before the next trigram that is new; the last one kept is beyond what can reach ``least``
            if begins and found > strict and (k + 1 < n or n < most):
                end = bisect_left(ends, places[k])
                if k + 1 == n or ends[end] < places[k + 1]:
                    strict = found
    return strict if strict >= least else 0.0, loose if loose >= least else 0.0


def similarities(query: str):
    """``word_similarities`` of a column of texts, as a pandas UDF of (strict, loose)."""

    @F.pandas_udf("strict double, loose double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([word_similarities(query, t or "") for t in texts], columns=["strict", "loose"], dtype="float64")

    return run


def fuzzy_hits(source: DataFrame, query: str) -> DataFrame:
    """Rows of strict word similarity of at least 0.5, by their plain word similarity.

    A text needs half of the query's trigrams at least; that is tested first, in built-in expressions.
    """
    grams = F.lit(sorted({g for g, _, _ in word_trigrams(query)}))
    enough = F.size(F.array_intersect(trigrams(F.col("text")), grams)) >= STRICT_LEAST * F.size(grams)
    near = source.filter(enough).withColumn("s", similarities(query)(F.col("text"))).filter(F.col("s.strict") >= STRICT_LEAST)
    return near.select("conv_uuid", "msg_uuid", "field", "text", boosted(F.col("s.loose"), TITLE_FUZZY, 1.0).alias("score"))


def semantic_hits(chunks: DataFrame, vectors: DataFrame, vector: list[float], fields: set[str], least: float = COSINE_LEAST, start: str | None = None, end: str | None = None) -> DataFrame:
    """Chunks whose vector's cosine is at least ``least``. Each distinct vector is scored once, before the join."""
    scope = sender_scope(fields)
    near = vectors.select("text_sha256", cosine(F.col("embedding"), F.lit(vector)).alias("score")).filter(F.col("score") >= least)
    own = chunks.filter(scope if scope is not None else F.lit(False)).filter(date_window(F.col("created_at"), start, end))
    return own.join(near, "text_sha256").select("conv_uuid", "msg_uuid", F.lit("prose").alias("field"), "text", "score")


def fuzzy_batch(source: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key, score) of a table (query_id, text) of fuzzy searches in texts (key, text); scores as in ``fuzzy_hits``.

    A text needs half of a query's trigrams at least, so it has one of the query's rarest: of half of them and one more. Only these
    are looked up; what is found must have enough trigrams in common before it is read. Long texts have many in common with any
    query, so pairs of them cost the most.
    """
    texts = cut(source.select("key", trigrams(F.col("text")).alias("grams")).filter(F.size("grams") > 0), "text-trigrams")
    posted = texts.select("key", F.explode("grams").alias("gram"))
    asked = queries.select("query_id", F.col("text").alias("query"), trigrams(F.col("text")).alias("wanted")).filter(F.size("wanted") > 0)
    every = asked.select("query_id", F.explode("wanted").alias("gram"))
    often = posted.join(every.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
    least = F.ceil(F.size("wanted") * F.lit(STRICT_LEAST)).cast("int")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")))
    rarest = every.join(often, "gram", "left").groupBy("query_id").agg(order.alias("o")).join(asked.select("query_id", least.alias("least")), "query_id")
    looked = rarest.select("query_id", F.explode(F.slice(F.col("o.gram"), F.lit(1), F.size("o") - F.col("least") + 1)).alias("gram"))
    met = looked.join(posted, "gram").select("query_id", "key").distinct()
    near = met.join(asked, "query_id").join(texts, "key").filter(F.size(F.array_intersect("wanted", "grams")) >= least).select("query_id", "query", "key")

    @F.pandas_udf("strict double, loose double")
    def both(asked_texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([word_similarities(q, t or "") for q, t in zip(asked_texts, found, strict=True)], columns=["strict", "loose"], dtype="float64")

    read = near.join(source.select("key", "text"), "key").select("query_id", "key", both("query", "text").alias("s"))
    return read.filter(F.col("s.strict") >= STRICT_LEAST).select("query_id", "key", F.col("s.loose").alias("score"))


def matrix_of(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length one, as rows, and which of all they are; null and zero vectors are left out."""
    known = np.flatnonzero(vectors.notna().to_numpy())
    rows = np.array([np.asarray(v, np.float64) for v in vectors.iloc[known]], np.float64)
    length = np.linalg.norm(rows, axis=1) if len(rows) else np.empty(0)
    good = length > 0
    return rows[good] / length[good, None], known[good]


def near_pairs(rows: np.ndarray, matrix: np.ndarray, rough: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows and queries (``matrix``, and the same in single precision) have a product of at least ``least``, and the products.

    Single precision finds those that may, with room for its error; these are computed anew in double precision.
    """
    own, room = rows.astype(np.float32), 1e-5 + 2.0**-22 * rows.shape[1]
    found = [(at, np.flatnonzero(own @ rough[at : at + SLAB].T >= np.float32(least - room))) for at in range(0, len(rough), SLAB)]
    wide = [min(SLAB, len(rough) - at) for at, _ in found]
    i = np.concatenate([x // n for (_, x), n in zip(found, wide, strict=True)])
    j = np.concatenate([x % n + at for (at, x), n in zip(found, wide, strict=True)])
    exact = np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", rows[i[k : k + SLAB]], matrix[j[k : k + SLAB]]) for k in range(0, len(i), SLAB)]])
    good = exact >= least
    return i[good], j[good], exact[good]


def semantic_batch(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, fields: set[str], least: float = COSINE_LEAST, start: str | None = None, end: str | None = None) -> DataFrame:
    """(query_id, conv_uuid, score, msg_uuid): the best chunk of each conversation for each query (query_id, embedding), of
    those whose cosine is at least ``least``; ties to the larger message uuid.

    The distinct vectors are written once. Up to ``QUERIES`` queries at a time go to all tasks as one matrix, which meets them in
    Arrow blocks; more are more passes, one after the other, so that the driver holds one matrix only. What is near meets the
    conversations by the vector's number, and each task keeps the best of a conversation before it sends anything. All vectors
    meet all queries, so the work grows with the product of both.
    """
    spark = vectors.sparkSession
    held = cut(vectors.filter("embedding is not null").select("text_sha256", "embedding"), "vectors")
    # numbers are those of a written table, so they stay the same
    numbered = cut(held.select("embedding").distinct().withColumn("vec", F.monotonically_increasing_id()), "distinct-vectors")
    texts = held.join(numbered, "embedding").select("text_sha256", "vec")
    asked = cut(queries.select("query_id", "embedding"), "queries")
    kind = asked.schema["query_id"].dataType.simpleString()
    parts = max(1, -(-asked.count() // QUERIES))
    path = new_path(spark, "near")
    schema = f"query_id {kind}, vec long, score double"
    for p in range(parts):
        told = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts).cast("long")) == p).toPandas()  # at most about ``QUERIES`` rows
        matrix, own = matrix_of(told["embedding"])
        ids, rough = told["query_id"].to_numpy()[own], matrix.astype(np.float32)

        def score(frames: Iterator[pd.DataFrame], matrix: np.ndarray = matrix, rough: np.ndarray = rough, ids: np.ndarray = ids) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame) if len(ids) else 0, BLOCK):
                    rows, known = matrix_of(frame["embedding"].iloc[at : at + BLOCK])
                    if len(rows):
                        i, j, exact = near_pairs(rows, matrix, rough, least)
                        yield pd.DataFrame({"query_id": ids[j], "vec": frame["vec"].to_numpy()[at + known[i]], "score": exact})

        numbered.select("vec", "embedding").mapInPandas(score, schema).write.mode("append").parquet(path)
    near = spark.read.schema(schema).parquet(path)
    scope = sender_scope(fields)
    rows = chunks.filter(scope if scope is not None else F.lit(False)).filter(date_window(F.col("created_at"), start, end)).select("text_sha256", "conv_uuid", "msg_uuid")
    # of a conversation's chunks with one vector only the last can be its best
    last = rows.join(texts, "text_sha256").groupBy("vec", "conv_uuid").agg(F.max("msg_uuid").alias("msg_uuid"))
    best = near.join(last, "vec").groupBy("query_id", "conv_uuid").agg(F.max(F.struct("score", "msg_uuid")).alias("b"))
    return best.select("query_id", "conv_uuid", "b.score", "b.msg_uuid")


def distinct_conversations(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count_distinct("conv_uuid").alias("n"))


def resolved(mode: str | None, fields: list[str] | None) -> tuple[str, set[str]]:
    """The mode, ``word`` for one that doesn't exist, and the fields that apply in it, or else the default ones."""
    mode = mode if mode in FIELDS else "word"
    applied = {f for f in fields or DEFAULT_FIELDS if f in FIELDS[mode]}
    return mode, applied or {f for f in DEFAULT_FIELDS if f in FIELDS[mode]}


def search_hits(messages: DataFrame, conversations: DataFrame, chunks: DataFrame, vectors: DataFrame, text: str, mode: str | None = None, fields: list[str] | None = None, start: str | None = None, end: str | None = None, vector: list[float] | None = None) -> DataFrame:
    """All hits of a search: by English words, by characters (trigrams) or by the vector of its text."""
    mode, fields = resolved(mode, fields)
    if mode == "semantic":
        return semantic_hits(chunks, vectors, vector, fields, start=start, end=end)
    source = fan_out(messages, conversations, fields, start, end)
    return fuzzy_hits(source, text) if mode == "char" else fulltext_hits(source, parse_websearch(text), stemmed=True)


def search_page(hits: DataFrame, conversations: DataFrame, text: str, mode: str | None = None, sort: str = "best", page: int = 1) -> DataFrame:
    """One page of the best hit of each conversation, with a snippet of its text: fragments around the matching words in
    word mode, the first ``SNIPPET`` characters else. Snippets are made of the page's rows only."""
    found = paged(hits, conversations, sort, PER_PAGE, (max(1, page) - 1) * PER_PAGE)
    if resolved(mode, None)[0] != "word":
        return found.withColumn("snippet", F.substring("text", 1, SNIPPET)).drop("text")
    terms = sorted({w for clause in english(parse_websearch(text)).clauses for phrase in clause for w in phrase if w})
    return found.withColumn("snippet", headline(stemmed=True)(F.col("text"), F.array(*[F.lit(w) for w in terms]).cast("array<string>"))).drop("text")


def total_pages(conversations: int) -> int:
    return -(-conversations // PER_PAGE)
