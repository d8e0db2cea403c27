"""The queries of this subpackage, with their parameters for production, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm import bpe, decontaminate, langid, merkle, minhash, neighbours, periodic, pieces, pii, secrets, substrings, tokenfile, toxicity

#: The vocabulary files that the contracts name.
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: How often a passage of fewer than ``substrings.SURE_WORDS`` must stand to be reported.
COMMON = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word", "n_words")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"), common=COMMON).drop("text_hash")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def of_kind(kind: int, span: Column) -> Column:
    return span["kind"] == kind


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.found_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", partial(of_kind, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", partial(of_kind, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("lang")


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), check=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_neighbours": op2_neighbours,
    "op3_bpe": op3_bpe,
    "op4_substrings": op4_substrings,
    "op5_minhash": op5_minhash,
    "op6_secrets": op6_secrets,
    "op7_pii": op7_pii,
    "op8_tokenfile": op8_tokenfile,
    "op9_langid": op9_langid,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_periodic": op12_periodic,
    "op13_sentencepiece": op13_sentencepiece,
}
#: Every window of every document that shares a shingle with an item, compared with it exactly.
LEAKS_SQL = r"""
with items as (select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark where item_id is not null and text is not null),
sized as (select item_id, w, len(w) as l, least(len(w), 5) as k from items where len(w) > 0),
parts as (select item_id, l, k, unnest(list_transform(range(1, l - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as sh from sized),
counted as (select item_id, l, k, sh, count(*) as c from parts group by all),
docs as (select distinct doc_id, text as t, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where text is not null),
places as (select doc_id, t, len(w) as n, k, unnest(range(0, len(w) - k + 1)) as pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as sh
  from docs, (select distinct k from sized) where len(w) >= k),
hits as (select doc_id, t, n, pos, p.sh, item_id, l, p.k, c from places p join counted c on c.k = p.k and c.sh = p.sh),
starts as (select distinct doc_id, t, n, item_id, l, k, unnest(range(greatest(pos - (l - k), 0), least(pos, greatest(n - l, 0)) + 1)) as s from hits),
low as (select x.doc_id, x.t, x.n, x.item_id, x.l, x.k, s, sh, least(count(*), any_value(c)) as m from starts x join hits h on x.doc_id is not distinct from h.doc_id and x.t = h.t and x.item_id = h.item_id and pos between s and s + x.l - x.k group by x.doc_id, x.t, x.n, x.item_id, x.l, x.k, s, sh),
scored as (select doc_id, t, item_id, s, l, cast(sum(m) as double) / (least(n, l) - k + 1 + l - k + 1 - sum(m)) as similarity from low group by doc_id, t, n, item_id, l, k, s)
select doc_id, item_id, similarity, cast(s as int) as start_word, cast(l as int) as n_words
from (select *, row_number() over (partition by doc_id, t, item_id order by similarity desc, s) as r from scored where similarity >= 0.8 - 1e-9) where r = 1
"""

#: The weighted Jaccard of all texts that share a shingle, and the components of those at 0.8 or more.
CLASSES_SQL = r"""
with recursive texts as (select t, row_number() over (order by t) as id from (select distinct coalesce(text, '') as t from documents)),
words as (select id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') as w from texts),
places as (select id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i : i + least(len(w), 5) - 1], ' '))) as sh from words where len(w) > 0),
parts as (select id, sh, count(*) as times from places group by all),
sizes as (select id, sum(times) as n from parts group by id),
pairs as (select x.id as a, y.id as b, sum(least(x.times, y.times)) as c from parts x join parts y on x.sh = y.sh and x.id < y.id group by all),
links as (select a, b from pairs join sizes x on x.id = a join sizes y on y.id = b where c >= 0.8 * (x.n + y.n - c) - 1e-9),
ends as (select a, b from links union all select b, a from links),
reached as (select id as a, id as b from texts union select r.a, e.b from reached r join ends e on e.a = r.b),
labels as (select a as id, min(b) as label from reached group by a),
members as (select doc_id, label from documents join texts on t = coalesce(text, '') join labels using (id)),
classes as (select label, min(doc_id) as class_id, count(*) as class_size from members group by label)
select doc_id, class_id, class_size from members join classes using (label)
"""

#: Both tries level by level, and each leaf's way up, from the altered leaf and with what stands beside it.
MANIFEST_SQL = r"""
with recursive docs as (
  select row_number() over () as id, *, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)) as digits from documents),
crcs as (select *, xor(4294967295, list_reduce(digits, lambda a, b: list_reduce(range(8), lambda x, i: xor(x // 2, case when x % 2 = 1 then 3988292384 else 0 end), xor(a, b)), 4294967295)) as crc from docs),
told as (select id, doc_id, lang, crc,
    concat(coalesce(concat(strlen(cast(doc_id as varchar)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(cast(n_chars as varchar)), ':', n_chars), '-')) as own,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from crcs),
leaves as (select id, doc_id, coalesce('1' || lang, '0') as grp, sha256(own || coalesce(concat(strlen(text), ':', text), '-')) as leaf,
    case when doc_id is not null and crc % 3 = 0 then sha256(own || coalesce(concat(strlen(low), ':', low), '-')) end as altered from told),
ranked as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by grp) as n from leaves),
nodes as (
  select grp, 0 as lvl, idx, n, leaf as h from ranked
  union all
  select grp, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' order by idx)) from nodes where n > 1 group by grp, lvl, n, idx // 8),
runs as (select grp, lvl, idx // 8 as up, list(h order by idx) as hs from nodes where n > 1 group by grp, lvl, idx // 8),
subroots as (select grp, h as subroot, row_number() over (order by grp) - 1 as idx, count(*) over () as n from nodes where n = 1),
top_nodes as (
  select 0 as lvl, idx, n, subroot as h from subroots
  union all
  select lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' order by idx)) from top_nodes where n > 1 group by lvl, n, idx // 8),
top_runs as (select lvl, idx // 8 as up, list(h order by idx) as hs from top_nodes where n > 1 group by lvl, idx // 8),
walk as (
  select id, grp, 0 as lvl, idx, n, coalesce(altered, leaf) as h, '' as proof from ranked
  union all
  select id, grp, lvl + 1, idx // 8, (n + 7) // 8, sha256(array_to_string(hs[1 : idx % 8], '') || h || array_to_string(hs[idx % 8 + 2 : 8], '')), proof || array_to_string(hs[1 : idx % 8], '') || array_to_string(hs[idx % 8 + 2 : 8], '')
  from walk join runs using (grp, lvl) where n > 1 and up = idx // 8),
climbed as (select id, grp, h, proof from walk where n = 1),
top_walk as (
  select id, 0 as lvl, s.idx, s.n, h, proof from climbed join subroots s using (grp)
  union all
  select id, lvl + 1, idx // 8, (n + 7) // 8, sha256(array_to_string(hs[1 : idx % 8], '') || h || array_to_string(hs[idx % 8 + 2 : 8], '')), proof || array_to_string(hs[1 : idx % 8], '') || array_to_string(hs[idx % 8 + 2 : 8], '')
  from top_walk join top_runs using (lvl) where n > 1 and up = idx // 8),
root as (select h as root from top_nodes where n = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified
from ranked join subroots using (grp) join (select id, h, proof from top_walk where n = 1) using (id), root
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": LEAKS_SQL, "op5_minhash": CLASSES_SQL, "op11_merkle": MANIFEST_SQL}
