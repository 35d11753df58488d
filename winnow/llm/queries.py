"""The registered queries of the training-data operators and, where SQL can say them, their SQL twins.

Each takes (spark, folder) and applies its operator, with production parameters, to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import conversation_trie, decontaminate, fingerprints, html_text, jaccard_join, langid, licenses, line_dedup, packing, quality, suffix_dedup, unit_dedup, whitening
from winnow.llm.frames import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out), sample_key=F.col("doc_id"))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_quality_knn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    rows = quality.labelled(docs, table(spark, folder, "labels"), ~held_out, "doc_id", "text", "quality", quality.FIT_ROWS)
    found = quality.score(docs, quality.fit(rows))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query
def op3_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.remove_boilerplate(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op3_line_spread"] = f"""
with parts as (
  select doc_id, source, string_split(text, chr(10)) as ls from documents where text is not null),
lines as (
  select doc_id, source, ls[p] as line, p from (select doc_id, source, ls, unnest(range(1, len(ls) + 1)) as p from parts)),
wide as (
  select trim(line) as t, min(doc_id) as doc_id from lines where trim(line) <> ''
  group by 1 having count(distinct source) >= {line_dedup.MIN_SITES}),
top as (
  select w.t, w.doc_id, min(l.p) as p from wide w join lines l on l.doc_id = w.doc_id and trim(l.line) = w.t group by 1, 2),
marked as (
  select l.*, w.t is not null and not exists (select 1 from top o where o.t = w.t and o.doc_id = l.doc_id and o.p = l.p) as gone
  from lines l left join wide w on w.t = trim(l.line)),
kept as (
  select doc_id, cast(count(*) as int) as n_lines, cast(count(*) filter (where gone) as int) as n_removed,
         coalesce(string_agg(line, chr(10) order by p) filter (where not gone), '') as body
  from marked group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
       case when d.text is null then null else sha256(body) end as kept_sha256
from documents d left join kept using (doc_id)
"""


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query
def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, folder, "documents"), k=3, percent=90)


ORACLES["op5_ngram_jaccard"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
runs as materialized (
  select distinct doc_id, s from (
    select doc_id, array_to_string(w[p : p + 2], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from words where len(w) >= 3)
    union all select doc_id, array_to_string(w, ' ') from words where len(w) in (1, 2))),
sizes as materialized (select doc_id, count(*) as n from runs group by 1),
common as materialized (select a.doc_id as a, b.doc_id as b, count(*) as c from runs a join runs b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as materialized (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
reached(doc_id, other) as (
  select doc_id, doc_id from documents union select reached.doc_id, links.b from reached join links on links.a = reached.other)
select r.doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id from reached r left join sizes using (doc_id) group by r.doc_id
"""


@query
def op6_syncmer_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_study(table(spark, folder, "documents"))


@query
def op8_containment_search(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "matched", "containment")


ORACLES["op8_containment_search"] = rf"""
with words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') as w from documents
  union all
  select 'i', item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') from benchmark),
lengths as (select distinct least(len(w), {decontaminate.WORDS}) as k from words where kind = 'i' and len(w) > 0),
runs as (
  select distinct kind, id, k, array_to_string(w[p : p + k - 1], ' ') as s
  from (select kind, id, k, w, unnest(range(1, len(w) - k + 2)) as p from words, lengths
        where kind = 'd' or least(len(w), {decontaminate.WORDS}) = k)),
items as (select id, k, s, count(*) over (partition by id) as n from runs where kind = 'i')
select d.id as doc_id, i.id as item_id, cast(i.n as int) as n_shingles, cast(count(*) as int) as matched, count(*) / cast(i.n as double) as containment
from items i join runs d on d.kind = 'd' and d.k = i.k and d.s = i.s
group by d.id, i.id, i.n having count(*) >= ceil({decontaminate.CONTAINMENT} * i.n - 1e-9)
"""


@query
def op7_unit_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return unit_dedup.repeated_units(table(spark, folder, "documents"))


@lru_cache(maxsize=1)
def word_bpe():
    """The public tokenizer that sequences are packed with; a worker keeps it, and the words it knows, for its tasks."""
    import public_tokenizers

    return packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), word_bpe)


@query
def op9_suffix_intervals(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.repeats_removed(table(spark, folder, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op12_exact_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    paths = conversation_trie.paths_of(table(spark, folder, "conversations"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return conversation_trie.trie(conversation_trie.grafted(paths, F.col("conv_id") - F.col("conv_id") % 20, heads, most=3))


ORACLES["op13_conversation_trie"] = r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, '')) as p,
         struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as t
  from conversations where conv_id is not null),
sizes as (
  select conv_id, max(p) as n,
         xor(list_reduce([4294967295] || list_transform(range(1, length(cast(conv_id as varchar)) + 1), lambda i: cast(ord(cast(conv_id as varchar)[i]) as bigint)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 as h
  from turns group by conv_id),
rebuilt as (
  select s.conv_id, t.p as o, 0 as own, t.t from sizes s join turns t on t.conv_id = s.conv_id - s.conv_id % 20 and t.p <= s.h
  union all
  select s.conv_id, t.p, 1, t.t from sizes s join turns t on t.conv_id = s.conv_id and t.p > s.h),
paths as (select s.conv_id, coalesce(list(r.t order by r.own, r.o) filter (where r.t is not null), []) as path from sizes s left join rebuilt r using (conv_id) group by s.conv_id),
prefixes as (select conv_id, path, d, path[1 : d] as pre from (select conv_id, path, unnest(range(0, len(path) + 1)) as d from paths)),
nodes as materialized (
  select d, pre, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where len(path) = d), '')) as ends,
         case when d = 0 then 0 else len(regexp_extract_all(pre[d].text, '[^ 	-
]+')) end as words
  from prefixes group by d, pre),
linked as (
  select n.*, u.conv_id as up, (select count(*) from nodes c where c.d = n.d + 1 and c.pre[1 : n.d] = n.pre) as kids
  from nodes n left join nodes u on u.d = n.d - 1 and u.pre = n.pre[1 : n.d - 1]),
below as (
  select a.d, a.conv_id, sum(case when b.kids = 0 then 1 else 0 end) as leaves, sum((b.n_convs - 1) * b.words) as saved
  from linked a join linked b on b.d >= a.d and b.pre[1 : a.d] = a.pre group by 1, 2)
select n.conv_id, n.d as depth, n.up as parent_conv_id, n.n_convs, n.kids as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, n.ends as ends_sha256
from linked n join below b on b.d = n.d and b.conv_id = n.conv_id
"""
