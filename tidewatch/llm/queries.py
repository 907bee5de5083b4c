"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, filter_audit, language_id, line_dedup, mixing, near_dedup, pieces, quality_model, quality_rules, spelling, toxicity, warc
from .common import fold, read, scratch


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measured(read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    captures = warc.with_originals(warc.assemble(warc.read_records(spark, path, with_payload=False)))
    known = F.col("metadata.fields")
    return captures.select(
        known["page-id"].cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", known["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.rec_type").alias("record_type"),
        F.col("original.fields")["page-id"].cast("long").alias("refers_to"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scores = toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slot")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(read(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scores = quality_model.scored(docs, quality_model.fit(docs, read(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(read(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(read(spark, sf_dir, "documents"), width=4, percent=80)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return language_id.predicted(docs, language_id.fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.found(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_model": op7_quality_model,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_decontamination": op13_decontamination,
}

SQL: dict[str, str] = {
    "op1_quality_rules": r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct u.line) as n_dup from t, unnest(string_split(text, chr(10))) as u(line)
  where regexp_matches(u.line, '[^\x20\x09-\x0D]') group by doc_id
), g as (
  select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from t, unnest(range(1, len(w) - 1)) as r(i)
), again as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from g) where n > 1
), covered as (
  select doc_id, count(distinct i + k) as n from again, unnest([0, 1, 2]) as s(k) group by doc_id
), f as (
  select t.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(l.n_dup, 0)::bigint as n_dup_lines, coalesce(l.n_lines, 0) as n_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
    length(regexp_replace(text, '[^!]', '', 'g')) as n_exclaim
  from t left join l using (doc_id) left join covered using (doc_id)
), b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 4 * n_symbols > n_words or 2 * n_dup_lines > n_lines or 2 * n_words > word_chars or word_chars > 20 * n_words or 2 * n_exclaim > n_words) as kept
from b""",
    "op2_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
o as (select payload_digest, min(page_id) as original from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest, case when p.page_id > o.original then 'revisit' else 'response' end as record_type,
  case when p.page_id > o.original then o.original end as refers_to
from p left join o on p.payload_digest = o.payload_digest""",
    "op4_line_dedup": r"""
with l as (
  select d.doc_id, u.line, u.pos from documents d,
    unnest(string_split(coalesce(d.text, ''), chr(10))) with ordinality as u(line, pos)
), k as (
  select *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), f as (
  select key, count(distinct doc_id) as n, max(doc_id) as holder from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), m as (
  select k.doc_id, k.line, k.pos, f.key is not null and k.doc_id <> f.holder as dropped from k left join f on k.key = f.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from m group by doc_id""",
    "op8_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*)::bigint as group_size from n group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256 from n join g on n.t = g.t""",
    "op11_filter_audit": r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from d),
f as (
  select part,
    (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
      + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as fails,
    doc_id in (select doc_id from labels where quality = 1) as good, doc_id in (select doc_id from labels where toxic = 1) as toxic
  from w
), c as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from f group by part, fails),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x
), s as (
  select filter_order, step, filter_order[step] as letter, 1 << (ascii(filter_order[step]) - 65) as own,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) as earlier
  from o, unnest(range(1, 6)) as r(step)
), t as (
  select part, filter_order, step::int as step, letter,
    coalesce(sum(n) filter (where fails & (own | before) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (where fails & own > 0 and fails & before = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (where fails & own > 0 and fails & before > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (where fails = own), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where fails & own > 0 and fails & before = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where fails & own > 0 and fails & before = 0), 0)::bigint as toxic_lost
  from c, (select * exclude (earlier), coalesce(earlier, 0)::int as before from s) group by part, filter_order, step, letter
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from t""",
    "op12_spelling_variants": r"""
with recursive table_ as (
  select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), r as (
  select doc_id, translate(u.w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as u(w)
), p as (
  select doc_id, run, count(*) as n, coalesce(doc_id::varchar, '') || ':' || run as named from r where length(run) >= 7 group by doc_id, run
), h as (
  select run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(named, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] end))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) as h from p, table_
), m as (
  select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h
), w as (select word, sum(n)::bigint as n from m where length(word) >= 7 group by word having sum(n) >= 2),
x as (select word, n, i, left(word, i::int - 1) || substr(word, i::int + 1) as shorter from w, unnest(range(1, length(word) + 1)) as u(i)),
e as (
  select a.word as a, b.word as b from x a join w b on a.shorter = b.word union select b.word, a.word from x a join w b on a.shorter = b.word
  union select a.word, b.word from x a join x b on a.i = b.i and a.shorter = b.shorter and a.word <> b.word
), g as (
  select e.a as word, count(*)::bigint as n_near, first(e.b order by w.n desc, e.b) as best, max(w.n) as best_n from e join w on e.b = w.word group by e.a
), f as (
  select w.word, w.n, coalesce(g.n_near, 0)::bigint as n_near, case when g.best_n >= 10 * w.n then g.best end as form, case when g.best_n >= 10 * w.n then g.best_n end as form_n
  from w left join g on w.word = g.word
), chain as (
  select word, word as root, form as next from f
  union all select c.word, f.word, f.form from chain c join f on c.next = f.word
)
select f.word, f.form, chain.root, f.n, f.n_near, f.form_n from f join chain on chain.word = f.word and chain.next is null""",
    "op13_decontamination": r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), b as (
  select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), i as (
  select distinct item, k, array_to_string(w[j:j + k - 1], ' ') as s from (select item, w, least(10, len(w)) as k from b where len(w) > 0), unnest(range(1, len(w) - k + 2)) as u(j)
), g as (
  select doc_id, k, j, array_to_string(w[j:j + k - 1], ' ') as s from d, (select distinct k from i), unnest(range(1, len(w) - k + 2)) as u(j)
), m as (select g.doc_id, g.k, g.j, i.item from g join i on g.k = i.k and g.s = i.s),
hit as (select doc_id, count(distinct j + o) as n_hit from (select distinct doc_id, k, j from m), unnest(range(k)) as u(o) group by doc_id),
items as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as listed from m group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join items on d.doc_id = items.doc_id""",
}
