"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.langid import fit, held_out, identify

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.bpe import encode_decode

    return encode_decode(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.substring import near_passages

    return near_passages(_read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.quality import judge

    return judge(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.sharding import shard_rows

    return shard_rows(_read(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.topk import top_k

    rows = _read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.linededup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed_lines")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.htmltext import extract

    return extract(_read(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.fillmiddle import fill_in_middle

    return fill_in_middle(_read(spark, sf_dir, "documents")).drop("output")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.prefixtrie import rebuilt, trie

    return trie(rebuilt(_read(spark, sf_dir, "conversations")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.llm.toxicity import fit, held_out, score

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs.where(~held_out(F.col("doc_id"))), _read(spark, sf_dir, "labels")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_sharding": op7_sharding,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_text": op10_html_text,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_toxicity": op13_toxicity,
}

#: DuckDB SQL by query; the others are tested against brute force.
ORACLES = {
    "op5_quality_rules": r"""
with w as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents),
wins as (
  select doc_id, i, words[i:i + 7] as win
  from w, unnest(range(1, len(words) - 6)) as u(i)),
twice as (
  select doc_id, i from wins qualify count(*) over (partition by doc_id, win) > 1),
covered as (
  select doc_id, count(distinct i + j) as n from twice, range(0, 8) as r(j) group by doc_id),
m as (
  select w.doc_id, t, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         len(lines) as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(covered.n, 0)::bigint as n_repeat_words
  from w left join covered using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 20 * n_words
            or length(t) - length(replace(t, '!!', '')) > n_words * 0.6
            or 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(t, '[^\p{L}]+', '', 'g'))
            or 10 * len(regexp_extract_all(t, '\p{L}[^\x20\x09-\x0D]*')) < 7 * n_words) as kept
from b
""",
    "op6_minhash_near_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
shingles as (
  select distinct doc_id, words[i:i + 4] as s from w, unnest(range(1, greatest(len(words) - 3, 2))) as u(i) where len(words) > 0),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b using (s) where a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common c join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c.n >= 85 * (p.n + q.n - c.n)),
edges as (select a, b from links union select b, a from links),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from reach r join edges e on e.a = r.b)
select d.doc_id, coalesce(max(n), 0)::bigint as n_shingles, min(b) as component_id, d.doc_id = min(b) as kept
from documents d join reach on reach.a = d.doc_id left join sizes on sizes.doc_id = d.doc_id group by d.doc_id
""",
    "op8_exact_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 20
""",
    "op9_line_dedup": r"""
with l as (
  select doc_id, i as line, string_split(coalesce(text, ''), chr(10))[i] as t
  from documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as u(i)),
s as (select doc_id, line, list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as w from l),
big as (select row_number() over (order by doc_id, line) as k, doc_id, line, w, len(w) as n from s where len(w) > 0),
words as (select k, n, unnest(w) as x from big),
freq as (select x, count(*) as f from words group by 1),
placed as (select k, n, x, row_number() over (partition by k order by f, x) as p from words join freq using (x)),
prefix as (select * from placed where p <= n - ceil(0.8 * n) + 1),
candidates as (
  select distinct a.k as a, b.k as b from prefix a join prefix b using (x)
  where b.k < a.k and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
gone as (
  select distinct a from candidates join big p on p.k = a join big q on q.k = b
  where 100 * len(list_intersect(p.w, q.w)) >= 80 * (p.n + q.n - len(list_intersect(p.w, q.w)))),
marked as (select l.doc_id, l.line, t, gone.a is not null as removed from l left join big using (doc_id, line) left join gone on gone.a = big.k)
select d.doc_id, case when d.text is not null then coalesce(m.text, '') end as text, case when d.text is null then 0 else m.n_lines end as n_lines, m.n_removed_lines
from documents d join (
  select doc_id, string_agg(t, chr(10) order by line) filter (not removed) as text, count(*) as n_lines, count(*) filter (removed) as n_removed_lines from marked group by 1) m using (doc_id)
""",
    "op11_fill_in_middle": r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
k as (
  select doc_id, t, w, len(w) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from k),
p as (
  select *, array_to_string(w[1:a], '') as prefix, array_to_string(w[a + 1:b], '') as middle, array_to_string(w[b + 1:n], '') as suffix from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from p
""",
    "op12_prefix_trie": r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as i,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 20 as base,
         xor(4294967295, list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint),
                                     lambda a, x: list_reduce(range(8), lambda v, j: xor(v >> 1, 3988292384 * (v & 1)), xor(a, x)), 4294967295::bigint)) % 4 as h
  from (select distinct conv_id from t)),
turns as (
  select c.conv_id, t.i, t.t from c join t on t.conv_id = c.base and t.i <= c.h
  union all select c.conv_id, t.i + 3, t.t from c join t on t.conv_id = c.conv_id and t.i > c.h),
seqs as (select c.conv_id, coalesce(list(turns.t order by turns.i) filter (turns.i is not null), []) as s from c left join turns using (conv_id) group by 1),
nodes as (
  select s[1:d] as node, d as depth, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(s) = d), '')) as ends_sha256
  from seqs, unnest(range(0, len(s) + 1)) as u(d) group by 1, 2),
kids as (select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by 1),
own as (
  select n.*, n_children is null as leaf,
         case when depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(n.node[depth].text, '[^\x20\x09-\x0D]+')) end as saved, coalesce(n_children, 0) as n_children_
  from nodes n left join kids using (node)),
trees as (select node[1:k] as node, count(*) filter (leaf) as n_leaves, sum(saved)::bigint as saved_tokens from own, unnest(range(0, depth + 1)) as u(k) group by 1)
select o.conv_id, o.depth::bigint as depth, p.conv_id as parent_conv_id, o.n_convs::bigint as n_convs, o.n_children_::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens, o.ends_sha256
from own o join trees using (node) left join nodes p on o.depth > 0 and p.node = o.node[1:o.depth - 1]
""",
}
