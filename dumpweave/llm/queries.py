"""The operators over the driver's tables, with SQL where it can express them."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpweave.llm import (
    conversation_trie,
    decontaminate,
    imatch,
    interpolated_lm,
    jaccard_join,
    language_id,
    mixing,
    quality_rules,
    spelling_variants,
    substring_dedup,
    token_counts,
    token_files,
    warc_index,
)
from dumpweave.plans.session import store

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def workers_find_library(spark: SparkSession) -> None:
    """Python workers import this package from where it lies, whatever folder they start in."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))


def query(name: str, sql: str | None = None):
    def register(function):
        @functools.wraps(function)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            workers_find_library(spark)
            return function(spark, sf)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


OP1_SQL = r"""
with recursive cleaned as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end) as s
  from cleaned
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), links as (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  where 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  group by a.doc_id, b.doc_id, x.n, y.n
  having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), edges as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, e.b from reach r join edges e on e.a = r.b
)
select c.doc_id, coalesce(any_value(z.n), 0)::bigint as n_shingles, min(r.b) as component_id
from cleaned c left join sizes z on z.doc_id = c.doc_id join reach r on r.a = c.doc_id
group by c.doc_id
"""


@query("op1_jaccard_join", OP1_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf, "documents"), k=4, num=85, den=100)


OP2_SQL = """
with payloads as (
  select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest from pages
), newest as (
  select *, max(page_id) over (partition by digest) as last from payloads
)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when n >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < last then last end as refers_to
from newest
"""


@query("op2_warc_index", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return warc_index.captures(table(spark, sf, "pages"))


def document_edits() -> Column:
    """Three edits of a text: some of it removed, its start inserted, some put in capitals."""
    n = F.length("text")
    quarter, half, rest = (F.floor(n * i / 4).cast("int") for i in (1, 2, 3))
    kind = "struct<start:int,removed:int,inserted:string>"

    def edit(start: Column, removed: Column, inserted: Column) -> Column:
        return F.struct(start.alias("start"), removed.alias("removed"), inserted.alias("inserted")).cast(kind)

    few = F.least(F.lit(20), F.floor(n / 8).cast("int"))
    return F.array(
        edit(quarter, few, F.lit("")),
        edit(half, F.lit(0), F.substring("text", 1, 30)),
        edit(rest, few, F.upper(F.expr("substring(text, int(floor(length(text) * 3 / 4)) + 1, least(20, int(floor(length(text) / 8))))"))),
    )


@query("op3_token_counts")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_after_edits(
        table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), document_edits()
    )


OP4_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), windows as (
  select distinct item_id, least(len(w), 10) as k,
    unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i+9], ' '))) as s
  from items where len(w) > 0
), lengths as (
  select distinct k from windows
), places as (
  select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, lengths where len(w) >= k
), hits as (
  select p.doc_id, p.i, p.k, v.item_id
  from (select doc_id, i, k, array_to_string(w[i:i+k-1], ' ') as s from places) p join windows v on v.s = p.s and v.k = p.k
), hit_words as (
  select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + k)) as j from hits) group by doc_id
), hit_items as (
  select doc_id, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names
  from hits group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(i.n, 0)::bigint as n_items,
  sha256(coalesce(i.names, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from words d left join hit_words h on h.doc_id = d.doc_id left join hit_items i on i.doc_id = d.doc_id
"""


@query("op4_decontaminate", OP4_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_token_files")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.token_files(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


MIX_REPEATS = 2.0


@query("op6_mixing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    # counted once, as the mixture reads them several times
    counted = store(token_counts.with_token_counts(docs, tokenizer_file("byte_bpe_50k.json")).drop("text"))
    found = mixing.mixed(counted, F.col("n_tokens"), mixing.Target(repeats=MIX_REPEATS))
    return found.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_place")


@query("op7_language_id")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.held_out_predictions(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf, "documents")).drop("kept")


@query("op9_imatch")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, sf, "documents"))


@query("op10_interpolated_lm")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return interpolated_lm.held_out_scores(table(spark, sf, "documents"))


# crc32 in SQL: the table of the reflected polynomial 0xEDB88320, and the bytes of a text folded over it
CRC_TABLE = """(select list(list_reduce(range(8), lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i) order by i) as t
  from range(256) r(i))"""


def crc_sql(text: str) -> str:
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || hex(encode({text}))[2*i+1:2*i+2])::bigint)"
    step = "lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])"
    return f"xor(list_reduce({octets}, {step}, 4294967295), 4294967295)"


@query("op11_quality_rules")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf, "documents"), table(spark, sf, "labels"))


OP12_SQL = rf"""
with crc as materialized {CRC_TABLE}, turns as materialized (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, said) - 1 as p, said, words
  from (
    select conv_id, turn, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as said,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
    from conversations where conv_id is not null
  )
), ids as materialized (
  select c, {crc_sql("c::varchar")} % 4 as h from (select distinct conv_id as c from turns), crc
), heads as (
  select i.c, t.p + 1 as d, t.said, t.words from ids i join turns t on t.conv_id = i.c - i.c % 20 and t.p < i.h
), taken as (
  select i.c, i.h, count(x.d) as n from ids i left join heads x on x.c = i.c group by i.c, i.h
), rebuilt as (
  select * from heads
  union all
  select x.c, t.p - x.h + x.n + 1, t.said, t.words from taken x join turns t on t.conv_id = x.c and t.p >= x.h
), paths as materialized (
  select c, d, words, string_agg(said, '') over (partition by c order by d) as k from rebuilt
  union all
  select c, 0, 0, '' from ids
), lengths as (
  select c, max(d) as d from paths group by c
), nodes as materialized (
  select p.k, any_value(p.d)::bigint as d, min(p.c) as c, count(*) as n, any_value(p.words) as words,
    sha256(coalesce(string_agg(p.c::varchar, ',' order by p.c) filter (where l.d = p.d), '')) as ends
  from paths p join lengths l on l.c = p.c group by p.k
), children as (
  select left(k, 32 * (d - 1)) as k, count(*) as n from nodes where d > 0 group by 1
), sums as (
  select left(x.k, 32 * x.up) as k, sum(x.leaf)::bigint as leaves, sum(x.saved)::bigint as saved
  from (
    select n.k, unnest(range(n.d + 1)) as up, (n.n - 1) * n.words as saved, case when c.n is null then 1 else 0 end as leaf
    from nodes n left join children c on c.k = n.k
  ) x group by 1
)
select n.c as conv_id, n.d as depth, p.c as parent_conv_id, n.n as n_convs, coalesce(c.n, 0) as n_children,
  s.leaves as n_leaves, s.saved as saved_tokens, n.ends as ends_sha256
from nodes n join sums s on s.k = n.k left join children c on c.k = n.k
left join nodes p on n.d > 0 and p.k = left(n.k, 32 * (n.d - 1))
"""


@query("op12_conversation_trie", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf, "conversations"))


OP13_SQL = rf"""
with recursive crc as {CRC_TABLE}, runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as w
  from documents
), names as (
  select doc_id, w, count(*) as m, coalesce(doc_id::varchar, '') || ':' || w as name from runs group by doc_id, w
), sums as (
  select w, m, {crc_sql("name")} as h from names, crc
), counted as (
  select case when h % 97 = 0 then w[1:(h % length(w))] || w[(h % length(w)) + 2:] else w end as word, sum(m)::bigint as n
  from sums group by 1
), words as materialized (
  select word, n from counted where length(word) >= 5 and n >= 3
), shorter as materialized (
  select word, n, i, word[1:i] || word[i + 2:] as s from (select word, n, unnest(range(length(word))) as i from words)
), pairs as materialized (
  select a.word as a, a.n as a_n, b.word as b, b.n as b_n from shorter a join shorter b on a.i = b.i and a.s = b.s where a.word <> b.word
  union
  select a.word, a.n, b.word, b.n from shorter a join words b on a.s = b.word
  union
  select b.word, b.n, a.word, a.n from shorter a join words b on a.s = b.word
), near as (
  select a, count(*) as n_near from pairs group by a
), forms as materialized (
  select a, b as form, b_n as form_n from pairs where b_n >= 2 * a_n
  qualify row_number() over (partition by a order by b_n desc, b) = 1
), walk as (
  select word, word as here, 0 as step from words
  union all
  select k.word, f.form, k.step + 1 from walk k join forms f on f.a = k.here
), roots as (
  select word, arg_max(here, step) as root from walk group by word
)
select w.word, f.form, r.root, w.n, coalesce(n.n_near, 0)::bigint as n_near, f.form_n
from words w join roots r on r.word = w.word left join near n on n.a = w.word left join forms f on f.a = w.word
"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants.variant_groups(table(spark, sf, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
