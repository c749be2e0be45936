"""Every operator over the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_queries import views as v
from driver_queries.views import parsed, table
from dumpweave.fixed_values import EXPECTED_PAGES, STOP_WORDS
from dumpweave.functions import text as tx
from dumpweave.functions import wikitext as wt
from dumpweave.functions.translit import transliterate
from dumpweave.operators import checks, graph, links, loads, pages, quality, similarity, stats, subwords
from dumpweave.plans.session import configure, store, work_dir
from dumpweave.sinks import tables as sinks
from dumpweave.sources import sql_dump, xml_dump
from dumpweave.sources import tables as stored
from dumpweave.streaming.incremental import incremental_load, load_log
from dumpweave.streaming.keyed import keyed_load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(configure(spark), sf)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle.strip()
        return run

    return add


def six(column):
    return F.round(column, 6)


def big(column):
    return F.col(column).cast("bigint").alias(column)


# --- sources --------------------------------------------------------------------
@query("s1_dump_file_listing", f"with {v.V_FILES} select path, start_idx, end_idx from v_files")
def _(spark, sf):
    return xml_dump.dump_files(v.file_paths(spark, sf)).orderBy("start_idx")


@query(
    "s2_valid_dump_file",
    f"""with {v.V_FILES}
    select path, true as is_valid from v_files
    union all select replace(path, '.bz2', '.txt'), false from v_files
    union all select '/dump/enwiki-20210420-pages-articles-multistream.xml.' || (block + 1) || '.bz2',
      false from v_blocks""",
)
def _(spark, sf):
    return xml_dump.valid_dump_file(v.file_paths(spark, sf))


@query(
    "s3_read_xml_pages",
    f"""with {v.V_XML}
    select id, ns::bigint as ns, title, is_redirect, length(text) as n_chars, md5(text) as text_md5
    from v_xml""",
)
def _(spark, sf):
    return xml_dump.parse_xml_pages(v.xml_records(spark, sf)).select(
        "id", "ns", "title", "is_redirect",
        F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"),
    )


@query(
    "s4_read_sql_dump_lines",
    f"""with {v.V_DUMP_PAGE}
    select p.page_id, 'INSERT INTO `page` VALUES' as statement
    from v_page_dump p where p.namespace = 0""",
)
def _(spark, sf):
    return sql_dump.insert_lines(v.dump_page_lines(spark, sf)).select(
        F.regexp_extract("value", r"\((\d+),", 1).cast("bigint").alias("page_id"),
        F.substring_index("value", " (", 1).alias("statement"),
    )


@query(
    "s5_parse_sql_dump_page",
    f"""with {v.V_DUMP_PAGE}
    select page_id, namespace::bigint as namespace, title, '' as restrictions,
      is_redirect::bigint as is_redirect from v_page_dump""",
)
def _(spark, sf):
    return sql_dump.parse_sql_dump(v.dump_page_lines(spark, sf), "page")


@query(
    "s5_parse_sql_dump_link",
    f"""with {v.V_DUMP_LINK}
    select pl_from, namespace::bigint as namespace, title, from_namespace::bigint as from_namespace
    from v_link_dump""",
)
def _(spark, sf):
    return sql_dump.parse_sql_dump(v.dump_link_lines(spark, sf), "link")


@query(
    "s5_parse_sql_dump_link_escaped",
    f"""with {v.V_DUMP_LINK}
    select pl_from, replace(title, '''', chr(92) || '''') as title from v_link_dump""",
)
def _(spark, sf):
    parsed = sql_dump.parse_sql_dump(v.dump_link_lines(spark, sf), "link", unescape=False)
    return parsed.select("pl_from", "title")


@query(
    "s5_parse_sql_dump_categorylink",
    f"""select o_custkey + 1 + {v.TALK_OFFSET} as cl_from, {v._GRADE_SQL} || '-Class_articles' as category
    from orders
    union all select o_custkey + 1 + {v.TALK_OFFSET}, 'Living_people_(x)' from orders""",
)
def _(spark, sf):
    return sql_dump.parse_sql_dump(v.dump_category_lines(spark, sf), "categorylink")


def _linked_tables(spark, sf) -> dict[str, DataFrame]:
    page = v.page_table(spark, sf)
    talk = (
        quality.talk_of_existing_pages(v.talk_candidates(spark, sf), page)
        .where(F.col("status") == "kept")
        .select("page_id", "page_title")
    )
    graded = quality.first_quality_per_page(
        quality.quality_from_category(v.quality_candidates(spark, sf))
    ).select(F.col("id").alias("page_id"), F.col("quality").alias("page_quality"))
    kept, _ = quality.quality_of_existing_talk(graded, talk)
    return {"page": page, "talk": talk, "quality": kept}


@query(
    "s6_read_tables",
    f"with {v.V_TABLES} select page_id, page_title from v_talk",
)
def _(spark, sf):
    root = work_dir(spark, "tables")
    sinks.write_table(_linked_tables(spark, sf)["talk"], root, "talk")
    return stored.read_table(spark, root, "talk")


# --- projections, filters, predicates ---------------------------------------------
@query(
    "f1_article_pages",
    f"""with {v.V_XML}
    select id, title, strip_accents(replace(title, 'ß', 'ss')) as title_ascii from v_xml
    where not regexp_matches(title, '^.+:.+$') and length(title) <= 200 and not is_redirect""",
)
def _(spark, sf):
    articles = pages.article_pages(xml_dump.parse_xml_pages(v.xml_records(spark, sf)))
    return articles.select("id", "title", "title_ascii")


@query(
    "f1_article_pages_by_ns",
    f"""with {v.V_XML}
    select id, title, strip_accents(replace(title, 'ß', 'ss')) as title_ascii from v_xml
    where ns = 0 and length(title) <= 200 and not is_redirect""",
)
def _(spark, sf):
    articles = pages.article_pages(xml_dump.parse_xml_pages(v.xml_records(spark, sf)), "ns")
    return articles.select("id", "title", "title_ascii")


@query(
    "f2_pages_in_namespace",
    f"""with {v.V_DUMP_PAGE}
    select page_id, title from v_page_dump where namespace = 0 and is_redirect = 0""",
)
def _(spark, sf):
    return pages.pages_in_namespace(
        sql_dump.parse_sql_dump(v.dump_page_lines(spark, sf), "page"), 0
    )


@query(
    "f3_clean_title",
    f"""select doc_id, {v.FIRST_LINE} as page_title,
      case when length({v.FIRST_LINE}) <= 200 then 'kept' else 'skipped' end as status
    from documents""",
)
def _(spark, sf):
    raw = table(spark, sf, "documents").select(
        "doc_id", tx.slug(v.first_line(F.col("text"))).alias("title")
    )
    return pages.clean_title(raw).select("doc_id", "page_title", "status")


@query("f4_ns0_links", f"with {v.V_DUMP_LINK} select pl_from, title from v_ns0")
def _(spark, sf):
    return _ns0(spark, sf)


def _ns0(spark, sf):
    return links.ns0_links(sql_dump.parse_sql_dump(v.dump_link_lines(spark, sf), "link"))


@query(
    "f5_title_equals_ci",
    "select c_custkey, c_name from customer where lower(c_name) = lower('CUSTOMER#000000042')",
)
def _(spark, sf):
    found = pages.find_by_title(table(spark, sf, "customer"), "CUSTOMER#000000042", "c_name")
    return found.select("c_custkey", "c_name")


@query(
    "f6_find_exact",
    """select o_orderkey, o_custkey from orders where o_orderstatus = 'F'
    and o_orderpriority = '2-HIGH' order by o_orderkey limit 1""",
)
def _(spark, sf):
    found = pages.find_exact(
        table(spark, sf, "orders"), ["o_orderkey"], o_orderstatus="F", o_orderpriority="2-HIGH"
    )
    return found.select("o_orderkey", "o_custkey")


@query(
    "f7_quality_from_category",
    f"select o_custkey + 1 + {v.TALK_OFFSET} as cl_from, {v._GRADE_SQL} as quality from orders",
)
def _(spark, sf):
    categories = sql_dump.parse_sql_dump(v.dump_category_lines(spark, sf), "categorylink")
    return quality.quality_from_category(categories).select("cl_from", "quality")


@query(
    "f8_valid_page",
    f"""with p as (
      select doc_id, nullif({v.FIRST_LINE}, '') as title, string_split({v.FIRST_LINE}, ' ') as h,
        string_split(text, chr(10)) as s from documents)
    select doc_id, case when title is null then 'invalid title'
      when list_contains(h, 'the') then 'invalid headings element'
      when len(h) <> len(s) then 'sizes differ' end as reason from p""",
)
def _(spark, sf):
    line = v.first_line(F.col("text"))
    built = table(spark, sf, "documents").select(
        "doc_id",
        F.nullif(line, F.lit("")).alias("title"),
        F.transform(F.split(line, " "), lambda x: F.nullif(x, F.lit("the"))).alias("headings"),
        F.split("text", "\n").alias("sections"),
        F.array("source").alias("links"),
    )
    return pages.valid_page(built).select("doc_id", "reason")


@query(
    "f9_valid_file_range",
    """select l_orderkey, l_linenumber, l_partkey, case when l_orderkey > l_partkey then
      'start_idx is above end_idx' end as reason from lineitem""",
)
def _(spark, sf):
    files = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path"),
        F.col("l_orderkey").alias("start_idx"),
        F.col("l_partkey").alias("end_idx"),
    )
    return xml_dump.valid_file_range(files).select(
        "l_orderkey", "l_linenumber", "l_partkey", "reason"
    )


# --- joins --------------------------------------------------------------------------
@query(
    "j1_page_quality",
    f"""with {v.V_TABLES}
    select p.page_id, p.page_title, t.page_id as talk_id, q.page_quality
    from v_page p join v_talk t using (page_title) join v_quality q on q.page_id = t.page_id""",
)
def _(spark, sf):
    return quality.page_quality(**_linked_tables(spark, sf))


@query(
    "j2_page_links_quality",
    f"""with {v.V_TABLES}, {v.V_DUMP_LINK}
    select n.pl_from, p.page_title, q.page_quality, n.title
    from v_ns0 n join v_page p on p.page_id = n.pl_from join v_talk t using (page_title)
    join v_quality q on q.page_id = t.page_id""",
)
def _(spark, sf):
    return quality.page_links_quality(_ns0(spark, sf), **_linked_tables(spark, sf))


@query(
    "j3_talk_of_existing_pages",
    f"""with {v.V_TABLES}
    select page_id, page_title, case when page_title in (select page_title from v_page)
      then 'kept' else 'skipped_no_page' end as status from v_talk_all""",
)
def _(spark, sf):
    found = quality.talk_of_existing_pages(v.talk_candidates(spark, sf), v.page_table(spark, sf))
    return found.select("page_id", "page_title", "status")


def _graded(spark, sf, mode="first"):
    return quality.first_quality_per_page(
        quality.quality_from_category(v.quality_candidates(spark, sf)), mode
    )


@query(
    "j4_quality_of_existing_talk",
    f"""with {v.V_TABLES}
    select page_id, page_quality, case when page_id in (select page_id from v_talk) then 'kept'
      else 'skipped' end as status from v_quality_first""",
)
def _(spark, sf):
    graded = _graded(spark, sf).select(
        F.col("id").alias("page_id"), F.col("quality").alias("page_quality")
    )
    kept, skipped = quality.quality_of_existing_talk(graded, _linked_tables(spark, sf)["talk"])
    return kept.withColumn("status", F.lit("kept")).unionByName(
        skipped.withColumn("status", F.lit("skipped"))
    )


@query(
    "j5_links_from_selected_pages",
    f"""with {v.V_TABLES}, {v.V_DUMP_LINK}
    select pl_from, title from v_ns0 where pl_from in (
      select p.page_id from v_page p join v_talk t using (page_title)
      join v_quality q on q.page_id = t.page_id)""",
)
def _(spark, sf):
    selected = quality.page_quality(**_linked_tables(spark, sf))
    return links.links_from_selected_pages(_ns0(spark, sf), selected)


@query(
    "j5_selected_link_counts",
    f"""with {v.V_TABLES}, {v.V_DUMP_LINK}
    select count(*) filter (pl_from in (select page_id from v_page))::bigint as n_items,
      count(*) filter (pl_from not in (select page_id from v_page))::bigint as n_skips from v_ns0""",
)
def _(spark, sf):
    return links.selected_link_counts(_ns0(spark, sf), v.page_table(spark, sf))


def _resolved(spark, sf):
    found = links.explode_links(v.page_arrays(spark, sf))
    return links.resolve_links(found, v.page_titles(spark, sf).drop("page_id"))


@query(
    "j6_resolve_links",
    f"""with {v.V_LINKS}
    select a.page_id, l.pos::int as pos, l.link, k.best.t as resolved
    from anchors a left join v_links l using (page_id) left join by_key k on k.k = lower(l.link)""",
)
def _(spark, sf):
    return _resolved(spark, sf)


@query(
    "j6_unresolved_links",
    f"""with {v.V_LINKS}
    select page_id, pos::int as pos, link from v_links
    where lower(link) not in (select k from by_key)""",
)
def _(spark, sf):
    found = links.explode_links(v.page_arrays(spark, sf))
    return links.unresolved_links(found, v.page_titles(spark, sf))


@query(
    "j7_quality_walk",
    f"""with {v.V_TABLES}
    select q.page_id as talk_id, q.page_quality, t.page_title, p.page_id as content_page_id
    from v_quality_first q left join v_talk t on t.page_id = q.page_id
    left join v_page p on p.page_title = t.page_title""",
)
def _(spark, sf):
    tables = _linked_tables(spark, sf)
    graded = _graded(spark, sf).select(
        F.col("id").alias("page_id"), F.col("quality").alias("page_quality")
    )
    return quality.quality_walk(graded, tables["talk"], tables["page"])


# --- aggregations ---------------------------------------------------------------------
@query(
    "a1_collect_page_links",
    f"""with {v.V_DUMP_LINK}
    select pl_from, 0::bigint as part, count(*)::int as n_titles,
      string_agg(replace(title, '_', ' '), '|' order by title desc) as titles
    from v_ns0 group by pl_from""",
)
def _(spark, sf):
    collected = links.collect_page_links(_ns0(spark, sf))
    return collected.select(
        "pl_from", "part", F.size("pl_titles").alias("n_titles"),
        F.array_join("pl_titles", "|").alias("titles"),
    )


@query(
    "a2_article_count_longest_title",
    f"""with p as (select substr(source, 4)::bigint as file_start, doc_id as pos,
      {v.FIRST_LINE} as title from documents)
    select file_start, count(*) as n_articles,
      first(title order by length(title) desc, pos) as longest_title from p group by 1""",
)
def _(spark, sf):
    return pages.article_count_longest_title(_titled(spark, sf))


def _titled(spark, sf):
    return v.chunked_pages(spark, sf).drop("title").join(
        table(spark, sf, "documents").select(
            F.col("doc_id").alias("pos"), v.first_line(F.col("text")).alias("title")
        ),
        "pos",
    )


@query(
    "a2_article_count_longest_title_of_all",
    f"""with p as (select substr(source, 4)::bigint as file_start, doc_id as pos,
      {v.FIRST_LINE} as title from documents)
    select count(*) as n_articles,
      first(title order by length(title) desc, file_start, pos) as longest_title from p""",
)
def _(spark, sf):
    return pages.article_count_longest_title(_titled(spark, sf), per_file=False)


_REPORT = """count(*) as pages, count(*) filter (status = 'added') as additions,
  count(*) filter (status = 'duplicate') as duplicates, 0::bigint as errors"""


@query(
    "a3_load_report",
    f"with {v.V_DUPS} select file_start, chunk, {_REPORT} from v_loaded group by 1, 2",
)
def _(spark, sf):
    return pages.load_report(
        pages.dedupe_by_title(v.chunked_pages(spark, sf)), ["file_start", "chunk"]
    )


@query("a4_load_totals", f"with {v.V_DUPS} select status, count(*) as n_rows from v_loaded group by 1")
def _(spark, sf):
    return pages.load_totals(pages.dedupe_by_title(v.chunked_pages(spark, sf)))


@query(
    "a5_link_totals",
    f"""with {v.V_DUMP_LINK}, t as (
      select count(*) as all_links, count(*) filter (from_namespace = 0) as ns0_to_all,
        count(*) filter (from_namespace = 0 and namespace = 0) as ns0_to_ns0,
        (select count(*) from part) as n_pages from v_link_dump)
    select *, round(ns0_to_all / n_pages, 6) as avg_to_all, round(ns0_to_ns0 / n_pages, 6) as avg_to_ns0
    from t""",
)
def _(spark, sf):
    totals = links.link_totals(
        sql_dump.parse_sql_dump(v.dump_link_lines(spark, sf), "link"), table(spark, sf, "part")
    )
    return totals.withColumn("avg_to_all", six("avg_to_all")).withColumn(
        "avg_to_ns0", six("avg_to_ns0")
    )


@query("a6_table_count", "select count(*) as n_rows from lineitem")
def _(spark, sf):
    return pages.table_count(table(spark, sf, "lineitem"))


def _lengths(spark, sf):
    return tx.lead_token_length(wt.extract_sections(v.wikitext(spark, sf), markup=False))


@query(
    "a7_length_summary",
    f"""with {v.V_LEAD}
    select max(length)::bigint as max_length, round(avg(length), 6) as mean_length,
      median(length)::double as median_length, sum(length)::bigint as sum_length from v_lead""",
)
def _(spark, sf):
    summary = stats.length_summary(_lengths(spark, sf))
    return summary.withColumn("mean_length", six("mean_length"))


@query(
    "a8_length_percentiles",
    f"""with {v.V_LEAD}
    select unnest([0.05, 0.25, 0.5, 0.75, 0.99, 0.9999])::double as share,
      round(unnest(quantile_cont(length::double, [0.05, 0.25, 0.5, 0.75, 0.99, 0.9999])), 6) as value
    from v_lead""",
)
def _(spark, sf):
    found = stats.length_percentiles(_lengths(spark, sf))
    return found.withColumn("value", six("value"))


@query(
    "a8_sketched_percentiles",
    f"""with {v.V_LEAD}, s as (select unnest([0.05, 0.25, 0.5, 0.75, 0.99, 0.9999])::double as share)
    select share, true as within, (select count(*) from v_lead) as n from s""",
)
def _(spark, sf):
    # sketches of eight parts, stored, merged and held against exact ranks
    lengths = store(_lengths(spark, sf).select((F.col("doc_id") % 8).alias("part"), "length"))
    parts = store(stats.length_sketches(lengths, ["part"]))
    found = stats.sketched_percentiles(stats.merge_sketches(parts)).collect()  # one for each share
    ranks = [
        F.struct(
            F.lit(r["share"]).alias("share"),
            (
                (F.avg((F.col("length") < r["value"]).cast("int")) - r["share"] <= stats.SKETCH_ERROR)
                & (r["share"] - F.avg((F.col("length") <= r["value"]).cast("int")) <= stats.SKETCH_ERROR)
            ).alias("within"),
            F.lit(r["n"]).cast("bigint").alias("n"),
        )
        for r in found
    ]
    return lengths.agg(F.array(*ranks).alias("ranks")).select(F.inline("ranks"))


@query(
    "a9_length_histogram",
    f"""with {v.V_LEAD},
    b as (select min(length)::double as lo, max(length)::double as hi from v_lead),
    c as (select least(floor(10.0::double * (length - lo) / (hi - lo))::bigint + 1, 10) as bin,
      count(*) as n from v_lead, b group by 1)
    select g.bin, round(lo + (g.bin - 1) * ((hi - lo) / 10), 6) as lower,
      round(lo + g.bin * ((hi - lo) / 10), 6) as upper, coalesce(n, 0) as n
    from (select unnest(generate_series(1, 10)) as bin) g, b left join c on c.bin = g.bin""",
)
def _(spark, sf):
    found = stats.length_histogram(_lengths(spark, sf))
    return found.withColumn("lower", six("lower")).withColumn("upper", six("upper"))


@query(
    "a10_unknown_share",
    rf"""with {v.V_LEAD}, voc as (
      select distinct unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) as token from benchmark),
    t as (select unnest(lead) as token from v_lead),
    u as (select count(*) filter (token not in (select token from voc)) as n_unknown from t)
    select n_unknown, (select sum(length)::bigint from v_lead) as n_tokens,
      round(100 * n_unknown / (select sum(length) from v_lead), 6) as percent_unknown from u""",
)
def _(spark, sf):
    share = stats.unknown_share(
        wt.extract_sections(v.wikitext(spark, sf), markup=False), v.vocabulary(spark, sf)
    )
    return share.withColumn("percent_unknown", six("percent_unknown"))


@query(
    "a11_links_per_page",
    f"""with {v.V_LINKS}
    select a.page_id, count(l.link) as n_links,
      count(*) filter (l.link is not null and k.k is null) as n_unresolved
    from anchors a left join v_links l using (page_id) left join by_key k on k.k = lower(l.link)
    group by 1""",
)
def _(spark, sf):
    return links.links_per_page(_resolved(spark, sf))


# --- window-style -----------------------------------------------------------------------
@query(
    "w1_first_quality_per_page",
    f"with {v.V_TABLES} select page_id as id, seq, page_quality as quality from v_quality_first",
)
def _(spark, sf):
    return _graded(spark, sf)


@query(
    "w1_best_quality_per_page",
    f"""with {v.V_TABLES}
    select id, seq, quality from v_quality_all
    qualify row_number() over (partition by id order by grade_rank, seq) = 1""",
)
def _(spark, sf):
    return _graded(spark, sf, "best")


@query("w2_dedupe_by_title", f"with {v.V_DUPS} select * from v_loaded")
def _(spark, sf):
    return pages.dedupe_by_title(v.chunked_pages(spark, sf))


_CONTIGUITY = """
 w as (select *, row_number() over (order by start_idx) as i,
      start_idx <> lag(end_idx, 1, 0) over (order by start_idx) + 1 as breaks,
      lag(path) over (order by start_idx) as before from f)
    select not bool_or(breaks) as contiguous, case when bool_or(breaks)
      then first(before order by i) filter (breaks) else last(path order by i) end as last_valid_file
    from w"""


@query("w3_dump_contiguity", f"with {v.V_FILES}, f as (select * from v_files), {_CONTIGUITY}")
def _(spark, sf):
    return checks.dump_contiguity(xml_dump.dump_files(v.file_paths(spark, sf)))


_GAPPED = """f as (select 'c' || o_custkey as path, min(o_orderkey) + 1 as start_idx,
      max(o_orderkey) + 1 as end_idx from orders group by o_custkey)"""


@query("w3_dump_contiguity_of_overlaps", f"with {_GAPPED}, {_CONTIGUITY}")
def _(spark, sf):
    files = (
        table(spark, sf, "orders")
        .groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"))
        .agg(
            (F.min("o_orderkey") + 1).alias("start_idx"), (F.max("o_orderkey") + 1).alias("end_idx")
        )
    )
    return checks.dump_contiguity(files)


_TFIDF = r"""
tok as (
  select doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from corpus),
tf as (select doc, term, count(*) as tf from tok group by all),
df as (select term, count(*) as df from tf group by 1),
raw as (
  select doc, term, tf, tf * (ln((1 + (select count(*) from corpus)) / (1 + df)) + 1) as w
  from tf join df using (term)),
vec as (select doc, term, tf, w / sqrt(sum(w * w) over (partition by doc)) as weight from raw)
"""
_CORPUS = "corpus as (select doc_id as doc, text from documents)"


def _corpus(spark, sf):
    return parsed(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")


@query(
    "w4_top_terms",
    f"""with {_CORPUS}, {_TFIDF}, r as (
      select *, row_number() over (partition by doc order by weight desc, term) as rank from vec)
    select doc, term, tf, round(weight, 6) as weight, rank::int as rank from r where rank <= 5""",
)
def _(spark, sf):
    top = similarity.top_terms(similarity.tfidf(_corpus(spark, sf)))
    return top.withColumn("weight", six("weight"))


@query(
    "w7_trailing_mean_at_every_chunk",
    """select o_orderkey as at_chunk, round(avg(o_custkey) over x, 6) as avg_items,
      round(avg(floor(o_totalprice)) over x, 6) as avg_skips
    from orders window x as (order by o_orderkey rows between 7499 preceding and current row)""",
)
def _(spark, sf):
    chunks = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("items"), F.floor("o_totalprice").alias("skips")
    )
    means = links.trailing_chunk_means(chunks)
    return means.select("at_chunk", six("avg_items").alias("avg_items"), six("avg_skips").alias("avg_skips"))


FILE_LIMIT = 7


@query(
    "w5_limit_per_file",
    f"""with {v.V_DUPS}
    select * from v_dups qualify row_number() over (partition by file_start order by pos) <= {FILE_LIMIT}""",
)
def _(spark, sf):
    return pages.limit_per_file(v.chunked_pages(spark, sf), FILE_LIMIT)


@query(
    "w6_limit_links_per_page",
    f"""with {v.V_GRAPH}
    select src, dst, rn::int as rank from v_capped""",
)
def _(spark, sf):
    return links.limit_links_per_page(v.graph_links(spark, sf), v.GRAPH_CAP, order=("dst",))


@query(
    "w7_trailing_chunk_mean",
    """with c as (select o_orderkey as chunk, o_custkey as items, floor(o_totalprice) as skips,
      max(o_orderkey) over () as last from orders),
    w as (select *, avg(items) over x as a, avg(skips) over x as b from c
      window x as (order by chunk rows between 499 preceding and current row))
    select chunk as at_chunk, round(a, 6) as avg_items, round(b, 6) as avg_skips
    from w where chunk % 500 = 0""",
)
def _(spark, sf):
    chunks = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("chunk"),
        F.col("o_custkey").alias("items"),
        F.floor("o_totalprice").alias("skips"),
    )
    means = links.trailing_chunk_mean(chunks, 500)
    return means.select("at_chunk", six("avg_items").alias("avg_items"), six("avg_skips").alias("avg_skips"))


# --- sorts, limits, set operations --------------------------------------------------------
@query("l1_sort_links", f"with {v.V_DUMP_LINK} select pl_from, title from v_ns0 order by 1, 2")
def _(spark, sf):
    return links.sort_links(_ns0(spark, sf))


@query(
    "l2_sort_qualities",
    f"with {v.V_TABLES} select seq, id, quality from v_quality_all order by id, seq",
)
def _(spark, sf):
    graded = quality.quality_from_category(v.quality_candidates(spark, sf))
    return quality.sort_qualities(graded).select("seq", "id", "quality")


@query(
    "l3_page_of_rows",
    "select o_orderkey, o_custkey from orders order by o_orderkey limit 50 offset 1000",
)
def _(spark, sf):
    return pages.page_of_rows(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 1000, 50
    )


@query(
    "l3_page_after",
    "select o_orderkey, o_custkey from orders where o_orderkey > 999 order by o_orderkey limit 50",
)
def _(spark, sf):
    return pages.page_after(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 999, 50
    )


@query(
    "l4_sort_terms",
    f"with {_CORPUS}, {_TFIDF} select doc, term, round(weight, 6) as weight from vec order by 1, 3 desc",
)
def _(spark, sf):
    ordered = similarity.sort_terms(similarity.tfidf(_corpus(spark, sf)))
    return ordered.select("doc", "term", six("weight").alias("weight"))


@query(
    "l5_combine_chunks",
    """select c_name as title from customer union all select s_name from supplier
    union all select p_name from part""",
)
def _(spark, sf):
    return pages.combine_chunks(
        table(spark, sf, "customer").select(F.col("c_name").alias("title")),
        table(spark, sf, "supplier").select(F.col("s_name").alias("title")),
        table(spark, sf, "part").select(F.col("p_name").alias("title")),
    )


@query(
    "l6_page_diff",
    """select 'd' || doc_id as title, case lang when 'es' then 'removed' when 'de' then 'changed'
      else 'same' end as status from documents
    union all select 'b' || item_id, 'added' from benchmark""",
)
def _(spark, sf):
    def page(df, title, headings):
        return df.select(
            title.alias("title"),
            headings.alias("headings"),
            F.split("text", "\n").alias("sections"),
            F.array().cast("array<string>").alias("links"),
        )

    docs = table(spark, sf, "documents")
    title = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    old = page(docs, title, F.array("lang"))
    new = page(
        docs.where(F.col("lang") != "es"),
        title,
        F.when(F.col("lang") == "de", F.array(F.lit("other"))).otherwise(F.array("lang")),
    ).unionByName(
        page(
            table(spark, sf, "benchmark"),
            F.concat(F.lit("b"), F.col("item_id").cast("string")),
            F.array(F.lit("x")),
        )
    )
    return pages.page_diff(old, new)


# --- whole loads, with rejects -----------------------------------------------------------------
def _load_text(spark, sf):
    return loads.load_text(v.dump_records(spark, sf), work_dir(spark, "load"), chunk_pages=20)


_LOADED = f"with {v.V_LOAD}"


@query(
    "e1_load_text",
    f"""{_LOADED}
    select l.title, len(string_split(j.text, chr(10)))::int as n_sections,
      md5(strip_accents(replace(replace(array_to_string(list_transform(string_split(j.text, chr(10)),
        lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160))), '|'), 'ß', 'ss')
        || case when ends_with(j.text, chr(10)) then '' else ' ' end || 'label', chr(0), ''))) as sections_md5,
      'Page ' || j.lang as link
    from l_log l join l_judged j using (id) where l.status = 'added'""",
)
def _(spark, sf):
    return _load_text(spark, sf).tables["text"].select(
        "title", F.size("sections").alias("n_sections"),
        F.md5(F.array_join("sections", "|")).alias("sections_md5"), F.get("links", F.lit(0)).alias("link"),
    )


@query("e1_load_log", f"{_LOADED} select file_start, chunk, id, title, status, reason from l_log")
def _(spark, sf):
    return _load_text(spark, sf).log


@query(
    "e1_load_report",
    f"""{_LOADED}
    select file_start, count(*) as pages, count(*) filter (status = 'added') as additions,
      count(*) filter (status = 'duplicate') as duplicates, count(*) filter (status = 'error') as errors
    from l_log where status <> 'left out' group by 1""",
)
def _(spark, sf):
    return _load_text(spark, sf).report("file_start")


@query("e1_load_totals", f"{_LOADED} select status, count(*) as n_rows from l_log group by 1")
def _(spark, sf):
    return _load_text(spark, sf).status_totals(spark)


@query("e1_rejected_pages", f"{_LOADED} select file_start, id from l_judged where broken")
def _(spark, sf):
    found = _load_text(spark, sf).rejected
    return found.select(
        F.regexp_extract("file", r"xml-p(\d+)p", 1).cast("bigint").alias("file_start"),
        F.regexp_extract("value", r"<id>(\d+)</id>", 1).cast("bigint").alias("id"),
    )


def _load_pages(spark, sf):
    return loads.load_page_tables(v.dump_page_lines_with_rejects(spark, sf), work_dir(spark, "load"))


@query(
    "e2_load_page_and_talk",
    f"with {v.V_LOAD_PAGES} select table_name, page_id, page_title from r_log where status = 'added'",
)
def _(spark, sf):
    tables = _load_pages(spark, sf).tables
    return pages.combine_chunks(*[df.select(F.lit(n).alias("table_name"), "page_id", "page_title") for n, df in tables.items()])


@query("e2_load_log", f"with {v.V_LOAD_PAGES} select * from r_log")
def _(spark, sf):
    return _load_pages(spark, sf).log


@query(
    "e2_load_report",
    f"""with {v.V_LOAD_PAGES}
    select table_name, count(*) as pages, count(*) filter (status = 'added') as additions,
      count(*) filter (status = 'duplicate') as duplicates, count(*) filter (status = 'error') as errors
    from r_log where status <> 'left out' group by 1""",
)
def _(spark, sf):
    return _load_pages(spark, sf).report("table_name")


@query(
    "e2_rejected_tuples",
    f"""select '(' || (p_partkey + 1) || ',0)' as value from part
    union all select '(' || p_partkey || ',0,''Cut off' from part where p_size > 25""",
)
def _(spark, sf):
    return _load_pages(spark, sf).rejected


# --- text ------------------------------------------------------------------------------------
_ASCII = "strip_accents(replace({}, 'ß', 'ss'))"


@query(
    "t1_extract_sections",
    f"""with s as (select doc_id, unnest(string_split(text, chr(10))) as line,
      unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as pos from documents)
    select doc_id, pos::int as pos, case when pos = 0 then 'Lead' else 'Part ' || pos end as heading,
      {_ASCII.format("line")} as section from s""",
)
def _(spark, sf):
    parsed = wt.extract_sections(v.wikitext(spark, sf))
    return parsed.select(
        "doc_id", F.posexplode(F.arrays_zip("headings", "sections")).alias("pos", "both")
    ).select("doc_id", "pos", F.col("both.headings").alias("heading"), F.col("both.sections").alias("section"))


@query(
    "t1_extract_sections_headed_only",
    f"""with s as (select doc_id, string_split(text, chr(10)) as lines from documents)
    select doc_id, case when len(lines) > 1 then len(lines) else 0 end::int as n_headings from s""",
)
def _(spark, sf):
    parsed = wt.extract_sections(v.wikitext(spark, sf), keep_headless=False)
    return parsed.select("doc_id", F.size("headings").alias("n_headings"))


_LINKED = """
shown as (
  select page_id, 0 as pos, links[1] as link, links[1] as label from anchors where len(links) > 0
  union all
  select page_id, pos + 1, link, case when pos % 2 = 0 then link else 'label ' || pos end from v_links)
"""


@query(
    "t2_extract_links",
    f"""with {v.V_LINKS}, {_LINKED}
    select page_id, pos::int as pos, {_ASCII.format("link")} as link from anchors left join shown using (page_id)""",
)
def _(spark, sf):
    found = wt.extract_links(F.col("text"))
    return v.wikilinks(spark, sf).select("page_id", F.posexplode_outer(found).alias("pos", "link"))


@query(
    "t2_extract_links_display",
    f"""with {v.V_LINKS}, {_LINKED}
    select page_id, pos::int as pos, {_ASCII.format("label")} as link from anchors left join shown using (page_id)""",
)
def _(spark, sf):
    found = wt.extract_links(F.col("text"), use="display")
    return v.wikilinks(spark, sf).select("page_id", F.posexplode_outer(found).alias("pos", "link"))


@query(
    "t3_strip_markup",
    f"""with {v.V_LINKS}, {_LINKED},
    l as (select page_id, string_agg(label, ' ' order by pos) as labels from shown where pos > 0
      group by 1)
    select page_id, 'thumb|see ' || coalesce(links[1], 'it') || ' and ' || coalesce(labels, '') || ' Category:Pages  ' as visible
    from anchors left join l using (page_id)""",
)
def _(spark, sf):
    return v.wikilinks(spark, sf).select(
        "page_id", wt.strip_markup(F.col("text")).alias("visible")
    )


@query(
    "t3_strip_tables",
    """select doc_id, array_to_string(list_transform(string_split(text, chr(10)),
        lambda x: chr(10) || ' ' || x || '   [[x]]'), chr(10)) || chr(10) as visible
    from documents""",
)
def _(spark, sf):
    return v.tabled(spark, sf).select("doc_id", wt.strip_markup(F.col("text")).alias("visible"))


@query(
    "t4_transliterate",
    f"select doc_id, md5({_ASCII.format('text')}) as ascii_md5, length({_ASCII.format('text')}) as n from documents",
)
def _(spark, sf):
    ascii_text = transliterate(F.col("text"))
    return parsed(spark, sf, "documents").select(
        "doc_id", F.md5(ascii_text).alias("ascii_md5"),
        F.char_length(ascii_text).cast("bigint").alias("n"),
    )


@query(
    "t4_transliterate_nfkd",
    "select doc_id, md5(strip_accents(replace(text, 'ß', ''))) as ascii_md5 from documents",
)
def _(spark, sf):
    return parsed(spark, sf, "documents").select(
        "doc_id", F.md5(transliterate(F.col("text"), "nfkd")).alias("ascii_md5")
    )


_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"
_NO_STOP = rf"""array_to_string(list_filter(string_split_regex(text, '\s+'),
  lambda w: w <> '' and not list_contains({_STOP_SQL}, lower(w))), ' ')"""


@query("t5_remove_stopwords", f"select doc_id, {_NO_STOP} as text from documents")
def _(spark, sf):
    return parsed(spark, sf, "documents").select(
        "doc_id", tx.remove_stopwords(F.col("text")).alias("text")
    )


@query(
    "t6_collapse_lines",
    "select doc_id, replace(text, chr(10), '') as text from documents",
)
def _(spark, sf):
    return parsed(spark, sf, "documents").select(
        "doc_id", tx.collapse_lines(F.col("text")).alias("text")
    )


@query("t7_lead_token_length", f"with {v.V_LEAD} select doc_id, length::bigint as length from v_lead")
def _(spark, sf):
    return _lengths(spark, sf).select("doc_id", "length")


_CUT = f"with recursive {v.V_PIECES}"


def _subwords(spark, sf, cap=None):
    leads = wt.extract_sections(v.wikitext(spark, sf), markup=False)
    return subwords.lead_subword_lengths(leads, v.piece_vocabulary(spark, sf), "doc_id", cap)


@query(
    "t7_lead_subword_length",
    f"""{_CUT}
    select d.doc_id, case when any_value(d.text) = '' then 0 else coalesce(sum(w.n), 0) + 2 end::bigint as length,
      count(*) filter (w.unknown)::bigint as n_unknown
    from documents d left join v_leads l using (doc_id) left join v_words w using (word) group by 1""",
)
def _(spark, sf):
    return _subwords(spark, sf)


@query(
    "t7_lead_subword_length_capped",
    f"""{_CUT}, t as (
      select l.doc_id, w.n, w.unknown, sum(w.n) over (partition by l.doc_id order by l.pos) as upto
      from v_leads l join v_words w using (word))
    select d.doc_id, case when any_value(d.text) = '' then 0 else least(coalesce(max(t.upto), 0), 22) + 2 end::bigint as length,
      count(*) filter (t.unknown and t.upto - t.n < 22)::bigint as n_unknown
    from documents d left join t using (doc_id) group by 1""",
)
def _(spark, sf):
    return _subwords(spark, sf, cap=24)


@query(
    "a10_unknown_subword_share",
    f"""{_CUT}, t as (
      select (select count(*) from documents where text <> '') * 2 + sum(w.n) as n_tokens, count(*) filter (w.unknown) as n_unknown
      from v_leads l join v_words w using (word))
    select n_unknown, n_tokens::bigint as n_tokens, round(100 * n_unknown / n_tokens, 6) as percent_unknown from t""",
)
def _(spark, sf):
    return subwords.unknown_subword_share(_subwords(spark, sf)).withColumn("percent_unknown", six("percent_unknown"))


@query(
    "t8_tokenize_terms",
    rf"""select doc_id, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'))::int as n_terms,
      md5(array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), ' ')) as terms_md5
    from documents""",
)
def _(spark, sf):
    terms = tx.tokenize_terms(F.col("text"))
    return parsed(spark, sf, "documents").select(
        "doc_id", F.size(terms).alias("n_terms"), F.md5(F.array_join(terms, " ")).alias("terms_md5")
    )


@query(
    "t9_slug",
    f"select doc_id, replace({v.FIRST_LINE}, ' ', '_') as slug from documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.slug(v.first_line(F.col("text"))).alias("slug")
    )


@query(
    "t10_colour_by_attribute",
    """select c_custkey, case c_mktsegment when 'BUILDING' then 'blue' when 'MACHINERY' then 'pink'
      else 'grey' end as colour from customer""",
)
def _(spark, sf):
    colour = tx.colour_by_attribute(
        F.col("c_mktsegment"), {"BUILDING": "blue", "MACHINERY": "pink"}, "grey"
    )
    return table(spark, sf, "customer").select("c_custkey", colour.alias("colour"))


# --- similarity --------------------------------------------------------------------------------
@query(
    "x1_tfidf",
    f"with {_CORPUS}, {_TFIDF} select doc, term, tf, round(weight, 6) as weight from vec",
)
def _(spark, sf):
    return similarity.tfidf(_corpus(spark, sf)).withColumn("weight", six("weight"))


@query(
    "x2_pairwise_cosine",
    f"""with {_CORPUS}, {_TFIDF},
    p as (select doc as a, doc + 1 as b from corpus union select doc, doc + 7 from corpus where doc % 3 = 0)
    select a, b, round(coalesce(sum(x.weight * y.weight), 0), 6) as similarity
    from p left join vec x on x.doc = a left join vec y on y.doc = b and y.term = x.term
    group by 1, 2""",
)
def _(spark, sf):
    docs = _corpus(spark, sf)
    vectors = store(similarity.tfidf(docs))
    near = docs.select(F.col("doc").alias("a"), (F.col("doc") + 1).alias("b"))
    far = docs.where("doc % 3 = 0").select(F.col("doc").alias("a"), (F.col("doc") + 7).alias("b"))
    pairs = near.unionByName(far).unionByName(far)  # with gaps and repeats
    return similarity.pairwise_cosine(vectors, pairs).withColumn("similarity", six("similarity"))


@query(
    "x3_melt_terms",
    """select l_suppkey as doc, l_returnflag || l_linestatus as term, count(*)::double as weight
      from lineitem group by all""",
)
def _(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc"), F.concat("l_returnflag", "l_linestatus").alias("term")
    )
    # the columns of the wide matrix: all flags there can be
    terms = [flag + status for flag in "ANR" for status in "FO"]
    wide = items.groupBy("doc").agg(
        *[F.count_if(F.col("term") == t).cast("double").alias(t) for t in terms]
    )
    return similarity.melt_terms(wide, terms)


def _page_links_and_texts(spark, sf):
    resolved = links.resolve_links(
        links.explode_links(v.page_arrays(spark, sf).withColumnRenamed("page_id", "src"), "src"),
        v.page_titles(spark, sf),
    )
    found = resolved.where(F.col("page_id").isNotNull()).select("src", F.col("page_id").alias("dst"))
    texts = parsed(spark, sf, "pages").select(
        F.col("page_id").alias("doc"), F.regexp_replace("html", "<[^>]*>", " ").alias("text")
    )
    return found, texts


@query(
    "x4_similar_pages",
    f"""with {v.V_LINKS},
    corpus as (select page_id as doc, regexp_replace(html, '<[^>]*>', ' ', 'g') as text from pages),
    {_TFIDF},
    p as (select distinct l.page_id as a, k.best.p as b from v_links l
      join by_key k on k.k = lower(l.link) where l.page_id <> k.best.p),
    s as (select a, b, coalesce(sum(x.weight * y.weight), 0) as sim
      from p left join vec x on x.doc = a left join vec y on y.doc = b and y.term = x.term group by 1, 2)
    select a as src, b as dst, round(sim, 6) as similarity,
      (row_number() over (partition by a order by sim desc, b))::int as rank
    from s where sim >= 0.05 qualify rank <= 10""",
)
def _(spark, sf):
    found, texts = _page_links_and_texts(spark, sf)
    vectors = store(similarity.tfidf(texts))
    best = similarity.similar_pages(found, vectors, threshold=0.05, k=10)
    return best.withColumn("similarity", six("similarity"))


_CLASSES = """
names as (select doc, string_agg(term || chr(1) || tf, chr(2) order by term) as name from vec group by doc),
classes as (select doc, min(doc) over (partition by name) as representative from names),
own as (select v.* from vec v join classes c on c.doc = v.doc and c.representative = v.doc)"""
SIMILAR = 0.8


def _similar(spark, sf):
    return similarity.similar_pairs(similarity.tfidf(_corpus(spark, sf), packed=True), SIMILAR)


@query(
    "x4_similar_pairs",
    f"""with {_CORPUS}, {_TFIDF}, {_CLASSES}
    select x.doc as a, y.doc as b, round(sum(x.weight * y.weight), 6) as similarity
    from own x join own y on x.term = y.term and x.doc < y.doc group by 1, 2
    having sum(x.weight * y.weight) >= {SIMILAR}""",
)
def _(spark, sf):
    return _similar(spark, sf)[0].withColumn("similarity", six("similarity"))


@query("x4_equal_pages", f"with {_CORPUS}, {_TFIDF}, {_CLASSES} select doc, representative from classes")
def _(spark, sf):
    return similarity.vector_classes(store(similarity.tfidf(_corpus(spark, sf))))


@query(
    "x5_normalised_corpus",
    f"""with corpus as (select doc_id as doc, {_NO_STOP} as text from documents), {_TFIDF}
    select doc, term, tf, round(weight, 6) as weight from vec""",
)
def _(spark, sf):
    vectors = similarity.tfidf(similarity.normalised_corpus(_corpus(spark, sf)))
    return vectors.withColumn("weight", six("weight"))


# --- graph --------------------------------------------------------------------------------------
def _stored_graph(spark, sf):
    """The links, in buckets of their source, and the level graph's vertices and edges."""
    found = graph.stored_links(v.graph_links(spark, sf))
    return found, *graph.level_graph(
        found, v.GRAPH_START, v.GRAPH_LEVELS, v.GRAPH_CAP, order=("dst",)
    )


def _level_graph(spark, sf):
    return _stored_graph(spark, sf)[1:]


@query(
    "g1_level_graph",
    f"with {v.V_GRAPH} select id, level, level < 3 as is_mapped from v_vertices",
)
def _(spark, sf):
    return _level_graph(spark, sf)[0]


_ALL_LINKS = f"""{v.V_GRAPH.rsplit("v_walk as", 1)[0]}
v_reach as (
  select '{v.GRAPH_START}' as id, 0 as level
  union
  select g.dst, r.level + 1 from v_reach r join v_graph g on g.src = r.id where r.level < {v.GRAPH_LEVELS}),
v_all as (select id, min(level)::bigint as level from v_reach group by id)"""


@query(
    "g1_level_graph_uncapped",
    f"with {_ALL_LINKS} select id, level, level < {v.GRAPH_LEVELS} as is_mapped from v_all",
)
def _(spark, sf):
    found = graph.stored_links(v.graph_links(spark, sf))
    return graph.level_graph(found, v.GRAPH_START, v.GRAPH_LEVELS)[0]


@query(
    "g2_graph_edges_uncapped",
    f"""with {_ALL_LINKS} select g.src, g.dst from v_graph g join v_all a on a.id = g.src
    where a.level < {v.GRAPH_LEVELS}""",
)
def _(spark, sf):
    found = graph.stored_links(v.graph_links(spark, sf))
    vertices, _ = graph.level_graph(found, v.GRAPH_START, v.GRAPH_LEVELS)
    return graph.graph_edges(found, vertices)


_EDGES = "v_edges as (select c.src, c.dst from v_capped c join v_vertices x on x.id = c.src where x.level < 3)"


@query("g2_graph_edges", f"with {v.V_GRAPH}, {_EDGES} select src, dst from v_edges")
def _(spark, sf):
    found, vertices, _ = _stored_graph(spark, sf)
    return graph.graph_edges(found, vertices, v.GRAPH_CAP, order=("dst",))


@query(
    "g3_vertex_status",
    f"""with {v.V_GRAPH}, n as (select distinct src as id from v_graph)
    select n.id, x.id is not null as in_graph, coalesce(x.level < 3, false) as is_mapped
    from n left join v_vertices x using (id)""",
)
def _(spark, sf):
    found, vertices, _ = _stored_graph(spark, sf)
    names = found.select(F.col("src").alias("id")).distinct()
    return graph.vertex_status(vertices, names)


@query(
    "g3_unmapped_vertices",
    f"with {v.V_GRAPH} select id, level from v_vertices where level = 3",
)
def _(spark, sf):
    return graph.unmapped_vertices(_level_graph(spark, sf)[0]).select("id", "level")


@query(
    "g4_graph_export",
    f"""with {v.V_GRAPH}, {_EDGES}
    select 'nodes' as part, '{{"id":"' || id || '","group":' || level || '}}' as json from v_vertices
    union all select 'links', '{{"source":"' || src || '","target":"' || dst || '","value":1}}' from v_edges""",
)
def _(spark, sf):
    return graph.graph_records(*_level_graph(spark, sf))


@query(
    "g5_level_filter",
    f"with {v.V_GRAPH} select id, level from v_vertices where level <= 2",
)
def _(spark, sf):
    return graph.level_filter(_level_graph(spark, sf)[0], 2).select("id", "level")


@query(
    "g6_graph_from_pairs",
    f"""with {v.V_GRAPH}, a as (select 's' || s_suppkey as id, s_name from supplier)
    select id, s_name from (select src as id from v_pairs union select dst from v_pairs)
    left join a using (id)""",
)
def _(spark, sf):
    attributes = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), "s_name"
    )
    return graph.graph_from_pairs(v.supplier_parts(spark, sf), attributes)[0]


@query(
    "a12_graph_summary",
    f"""with {v.V_GRAPH}, {_EDGES}
    select (select count(*) from v_vertices) as n_vertices, (select count(*) from v_edges) as n_edges""",
)
def _(spark, sf):
    return graph.graph_summary(*_level_graph(spark, sf))


# --- sinks, checks, identifiers -------------------------------------------------------------------
@query("k1_write_tables", f"with {v.V_TABLES} select page_id, page_quality from v_quality")
def _(spark, sf):
    root = work_dir(spark, "tables")
    sinks.write_tables(_linked_tables(spark, sf), root)
    return stored.read_table(spark, root, "quality")


@query(
    "k2_rebuild_tables",
    f"""with {v.V_TABLES}
    select 'page' as table_name, count(*) as n_rows from v_page
    union all select 'talk', 0 union all select 'link', 0
    union all select 'quality', count(*) from v_quality
    union all select 'text', count(*) from documents""",
)
def _(spark, sf):
    root = work_dir(spark, "tables")
    tables = _linked_tables(spark, sf)
    text = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("title"),
        F.array("lang").alias("headings"),
        F.array("text").alias("sections"),
        F.array("source").alias("links"),
    )
    sinks.write_tables({"text": text, "talk": tables["talk"]}, root)
    sinks.rebuild_tables(spark, {"page": tables["page"], "quality": tables["quality"]}, root)
    counts = [
        pages.table_count(df).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in stored.read_tables(spark, root).items()
    ]
    return pages.combine_chunks(*counts)


@query(
    "k2_rebuild_version",
    f"""with {v.V_TABLES}
    select 1 as version, 'page' as table_name, count(*) as n_rows from v_page
    union all select 1, 'talk', count(*) from v_talk
    union all select 1, 'link', 0 union all select 1, 'quality', count(*) from v_quality
    union all select 1, 'text', count(*) from documents
    union all select 2, 'page', count(*) from v_page
    union all select 2, 'talk', 0 union all select 2, 'link', 0 union all select 2, 'quality', 0
    union all select 2, 'text', count(*) from documents""",
)
def _(spark, sf):
    root = work_dir(spark, "tables")
    text = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("title"), F.array("lang").alias("headings"),
        F.array("text").alias("sections"), F.array("source").alias("links"),
    )
    tables = _linked_tables(spark, sf)
    first = sinks.rebuild_version(spark, tables | {"text": text}, root)
    second = sinks.rebuild_version(spark, {"page": tables["page"]}, root)
    counts = [
        pages.table_count(df).select(F.lit(number).alias("version"), F.lit(name).alias("table_name"), "n_rows")
        for number in (first, second) for name, df in sinks.read_version(spark, root, number).items()
    ]
    return pages.combine_chunks(*counts)


@query(
    "k3_integrity_report",
    f"""with {v.V_TABLES}, {v.V_LINKS},
    v_titles_linked as (select page_id * 7 as page_id, repeat(link, 40) as link from v_links)
    select 'page' as table_name, 'unique page_id' as check_name, 0::bigint as violations
    union all select 'page', 'unique page_title', 0
    union all select 'page', 'not null page_id', 0
    union all select 'page', 'length page_title', 0
    union all select 'talk', 'unique page_id', 0
    union all select 'talk', 'unique page_title', 0
    union all select 'talk', 'not null page_id', 0
    union all select 'talk', 'length page_title', 0
    union all select 'talk', 'page_title in page', count(*) from v_talk_all
      where page_title not in (select page_title from v_page)
    union all select 'quality', 'unique page_id', count(*) from (
      select id from v_quality_all group by id having count(*) > 1)
    union all select 'quality', 'not null page_id', 0
    union all select 'quality', 'length page_quality', 0
    union all select 'quality', 'page_id in talk', count(*) from v_quality_all
      where id not in (select page_id from v_talk_all)
    union all select 'link', 'unique pl_from, part', 0
    union all select 'link', 'not null pl_from', 0
    union all select 'link', 'not null part', 0
    union all select 'link', 'length pl_titles', count(*) from (
      select page_id from v_titles_linked group by 1 having max(length(link)) > 200)
    union all select 'link', 'pl_from in page', count(*) from (
      select distinct page_id from v_titles_linked where page_id not in (select page_id from v_page))
    union all select 'text', 'unique title', count(*) from (
      select {v.FIRST_LINE} from documents group by 1 having count(*) > 1)
    union all select 'text', 'not null title', 0
    union all select 'text', 'length title', count(*) from documents where length({v.FIRST_LINE}) > 200""",
)
def _(spark, sf):
    graded = quality.quality_from_category(v.quality_candidates(spark, sf)).select(
        F.col("id").alias("page_id"), F.col("quality").alias("page_quality")
    )
    return checks.integrity_report(
        {
            "text": table(spark, sf, "documents").select(v.first_line(F.col("text")).alias("title")),
            "page": v.page_table(spark, sf),
            "talk": v.talk_candidates(spark, sf),
            "quality": graded,
            "link": _stored_links(spark, sf),
        }
    )


def _stored_links(spark, sf):
    """Links of every web page as if of the page with seven times its number; most of these do not exist, and some titles are long."""
    found = v.page_arrays(spark, sf).select((F.col("page_id") * 7).alias("pl_from"), F.explode("links").alias("title"))
    return links.collect_page_links(found.withColumn("title", F.repeat("title", F.lit(40))))


@query(
    "k4_expected_count_gate",
    f"""select count(*) as n_rows, {EXPECTED_PAGES}::bigint as expected, count(*) = {EXPECTED_PAGES} as is_full
    from lineitem union all select count(*), 25::bigint, count(*) = 25 from nation""",
)
def _(spark, sf):
    loaded = sinks.expected_count_gate(table(spark, sf, "lineitem"), EXPECTED_PAGES)
    return loaded.unionByName(sinks.expected_count_gate(table(spark, sf, "nation"), 25))


@query(
    "k5_duplicate_log",
    f"with {v.V_DUPS} select file_start, chunk, pos, title from v_loaded where status = 'duplicate'",
)
def _(spark, sf):
    return pages.duplicate_log(pages.dedupe_by_title(v.chunked_pages(spark, sf)))


@query(
    "k5_skipped_log",
    f"""with {v.V_TABLES} select page_id, page_title from v_talk_all
    where page_title not in (select page_title from v_page)""",
)
def _(spark, sf):
    found = quality.talk_of_existing_pages(v.talk_candidates(spark, sf), v.page_table(spark, sf))
    return found.where(F.col("status") != "kept").select("page_id", "page_title")


_WORDS = rf"""
w as (select distinct unnest(string_split_regex(text, '\s+')) as title from documents),
a as (select {_ASCII.format("title")} as title_ascii, title from w),
c as (select title_ascii, count(*) as n_titles, min(title) as first_title, max(title) as last_title
  from a group by 1 having count(*) > 1 or title_ascii = '')
"""


def _words(spark, sf):
    return parsed(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("title"))


@query("k6_translit_collisions", f"with {_WORDS} select * from c")
def _(spark, sf):
    return checks.translit_collisions(_words(spark, sf))


@query(
    "k6_colliding_titles",
    f"with {_WORDS} select title_ascii, title from a where title_ascii in (select title_ascii from c)",
)
def _(spark, sf):
    return checks.colliding_titles(_words(spark, sf))


@query(
    "k7_title_ids",
    f"""with {v.V_DUMP_LINK}
    select title, row_number() over (order by title) - 1 as title_id
    from (select distinct title from v_link_dump)""",
)
def _(spark, sf):
    return links.title_ids(sql_dump.parse_sql_dump(v.dump_link_lines(spark, sf), "link"))


@query(
    "k7_title_ids_by_appearance",
    """with t as (select p_name as title, min(p_partkey) as seen from part group by 1)
    select p.p_partkey, i.title_id from part p join (
      select title, row_number() over (order by seen) - 1 as title_id from t) i on i.title = p.p_name""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"))
    return links.replace_titles(part, links.title_ids(part, seen="p_partkey"))


# --- streaming --------------------------------------------------------------------------------------
_ARRIVALS = f"""with {v.V_DUPS},
    b as (select *, case when file_start < 10 then 0 else 1 end as arrival from v_dups)
    select file_start, chunk, pos, title, case when row_number() over (
      partition by title order by arrival, file_start, chunk, pos desc) = 1
      then 'added' else 'duplicate' end as status from b"""


def _two_deliveries(spark, sf, load):
    """Pages that arrive in two deliveries, the second of which sees what the first loaded."""
    arriving = v.chunked_pages(spark, sf)
    root = work_dir(spark, "stream")
    for early in (True, False):
        delivery = arriving.where((F.col("file_start") < 10) == F.lit(early))
        delivery.write.mode("append").parquet(f"{root}/arriving")
        load(spark, f"{root}/arriving", arriving.schema, f"{root}/loaded", f"{root}/checkpoint")
    return load_log(spark, f"{root}/loaded", arriving.schema).drop("stream", "batch_id")


@query("r1_incremental_load", _ARRIVALS)
def _(spark, sf):
    return _two_deliveries(spark, sf, incremental_load)


@query("r1_keyed_load", _ARRIVALS)
def _(spark, sf):
    return _two_deliveries(spark, sf, keyed_load)
