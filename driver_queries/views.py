"""The driver's tables seen as dumps, wikitext, links and tables.

Every view covers its whole table. Texts are rendered within a row, so no view
groups rows into one value. The SQL fragments say the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpweave.functions.text import tokens
from dumpweave.operators.subwords import mark_pieces, plain_words
from dumpweave.plans.barrier import once
from dumpweave.plans.session import spread

TALK_OFFSET = 10_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parsed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose texts are about to be parsed."""
    return spread(table(spark, sf, name))


def first_line(text: Column) -> Column:
    return F.get(F.split(text, "\n"), F.lit(0))


FIRST_LINE = "split_part(text, chr(10), 1)"

# --- links between web pages ------------------------------------------------
_ANCHOR = r"<a [^>]*>([^<]*)</a>"


def page_arrays(spark, sf) -> DataFrame:
    """page_id, links: the anchor texts of every page."""
    anchors = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1))
    return once(parsed(spark, sf, "pages"), links=anchors).select("page_id", "links")


def page_titles(spark, sf) -> DataFrame:
    """title, key (its first word), page_id."""
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return parsed(spark, sf, "pages").select(
        title.alias("title"), F.substring_index(title, " ", 1).alias("key"), "page_id"
    )


V_LINKS = rf"""
anchors as (select page_id, regexp_extract_all(html, '{_ANCHOR}', 1) as links from pages),
v_links as (
  select page_id, unnest(generate_series(0, len(links) - 1)) as pos, unnest(links) as link
  from anchors where len(links) > 0),
v_titles as (
  select title, split_part(title, ' ', 1) as key, page_id
  from (select regexp_extract(html, '<title>(.*?)</title>', 1) as title, page_id from pages)),
by_key as (
  select lower(key) as k, min(struct_pack(t := title, p := page_id)) as best
  from v_titles group by 1)
"""


def wikilinks(spark, sf) -> DataFrame:
    """page_id, text: links in wikitext, every other one with a label, after an
    image whose caption holds a link, before a category and a blank link. A page
    without links has the image and the rest."""
    link = F.transform(
        "links",
        lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("[["), x, F.lit("]]"))).otherwise(
            F.concat(F.lit("[["), x, F.lit("|label "), i.cast("string"), F.lit("]]"))
        ),
    )
    first = F.get("links", F.lit(0))
    text = F.concat(
        F.lit("<!-- note -->[[File:p.jpg|thumb|see [["),
        first,
        F.lit("]]]] '''and''' {{x|{{y}}}}"),
        F.array_join(link, " "),
        F.lit(" [[Category:Pages]] [[ ]]"),
    )
    plain = F.lit("<!-- note -->[[File:p.jpg|thumb|see it]] '''and''' {{x|{{y}}}} [[Category:Pages]] [[ ]]")
    text = F.when(F.size("links") > 0, text).otherwise(plain)
    return once(page_arrays(spark, sf), text=text).select("page_id", "text")


# --- SQL dumps ----------------------------------------------------------------
def _quoted(text: Column) -> Column:
    escaped = F.regexp_replace(F.translate(text, " ", "_"), r"(['\\])", r"\\$1")
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def _tuples(name: str, *tuples: list[Column | str]) -> Column:
    parts = [F.lit(f"INSERT INTO `{name}` VALUES (")]
    for i, fields in enumerate(tuples):
        if i:
            parts.append(F.lit("),("))
        for j, field in enumerate(fields):
            if j:
                parts.append(F.lit(","))
            parts.append(F.lit(field) if isinstance(field, str) else field.cast("string"))
    return F.concat(*parts, F.lit(");"))


def dump_page_lines(spark, sf) -> DataFrame:
    """value: per part a comment, and an INSERT line with an article and its talk page."""
    title = F.concat(F.col("p_name"), F.lit("'s (x), y "), F.col("p_partkey").cast("string"))
    redirect = F.when(F.col("p_type") == "ECONOMY", 1).otherwise(0)
    rest = ["0", "0.5", "'20210501'", "NULL", "77", "9", "'wikitext'", "NULL"]
    line = _tuples(
        "page",
        [F.col("p_partkey") + 1, "0", _quoted(title), "''", redirect, *rest],
        [F.col("p_partkey") + 1 + TALK_OFFSET, "1", _quoted(title), "''", "0", *rest],
    )
    return parsed(spark, sf, "part").select(
        F.explode(F.array(F.lit("-- Dumping data"), line, F.lit(""))).alias("value")
    )


V_DUMP_PAGE = f"""
v_titles as (
  select p_partkey, p_name || '''s (x), y ' || p_partkey as title,
         case when p_type = 'ECONOMY' then 1 else 0 end as redirect from part),
v_page_dump as (
  select p_partkey + 1 as page_id, 0 as namespace, replace(title, ' ', '_') as title,
         redirect as is_redirect from v_titles
  union all
  select p_partkey + 1 + {TALK_OFFSET}, 1, replace(title, ' ', '_'), 0 from v_titles)
"""


def dump_link_lines(spark, sf) -> DataFrame:
    """value: per line item an INSERT line with a link of the supplier's page and one
    of the order's page."""
    part = F.col("l_partkey").cast("string")
    first = F.concat(F.when(F.col("l_linestatus") == "O", "Part ").otherwise("Part"), part)
    second = F.concat(F.lit("It's ("), part, F.lit("), x"))
    line = _tuples(
        "pagelinks",
        [
            F.col("l_suppkey") + 1,
            F.when(F.col("l_linenumber") == 7, 1).otherwise(0),
            _quoted(first),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0),
        ],
        [F.col("l_orderkey") + 1 + TALK_OFFSET, "0", _quoted(second), "0"],
    )
    return once(parsed(spark, sf, "lineitem"), value=line).select("value")


V_DUMP_LINK = f"""
v_link_dump as (
  select l_suppkey + 1 as pl_from, case when l_linenumber = 7 then 1 else 0 end as namespace,
         (case when l_linestatus = 'O' then 'Part_' else 'Part' end) || l_partkey as title,
         case when l_returnflag = 'R' then 1 else 0 end as from_namespace from lineitem
  union all
  select l_orderkey + 1 + {TALK_OFFSET}, 0, 'It''s_(' || l_partkey || '),_x', 0 from lineitem),
v_ns0 as (select pl_from, title from v_link_dump where namespace = 0 and from_namespace = 0)
"""


def grade_category(key: str) -> Column:
    grades = ["FA", "FL", "A", "GA", "B", "C"]
    grade = F.get(F.lit(grades), (F.col(key) % 6).cast("int"))
    return F.concat(grade, F.lit("-Class_articles"))


_GRADE_SQL = "(['FA','FL','A','GA','B','C'])[(o_orderkey % 6 + 1)::int]"


def dump_category_lines(spark, sf) -> DataFrame:
    """value: per order an INSERT line with a grade and another category of a talk page."""
    talk = F.col("o_custkey") + 1 + TALK_OFFSET
    rest = ["'SORT\\'KEY'", "'2021-05-01 00:00:00'", "''", "'uca'", "'page'"]
    line = _tuples(
        "categorylinks",
        [talk, F.concat(F.lit("'"), grade_category("o_orderkey"), F.lit("'")), *rest],
        [talk, "'Living_people_(x)'", *rest],
    )
    return once(parsed(spark, sf, "orders"), value=line).select("value")


# --- relational tables ----------------------------------------------------------
def page_table(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1).alias("page_id"), F.col("c_name").alias("page_title")
    )


def talk_candidates(spark, sf) -> DataFrame:
    """Talk pages of all customers and suppliers; one segment's, and the suppliers', have no page."""
    no_page = F.concat(F.lit("Lost "), F.col("c_name"))
    title = F.when(F.col("c_mktsegment") == "BUILDING", no_page).otherwise(F.col("c_name"))
    customers = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1 + TALK_OFFSET).alias("page_id"), title.alias("page_title")
    )
    suppliers = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1 + 2 * TALK_OFFSET).alias("page_id"),
        F.col("s_name").alias("page_title"),
    )
    return customers.unionByName(suppliers)


def quality_candidates(spark, sf) -> DataFrame:
    """seq, id, category: a grade of a customer's talk page per order."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        (F.col("o_custkey") + 1 + TALK_OFFSET).alias("id"),
        grade_category("o_orderkey").alias("category"),
    )


V_TABLES = f"""
v_page as (select c_custkey + 1 as page_id, c_name as page_title from customer),
v_talk_all as (
  select c_custkey + 1 + {TALK_OFFSET} as page_id,
    case c_mktsegment when 'BUILDING' then 'Lost ' else '' end || c_name as page_title from customer
  union all select s_suppkey + 1 + {2 * TALK_OFFSET}, s_name from supplier),
v_talk as (select * from v_talk_all where page_title in (select page_title from v_page)),
v_quality_all as (
  select o_orderkey as seq, o_custkey + 1 + {TALK_OFFSET} as id, {_GRADE_SQL} as quality,
         o_orderkey % 6 as grade_rank from orders),
v_quality_first as (
  select id as page_id, quality as page_quality, seq from v_quality_all
  qualify row_number() over (partition by id order by seq) = 1),
v_quality as (
  select page_id, page_quality from v_quality_first
  where page_id in (select page_id from v_talk))
"""


# --- XML pages --------------------------------------------------------------------
def _escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def xml_title(text: Column, lang: Column) -> Column:
    line = first_line(text)
    return F.when(lang == "de", F.concat(F.lit("Talk:"), line)).when(
        lang == "es", F.concat(F.lit(":"), line)
    ).otherwise(line)


def xml_records(spark, sf) -> DataFrame:
    """value: every document as a page, cut where the reader cuts a dump."""
    value = F.concat(
        F.lit("\n  <page>\n    <title>"),
        _escaped(xml_title(F.col("text"), F.col("lang"))),
        F.lit("</title>\n    <ns>"),
        F.when(F.col("lang") == "de", "1").otherwise("0"),
        F.lit("</ns>\n    <id>"),
        F.col("doc_id").cast("string"),
        F.lit("</id>\n"),
        F.when(F.col("source") == "src3", '<redirect title="A &amp; B" />').otherwise(""),
        F.lit("<revision><id>7</id><text bytes=\"1\" xml:space=\"preserve\">"),
        _escaped(F.col("text")),
        F.lit("</text></revision>\n  "),
    )
    return once(parsed(spark, sf, "documents"), value=value).select("value")


V_XML = f"""
v_xml as (
  select doc_id as id, case when lang = 'de' then 1 else 0 end as ns, source = 'src3' as is_redirect,
         text, case lang when 'de' then 'Talk:' || {FIRST_LINE} when 'es' then ':' || {FIRST_LINE}
         else {FIRST_LINE} end as title
  from documents)
"""


def dump_records(spark, sf) -> DataFrame:
    """file, value: every document as a page of its source's dump file, with headings and a link.

    The titles of copies are the same. German pages are of another namespace,
    those of one source redirects. Where a document is in French and of two
    sources, its element lacks an end tag.
    """
    line = F.get(F.split("text", "\n"), F.lit(0))
    title = F.concat(F.when(F.col("lang") == "de", "Talk:").otherwise(""), F.translate(F.left(line, F.lit(40)), ":", ";"))
    start = F.substring("source", 4, 9)
    path = F.concat(F.lit(f"/dump/{_FILE}"), start, F.lit(".xml-p"), start, F.lit("p999999.bz2"))
    whole = F.concat(F.col("text"), F.lit(" [[Page "), F.col("lang"), F.lit("|label]]"))
    broken = (F.col("lang") == "fr") & F.col("source").isin("src5", "src0")
    value = F.concat(
        F.lit("\n  <page>\n    <title>"), _escaped(title), F.lit("</title>\n    <ns>"),
        F.when(F.col("lang") == "de", "1").otherwise("0"), F.lit("</ns>\n    <id>"), F.col("doc_id").cast("string"),
        F.lit("</id>\n"), F.when(F.col("source") == "src3", '<redirect title="A &amp; B" />').otherwise(""),
        F.lit('<revision><id>7</id><text bytes="1" xml:space="preserve">'), _escaped(headed(whole)),
        F.when(broken, "").otherwise("</text>"), F.lit("</revision>\n  "),
    )
    return once(parsed(spark, sf, "documents"), file=path, value=value).select("file", "value")


V_LOAD = rf"""
l_pages as (
  select substr(source, 4)::bigint as file_start, doc_id as id, lang, source, text,
    case when lang = 'de' then 'Talk:' else '' end || replace(left({FIRST_LINE}, 40), ':', ';') as title,
    lang = 'fr' and source in ('src5', 'src0') as broken
  from documents),
l_judged as (
  select *, strip_accents(replace(title, 'ß', 'ss')) as name,
    case when broken then 'error' when title = '' then 'error' when source = 'src3' or lang = 'de' then 'left out' else 'kept' end as state
  from l_pages),
l_placed as (
  select file_start, id, name, (row_number() over (partition by file_start order by id) - 1) // 20 as chunk,
    row_number() over (partition by file_start order by id) - 1 as pos
  from l_judged where state = 'kept'),
l_settled as (
  select *, case when row_number() over (partition by name order by file_start, chunk, pos desc) = 1
    then 'added' else 'duplicate' end as status from l_placed),
l_log as (
  select j.file_start, s.chunk, case when not j.broken then j.id end as id, case when not j.broken then j.name end as title,
    coalesce(s.status, j.state) as status,
    case when j.broken then 'not well formed' when j.title = '' then 'invalid title' when j.source = 'src3' then 'redirect'
      when j.lang = 'de' then 'other namespace' end as reason
  from l_judged j left join l_settled s on s.id = j.id)
"""


def dump_page_lines_with_rejects(spark, sf) -> DataFrame:
    """value: the lines of ``dump_page_lines``; with some pages comes a tuple of too few fields, a
    page of another namespace and an end that was cut off, and every talk page has a title of its own case."""
    title = F.concat(F.col("p_name"), F.lit("'s (x), y "), F.col("p_partkey").cast("string"))
    long = F.when(F.col("p_brand") == "Brand#11", F.repeat(F.lit("long "), F.lit(45))).otherwise("")
    rest = ["0", "0.5", "'20210501'", "NULL", "77", "9", "'wikitext'", "NULL"]
    redirect = F.when(F.col("p_type") == "ECONOMY", 1).otherwise(0)
    key = F.col("p_partkey")
    line = _tuples(
        "page",
        [key + 1, "0", _quoted(F.concat(title, long)), "''", redirect, *rest],
        [key + 1, "0"],
        [key + 1 + TALK_OFFSET, "1", _quoted(title), "''", "0", *rest],
        ["NULL", "0", _quoted(title), "''", "0", *rest],
        [key + 1 + 2 * TALK_OFFSET, "14", _quoted(title), "''", "0", *rest],
    )
    cut = F.concat(F.lit("INSERT INTO `page` VALUES ("), key.cast("string"), F.lit(",0,'Cut off"))
    lines = F.array(F.lit("-- Dumping data"), line, F.when(F.col("p_size") > 25, cut).otherwise(""))
    return parsed(spark, sf, "part").select(F.explode(lines).alias("value"))


V_LOAD_PAGES = f"""
r_tuples as (
  select p_partkey, p_name || '''s (x), y ' || p_partkey as title,
    case when p_brand = 'Brand#11' then repeat('long ', 45) else '' end as more, p_type = 'ECONOMY' as redirect, p_size
  from part),
r_page as (
  select 'page' as table_name, p_partkey + 1 as page_id, replace(title || more, '_', ' ') as page_title,
    case when redirect then 'left out' when length(title || more) > 200 then 'skipped' else 'added' end as status,
    case when redirect then 'redirect' when length(title || more) > 200 then 'long title' end as reason
  from r_tuples),
r_log as (
  select * from r_page
  union all
  select 'talk', p_partkey + 1 + {TALK_OFFSET}, title, case when p.page_title is null then 'skipped' else 'added' end,
    case when p.page_title is null then 'no page' end
  from r_tuples t left join (select distinct page_title from r_page where status = 'added') p on p.page_title = t.title
  union all
  select 'page', null, title, 'error', 'invalid page_id' from r_tuples
  union all
  select null, p_partkey + 1 + {2 * TALK_OFFSET}, title, 'left out', 'other namespace' from r_tuples
  union all
  select null, null, null, 'error', 'no tuple' from r_tuples
  union all
  select null, null, null, 'error', 'no tuple' from r_tuples where p_size > 25)
"""


# --- wikitext, chunks, files, graph ---------------------------------------------------
def headed(text: Column) -> Column:
    """Wikitext with a heading before each line but the first."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda x, i: F.when(i == 0, x).otherwise(
            F.concat(F.lit("== Part "), i.cast("string"), F.lit(" ==\n"), x)
        ),
    )
    return F.array_join(lines, "\n")


def wikitext(spark, sf) -> DataFrame:
    """doc_id, text: every document with a heading before each line but the first."""
    docs = parsed(spark, sf, "documents").select("doc_id", F.col("text").alias("_text"))
    return once(docs, text=headed(F.col("_text"))).select("doc_id", "text")


def tabled(spark, sf) -> DataFrame:
    """doc_id, text: every document as a table with a row for each line, and a cell of verbatim text beside it."""
    row = F.transform(
        F.split("_text", "\n"),
        lambda x: F.concat(F.lit('|-\n| style="s" | '), x, F.lit(" || <nowiki>[[x]]</nowiki>\n")),
    )
    text = F.concat(F.lit('{| class="x"\n'), F.array_join(row, ""), F.lit("|}"))
    docs = parsed(spark, sf, "documents").select("doc_id", F.col("text").alias("_text"))
    return once(docs, text=text).select("doc_id", "text")


V_LEAD = rf"""
v_lead as (
  select doc_id, len(regexp_extract_all({FIRST_LINE}, '[\p{{L}}\p{{N}}_]+')) + 2 as length,
         regexp_extract_all(strip_accents(replace({FIRST_LINE}, 'ß', 'ss')), '[\p{{L}}\p{{N}}_]+') as lead
  from documents)
"""


def vocabulary(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.explode(tokens(F.col("text"))).alias("token"))


def piece_vocabulary(spark, sf) -> DataFrame:
    """piece, is_start: words of the benchmark, their first letters, and pairs and triples from within."""
    words = table(spark, sf, "benchmark").select(F.explode(plain_words(F.col("text"))).alias("w")).distinct()
    starts = F.array("w", F.left("w", F.lit(1)), F.left("w", F.lit(2)), F.left("w", F.lit(4)))
    within = F.flatten(F.transform(
        F.sequence(F.lit(2), F.length("w") + 1), lambda i: F.array(F.substring("w", i, F.lit(2)), F.substring("w", i, F.lit(3)))
    ))
    marked = F.concat(starts, F.transform(within, lambda x: F.concat(F.lit("##"), x)))
    return mark_pieces(words.select(F.explode(marked).alias("piece")).where("piece <> '##'"))


V_PIECES = rf"""
v_pieces as materialized (
  with w as (select distinct unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) as w from benchmark),
  i as (select w, unnest(range(2, length(w) + 1)) as i from w)
  select distinct * from (
    select unnest([w, w[1:1], w[1:2], w[1:4]]) as piece, true as is_start from w
    union all select unnest([w[i:i+1], w[i:i+2]]), false from i)),
v_leads as materialized (
  select doc_id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) as word,
    unnest(range(len(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')))) as pos
  from (select doc_id, strip_accents(replace({FIRST_LINE}, 'ß', 'ss')) as t from documents)),
v_places as (
  select word, i, unnest(range(1, least(length(word) - i + 1, (select max(length(piece)) from v_pieces)) + 1)) as size
  from (select word, unnest(range(1, length(word) + 1)) as i from (select distinct word from v_leads where length(word) <= 100))),
v_steps as materialized (
  select p.word, p.i, max(p.size) as size from v_places p
  join v_pieces v on v.piece = substring(p.word, p.i, p.size) and v.is_start = (p.i = 1) group by 1, 2),
v_cut as (
  select word, 1::bigint as here, 0 as n from (select distinct word from v_leads)
  union all
  select c.word, c.here + s.size, c.n + 1 from v_cut c join v_steps s on s.word = c.word and s.i = c.here),
v_words as materialized (
  select word, coalesce(max(n) filter (here > length(word)), 1) as n, count(*) filter (here > length(word)) = 0 as unknown
  from v_cut group by word)
"""


def chunked_pages(spark, sf) -> DataFrame:
    """file_start, chunk, pos, title: documents by source, copies of a text share a title."""
    return table(spark, sf, "documents").select(
        F.substring("source", 4, 9).cast("bigint").alias("file_start"),
        F.floor(F.col("doc_id") / 50).alias("chunk"),
        F.col("doc_id").alias("pos"),
        F.md5("text").alias("title"),
    )


V_DUPS = """
v_dups as (
  select substr(source, 4)::bigint as file_start, doc_id // 50 as chunk, doc_id as pos,
         md5(text) as title from documents),
v_loaded as (
  select *, case when row_number() over (
    partition by title order by file_start, chunk, pos desc) = 1
    then 'added' else 'duplicate' end as status from v_dups)
"""

_FILE = "enwiki-20210420-pages-articles-multistream"


def file_paths(spark, sf) -> DataFrame:
    """path: a file for every hundred customers, and names that are none of the dump's."""
    blocks = (
        table(spark, sf, "customer")
        .groupBy(F.floor(F.col("c_custkey") / 100).alias("block"))
        .agg((F.min("c_custkey") + 1).alias("lo"), (F.max("c_custkey") + 1).alias("hi"))
    )
    part = (F.col("block") + 1).cast("string")
    span = F.concat(F.lit(".xml-p"), F.col("lo").cast("string"), F.lit("p"), F.col("hi").cast("string"))
    names = F.array(
        F.concat(F.lit(f"/dump/{_FILE}"), part, span, F.lit(".bz2")),
        F.concat(F.lit(f"/dump/{_FILE}"), part, span, F.lit(".txt")),
        F.concat(F.lit(f"/dump/{_FILE}.xml."), part, F.lit(".bz2")),
    )
    return blocks.select(F.explode(names).alias("path"))


V_FILES = f"""
v_blocks as (
  select c_custkey // 100 as block, min(c_custkey) + 1 as lo, max(c_custkey) + 1 as hi
  from customer group by 1),
v_files as (
  select '/dump/{_FILE}' || (block + 1) || '.xml-p' || lo || 'p' || hi || '.bz2' as path,
         lo as start_idx, hi as end_idx from v_blocks)
"""


def graph_links(spark, sf) -> DataFrame:
    """src, dst: suppliers and the parts they deliver, both ways."""
    pairs = supplier_parts(spark, sf)
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.unionByName(back)


def supplier_parts(spark, sf) -> DataFrame:
    return (
        parsed(spark, sf, "lineitem")
        .select(
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
        )
        .distinct()
    )


V_GRAPH = """ recursive
v_pairs as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem),
v_graph as (select src, dst from v_pairs union all select dst, src from v_pairs),
v_capped as materialized (
  select src, dst, rn from (
    select src, dst, row_number() over (partition by src order by dst) as rn from v_graph)
  where rn <= 5),
v_walk as (
  select 's1' as id, 0 as level
  union
  select c.dst, w.level + 1 from v_walk w join v_capped c on c.src = w.id where w.level < 3),
v_vertices as (select id, min(level)::bigint as level from v_walk group by id)
"""
GRAPH_START, GRAPH_LEVELS, GRAPH_CAP = "s1", 3, 5
