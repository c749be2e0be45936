"""SQL dumps: INSERT lines of many tuples each, read as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpweave.fixed_values import DUMP_COLUMNS, INSERT_LINE
from dumpweave.plans.barrier import once

# a quoted string with escapes, which a word may introduce, or a number or NULL, or nothing
_QUOTED = r"(?:_\w++\s*+)?'(?:[^'\\]++|\\.)*+'"
_FIELD = rf"(?:{_QUOTED}|[^,()']*+)"
# neither character occurs in titles or numbers
_ROW, _COLUMN = "\x02", "\x01"


def read_sql_dump_lines(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """INSERT lines (``value``) of a dump.

    Plain and bz2 files are split among tasks. A gz file is one task's work to
    read; ``tasks`` then deals its lines out before they are parsed.
    """
    lines = insert_lines(spark.read.text(path))
    return lines.repartition(tasks) if tasks else lines


def insert_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").rlike(INSERT_LINE))


def _number(field: Column) -> Column:
    return F.btrim(field, F.lit("'")).try_cast("bigint")


def _text(field: Column, unescape: bool) -> Column:
    field = F.when(field.startswith("_"), F.regexp_replace(field, r"^_\w+\s*", "")).otherwise(field)
    inner = F.when(field.startswith("'"), field.substr(F.lit(2), F.length(field) - 2))
    if not unescape:
        return inner
    return F.when(field.contains("\\"), F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(inner)


def parse_sql_dump(lines: DataFrame, kind: str, unescape: bool = True) -> DataFrame:
    """One row per tuple of the INSERT lines; other lines give none.

    ``kind`` is page, link or categorylink. Numbers are bigint, NULL stays
    NULL. ``unescape=False`` keeps the backslashes of quoted strings.
    """
    fields = _fields(lines, kind, unescape)
    return fields.where(F.size("_fields") > 1).select(*DUMP_COLUMNS[kind])


def marked_sql_dump(lines: DataFrame, kind: str, unescape: bool = True) -> DataFrame:
    """Tuples and rejects in one pass: the columns of ``parse_sql_dump``, ``is_tuple`` and ``rejected``.

    ``rejected`` is what an INSERT line holds after a tuple, or before the first
    one, that is no tuple of this kind; else NULL. Rows with neither are left out.
    """
    fields = _fields(lines, kind, unescape)
    rest = _beside(F.element_at("_fields", -1))
    fields = fields.select("*", (F.size("_fields") > 1).alias("is_tuple"), F.nullif(rest, F.lit("")).alias("rejected"))
    return fields.where("is_tuple or rejected is not null").drop("_fields")


def _fields(lines: DataFrame, kind: str, unescape: bool) -> DataFrame:
    """The columns of each tuple; ``_fields`` has one entry more than it has columns, or one where there is no tuple."""
    if kind not in DUMP_COLUMNS:
        raise ValueError(f"unknown kind {kind!r}, not one of {', '.join(DUMP_COLUMNS)}")
    names = DUMP_COLUMNS[kind]
    # one pass over a line marks where its tuples begin and their first columns
    # end; cutting at the marks is cheap, and columns not needed are never cut
    mark = _ROW + "".join(f"${i + 1}{_COLUMN}" for i in range(len(names)))
    marked = F.regexp_replace(_body(), _tuple_pattern(kind), mark)
    pieces = insert_lines(lines).select(F.explode(F.split(marked, _ROW)).alias("_piece"))
    fields = once(pieces, _fields=F.split("_piece", _COLUMN))
    text_columns = {"title", "restrictions", "category"}
    columns = []
    for position, name in enumerate(names):
        field = F.when(F.size("_fields") > 1, F.get("_fields", F.lit(position)))
        value = _text(field, unescape) if name in text_columns else _number(field)
        columns.append(value.alias(name))
    return fields.select("_fields", *columns)


def _beside(text: Column) -> Column:
    """Without commas between tuples and the end of the statement, which are nothing to report."""
    return F.regexp_replace(text, r"^[,\s]+|[,;\s]+$", "")


def _body() -> Column:
    return F.expr(
        "substring(value, locate(' VALUES ', value, locate('INSERT INTO ', value)) + 8)"
    )


def _tuple_pattern(kind: str) -> str:
    return r"\(" + ",".join([f"({_FIELD})"] * len(DUMP_COLUMNS[kind])) + rf"(?:,{_FIELD})*+\)"


def rejected_sql_tuples(lines: DataFrame, kind: str) -> DataFrame:
    """``value``: what the INSERT lines hold beside tuples of this kind, piece by piece."""
    left = F.regexp_replace(_body(), _tuple_pattern(kind), _ROW)
    pieces = insert_lines(lines).select(F.explode(F.split(left, _ROW)).alias("value"))
    return pieces.select(_beside(F.col("value")).alias("value")).where(F.col("value") != "")


def read_sql_dump(
    spark: SparkSession, path: str, kind: str, unescape: bool = True, tasks: int | None = None
) -> DataFrame:
    return parse_sql_dump(read_sql_dump_lines(spark, path, tasks), kind, unescape)
