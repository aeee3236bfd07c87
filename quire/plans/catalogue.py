"""The query catalogue: every registered query and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import engine
from quire.functions import native as N
from quire.operators import relational as R
from quire.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# DuckDB's spelling of the White_Space class.
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents")


# String functions


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r|\n', ' ', 'g'), '\x{{A0}}', ' ', 'g'), '[\x{{AD}}\x{{200B}}\x{{FEFF}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g') AS cleaned FROM documents""")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", N.clean_text(F.col("text")).alias("cleaned"))


@query(rf"SELECT doc_id, regexp_replace(text, '{_WS}+', ' ', 'g') AS collapsed FROM documents")
def collapse_space(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", N.collapse_space(F.col("text")).alias("collapsed"))


@query(rf"SELECT page_id, regexp_replace(' ' || url || chr(10), '^{_WS}+|{_WS}+$', '', 'g') AS trimmed FROM pages")
def trim_space(spark, sf_dir):
    padded = F.concat(F.lit(" "), F.col("url"), F.lit("\n"))
    return tables.table(spark, sf_dir, "pages").select("page_id", N.trim_space(padded).alias("trimmed"))


@query("""SELECT doc_id, len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS n_lines, l[1] AS first_line
FROM (SELECT doc_id, [rtrim(x, chr(13)) for x in string_split(text, chr(10))] AS l FROM documents)""")
def line_split(spark, sf_dir):
    split = N.lines(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(split).cast("long").alias("n_lines"), F.get(F.split("text", r"\r?\n", -1), F.lit(0)).alias("first_line"))


@query(r"""SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '[^/\\.][^/\\]*\.([^/\\.]+)$', 1)) AS extension,
CASE WHEN regexp_matches(n, '^.+\.[^.]*$') THEN regexp_replace(n, '\.[^.]*$', '') ELSE n END AS stem
FROM (SELECT *, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/\\]*)$', 1) AS n FROM pages)""")
def file_names(spark, sf_dir):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return tables.table(spark, sf_dir, "pages").select("page_id", N.file_extension(path).alias("extension"), N.file_stem(path).alias("stem"))


@query(r"""SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*:') AND NOT regexp_matches(url, '^[A-Za-z]:[\\/]') AS absolute,
regexp_matches(regexp_replace(url, '^https?:', ''), '^[A-Za-z][A-Za-z0-9+.\-]*:') AS rest_absolute FROM pages""")
def absolute_uris(spark, sf_dir):
    rest = F.regexp_replace("url", "^https?:", "")
    return tables.table(spark, sf_dir, "pages").select("page_id", N.is_absolute_uri(F.col("url")).alias("absolute"), N.is_absolute_uri(rest).alias("rest_absolute"))


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'anchor' ELSE s END AS html_id FROM (SELECT page_id,
regexp_replace(regexp_replace(regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS s FROM pages)""")
def sanitize_ids(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", N.sanitize_id(F.col("url")).alias("html_id"))


@query(rf"""SELECT doc_id, pos, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT doc_id, pos,
regexp_replace(replace(lower(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g')), ' ', '-'), '[^\p{{L}}\p{{N}}_-]', '', 'g') AS s FROM
(SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""")
def heading_slugs(spark, sf_dir):
    """Every line as a heading, with its place."""
    lines = _docs(spark, sf_dir).select("doc_id", F.split("text", "\n", -1).alias("l")).select("doc_id", F.posexplode("l").alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), N.gfm_slug(F.col("line")).alias("slug"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(u, '[() ]') THEN '<' || u || '>' ELSE u END AS destination
FROM (SELECT page_id, replace(replace(replace(url || '(x|y)', '<', '%3C'), '>', '%3E'), '|', '%7C') AS u FROM pages)""")
def link_destinations(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", N.format_url(F.concat("url", F.lit("(x|y)"))).alias("destination"))


@query(r"""SELECT doc_id, f || 'txt' || chr(10) || regexp_replace(t, '\n+$', '') || chr(10) || f || chr(10) AS markdown FROM (
SELECT doc_id, t, repeat('`', greatest(coalesce(list_max([len(x) for x in regexp_extract_all(t, '`+')]), 0) + 1, 3)) AS f
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '````' || text ELSE text END AS t FROM documents))""")
def fenced_source(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("````"), "text")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", N.fenced(text, F.lit("txt")).alias("markdown"))


@query(rf"""SELECT doc_id, len(p) AS n_paragraphs, array_to_string(p, chr(10) || chr(10)) AS paragraphs FROM (
SELECT doc_id, [x for x in [regexp_replace(y, '^{_WS}+|{_WS}+$', '', 'g') for y in string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n(?:[ \t]*\n)+')] if x <> ''] AS p FROM documents)""")
def text_paragraphs(spark, sf_dir):
    parts = N.paragraphs(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("n_paragraphs"), F.array_join(parts, "\n\n").alias("paragraphs"))


# Numbers, dates and labels


@query("""WITH RECURSIVE a(k, n, s) AS (SELECT p_partkey, p_partkey, '' FROM part UNION ALL
SELECT k, (n - 1) // 26, chr(CAST(97 + (n - 1) % 26 AS INTEGER)) || s FROM a WHERE n > 0)
SELECT k AS p_partkey, CASE WHEN k = 0 THEN '0' ELSE s END AS label FROM a WHERE n = 0""")
def alpha_labels(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").select("p_partkey", N.alpha_label(F.col("p_partkey")).alias("label"))


@query("""SELECT p_partkey, CASE WHEN n = 0 OR n > 3999 THEN CAST(n AS VARCHAR) ELSE
['', 'm', 'mm', 'mmm'][n // 1000 + 1] || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1]
|| ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] END AS label
FROM (SELECT p_partkey, p_partkey * 2 AS n FROM part)""")
def roman_labels(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").select("p_partkey", N.roman_label(F.col("p_partkey") * 2).alias("label"))


@query(r"""SELECT event_id, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'number'
WHEN lower(v) IN ('true', 'false', 'yes', 'no') THEN 'bool'
WHEN regexp_full_match(v, '[0-9]{1,4}-[0-9]{1,4}-[0-9]{1,4}([T ][0-9]{1,4}(:[0-9]{1,4}){1,2}(\..*)?)?') THEN 'date' ELSE 'text' END AS kind
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN strftime(ts, '%Y-%m-%d')
WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE CASE WHEN user_id % 2 = 0 THEN 'Yes' ELSE 'FALSE' END END AS v FROM events)""")
def cell_kinds(spark, sf_dir):
    k = F.col("event_id") % 5
    value = (
        F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.col("event_type")).when(k == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(k == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.when(F.col("user_id") % 2 == 0, "Yes").otherwise("FALSE"))
    )
    return tables.table(spark, sf_dir, "events").select("event_id", N.cell_kind(value).alias("kind"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(t, '%Y-%m-%d') ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS shown
FROM (SELECT o_orderkey, TIMESTAMP '1899-12-30' + to_days(CAST(30000 + o_orderkey % 20000 AS INTEGER)) + to_seconds((o_orderkey % 4) * 21600) AS t FROM orders)""")
def excel_dates(spark, sf_dir):
    serial = F.lit(30000) + F.col("o_orderkey") % 20000 + (F.col("o_orderkey") % 4) * F.lit(0.25)
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", N.excel_date(serial).alias("shown"))


@query("""SELECT o_orderkey, CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration,
CASE WHEN s // 3600000 < 10 THEN '0' ELSE '' END || CAST(s // 3600000 AS VARCHAR) || ':' || lpad(CAST(s // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(s % 1000 AS VARCHAR), 3, '0') AS cue
FROM (SELECT o_orderkey, o_orderkey * 37 AS s FROM orders)""")
def clock_texts(spark, sf_dir):
    s = F.col("o_orderkey") * 37
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", N.clock_text(s).alias("duration"), N.cue_time(s).alias("cue"))


@query("SELECT l_orderkey, l_linenumber, CAST(((l_partkey % 3 * 7 + l_suppkey % 5) * 24 + l_orderkey % 30) * 3600 + l_linenumber * 60 AS BIGINT) AS seconds FROM lineitem")
def iso_durations(spark, sf_dir):
    text = F.concat(F.lit("P"), (F.col("l_partkey") % 3).cast("string"), F.lit("W"), (F.col("l_suppkey") % 5).cast("string"), F.lit("DT"), (F.col("l_orderkey") % 30).cast("string"), F.lit("H"), F.col("l_linenumber").cast("string"), F.lit("M"))
    return tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.iso_duration_seconds(text).alias("seconds"))


@query(r"""SELECT event_id, regexp_replace(chr(27) || '[1;3' || CAST(event_id % 8 AS VARCHAR) || 'm' || event_type || chr(27) || '[0m', '\x1B\[[^@-~]*[@-~]', '', 'g') AS plain FROM events""")
def ansi_stripped(spark, sf_dir):
    coloured = F.concat(F.lit("\x1b[1;3"), (F.col("event_id") % 8).cast("string"), F.lit("m"), "event_type", F.lit("\x1b[0m"))
    return tables.table(spark, sf_dir, "events").select("event_id", N.strip_ansi(coloured).alias("plain"))


# Content classification


@query(r"""SELECT event_id, regexp_matches(props, '^\s*\{\s*("|\})') AS json, regexp_matches(event_type, '^\s*\{') AS other FROM events""")
def json_heads(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_id", N.opens_json(F.col("props")).alias("json"), N.opens_json(F.col("event_type")).alias("other"))


@query("SELECT page_id AS doc_id, 'html' AS format FROM pages")
def detected_pages(spark, sf_dir):
    return engine.detect(tables.pages(spark, sf_dir), path="path")


@query("SELECT event_id AS doc_id, 'data' AS format FROM events")
def detected_json(spark, sf_dir):
    return engine.detect(tables.table(spark, sf_dir, "events"), key="event_id", content="props").withColumnRenamed("event_id", "doc_id")


# Front ends


@query(r"""SELECT event_id AS doc_id, 'data' AS format, '- k: ' || json_extract_string(props, '$.k') || chr(10) AS markdown FROM events""")
def json_to_markdown(spark, sf_dir):
    found = engine.to_markdown(tables.table(spark, sf_dir, "events"), key="event_id", content="props", formats=["data"])
    return found.select(F.col("event_id").alias("doc_id"), "format", "markdown")


@query()
def pages_to_markdown(spark, sf_dir):
    return engine.to_markdown(tables.pages(spark, sf_dir), path="path")


@query()
def documents_to_markdown(spark, sf_dir):
    return engine.to_markdown(tables.documents(spark, sf_dir), path="path")


@query("SELECT doc_id, 'text' AS format, CASE WHEN ends_with(text, chr(10)) THEN text ELSE text || chr(10) END AS markdown FROM documents")
def markdown_passthrough(spark, sf_dir):
    return engine.to_markdown(tables.documents(spark, sf_dir, "md"), path="path").select("doc_id", "format", "markdown")


@query(r"""SELECT doc_id, 'data' AS format, f || 'yaml' || chr(10) || t || chr(10) || f || chr(10) AS markdown FROM (SELECT doc_id, t,
repeat('`', greatest(coalesce(list_max([len(x) for x in regexp_extract_all(t, '`+')]), 0) + 1, 3)) AS f FROM (SELECT doc_id, regexp_replace(text, '\s+$', '') AS t FROM documents))""")
def yaml_to_markdown(spark, sf_dir):
    return engine.to_markdown(tables.documents(spark, sf_dir, "yaml"), path="path").select("doc_id", "format", "markdown")


@query("""SELECT n_regionkey AS grid, '| key | name |' || chr(10) || '| --- | --- |' || chr(10)
|| string_agg('| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM nation GROUP BY n_regionkey""")
def csv_to_markdown(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "nation").withColumn("line", F.concat(F.col("n_nationkey").cast("string"), F.lit(";\""), "n_name", F.lit('"')))
    files = rows.groupBy(F.col("n_regionkey").alias("grid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n").alias("body"))
    files = files.withColumn("content", F.concat(F.lit("key;name\n"), "body"))
    return engine.to_markdown(files, key="grid", path=F.lit("nations.csv")).select("grid", "markdown")


@query("""SELECT l_orderkey AS grid, '| line | date | mode |' || chr(10) || '| --- | --- | --- |' || chr(10)
|| string_agg('| ' || l_linenumber || ' | ' || d || ' | ' || l_returnflag || ' |', chr(10) ORDER BY l_linenumber, d, l_returnflag) || chr(10) AS markdown
FROM (SELECT *, l_shipdate::DATE::VARCHAR AS d FROM lineitem) GROUP BY l_orderkey""")
def order_files_to_markdown(spark, sf_dir):
    """A CSV file for each order, with a row for each of its lines."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(";"), day, F.lit(';"'), "l_returnflag", F.lit('"'))
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grid"), F.struct("l_linenumber", day.alias("d"), "l_returnflag", line.alias("line")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
    files = rows.groupBy("grid").agg(F.concat(F.lit("line;date;mode\n"), body).alias("content"))
    return engine.to_markdown(files, key="grid", path=F.lit("order.csv")).select("grid", "markdown")


@query("""SELECT grid, CASE WHEN grid % 2 = 0 THEN 2 ELSE 0 END AS for_header, CASE WHEN grid % 2 = 0 OR n = 1 THEN 0 ELSE 2 + CAST(again AS INTEGER) END AS for_data,
CASE WHEN grid % 2 = 0 THEN 1 ELSE 0 END AS header_rows FROM (SELECT l_orderkey AS grid, count(*) AS n, count(*) FILTER (l_returnflag = top) > 1 AS again
FROM (SELECT *, first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_returnflag) AS top FROM lineitem) GROUP BY l_orderkey)""")
def order_headers(spark, sf_dir):
    """A grid for each order, with labels over its columns or, for odd orders, without."""
    rows = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_returnflag")) - F.col("l_orderkey") % 2
    values = F.array(F.col("l_linenumber").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_returnflag"))
    placed = rows.select(F.col("l_orderkey").alias("grid"), at.cast("long").alias("row"), values.alias("v"))  # numbered before it is exploded
    cells = placed.select("grid", "row", F.posexplode("v").alias("col", "value"))
    even = rows.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("grid")).distinct()
    labels = even.select("grid", F.lit(0).cast("long").alias("row"), F.posexplode(F.array(F.lit("line"), F.lit("date"), F.lit("mode"))).alias("col", "value"))
    return R.header_votes(cells.unionByName(labels))


@query(r"""SELECT o_orderkey, '# Order ' || o_orderkey || chr(10) || chr(10) || '**' || o_orderstatus || '** caf' || chr(233) || ' ' || chr(8211) || ' ' || o_custkey || chr(10) || chr(10)
|| '| key | customer |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | ' || o_custkey || ' |' || chr(10) AS markdown FROM orders""")
def rtf_to_markdown(spark, sf_dir):
    """Each order as a rich text file: a styled heading, bytes of a code page, a Unicode escape, a table."""
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    content = F.concat(
        F.lit(r"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0\fcharset0 Arial;}}{\stylesheet{\s1\outlinelevel0 heading 1;}}\pard\s1 Order "), key,
        F.lit(r"\par\pard\plain {\b "), F.col("o_orderstatus"), F.lit(r"} caf\'e9 \u8211- "), customer,
        F.lit(r"\par\trowd\cellx1000\cellx2000\intbl key\cell customer\cell\row\trowd\cellx1000\cellx2000 "), key, F.lit(r"\cell "), customer, F.lit(r"\cell\row\pard}"),
    )
    files = tables.table(spark, sf_dir, "orders").select("o_orderkey", content.alias("content"))
    return engine.to_markdown(files, key="o_orderkey", path=F.lit(None).cast("string")).select("o_orderkey", "markdown")


@query(r"""SELECT conv_id, string_agg('*\[' || lpad(CAST(turn // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || '.000]* ' || role, chr(10) || chr(10) ORDER BY turn, role) || chr(10) AS markdown
FROM conversations GROUP BY conv_id""")
def subtitles_to_markdown(spark, sf_dir):
    start = N.cue_time(F.col("turn") * 1000)
    cue = F.concat(start, F.lit(" --> "), start, F.lit("\n"), "role")
    rows = tables.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", cue.alias("cue")).alias("cue"))
    files = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("cue")), lambda x: x["cue"]), "\n\n").alias("content"))
    return engine.to_markdown(files, key="conv_id", path=F.lit("turns.srt")).select("conv_id", "markdown")


_CUE = T.ArrayType(T.StructType([T.StructField("start", T.StringType()), T.StructField("text", T.StringType())]))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS ord,
lpad(CAST(turn // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || '.000' AS start, role AS text FROM conversations""")
def subtitle_cues(spark, sf_dir):
    import pyarrow as pa

    def cues(raw: bytes, path: str | None) -> dict:
        from quire.formats import subtitle

        return {"cues": [{"start": s, "text": t} for s, t in subtitle.cues(raw)]}

    start = N.cue_time(F.col("turn") * 1000)
    cue = F.concat(start, F.lit(" --> "), start, F.lit("\n"), "role")
    rows = tables.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", cue.alias("cue")).alias("cue"))
    files = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("cue")), lambda x: x["cue"]), "\n\n").alias("content"))
    kind = pa.list_(pa.struct([("start", pa.string()), ("text", pa.string())]))
    found = engine.per_file(files, cues, [T.StructField("cues", _CUE)], [kind], key="conv_id")
    return found.select("conv_id", F.posexplode("cues").alias("ord", "cue")).select("conv_id", F.col("ord").cast("long").alias("ord"), "cue.start", "cue.text")


@query("""SELECT page_id, len(regexp_extract_all(html, '<h1[ >]')) AS h1, len(regexp_extract_all(html, '<li[ >]')) AS items, len(regexp_extract_all(html, '<a href="[^"]')) AS links FROM pages""")
def page_structure(spark, sf_dir):
    """Headings, list items and links of the parsed document model, per page."""
    import pyarrow as pa

    def count(raw: bytes, path: str | None) -> dict:
        from quire.formats import html
        from quire.model import Heading, Link, ListBlock
        from quire.render import every_block, every_inline, inlines_of

        blocks = [*every_block(html.document(html.decode_page(raw)).blocks)]
        return {
            "h1": sum(isinstance(b, Heading) and b.level == 1 for b in blocks),
            "items": sum(len(b.items) for b in blocks if isinstance(b, ListBlock)),
            "links": sum(isinstance(x, Link) for b in blocks for x in every_inline(inlines_of(b))),
        }

    names = ("h1", "items", "links")
    return engine.per_file(tables.table(spark, sf_dir, "pages"), count, [T.StructField(n, T.LongType()) for n in names], [pa.int64()] * 3, key="page_id", content="html")


# Structure


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, len(string_split(line, ' ')) AS width, count(*) AS n FROM p GROUP BY ALL)
SELECT doc_id, CAST(arg_max(width, n * 1000000 + width) AS BIGINT) AS width FROM s GROUP BY doc_id""")
def modal_widths(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return R.modal(lines.select("doc_id", F.size(F.split("line", " ", -1)).cast("long").alias("width")), ["doc_id"], "width")


@query("SELECT user_id, list_sort(list(event_id))[count(*) // 2 + 1] AS event_id FROM events GROUP BY user_id")
def upper_medians(spark, sf_dir):
    return R.upper_median(tables.table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("SELECT event_type, user_id, min(event_id) AS event_id, arg_min(props, event_id) AS props FROM events GROUP BY event_type, user_id")
def first_occurrences(spark, sf_dir):
    return R.first_wins(tables.table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "props"), ["event_type", "user_id"], "event_id")


@query("""SELECT user_id, event_id, CASE WHEN k = 0 THEN event_type ELSE event_type || '-' || CAST(k AS VARCHAR) END AS fragment
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS k FROM events)""")
def heading_fragments(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return R.numbered_slugs(rows, ["user_id"], "event_type", "event_id").select("user_id", "event_id", "fragment")


# Runs, sheets and regions over every row of lineitem: a sheet for each supplier, a row for each of its orders; holes and gaps are those of the data.


@query("""SELECT l_suppkey, island, min(l_orderkey) AS start, count(*) AS items FROM (SELECT *, sum(b) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS island FROM (
SELECT *, CASE WHEN l_orderkey = lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) + 1 THEN 0 ELSE 1 END AS b FROM
(SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem))) GROUP BY l_suppkey, island""")
def list_runs(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    runs = R.islands(rows, ["l_suppkey"], "l_orderkey", F.col("l_orderkey"))
    return runs.groupBy("l_suppkey", "island").agg(F.min("l_orderkey").alias("start"), F.count("*").alias("items"))


_SHEETS = """SELECT l_suppkey AS sheet, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1 AS "row", CAST(l_linenumber AS BIGINT) AS col, value
FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_shipdate::DATE::VARCHAR) AS value FROM lineitem GROUP BY ALL)"""


def _sheets(spark, sf_dir):
    cells = tables.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("value"))
    at = (F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey")) - 1).cast("long")
    return cells.select(F.col("l_suppkey").alias("sheet"), at.alias("row"), F.col("l_linenumber").cast("long").alias("col"), "value")


@query(f"""WITH cells AS ({_SHEETS}), box AS (SELECT sheet, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM cells GROUP BY sheet),
every AS (SELECT sheet, "row", unnest(range(c0, c1 + 1)) AS col FROM (SELECT sheet, unnest(range(r0, r1 + 1)) AS "row", c0, c1 FROM box))
SELECT sheet, "row", col, coalesce(value, '') AS value FROM every LEFT JOIN cells USING (sheet, "row", col)""")
def dense_sheets(spark, sf_dir):
    return R.dense_cells(_sheets(spark, sf_dir))


@query(f"""WITH cells AS ({_SHEETS}), m AS (SELECT sheet, k * 7 AS r0, k * 7 + 2 AS r1, 2 AS c0, 4 AS c1 FROM (SELECT sheet, unnest(range(max("row") // 7 + 1)) AS k FROM cells GROUP BY sheet))
SELECT cells.sheet, "row", col, value, r0, c0 FROM cells JOIN m ON cells.sheet = m.sheet AND "row" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1""")
def merged_cells(spark, sf_dir):
    cells = _sheets(spark, sf_dir)
    at = cells.groupBy("sheet").agg(F.max("row").alias("last")).select("sheet", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 7))).alias("k"))
    regions = at.select("sheet", (F.col("k") * 7).alias("r0"), (F.col("k") * 7 + 2).alias("r1"), F.lit(2).cast("long").alias("c0"), F.lit(4).cast("long").alias("c1"))
    return R.in_regions(cells, regions).select("sheet", "row", "col", "value", "r0", "c0")


@query("SELECT CAST(g AS BIGINT) AS grid, CASE WHEN g = 0 THEN 1 ELSE 0 END AS for_header, CASE WHEN g = 0 THEN 0 ELSE 1 END AS for_data, CASE WHEN g = 0 THEN 1 ELSE 0 END AS header_rows FROM range(2) t(g)")
def header_rows(spark, sf_dir):
    """One grid with labels over its columns and the same one without."""
    nations = tables.table(spark, sf_dir, "nation")
    at = F.col("n_nationkey").cast("long")
    cells = lambda grid, shift: nations.select(F.lit(grid).cast("long").alias("grid"), (at + shift).alias("row"), F.posexplode(F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))).alias("col", "value"))
    labels = spark.range(1).select(F.lit(0).cast("long").alias("grid"), F.lit(0).cast("long").alias("row"), F.posexplode(F.array(F.lit("key"), F.lit("name"))).alias("col", "value"))
    return R.header_votes(cells(0, 1).unionByName(labels).unionByName(cells(1, 0)))


@query(r"""SELECT n_regionkey, '|  |  |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || replace(n_name || '|x', '|', '\|') || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def native_tables(spark, sf_dir):
    row = N.pipe_row(F.array("n_name", N.escape_cell(F.concat("n_name", F.lit("|x")))))
    rows = tables.table(spark, sf_dir, "nation").select("n_regionkey", F.struct("n_nationkey", row.alias("line")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
    return rows.groupBy("n_regionkey").agg(F.concat(F.lit("|  |  |\n| --- | --- |\n"), body).alias("markdown"))


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as Markdown."""
    return pages_to_markdown(spark, sf_dir)
