"""Every query of the library with its oracle; those over packed formats are in packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions import metadata as M
from sparkfolio.functions import numbers as N
from sparkfolio.functions import text as T
from sparkfolio.operators import convert as C
from sparkfolio.operators import detect as D
from sparkfolio.operators import extract as X
from sparkfolio.operators import lookup as L
from sparkfolio.operators import registry as G
from sparkfolio.operators import render as R
from sparkfolio.operators.pages import page_range
from sparkfolio.schemas import BLOCK, RECT, RUN, STYLE
from sparkfolio.sources import formats as S
from sparkfolio.sources.parse import parse_files
from sparkfolio.sources.text import stats

from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ENDINGS = ("txt", "LOG", "json", "xml", "csv", "md", "html", "eml", "weird", "")
_SQL_NAME = "'doc_' || doc_id || '.' || ([" + ",".join(f"'{e}'" for e in ENDINGS) + "])[doc_id % 10 + 1]"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text files with names of many endings."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 10 + 1).cast("int"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ending)).withColumn("content", F.encode("text", "UTF-8"))


def _values(rows) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_SQL_EXTENSIONS = "(" + _values((e, k, *S.FORMATS[k]) for e, k in S.EXTENSIONS.items()) + ") AS e(ext, format, mime_type, extension, family, name, is_container)"
_SQL_PARSERS = "(" + _values((i, p, S.FORMATS[k][0]) for i, (p, k) in enumerate(S.PARSERS)) + ") AS p(ordinal, parser, mime_type)"
_SQL_SPACE = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _sql_escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _sql_words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{_SQL_SPACE}'), lambda w: w <> ''))::BIGINT"


# formats and detection


@query(f"SELECT * FROM ({_values((k, *v) for k, v in S.FORMATS.items())}) AS f(format, mime_type, extension, family, name, is_container)")
def formats(spark, sf_dir):
    return S.formats(spark)


@query(f"SELECT doc_id, e.mime_type, e.family, CASE WHEN e.format IS NOT NULL THEN 0.7::DOUBLE END AS confidence, CASE WHEN e.format IS NOT NULL THEN 'Extension' END AS method FROM (SELECT doc_id, {_SQL_NAME} AS fname FROM documents) d LEFT JOIN {_SQL_EXTENSIONS} ON lower(list_last(string_split(d.fname, '.'))) = e.ext")
def detect_extension(spark, sf_dir):
    return D.detect(_named(spark, sf_dir)).select("doc_id", "mime_type", "family", "confidence", "method")


@query("SELECT * FROM (" + _values((n, None if k is None else S.FORMATS[k][0], c, m) for n, _, k, c, m in fixtures.MAGIC) + ") AS f(name, mime_type, confidence, method)")
def magic_detect(spark, sf_dir):
    rows = [(n, bytearray(b)) for n, b, *_ in fixtures.MAGIC]
    return D.detect(spark.createDataFrame(rows, "name string, content binary")).select("name", "mime_type", "confidence", "method")


@query("SELECT * FROM (" + _values((m, next((S.FORMATS[k][3] for k in S.BY_MIME if S.FORMATS[k][0] == m), None)) for m in sorted({v[0] for v in S.FORMATS.values()})) + ") AS f(mime_type, name)")
def format_by_mime(spark, sf_dir):
    return S.formats(spark).select("mime_type").distinct().select("mime_type", D.format_info(D.format_by_mime(F.col("mime_type")))["name"].alias("name"))


@query(f"SELECT p_partkey, e.mime_type FROM (SELECT p_partkey, repeat('.', (p_partkey % 3)::INT) || (['PDF','Htm','weird','tgz'])[p_partkey % 4 + 1] AS x FROM part) LEFT JOIN {_SQL_EXTENSIONS} ON lower(ltrim(x, '.')) = e.ext")
def format_by_extension(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey")
    x = F.concat(F.repeat(F.lit("."), (F.col("p_partkey") % 3).cast("int")), F.element_at(F.array(*map(F.lit, ("PDF", "Htm", "weird", "tgz"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return part.select("p_partkey", D.format_info(D.format_by_extension(x))["mime_type"].alias("mime_type"))


# text and HTML


@query(f"SELECT doc_id, {_SQL_NAME} AS title, list_last(string_split({_SQL_NAME}, '.')) AS file_extension, octet_length(encode(text))::BIGINT AS character_count, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS line_count, {_sql_words('text')} AS word_count FROM documents")
def text_stats(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in stats(F.col("text"), F.col("name")).items()))


@query("""SELECT doc_id, kind, coalesce((octet_length(encode(t)) - octet_length(encode(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))))::DOUBLE / nullif(octet_length(encode(t)), 0) < 0.1, false) AS is_text
FROM (SELECT doc_id, 'whole' AS kind, text AS t FROM documents UNION ALL SELECT doc_id, 'control', repeat(chr(1) || chr(2), (doc_id % 9)::INT) || text FROM documents UNION ALL SELECT doc_id, 'key', chr(1) || doc_id::VARCHAR || 'abcd' FROM documents UNION ALL SELECT doc_id, 'empty', '' FROM documents)""")
def text_gate(spark, sf_dir):
    """Whole texts, the same after control characters, and two made-up rows a document: a key near the limit and nothing."""
    control = F.concat(F.repeat(F.lit("\x01\x02"), (F.col("doc_id") % 9).cast("int")), F.col("text"))
    kinds = {"whole": F.col("text"), "control": control, "key": F.concat(F.lit("\x01"), F.col("doc_id").cast("string"), F.lit("abcd")), "empty": F.lit("")}
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("t")) for k, t in kinds.items()))).alias("x"))
    return rows.select("doc_id", "x.kind", T.is_likely_text(F.encode("x.t", "UTF-8")).alias("is_text"))


@query(f"""SELECT page_id, CASE WHEN s > 0 AND strpos(substr(html, s + 7), '</title>') > 0 THEN regexp_replace(regexp_replace(substr(html, s + 7, strpos(substr(html, s + 7), '</title>') - 1), '^{_SQL_SPACE}', ''), '{_SQL_SPACE}$', '') END AS title
FROM (SELECT page_id, html, strpos(html, '<title>') AS s FROM (SELECT page_id, CASE page_id % 9 WHEN 0 THEN replace(html, '<title>', '<TITLE>') WHEN 1 THEN replace(html, '<title>', '<title> ' || chr(160)) ELSE html END AS html FROM pages))""")
def html_title(spark, sf_dir):
    html = F.when(F.col("page_id") % 9 == 0, F.replace("html", F.lit("<title>"), F.lit("<TITLE>"))).when(F.col("page_id") % 9 == 1, F.replace("html", F.lit("<title>"), F.lit("<title>  "))).otherwise(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", T.html_title(html).alias("title"))


@query("""SELECT kind, id, starts_with(s, '<!doctype') OR starts_with(s, '<html') OR contains(h, '<html') OR contains(h, '<!doctype') OR (contains(h, '<head') AND contains(h, '<body')) AS is_html
FROM (SELECT kind, id, lower(ltrim(t, ' ' || chr(9) || chr(10) || chr(13))) AS s, lower(substr(t, 1, 1024)) AS h FROM (SELECT kind, id, regexp_replace(t, '[^\\x00-\\x7f]', '', 'g') AS t FROM (
  SELECT 'page' AS kind, page_id AS id, html AS t FROM pages
  UNION ALL SELECT 'bare', page_id, replace(replace(lower(html), '<!doctype', '<x'), '<html', '<y') FROM pages
  UNION ALL SELECT 'document', doc_id, 'a' || text FROM documents)))""")
def html_gate(spark, sf_dir):
    pages, docs = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents")
    bare = F.replace(F.replace(F.lower("html"), F.lit("<!doctype"), F.lit("<x")), F.lit("<html"), F.lit("<y"))
    rows = pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    rows = rows.unionAll(pages.select(F.lit("bare"), "page_id", bare)).unionAll(docs.select(F.lit("document"), "doc_id", F.concat(F.lit("a"), F.col("text"))))
    return rows.select("kind", "id", T.is_likely_html(F.encode(F.regexp_replace("t", r"[^\x00-\x7f]", ""), "UTF-8")).alias("is_html"))


@query(f"SELECT page_id, {_sql_escape('html')} AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query("""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(array_to_string(regexp_extract_all(text, '[\\t\\n\\r\\x20-\\x7e]{4,}'), ' '), '[\\t\\n\\r ]+'), lambda w: w <> ''), ' ') AS printable FROM documents""")
def printable_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.printable_text(F.col("text")).alias("printable"))


@query("SELECT doc_id, base64(encode(text)) AS encoded FROM documents")
def base64_content(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.base64_plain(F.encode("text", "UTF-8")).alias("encoded"))


@query("SELECT doc_id, text AS decoded FROM documents")
def utf16_decode(spark, sf_dir):
    wide = F.encode(F.concat("text", F.lit("\0"), F.lit("rest")), "UTF-16LE")
    return _table(spark, sf_dir, "documents").select("doc_id", T.utf16_until_null(wide).alias("decoded"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '@example.com' ELSE c_name || ' <c' || c_custkey || '@example.com>' END AS address, 'To: ' || c_name || chr(10) AS header, 'Failed: ' || c_mktsegment AS error FROM customer")
def mail_addresses(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    email = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    return _table(spark, sf_dir, "customer").select("c_custkey", T.address(name, email).alias("address"), T.header_line(F.lit("To"), F.col("c_name")).alias("header"), T.with_context(F.lit("Failed"), F.col("c_mktsegment")).alias("error"))


@query("SELECT p_partkey, (['media/x.png','ppt/media/y.JPG','ppt/slides/z.gif','w.tiff'])[p_partkey % 4 + 1] AS path, (['image/png','image/jpeg','image/gif','image/tiff'])[p_partkey % 4 + 1] AS mime FROM part")
def part_paths(spark, sf_dir):
    target = F.element_at(F.array(*map(F.lit, ("../../media/x.png", "../media/y.JPG", "./z.gif", "../../w.tiff"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = T.resolve_path(F.lit("ppt/slides"), target)
    return _table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), T.image_mime(T.file_extension(path)).alias("mime"))


# numbers


@query("""SELECT kind, id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%.1f MB', n / 1048576.0::DOUBLE) END AS size
FROM (SELECT 'd' AS kind, doc_id AS id, n_chars AS n FROM documents UNION ALL SELECT 'o', o_orderkey, (o_totalprice * 100)::BIGINT FROM orders UNION ALL SELECT 'x', i, i * 1280 FROM range(2000) r(i))""")
def format_size(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))
    o = _table(spark, sf_dir, "orders").select(F.lit("o"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long"))
    x = spark.range(2000).select(F.lit("x"), "id", F.col("id") * 1280)
    return d.unionAll(o).unionAll(x).select("kind", "id", N.format_size(F.col("n")).alias("size"))


@query("""SELECT p_partkey, CASE WHEN i < 26 THEN chr((65 + i)::INT) WHEN i < 702 THEN chr((65 + (i - 26) // 26)::INT) || chr((65 + i % 26)::INT) ELSE chr((65 + (i - 702) // 676)::INT) || chr((65 + (i - 702) // 26 % 26)::INT) || chr((65 + i % 26)::INT) END AS letters,
i AS back, (p_partkey % 97)::BIGINT AS row_no FROM (SELECT p_partkey, p_partkey % 18278 AS i FROM part)""")
def excel_column(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", N.column_letters(F.col("p_partkey") % 18278).alias("letters"))
    ref = N.cell_reference(F.concat("letters", (F.col("p_partkey") % 97 + 1).cast("string")))
    return part.select("p_partkey", "letters", N.column_index(F.col("letters")).alias("back"), ref["row"].alias("row_no"))


@query("""SELECT p_partkey, regexp_replace(printf('%.4f', p_size / 16.0::DOUBLE), '\\.?0+$', '') AS css, p_size * 72.0::DOUBLE AS points, p_size * 914400 / 12700.0::DOUBLE AS emu_points FROM part""")
def css_number(spark, sf_dir):
    size = F.col("p_size")
    return _table(spark, sf_dir, "part").select("p_partkey", N.css_number(size / 16.0).alias("css"), N.inches(size).alias("points"), N.emu(size * 914400).alias("emu_points"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS padded, year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) || ' ' || hour(o_orderdate) || ':' || minute(o_orderdate) || ':' || second(o_orderdate) AS plain FROM orders")
def archive_dates(spark, sf_dir):
    seconds = F.unix_timestamp("o_orderdate")
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.unix_text(seconds).alias("padded"), N.unpadded_date(F.col("o_orderdate").cast("timestamp")).alias("plain"))


@query("SELECT vec_id, embedding[1]::DOUBLE BETWEEN -0.1 AND 0.1 AND embedding[2]::DOUBLE BETWEEN -0.05 AND 0.15 AS inside FROM embeddings")
def rect_contains(spark, sf_dir):
    rect = F.struct(F.lit(-0.1).alias("x"), F.lit(-0.05).alias("y"), F.lit(0.2).alias("width"), F.lit(0.2).alias("height"))
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return _table(spark, sf_dir, "embeddings").select("vec_id", N.rect_contains(rect, at(0), at(1)).alias("inside"))


# extraction


def _run(text: Column, **style: Column) -> Column:
    kinds = [f.split(":") for f in STYLE[len("struct<") : -1].split(",")]
    given = {"bold": F.lit(False), "italic": F.lit(False), "underline": F.lit(False), "strikethrough": F.lit(False)} | style
    return F.struct(text.alias("text"), F.struct(*(given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds)).alias("style")).cast(RUN)


def _block(kind: str, **given: Column) -> Column:
    fields = [f for f in _fields(BLOCK)]
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("x", "y", "width", "height")))
    known = {"kind": F.lit(kind), "bounds": zero, "rotation": F.lit(0.0)} | given
    return F.struct(*(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields)).cast(BLOCK)


def _fields(struct: str) -> list[tuple[str, str]]:
    """Names and types of a struct's own fields."""
    out, depth, start = [], 0, len("struct<")
    for i, c in enumerate(struct):
        depth += (c == "<") - (c == ">")
        if (c == "," and depth == 1) or (c == ">" and depth == 0):
            name, _, kind = struct[start:i].partition(":")
            out.append((name, kind))
            start = i + 1
    return out


def _turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of one page a turn: a text block, and an image block that extraction skips."""
    turns = _table(spark, sf_dir, "conversations")
    block = _block("Text", runs=F.array(_run(F.concat("role", F.lit(": "))), _run(F.col("text"))))
    page = F.struct(F.col("turn").cast("int").alias("number"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("rotation"), F.array(block, _block("Image", resource_id=F.lit("none"))).alias("blocks"))
    pages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", page.alias("page")))), lambda p: p["page"])
    return turns.groupBy("conv_id").agg(F.struct(pages.alias("pages")).alias("document"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def document_text(spark, sf_dir):
    return _turn_pages(spark, sf_dir).select("conv_id", X.document_text(F.col("document")).alias("text"))


@query(f"SELECT conv_id, {_sql_words('t')} AS words FROM (SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id)")
def document_words(spark, sf_dir):
    return _turn_pages(spark, sf_dir).select("conv_id", X.document_words(F.col("document")).alias("words"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def ordered_text(spark, sf_dir):
    return X.ordered_text(_table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "\n")


@query("SELECT conv_id, count(*)::BIGINT AS page_count, arg_min(text, turn) AS first_text, max(CASE WHEN n = 2 THEN text END) AS second_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) GROUP BY conv_id")
def doc_counts(spark, sf_dir):
    pages = F.col("document.pages")
    text = lambda p: X.runs_text(F.slice(F.get(p["blocks"], F.lit(0))["runs"], 2, 1))
    docs = _turn_pages(spark, sf_dir)
    return docs.select("conv_id", F.size(pages).cast("long").alias("page_count"), text(X.page_at(pages, F.lit(1))).alias("first_text"), text(X.page_at(pages, F.lit(2))).alias("second_text"))


def _nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region with a table of its nations."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    cell = lambda *runs: F.struct(F.array(F.array(*runs)).alias("content"), F.lit(1).alias("col_span"), F.lit(1).alias("row_span"), F.lit(None).cast("string").alias("background_color"))
    row = F.array(cell(_run(F.col("n_nationkey").cast("string"))), cell(_run(F.col("n_name"), bold=F.lit(True)), _run(F.lit(" & co"))))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"])
    joined = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(rows.alias("rows"))
    return joined.select("r_name", _block("Table", rows=F.col("rows")).alias("block"))


@query("SELECT r_name, string_agg(n_nationkey || chr(9) || n_name || ' & co', chr(10) ORDER BY n_nationkey) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def table_text(spark, sf_dir):
    return _nation_tables(spark, sf_dir).select("r_name", X.block_text(F.col("block")).alias("text"))


# rendering

_SQL_FLAG = "CASE WHEN {0} THEN '<{1}>' || {2} || '</{1}>' ELSE {2} END"


def _sql_run() -> str:
    x = _sql_escape("text")
    for flag, tag in (("doc_id % 2 = 0", "strong"), ("doc_id % 3 = 0", "em"), ("doc_id % 5 = 0", "u"), ("doc_id % 7 = 0", "s")):
        x = f"(SELECT {_SQL_FLAG.format(flag, tag, 'x')} FROM (SELECT {x} AS x))"
    css = "CASE WHEN doc_id % 11 = 0 THEN '<span style=\"font-size: ' || regexp_replace(printf('%.1f', (doc_id % 40) / 2.0::DOUBLE), '\\.0$', '') || 'pt; color: #&quot;' || (doc_id % 10) || '\">' || x || '</span>' ELSE x END"
    return f"SELECT doc_id, {css} AS html FROM (SELECT doc_id, {x} AS x FROM documents)"


@query(_sql_run())
def render_text_run(spark, sf_dir):
    d = F.col("doc_id")
    some = d % 11 == 0
    run = _run(F.col("text"), bold=d % 2 == 0, italic=d % 3 == 0, underline=d % 5 == 0, strikethrough=d % 7 == 0, font_size=F.when(some, (d % 40) / 2.0), color=F.when(some, F.concat(F.lit('#"'), (d % 10).cast("string"))))
    return _table(spark, sf_dir, "documents").select("doc_id", R.render_run(run).alias("html"))


_SQL_TURN = "'<div class=\"text-content\" style=\"position: relative; margin-bottom: 1em;  \">' || " + _sql_escape("role || ': ' || text") + " || '</div>' || chr(10) || '<div class=\"image-container\"><p><em>[Image not found]</em></p></div>'"


@query(f"""SELECT conv_id, string_agg('<div class="page" style="width: 612pt; height: 792pt; position: relative; overflow: hidden; background-color: white;">' || chr(10) || '        <div class="page-number" style="display: none;">Page ' || n || '</div>' || chr(10) || '        ' || {_SQL_TURN} || chr(10) || '    </div>', chr(10) ORDER BY n) AS html
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) GROUP BY conv_id""")
def render_page(spark, sf_dir):
    docs = _turn_pages(spark, sf_dir)
    empty = fixtures.NO_IMAGES
    return docs.select("conv_id", F.array_join(F.transform("document.pages", lambda p, i: R.render_page(p, i + 1, F.array().cast(empty))), "\n").alias("html"))


@query(f"""SELECT r_name, '<table class="data-table">' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || {_sql_escape("n_name || ' & co'")} || '</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def render_table(spark, sf_dir):
    return _nation_tables(spark, sf_dir).select("r_name", R.render_table(F.col("block")).alias("html"))


@query("""SELECT s_suppkey, '<div class="vector-block" style="position: absolute; left: 0pt; top: 0pt; width: ' || w || 'pt; height: 5pt;"><svg viewBox="0 0 ' || w || ' 5" width="100%" height="100%" preserveAspectRatio="none"><path d="M 0 ' || w || ' L 1.5 2 Z" fill="none" stroke="#' || w || '" stroke-width="0" /></svg></div>' AS html FROM (SELECT s_suppkey, s_suppkey % 50 + 1 AS w FROM supplier)""")
def render_vector(spark, sf_dir):
    w = (F.col("s_suppkey") % 50 + 1).cast("double")
    bounds = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), w.alias("width"), F.lit(5.0).alias("height")).cast(RECT)
    command = lambda op, *p: F.struct(F.lit(op).alias("op"), (F.array(*p) if p else F.array().cast("array<double>")).alias("points"))
    path = F.struct(F.array(command("M", F.lit(0.0), w), command("L", F.lit(1.5), F.lit(2.0)), command("Z")).alias("commands"), F.lit(None).cast("string").alias("fill"), F.concat(F.lit("#"), w.cast("int").cast("string")).alias("stroke"), F.lit(None).cast("double").alias("stroke_width"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", R.render_vector(_block("Vector", bounds=bounds, paths=F.array(path))).alias("html"))


@query("""SELECT r_regionkey, '<div class="container-block">' || string_agg('<div class="container-block">' || kids || '</div>', chr(10) ORDER BY n_nationkey) || '</div>' AS html FROM region JOIN (
  SELECT n_regionkey, n_nationkey, coalesce(string_agg(s_name, chr(10) ORDER BY s_suppkey), '') AS kids FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def render_container(spark, sf_dir):
    n, s, r = (_table(spark, sf_dir, t) for t in ("nation", "supplier", "region"))
    none = F.lit(None).cast(RECT)
    rows = r.select(F.col("r_regionkey"), F.array(F.lit(0).cast("long")).alias("block_path"), F.lit(True).alias("is_container"), none.alias("bounds"), F.lit(None).cast("string").alias("html"))
    inner = n.select("n_regionkey", F.array(F.lit(0).cast("long"), F.col("n_nationkey").cast("long")), F.lit(True), none, F.lit(None).cast("string"))
    leaves = s.join(n, s.s_nationkey == n.n_nationkey).select("n_regionkey", F.array(F.lit(0).cast("long"), F.col("n_nationkey").cast("long"), F.col("s_suppkey").cast("long")), F.lit(False), none, F.col("s_name"))
    bounds = F.struct(*(F.lit(0.0).alias(k) for k in ("x", "y", "width", "height")))
    return R.render_containers(rows.unionAll(inner).unionAll(leaves).withColumn("bounds", bounds), ["r_regionkey"]).select("r_regionkey", "html")


@query("""SELECT p_partkey, CASE WHEN f.id IS NULL THEN '<p><em>[Image not found]</em></p>' WHEN f.data IS NULL THEN '<p><em>[Image data missing]</em></p>' ELSE '<img src="data:image/png;base64,' || base64(encode(f.data)) || '" alt="Image" style="width: 100%; height: 100%;" />' END AS tag
FROM part LEFT JOIN (SELECT id, arg_min(data, k) AS data FROM (SELECT s_suppkey % 700 AS id, s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN '-' ELSE s_name END AS d2, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS data FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 700 ORDER BY s_suppkey) = 1) GROUP BY id) f ON f.id = p_partkey % 1500""")
def image_lookup(spark, sf_dir):
    images = _table(spark, sf_dir, "supplier").select(F.lit(1).alias("doc"), (F.col("s_suppkey") % 700).alias("id"), F.col("s_suppkey").alias("ordinal"), F.lit("image/png").alias("mime_type"), F.when(F.col("s_suppkey") % 5 != 0, F.encode("s_name", "UTF-8")).alias("data"))
    blocks = _table(spark, sf_dir, "part").select(F.lit(1).alias("doc"), "p_partkey", (F.col("p_partkey") % 1500).alias("resource_id"))
    found = L.resolve_images(blocks, images, ["doc"])
    return found.select("p_partkey", R.image_tag(F.col("image_found"), F.col("image_mime"), F.col("image_data"), F.lit(None).cast("string")).alias("tag"))


# joins and folds


@query(f"""SELECT d.doc_id, CASE WHEN p.parser IN ('HtmlParser') THEN CASE WHEN contains(lower(substr(text, 1, 1024)), '<html') THEN p.parser END WHEN p.parser = 'EmlParser' THEN CASE WHEN contains(substr(text, 1, 1024), 'From:') AND (contains(substr(text, 1, 1024), 'To:') OR contains(substr(text, 1, 1024), 'Subject:')) THEN p.parser END ELSE p.parser END AS parser
FROM (SELECT doc_id, {_SQL_NAME} AS fname, text FROM documents) d LEFT JOIN {_SQL_EXTENSIONS} ON lower(list_last(string_split(d.fname, '.'))) = e.ext
LEFT JOIN (SELECT mime_type, arg_max(parser, ordinal) AS parser FROM {_SQL_PARSERS} GROUP BY mime_type) p ON p.mime_type = e.mime_type""")
def registry_dispatch(spark, sf_dir):
    return G.dispatch(D.detect(_named(spark, sf_dir)), S.registrations(spark)).select("doc_id", "parser")


@query(f"SELECT mime_type, arg_max(parser, ordinal) AS parser FROM {_SQL_PARSERS} GROUP BY mime_type")
def registry_winners(spark, sf_dir):
    return G.winners(S.registrations(spark)).select("mime_type", "parser")


@query("""SELECT status::INT AS status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN doc_id % 10 IN (8, 9) THEN 415 ELSE 200 END AS status FROM documents) GROUP BY status""")
def convert_tally(spark, sf_dir):
    files = _named(spark, sf_dir).withColumn("length", F.octet_length("content").cast("long"))
    return C.tally(C.convert(files.drop("text")))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag = 'R' OR coalesce(p_size % 2 = 0, false) AS bold, l_linestatus = 'F' OR coalesce(p_size % 3 = 0, false) AS italic, l_returnflag = 'A' AS underline,
coalesce(CASE WHEN l_linenumber > 3 THEN '#111111' END, p_brand) AS color, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END, p_size::DOUBLE) AS size, p_type AS font FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE -l_partkey END AS style_id FROM lineitem) LEFT JOIN part ON style_id = p_partkey""")
def style_overlay(spark, sf_dir):
    runs = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).otherwise(-F.col("l_partkey")).alias("style_id"), (F.col("l_returnflag") == "R").alias("bold"), (F.col("l_linestatus") == "F").alias("italic"), (F.col("l_returnflag") == "A").alias("underline"), F.when(F.col("l_linenumber") > 3, F.lit("#111111")).alias("color"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("size"), F.lit(None).cast("string").alias("font"))
    named = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("style_id"), (F.col("p_size") % 2 == 0).alias("bold"), (F.col("p_size") % 3 == 0).alias("italic"), F.col("p_brand").alias("color"), F.col("p_size").cast("double").alias("size"), F.col("p_type").alias("font"))
    return L.overlay_styles(runs, named).drop("style_id")


@query("""SELECT l_orderkey, l_linenumber, coalesce(t.target, 'rId' || l_partkey % 50) AS resource_id FROM lineitem LEFT JOIN (SELECT s_suppkey % 40 AS k, arg_max('media/' || s_name, s_suppkey) AS target FROM supplier GROUP BY 1) t ON t.k = l_partkey % 50""")
def relation_lookup(spark, sf_dir):
    rid = lambda c: F.concat(F.lit("rId"), c.cast("string"))
    relations = _table(spark, sf_dir, "supplier").select(F.lit(1).alias("doc"), rid(F.col("s_suppkey") % 40).alias("rel_id"), F.col("s_suppkey").alias("ordinal"), F.concat(F.lit("media/"), F.col("s_name")).alias("target"))
    blocks = _table(spark, sf_dir, "lineitem").select(F.lit(1).alias("doc"), "l_orderkey", "l_linenumber", rid(F.col("l_partkey") % 50).alias("rel_id"))
    return L.resolve_relations(blocks, relations, ["doc"]).select("l_orderkey", "l_linenumber", "resource_id")


@query("""SELECT doc_id, pos::BIGINT AS place, substr(part, strpos(part, chr(10)) + 1) AS body FROM (SELECT doc_id, unnest(string_split(text, chr(10) || 'From ')) AS part, generate_subscripts(string_split(text, chr(10) || 'From '), 1) - 1 AS pos FROM documents) WHERE (pos > 0 OR starts_with(part, 'From ')) AND strpos(part, chr(10)) > 0""")
def mbox_split(spark, sf_dir):
    found = _table(spark, sf_dir, "documents").select("doc_id", F.explode(L.split_mailbox(F.col("text"))).alias("m"))
    return found.select("doc_id", F.col("m.place").cast("long").alias("place"), "m.body")


@query("""WITH RECURSIVE p AS (SELECT doc_id, string_split(repeat(text || chr(10), 12), chr(10)) AS v FROM documents),
f AS (SELECT doc_id, v, 1 AS i, 0 AS c, 0 AS pg, 0 AS held FROM p UNION ALL
 SELECT doc_id, v, i + 1, CASE WHEN v[i] <> '' AND c + 1 >= 50 THEN 0 ELSE c + 1 END, CASE WHEN v[i] <> '' AND c + 1 >= 50 THEN pg + 1 ELSE pg END, CASE WHEN v[i] = '' THEN held WHEN c + 1 >= 50 THEN 0 ELSE held + 1 END FROM f WHERE i <= len(v))
SELECT doc_id, greatest(1, pg + CASE WHEN held > 0 THEN 1 ELSE 0 END)::INT AS page_count FROM f WHERE i = len(v) + 1""")
def paginate(spark, sf_dir):
    lines = F.split(F.repeat(F.concat("text", F.lit("\n")), F.lit(12)), "\n", -1)
    return _table(spark, sf_dir, "documents").select("doc_id", L.page_count(lines).alias("page_count"))


@query("SELECT conv_id, number, row_number() OVER (PARTITION BY conv_id ORDER BY number)::INT AS page_no FROM (SELECT DISTINCT conv_id, turn * 3 AS number FROM conversations)")
def page_numbers(spark, sf_dir):
    """Pages numbered with gaps, as where pages between have no content."""
    return L.renumbered(_table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 3).alias("number")).distinct(), ["conv_id"], "number")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) <= 100")
def attachment_limit(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return L.at_most(rows, ["l_suppkey"], "o", 100).select("l_suppkey", "l_orderkey", "l_linenumber")


@query(f"""SELECT 'no_parser' AS kind, count(*)::BIGINT AS n FROM (SELECT * FROM ({_values((k, *v) for k, v in S.FORMATS.items())}) AS f(format, mime_type, extension, family, name, is_container) WHERE mime_type NOT IN (SELECT mime_type FROM {_SQL_PARSERS}))""")
def formats_without_parser(spark, sf_dir):
    return G.unparsed(S.formats(spark), S.registrations(spark)).agg(F.count("*").alias("n")).select(F.lit("no_parser").alias("kind"), "n")


@query("SELECT * FROM (VALUES ('Timeout', true, false), ('MemoryLimit', true, false), ('ParseError', false, true), ('InvalidInput', false, true), ('Corrupted', false, true), ('UnsupportedFormat', false, true), ('Io', false, false)) AS e(kind, recoverable, input_error)")
def error_classes(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in ("Timeout", "MemoryLimit", "ParseError", "InvalidInput", "Corrupted", "UnsupportedFormat", "Io")], "kind string")
    return kinds.select("kind", C.is_recoverable(F.col("kind")).alias("recoverable"), C.is_input_error(F.col("kind")).alias("input_error"))


@query("""SELECT p_partkey, p_name AS title, 'Brand' AS first_key, p_brand AS brand, (p_size * 2)::BIGINT AS size, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS price, ['#111111', NULL, '#EEEEEE'][p_size % 3 + 1] AS colour FROM part""")
def document_metadata(spark, sf_dir):
    custom = M.add_custom(M.no_custom(), F.lit("Brand"), M.value(F.col("p_brand"), "string"))
    custom = M.add_custom(custom, F.lit("size"), M.value(F.col("p_size"), "bigint"))
    custom = M.add_custom(custom, F.lit("size"), M.value(F.col("p_size") * 2, "bigint"))
    custom = M.add_custom(custom, F.when(F.col("p_size") % 2 == 0, F.lit("price")).otherwise(F.lit("other")), M.value(F.col("p_retailprice"), "double"))
    theme = F.create_map(F.lit("dk1"), F.lit("#111111"), F.lit("lt1"), F.lit("#EEEEEE"))
    colour = M.theme_colour(theme, F.element_at(F.array(F.lit("dk1"), F.lit("none"), F.lit("lt1")), F.col("p_size") % 3 + 1))
    rows = _table(spark, sf_dir, "part").select("p_partkey", M.metadata(custom, title=F.col("p_name")).alias("m"), colour.alias("colour"))
    get = lambda k: M.get_custom(F.col("m.custom"), F.lit(k))
    return rows.select("p_partkey", "m.title", F.get(F.map_keys("m.custom"), F.lit(0)).alias("first_key"), get("Brand")["s"].alias("brand"), get("size")["i"].alias("size"), get("price")["f"].alias("price"), "colour")


@query("SELECT conv_id, string_agg(CASE WHEN n BETWEEN 2 AND 3 THEN turn::VARCHAR END, ',' ORDER BY n) AS middle, string_agg(CASE WHEN n IN (1, 4) THEN turn::VARCHAR END, ',' ORDER BY n) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) GROUP BY conv_id")
def page_ranges(spark, sf_dir):
    numbers = lambda pages: F.nullif(F.array_join(F.transform(pages, lambda p: p["number"].cast("string")), ","), F.lit(""))
    pages = F.col("document.pages")
    return _turn_pages(spark, sf_dir).select("conv_id", numbers(page_range(pages, 2, 3)).alias("middle"), numbers(page_range(pages, only=[1, 4])).alias("listed"))


# parsers of containers and mail: whole tables wrapped in the format inside the query


def _files(rows: DataFrame, key: str, content: Column, kind: str) -> DataFrame:
    return rows.select(key, F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"), F.lit(f".{kind}")).alias("name"), content.alias("content"), F.lit(S.FORMATS[kind][0]).alias("mime_type"))


def _extracted(files: DataFrame, key: str) -> DataFrame:
    d = F.col("document")
    return parse_files(files).select(key, d["metadata"]["title"].alias("title"), d["metadata"]["author"].alias("author"), F.size(d["pages"]).cast("long").alias("pages"), X.document_text(d).alias("text"), d["error"]["kind"].alias("error"))


@query("""SELECT doc_id, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'Writer ' || doc_id END AS author, 1::BIGINT AS pages,
'From: ' || CASE WHEN doc_id % 2 = 0 THEN 'Writer ' || doc_id || ' <w@example.com>' ELSE 'w@example.com' END || chr(10) || 'To: a@example.com, B <b@example.com>' || chr(10) || 'Subject: Doc ' || doc_id || chr(10) || chr(10) || text AS text, NULL::VARCHAR AS error FROM documents""")
def eml_parse(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    sender = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Writer "), d, F.lit(" <w@example.com>"))).otherwise("w@example.com")
    raw = F.concat(F.lit("From: "), sender, F.lit("\nTo: a@example.com, B <b@example.com>\nSubject: Doc "), d, F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.col("text"))
    return _extracted(_files(_table(spark, sf_dir, "documents"), "doc_id", F.encode(raw, "UTF-8"), "eml"), "doc_id")


@query("""SELECT c_custkey, c_name AS title, NULL::VARCHAR AS author, 2::BIGINT AS pages, 'Name: ' || c_name || chr(10) || 'Organization: ' || c_mktsegment || chr(10) || 'Address: ' || c_nationkey || ', Main' || chr(10) || chr(10) || 'Note:' || chr(10) || 'long note' || chr(10) || chr(10) || chr(10) || 'Name: second' || chr(10) AS text, NULL::VARCHAR AS error FROM customer""")
def vcf_parse(spark, sf_dir):
    raw = F.concat(F.lit("BEGIN:VCARD\r\nVERSION:4.0\r\nFN:"), F.col("c_name"), F.lit("\r\nORG;X=y:"), F.col("c_mktsegment"), F.lit("\r\nADR:;;"), F.col("c_nationkey").cast("string"), F.lit(";Main;;\r\nNOTE:long \r\n note\r\nEND:VCARD\r\nBEGIN:VCARD\r\nFN:second\r\nEND:VCARD\r\n"))
    return _extracted(_files(_table(spark, sf_dir, "customer"), "c_custkey", F.encode(raw, "UTF-8"), "vcf"), "c_custkey")


@query("""SELECT o_orderkey, 'Orders' AS title, NULL::VARCHAR AS author, 1::BIGINT AS pages, 'Event: order ' || o_orderkey || chr(10) || 'Start: ' || strftime(o_orderdate, '%Y%m%d') || chr(10) || chr(10) || 'Description:' || chr(10) || o_orderpriority || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS text, NULL::VARCHAR AS error FROM orders""")
def ics_parse(spark, sf_dir):
    raw = F.concat(F.lit("BEGIN:VCALENDAR\nX-WR-CALNAME:Orders\nBEGIN:VEVENT\nSUMMARY:order "), F.col("o_orderkey").cast("string"), F.lit("\nDTSTART;VALUE=DATE:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("\nDESCRIPTION:"), F.col("o_orderpriority"), F.lit("\nEND:VEVENT\nEND:VCALENDAR\n"))
    return _extracted(_files(_table(spark, sf_dir, "orders"), "o_orderkey", F.encode(raw, "UTF-8"), "ics"), "o_orderkey")


@query("SELECT page_id, regexp_extract(html, '<title>\\s*([^<]*?)\\s*</title>', 1) AS title, NULL::VARCHAR AS author, 1::BIGINT AS pages, html AS text, NULL::VARCHAR AS error FROM pages")
def html_parse(spark, sf_dir):
    return _extracted(_files(_table(spark, sf_dir, "pages"), "page_id", F.encode("html", "UTF-8"), "html"), "page_id")
