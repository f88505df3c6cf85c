"""Reading HTML as a sequence of tokens: visible text, table cells, list and definition items.

A page is split into tags and texts by one pattern; positions then run through a state machine written as running counts and last seen
values over each page's tokens: how many tables, rows and cells have begun, how many are open, whether a script or style is open. So a page's cells
are rows by table, row and column, whatever is nested or left unclosed: a cell ends where the next one of its table begins, or its row or table ends.
Tokens of one page are ordered in one task, pages are spread.

Null and empty pages have no tokens. Comments, scripts and styles are no text. Character references are decoded as reference pages need them: numbers, and the names below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of character references, and what they stand for.
ENTITIES = (
    ("nbsp", " "), ("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("aacute", "á"), ("eacute", "é"), ("iacute", "í"), ("oacute", "ó"), ("uacute", "ú"), ("Aacute", "Á"), ("Eacute", "É"), ("Iacute", "Í"), ("Oacute", "Ó"), ("Uacute", "Ú"),
    ("ntilde", "ñ"), ("Ntilde", "Ñ"), ("ccedil", "ç"), ("Ccedil", "Ç"), ("uuml", "ü"), ("Uuml", "Ü"), ("agrave", "à"), ("egrave", "è"), ("ograve", "ò"), ("middot", "·"), ("ordm", "º"), ("ordf", "ª"), ("amp", "&"),
)

TOKEN = r"(?s)<!--.*?-->|<[a-zA-Z!/?][^>]*>|<|[^<]+"
#: Elements that end a line of visible text.
LINES = ("p", "div", "table", "tr", "ul", "ol", "dl", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "br")


def decode(text: Column) -> Column:
    """text with its character references decoded; `&amp;` last, so nothing is decoded twice."""
    out = text
    for name, value in ENTITIES[:-1]:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    codes = F.regexp_extract_all(out, F.lit(r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0))

    def one(acc: Column, code: Column) -> Column:
        hexadecimal = F.lower(F.substring(code, 3, 1)) == "x"
        number = F.when(hexadecimal, F.conv(F.regexp_extract(code, r"&#[xX]([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(code, r"&#([0-9]+);", 1)).cast("int")
        point = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        # UTF-16 units: one, or two beyond the basic plane
        low, high = F.conv((number % 65536).cast("string"), 10, 16), number - 0x10000
        pair = F.concat(F.lpad(F.conv((F.lit(0xD800) + F.floor(high / 1024)).cast("string"), 10, 16), 4, "0"), F.lpad(F.conv((F.lit(0xDC00) + high % 1024).cast("string"), 10, 16), 4, "0"))
        return F.when(point, F.replace(acc, code, F.decode(F.unhex(F.when(number < 65536, F.lpad(low, 4, "0")).otherwise(pair)), "UTF-16BE"))).otherwise(acc)

    out = F.when(F.size(codes) > 0, F.aggregate(F.array_distinct(codes), out, one)).otherwise(out)
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))


def visible_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags; a line for each block."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)<(br)\s*/?>|</(p|div|tr|li|h[1-6]|dt|dd)\s*>", "\n")
    text = decode(F.regexp_replace(lines, r"<[a-zA-Z!/?][^>]*>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x{0B}\x{A0}]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, null without it."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.when(found != "", decode(F.regexp_replace(found, "^[\"']|[\"']$", "")))


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, at, token, name, closes): a page's tags, text and comments in order; name is a tag's in lower case, empty for text."""
    each = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    return each.select(key, "at", "token", name.alias("name"), F.startswith("token", F.lit("</")).alias("closes"))


def _marked(pages: DataFrame, key: str, html: str) -> tuple[DataFrame, Window]:
    """Tokens that are seen, outside scripts, styles and comments, and the window up to each."""
    rows = tokens(pages, key, html)
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    hides = F.col("name").isin("script", "style", "title")
    last = F.last(F.when(hides, F.struct("name", "closes")), ignorenulls=True).over(upto)
    rows = rows.withColumn("hidden", F.coalesce(~last["closes"], F.lit(False)))
    return rows.where(~F.col("hidden") & ~F.startswith("token", F.lit("<!"))), upto


def _count(upto, condition: Column) -> Column:
    return F.sum(condition.cast("int")).over(upto)


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, table_id, row_no, column_no, header, text): every cell of every page's tables, numbered from 1.

    A cell inside an inner table is the inner table's; the outer cell's text goes on after it.
    """
    rows, upto = _marked(pages, key, html)
    begins, ends = ~F.col("closes"), F.col("closes")
    is_table = F.col("name") == "table"
    # depth of tables, and the number of the one that is open at each depth
    rows = rows.withColumn("depth", _count(upto, is_table & begins) - _count(upto, is_table & ends)).withColumn("opened", _count(upto, is_table & begins))
    within = Window.partitionBy(key, "depth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("table_no", F.last(F.when(is_table & begins, F.col("opened")), ignorenulls=True).over(within)).where("depth > 0")
    own = Window.partitionBy(key, "table_no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    row_begins = (F.col("name") == "tr") & begins
    rows = rows.withColumn("row_no", _count(own, row_begins))
    line = Window.partitionBy(key, "table_no", "row_no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cell = F.col("name").isin("td", "th")
    outside = (cell & ends) | ((F.col("name") == "tr") & ends)
    inside = F.last(F.when(cell & begins, F.lit(True)).when(outside, F.lit(False)), ignorenulls=True).over(line)
    rows = rows.withColumns({"column_no": _count(line, cell & begins), "inside": inside, "id": F.first(F.when(is_table & begins, attribute(F.col("token"), "id")), ignorenulls=True).over(own)})
    rows = rows.where("inside AND row_no > 0 AND column_no > 0")
    piece = F.when(F.col("name") == "", F.col("token")).when(F.col("name").isin(*LINES), F.lit(" ")).otherwise(F.lit(""))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("s")))), lambda x: x["s"]), "")
    out = rows.groupBy(key, "table_no", "row_no", "column_no").agg(F.first("id", ignorenulls=True).alias("table_id"), F.min_by("name", "at").alias("first"), whole.alias("raw"))
    return out.select(key, "table_no", "table_id", "row_no", "column_no", (F.col("first") == "th").alias("header"), squeeze(decode(F.col("raw"))).alias("text"))


def list_items(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, list_no, item_no, kind, text, href): items of every list and definition list of every page, numbered from 1, with their first link.

    kind is li, dt or dd. Text before a list's first item is nobody's. An item inside an inner list is the inner list's; what follows it is the outer item's.
    """
    rows, upto = _marked(pages, key, html)
    begins, ends = ~F.col("closes"), F.col("closes")
    is_list = F.col("name").isin("ul", "ol", "dl")
    rows = rows.withColumn("depth", _count(upto, is_list & begins) - _count(upto, is_list & ends)).withColumn("opened", _count(upto, is_list & begins))
    within = Window.partitionBy(key, "depth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("list_no", F.last(F.when(is_list & begins, F.col("opened")), ignorenulls=True).over(within)).where("depth > 0")
    own = Window.partitionBy(key, "list_no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    item = F.col("name").isin("li", "dt", "dd")
    rows = rows.withColumns({"item_no": _count(own, item & begins), "inside": F.last(F.when(item, begins), ignorenulls=True).over(own)}).where("inside AND item_no > 0")
    piece = F.when(F.col("name") == "", F.col("token")).when(F.col("name").isin(*LINES), F.lit(" ")).otherwise(F.lit(""))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("s")))), lambda x: x["s"]), "")
    link = F.min(F.when((F.col("name") == "a") & begins, F.struct("at", attribute(F.col("token"), "href").alias("href"))))
    out = rows.groupBy(key, "list_no", "item_no").agg(F.min_by("name", "at").alias("kind"), whole.alias("raw"), link["href"].alias("href"))
    return out.select(key, "list_no", "item_no", "kind", squeeze(decode(F.col("raw"))).alias("text"), "href")
