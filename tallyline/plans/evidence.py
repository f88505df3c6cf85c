"""Evidence for extracted values: where a quote stands on its page, flattened fields, parties, revisions, line categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.bind import let
from tallyline.functions.ids import check_nif, norm_iban
from tallyline.functions.text import fold, keyword_hits, levenshtein_similarity, norm_text, tokens
from tallyline.functions.amounts import parse_amount
from tallyline.functions.dates import parse_date
from tallyline.operators.ordered import latest

FOUND, MARGIN = 0.82, 0.15


def _folded(c: Column) -> Column:
    return fold(F.coalesce(c, F.lit("")), "lower", "a-z0-9")


def _inside(w: Column, box: Column) -> Column:
    x, y = (w["x0"] + w["x1"]) / 2, (w["y0"] + w["y1"]) / 2
    dx, dy = F.greatest(F.lit(2.0), (box[2] - box[0]) * MARGIN), F.greatest(F.lit(2.0), (box[3] - box[1]) * MARGIN)
    return x.between(box[0] - dx, box[2] + dx) & y.between(box[1] - dy, box[3] + dy)


def locate_quotes(fields: DataFrame, words: DataFrame) -> DataFrame:
    """fields(field_id, page_id, quote, bbox) with found text, score, scope and crop_status.

    words(page_id, idx, text, x0, y0, x1, y1) are gathered a page at a time, which small files don't foretell: pages are sorted, not broadcast. Runs of as many words as the quote has, one
    more, one fewer and two more are compared; inside the box first, then on the whole page.
    """
    pages = words.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "x0", "y0", "x1", "y1"))).alias("words"))
    rows = fields.join(pages.hint("merge"), "page_id", "left").withColumn("target", _folded(F.col("quote"))).withColumn("n", F.size(F.split("target", " ")))
    rows = rows.withColumn("words", F.transform(F.coalesce("words", F.array().cast(pages.schema["words"].dataType)), lambda w: w.withField("text", _folded(w["text"]))))

    def best(pool: Column) -> Column:
        def runs(p):
            def of(size):
                starts = F.when((size >= 1) & (F.size(p) >= size), F.sequence(F.lit(1), F.size(p) - size + 1)).otherwise(F.array().cast("array<int>"))
                return F.transform(starts, lambda i: F.slice(p, i, size))

            every = F.flatten(F.transform(F.array(F.col("n"), F.col("n") + 1, F.col("n") - 1, F.col("n") + 2), of))
            named = F.transform(every, lambda r: F.struct(F.array_join(F.filter(F.transform(r, lambda w: w["text"]), lambda t: t != ""), " ").alias("text"), r.alias("run")))
            scored = F.transform(F.filter(named, lambda r: r["text"] != ""), lambda r: F.struct(levenshtein_similarity(r["text"], F.col("target")).alias("score"), (-r["run"][0]["idx"]).alias("at"), r["text"].alias("text"), r["run"].alias("run")))
            return F.array_max(scored)

        return let(pool, runs)

    boxed = F.when(F.col("bbox").isNotNull(), F.filter("words", lambda w: _inside(w, F.col("bbox")))).otherwise(F.slice("words", 1, 0))
    ok_box, ok_page = F.coalesce(F.col("in_box.score") >= FOUND, F.lit(False)), F.coalesce(F.col("on_page.score") >= FOUND, F.lit(False))
    rows = rows.withColumn("in_box", best(boxed)).withColumn("on_page", F.when(~ok_box, best(F.col("words"))))
    rows = rows.withColumn("hit", F.when(F.col("target") == "", F.lit(None)).when(ok_box, F.col("in_box")).when(ok_page, F.col("on_page")))
    held = F.col("bbox").isNotNull() & F.forall("hit.run", lambda w: _inside(w, F.col("bbox")))
    status = F.when(F.col("hit").isNull(), "page_only").when(F.coalesce(held, F.lit(False)), "anchored").otherwise("approximate")
    scope = F.when(F.col("hit").isNotNull(), F.when(ok_box, "bbox").otherwise("page"))
    return rows.select("field_id", F.col("hit.text").alias("found"), F.col("hit.score").alias("score"), scope.alias("scope"), status.alias("crop_status"))


#: Words that carry a table over to the next page, and what a page number is printed as.
CARRY = r"\b(suma\s*(y|i)\s*sigue|suma\s*i\s*segueix|continua|continuacion|continuacio|sigue\b|segueix\b|passa\s*full)"
PAGE_OF, PAGE = r"(\d{1,3})\s*(?:/|de|d'|of)\s*(\d{1,3})", r"(?:pag(?:ina)?|pg|p|hoja|full|foli|folio)\.?\s*(\d{1,3})\b"
#: From what confidence on a reader's word counts, and how sure each kind of link is.
CONTINUES, SAME_FILE, CHAINED, SAME_NUMBER = 0.8, 0.9, 0.9, 0.85


def page_marker(c: Column) -> Column:
    """struct(page, of, carry) of a printed page marker; its numbers are null where there are none."""

    def read(t):
        number, single = F.nullif(F.regexp_extract(t, PAGE_OF, 1), F.lit("")), F.nullif(F.regexp_extract(t, PAGE, 1), F.lit(""))
        return F.struct(F.coalesce(number, single).try_cast("int").alias("page"), F.nullif(F.regexp_extract(t, PAGE_OF, 2), F.lit("")).try_cast("int").alias("of"), t.rlike(CARRY).alias("carry"))

    return let(fold(F.coalesce(c, F.lit("")), "lower"), read)


def page_links(pages: DataFrame, batch: str = "batch", order: str = "page_no") -> DataFrame:
    """pages with link and confidence: whether each continues the one before it, as ordered.group_pages takes it.

    pages has file_id, is_pdf, role, continues, continues_confidence, number_hint, issuer_hint and marker. Pages of one PDF belong together, but one
    marked as a first page only if it is of its group's kind (link is null). Others need a sign: the reader's word, the same number and
    issuer, a page number that follows, or a table carried over.
    """
    by = Window.partitionBy(batch).orderBy(order)
    key = {c: fold(F.coalesce(c, F.lit("")), "lower", "a-z0-9", "") for c in ("number_hint", "issuer_hint")}
    rows = pages.withColumns({"_m": page_marker(F.col("marker")), "_n": key["number_hint"], "_i": key["issuer_hint"]})
    rows = rows.withColumn("_p", F.lag(F.struct("file_id", "_m", "_n", "_i")).over(by))
    same_file = F.coalesce((F.col("_p.file_id") == F.col("file_id")) & F.col("is_pdf"), F.lit(False))
    told = F.coalesce(F.col("continues") & (F.col("continues_confidence") >= CONTINUES), F.lit(False))
    numbered = F.coalesce((F.col("_n") != "") & (F.col("_i") != "") & (F.col("_n") == F.col("_p._n")) & (F.col("_i") == F.col("_p._i")), F.lit(False))
    totals = F.col("_p._m.of").isNull() | F.col("_m.of").isNull() | (F.col("_p._m.of") == F.col("_m.of"))
    chained = F.coalesce((F.col("_m.page") == F.col("_p._m.page") + 1) & totals, F.lit(False)) | F.coalesce(F.col("_p._m.carry"), F.lit(False))
    first = same_file & F.coalesce(F.col("role") == "first", F.lit(False))
    link = F.when(F.col("_p").isNull(), False).when(first, F.lit(None)).otherwise(same_file | told | numbered | chained)
    sure = F.greatest(F.when(same_file, SAME_FILE).otherwise(0.0), F.when(told, F.col("continues_confidence")).otherwise(0.0), F.when(numbered, SAME_NUMBER).otherwise(0.0), F.when(chained, CHAINED).otherwise(0.0))
    return rows.withColumns({"link": link, "confidence": F.when(F.col("_p").isNotNull(), sure).otherwise(0.0)}).drop("_m", "_n", "_i", "_p")


def canonical(kind: Column, raw: Column) -> Column:
    """A field's value in the one form in which two readers are compared."""
    return (
        F.when(kind == "amount", parse_amount(raw).cast("decimal(18,2)").cast("string")).when(kind == "date", parse_date(raw).cast("string"))
        .when(kind == "nif", F.nullif(check_nif(raw)["nif"], F.lit(""))).when(kind == "iban", F.nullif(norm_iban(raw), F.lit(""))).otherwise(norm_text(raw))
    )


def two_sources(readings: DataFrame) -> DataFrame:
    """(field_id, value, status) of readings(field_id, source, kind, raw): agreed if two sources give one value, demoted if a third denies it."""
    each = readings.withColumn("v", canonical(F.col("kind"), F.col("raw")))
    counts = each.where("v IS NOT NULL").groupBy("field_id", "v").agg(F.count_distinct("source").alias("n"))
    top = counts.groupBy("field_id").agg(F.max_by("v", F.struct("n", "v")).alias("value"), F.max("n").alias("n"), F.count(F.lit(1)).alias("values"))
    status = F.when((F.col("n") >= 2) & (F.col("values") == 1), "agreed").when(F.col("n") >= 2, "demoted").otherwise("single")
    return top.select("field_id", "value", status.alias("status"))


def flatten_json(docs: DataFrame, doc_id: str, column: str) -> DataFrame:
    """(doc_id, path, value) of every leaf of a JSON text, array places as [i]. Depth is bounded by the schemas: six levels."""
    level = docs.select(doc_id, F.lit("").alias("path"), F.try_parse_json(column).alias("v"))
    out = None
    for _ in range(6):
        kind = F.schema_of_variant("v")
        leaf = level.where(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"))
        leaf = leaf.select(doc_id, "path", F.try_variant_get("v", "$", "string").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        inner = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        inner.createOrReplaceTempView("_flatten")
        child = inner.sparkSession.sql(f"SELECT _flatten.`{doc_id}`, path, t.pos, t.key, t.value AS v FROM _flatten, LATERAL variant_explode(_flatten.v) AS t")
        name = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat_ws(".", F.nullif("path", F.lit("")), "key"))
        level = child.select(doc_id, name.alias("path"), "v")
    return out


def resolve_parties(mentions: DataFrame) -> DataFrame:
    """(party_key, name, nif, mentions): mentions(mention_id, name, nif, at) by tax number, else by normalised name; the first known values stay."""
    nif = check_nif(F.col("nif"))
    keyed = mentions.withColumns({"_n": F.when(nif["valid"], nif["nif"]), "_t": norm_text(F.col("name"))}).withColumn("party_key", F.coalesce("_n", "_t")).where("party_key IS NOT NULL")
    return keyed.groupBy("party_key").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("at", "mention_id"))).alias("name"), F.max("_n").alias("nif"), F.count(F.lit(1)).alias("mentions"))


def current_values(revisions: DataFrame) -> DataFrame:
    """The newest revision of each field; needs_reason marks a person's change of more than one euro without a reason."""
    by = Window.partitionBy("document_id", "field_path").orderBy("created_at", "id")
    change = F.abs(parse_amount(F.col("value")) - parse_amount(F.lag("value").over(by)))
    marked = revisions.withColumn("needs_reason", F.coalesce((F.col("author") == "human") & (F.col("kind") == "amount") & (change > 1) & (F.trim(F.coalesce("reason", F.lit(""))) == ""), F.lit(False)))
    return latest(marked, ["document_id", "field_path"], ["created_at", "id"])


def classify_lines(lines: DataFrame, keywords: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(line_id, code, score, confidence): lines(line_id, text, vendor) by keywords(code, keyword); a keyword scores its words.

    A vendor's hint(vendor, code) is kept unless another category leads it by two. keywords are a small list.
    """
    known = keywords.select("code", tokens(F.col("keyword")).alias("k")).agg(F.collect_list(F.struct("code", "k")).alias("all"))
    rows = lines.withColumn("_w", tokens(F.col("text"))).join(F.broadcast(known))  # one row: the list
    hits = rows.select("line_id", F.explode(F.filter("all", lambda x: (F.size(x["k"]) > 0) & keyword_hits(F.col("_w"), x["k"]))).alias("h"))
    score = hits.groupBy("line_id", F.col("h.code").alias("code")).agg(F.sum(F.size("h.k")).alias("score"))
    if hints is not None:
        own = lines.join(hints, "vendor").select("line_id", "code", F.lit(True).alias("_hint"))
        score = score.join(own, ["line_id", "code"], "full").fillna(0, ["score"])
        score = score.withColumn("_rank", F.col("score") + F.when(F.col("_hint"), 1.5).otherwise(0.0))
    else:
        score = score.withColumn("_rank", F.col("score").cast("double"))
    best = score.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("_rank")).alias("r"), "code", "score"))).alias("s"))
    runner = F.coalesce(F.get("s", F.lit(1))["score"], F.lit(0))
    confidence = F.least(F.lit(0.95), 0.5 + 0.1 * F.col("s")[0]["score"] + 0.1 * F.greatest(F.col("s")[0]["score"] - runner, F.lit(0)))
    return best.select("line_id", F.col("s")[0]["code"].alias("code"), F.col("s")[0]["score"].alias("score"), F.round(confidence, 3).alias("confidence"))
