"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions.

The training side is read once into a stored index: a posting (term, doc, at) for every place of a term that some test
item has. A test item's windows are its runs of N = 10 consecutive words (an item of fewer words is one window). Term
counts come from the index and order each window's terms from the rarest on; a window with a term that no document
holds is dropped unread. Lists are intersected in that order: the postings of a window's rarest term, shifted by its
offset, are the starts at which the window may stand; those go on that the second rarest term's postings meet, shifted by
its own offset, then the third rarest's, and then those that the postings of all further terms meet, in the documents that are left. With slop, a term may stand
that many words off its place: proximity matches. Without, matches are exact phrases.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Null texts have no
words, items without words no window; null item ids count in no digest, but their windows are looked for. Ids may be null
or repeat: a document is named by its id and its text's hash, so equal rows share one outcome, and two texts of one id
don't. Among equally rare terms of a window the first one counts as rarer. An empty table of documents gives no rows, an empty
benchmark no hits. Columns beside id and text are not looked at; clean() keeps them. A very long text is many postings, no long row.

What is shuffled are postings and starts, never texts. The test side is small by nature; it is broadcast only under
BROADCAST_ROWS rows and joined otherwise. A frequent term is met by broadcast, or as a skewed key that adaptive execution
splits; from the second list on the document is part of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import materialise

N = 10
#: Rows of the test side up to which it is broadcast; a row is a term and two numbers.
BROADCAST_ROWS = 400_000
#: Documents with starts left after three lists up to which they are broadcast; a row is two longs. Beyond it the index is shuffled once.
DOCUMENT_ROWS = 1_000_000
#: What stands between words, before and after A-Z is lowered.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """Words in their own case; the first and the last may be empty."""
    return F.split(F.coalesce(text, F.lit("")), BREAK)


def lowered(word: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def n_words(words: Column) -> Column:
    return F.size(words) - (F.element_at(words, 1) == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """(item, words): the distinct windows of each item; words is an array of at most n."""
    words = F.filter(F.transform(raw_words(items[text_col]), lowered), lambda w: w != "")
    rows = items.select(items[id_col].alias("item"), words.alias("all")).where(F.size("all") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("all") - n + 1, F.lit(1)))
    return rows.select("item", F.explode(F.transform(at, lambda i: F.slice("all", i, n))).alias("words")).distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def index(docs: DataFrame, wins: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings (term, id, h, at) of the terms of wins in docs; at counts words from 1, h is the text's hash."""
    terms = materialise(wins.select(F.explode("words").alias("term")).distinct(), "terms")
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), raw_words(docs[text_col]).alias("words"))
    rows = rows.withColumn("lead", (F.element_at("words", 1) == "").cast("int"))  # split leaves an empty word before a first break
    rows = rows.select("id", "h", "lead", F.posexplode("words").alias("pos", "raw")).where("raw <> ''")
    found = rows.select(lowered(F.col("raw")).alias("term"), "id", "h", (F.col("pos") + 1 - F.col("lead")).alias("at"))
    return materialise(found.join(_small(terms, terms.count()), "term", "left_semi"), "index")


def ordered(postings: DataFrame, wins: DataFrame) -> DataFrame:
    """(win, item, length, step, term, offset): the terms of each window that can occur, rarest first (step 0)."""
    each = wins.select("win", "item", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))
    counts = materialise(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")  # summed per task before they are shuffled
    ranked = each.join(counts, "term", "left").groupBy("win", "item", "length").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("terms")  # at most N terms
    )
    ranked = ranked.where("terms[0].n > 0").select("win", "item", "length", F.posexplode("terms").alias("step", "t"))
    return materialise(ranked.select("win", "item", "length", "step", "t.term", "t.offset"), "plan")


def intersect(postings: DataFrame, plan: DataFrame, slop: int = 0) -> DataFrame:
    """(id, h, win, start): where windows occur; start counts words from 1 and may be off by slop where slop is over 0."""
    size = plan.count()

    def of(steps: str) -> DataFrame:
        return plan.where(steps)

    def shifted(rows: DataFrame, at: Column) -> DataFrame:
        """A row for each place within slop of at."""
        if not slop:
            return rows.withColumn("due", at)
        return rows.withColumn("due", F.explode(F.array(*(at + F.lit(d) for d in range(-slop, slop + 1)))))

    rarest = of("step = 0").select("term", "win", "offset", "length")
    starts = shifted(postings.join(_small(rarest, size), "term"), F.col("at") - F.col("offset"))
    # a window begins within the text, if its words keep their places
    starts = starts.select("id", "h", "win", "length", F.col("due").cast("int").alias("start")).where(F.col("start") >= 1 - slop)
    starts = materialise(starts.distinct() if slop else starts, "starts")

    def met(starts: DataFrame, steps: str, postings: DataFrame) -> DataFrame:
        """(id, h, win, length, start, step): the steps' terms that stand where a start needs them."""
        terms = of(steps).select("win", "step", F.col("term").alias("need"), "offset")
        asks = starts.join(_small(terms, size), "win")
        asks = shifted(asks, F.col("start") + F.col("offset")).drop("offset")
        same = F.col("p.id").eqNullSafe(F.col("a.id")) & (F.col("p.h") == F.col("a.h")) & (F.col("p.term") == F.col("a.need")) & (F.col("p.at") == F.col("a.due"))
        # starts grow with the documents: both sides are shuffled at every size
        return postings.alias("p").hint("merge").join(asks.alias("a"), same).select("a.id", "a.h", "a.win", "a.length", "a.start", "a.step")

    def lists(steps: str) -> DataFrame:
        """The postings of the steps' terms alone: frequent terms are no window's second or third rarest."""
        return postings.join(_small(of(steps).select("term").distinct(), size), "term", "left_semi")

    for step in (1, 2):
        left = starts.where(f"length > {step}")
        left = met(left, f"step = {step}", lists(f"step = {step}"))
        left = (left.distinct() if slop else left).select("id", "h", "win", "length", "start")
        starts = materialise(starts.where(f"length <= {step}").unionByName(left), "starts")
    done = starts.where("length <= 3").select("id", "h", "win", "start")
    left = starts.where("length > 3")
    places = materialise(left.select(F.col("id").alias("d_id"), F.col("h").alias("d_h")).distinct(), "places")
    few = F.broadcast(places) if places.count() <= DOCUMENT_ROWS else places
    near = postings.join(few, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("h") == F.col("d_h")), "left_semi")
    rest = met(left, "step > 2", near)
    steps = F.count_distinct("step") if slop else F.count(F.lit(1))  # without slop a place holds one term, so steps are met once
    rest = rest.groupBy("id", "h", "win", "length", "start").agg(steps.alias("n")).where("n = length - 3").select("id", "h", "win", "start")
    return done.unionByName(rest)


def numbered(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """windows() with a number win each."""
    return materialise(windows(items, id_col, text_col, n).withColumn("win", F.monotonically_increasing_id()), "windows")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N) -> DataFrame:
    """(id, h, start, length, item): every place at which a window occurs."""
    wins = numbered(items, item_col, item_text, n)
    postings = index(docs, wins, id_col, text_col)
    plan = ordered(postings, wins)
    found = intersect(postings, plan)
    named = plan.where("step = 0").select("win", "item", "length")
    return found.join(_small(named, named.count()), "win").select("id", "h", "start", "length", "item")


def proximity(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N) -> DataFrame:
    """(id_col, item_col): documents in which all words of a window stand within slop words of their places, around some start."""
    wins = numbered(items, item_col, item_text, n)
    postings = index(docs, wins, id_col, text_col)
    plan = ordered(postings, wins)
    found = intersect(postings, plan, slop).select("id", "win").distinct()
    named = plan.where("step = 0").select("win", "item")
    return found.join(_small(named, named.count()), "win").select(F.col("id").alias(id_col), F.col("item").alias(item_col)).distinct()


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256 and contaminated for every document.

    A word is hit if an occurrence of a window covers it. items_sha256 digests the ids of the items
    with occurring windows, sorted as strings and joined by commas.
    """
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), raw_words(docs[text_col]).alias("words"))
    found = materialise(hits(docs, items, id_col, text_col, item_col, item_text, n).distinct(), "hits")
    by_start = Window.partitionBy("id", "h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("id", "h", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    spans = spans.withColumn("before", F.max("end").over(by_start))
    covered = spans.groupBy("id", "h").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", F.coalesce("before", "start")), F.lit(0))).alias("n_hit"))
    met = found.select("id", "h", F.col("item").cast("string").alias("item")).distinct()
    met = met.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    per_doc = materialise(_null_safe(covered, met, "inner").select("l.id", "l.h", "n_hit", "n_items", "items_sha256"), "per_doc")
    counted = rows.select("id", "h", n_words(F.col("words")).cast("bigint").alias("n_words"))
    return _null_safe(counted, per_doc, "left").select(
        F.col("l.id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _null_safe(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    return left.alias("l").join(right.alias("r"), F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.h") == F.col("r.h")), how)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """documents without any occurrence of a window of items, with all their columns; no ids and no rows are lost beside."""
    gone = materialise(hits(docs, items).select(F.col("id").alias("_gone_id"), F.col("h").alias("_gone_h")).distinct(), "hits")
    small = _small(gone, gone.count())
    return docs.join(small, docs["doc_id"].eqNullSafe(small["_gone_id"]) & (F.xxhash64(docs["text"]) == small["_gone_h"]), "left_anti")


#: The same result in DuckDB.
REPORT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), b AS (
  SELECT item_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark
), w AS (
  SELECT DISTINCT item_id, len(words[i:i + 9]) AS n, array_to_string(words[i:i + 9], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), place AS (
  SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n
), hit AS (
  SELECT rid, s, place.n, item_id FROM place JOIN w ON w.n = place.n AND w.phrase = array_to_string(words[s:s + place.n - 1], ' ')
), pos AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid
), met AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN met USING (rid)
"""
