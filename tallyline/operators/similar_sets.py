"""Set-similarity join: pairs of sets whose Jaccard similarity reaches a threshold, without comparing all pairs.

Items are ordered rarest first over the whole table. Two sets that are similar enough share an item in their prefixes (all but the last
ceil(t * size) - 1 items), so only the prefixes' items are joined; sizes must lie within t of each other, and the place of the
first shared item bounds how much can still be shared. What is left is verified on the whole sets. Equal sets are one node from the
start, so copies cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.text import strip_diacritics
from tallyline.operators.scratch import materialise


def trigrams(text: Column) -> Column:
    """The distinct three-character runs of a text's words, each word in lower case with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(strip_diacritics(F.coalesce(text, F.lit("")))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")

    def runs(word):
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, runs)))


def similar_sets(rows: DataFrame, node: str, items: str, percent: int) -> DataFrame:
    """(a, b, shared, total) of rows(node, items): pairs of different nodes, a < b, with 100 * shared >= percent * total.

    node is a row's number or name, once each; items an array of distinct items. Empty sets are similar to none. shared and total are the sizes of
    intersection and union.
    """
    rows = rows.select(F.col(node).alias("node"), F.col(items).alias("items")).where(F.size(items) > 0)
    each = rows.select("node", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    order = F.array_sort(F.collect_list(F.struct("often", "item")))
    ranked = each.join(often, "item").groupBy("node").agg(F.transform(order, lambda x: x["item"]).alias("items"))
    ranked = materialise(ranked.withColumn("n", F.size("items")), "ranked")
    first = F.slice("items", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    prefix = ranked.select("node", "n", F.posexplode(first).alias("at", "item"))
    one, other = (prefix.select("item", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "at"))) for x in "ab")
    # the pair meets at each shared item of the prefixes; at the first of them `rest` bounds what both can share
    rest = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    met = one.join(other, "item").where((F.col("a_node") < F.col("b_node")) & (100 * small >= percent * large))
    pairs = met.groupBy("a_node", "b_node").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"), F.max(rest).alias("rest"))
    enough = (100 + percent) * F.col("rest") >= percent * (F.col("a_n") + F.col("b_n"))
    pairs = pairs.where(enough).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    for x in "ab":
        pairs = pairs.join(ranked.select(F.col("node").alias(x), F.col("items").alias(f"{x}_items")), x)
    shared = F.size(F.array_intersect("a_items", "b_items"))
    out = pairs.select("a", "b", shared.alias("shared"), (F.size("a_items") + F.size("b_items")).alias("both"))
    return out.select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("total")).where(100 * F.col("shared") >= percent * F.col("total"))


def similar_lines(lines: DataFrame, line: str, vendor: str, day: str, text: str, percent: int = 85, days: int = 120) -> DataFrame:
    """(line, similar): for each line how many lines of other vendors within `days` of it have a similar text (trigrams, at least percent / 100).

    Texts with equal trigrams are one node, with a number. Partners are counted, not listed: sums over days up to both ends of a window, by text for all
    vendors and by text and vendor for a line's own, so a text on very many lines costs a sort. What is sorted is a row for each line and each text like its own that has
    another number, of numbers alone; a line's name is sorted once. Lines without day, vendor or words have none. Names of lines must be distinct.
    """
    rows = lines.select(F.col(line).alias("line"), F.col(vendor).alias("vendor"), F.unix_date(F.col(day).cast("date")).alias("day"), F.col(text).alias("text"))
    texts = rows.select("text").distinct().withColumn("items", F.array_sort(trigrams(F.col("text"))))
    texts = materialise(texts.where(F.size("items") > 0).withColumn("same", F.sha2(F.array_join("items", "|"), 256)), "texts")
    nodes = texts.groupBy("same").agg(F.first("items").alias("items")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes, "nodes")
    pairs = similar_sets(nodes, "node", "items", percent).select("a", "b")
    others = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "pairs").withColumnRenamed("a", "node")
    numbered = texts.join(nodes.select("same", "node"), "same").select("text", "node")
    rows = materialise(rows.join(numbered, "text", "left").drop("text"), "lines")
    known = F.col("day").isNotNull() & F.col("vendor").isNotNull() & F.col("node").isNotNull()
    counted = rows.where(known)

    def within(*keys):
        by = Window.partitionBy(*keys).orderBy("day")
        return F.sum("n").over(by.rangeBetween(Window.unboundedPreceding, days)) - F.coalesce(F.sum("n").over(by.rangeBetween(Window.unboundedPreceding, -days - 1)), F.lit(0))

    daily = counted.groupBy("node", "day").agg(F.count(F.lit(1)).alias("n")).repartition("day")  # a day's texts meet in one place before they are dealt by text
    near = daily.unionByName(daily.join(others, "node").select(F.col("b").alias("node"), "day", "n")).groupBy("node", "day").agg(F.sum("n").alias("n"))
    every = near.select("node", "day", within("node").alias("every"))
    mine = counted.select("line", "vendor", "day", "node", F.lit(1).alias("n"))
    theirs = counted.select("vendor", "day", "node").join(others, "node").select(F.lit(None).cast(rows.schema["line"].dataType).alias("line"), "vendor", "day", F.col("b").alias("node"), F.lit(1).alias("n"), F.lit(False).alias("_own"))
    own = mine.withColumn("_own", F.lit(True)).unionByName(theirs).withColumn("own", within("vendor", "node")).where("_own")
    found = own.join(every, ["node", "day"]).select("line", (F.col("every") - F.col("own")).alias("similar"))
    return found.unionByName(rows.where(~known).select("line", F.lit(0).cast("bigint").alias("similar"))).withColumnRenamed("line", line)
