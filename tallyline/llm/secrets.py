"""Secrets: known patterns, and candidate strings of high sliding-window entropy less an allow-list.

Everything is DataFrame functions. Kinds, in their fixed order: assign, access, hex (the base
patterns) and entropy, which the method adds. A candidate is a run of at least MIN_LEN characters of
the token alphabet; it is judged in the class of its characters (hexadecimal, letters and digits,
full token alphabet), each with its own threshold. A window of WINDOW characters slides over it: the count of
every character and the sum of c * log2(c) over the counts are carried from window to window and
changed only for the character that leaves and the one that enters. The largest entropy decides; a part between
slashes that is long enough is judged in its own class too. An entropy span that meets a base span, or that the allow-list knows, is left out.

Offsets are code points, ends exclusive. Null texts count as empty and have no spans; repeated rows
each get theirs; ids may be null; an empty table gives no rows; other columns of the table are not looked at, whatever
their names. Spans that start together come in the order of kinds, one kind's spans never overlap. Work and memory grow in proportion to
a text's length, also if it is one candidate or nothing but matches: see scan(), and the patterns, none of which backtracks into a repeated group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

MIN_LEN, WINDOW = 20, 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits a character in the richest window from which a candidate of a class counts as a secret.
THRESHOLD = {"hex": 3.0, "alnum": 3.6, "token": 3.7}
#: Parts of a path that read as words: one case or capitalised words, at most four digits after them.
_PART = r"(?:[A-Z]++(?![a-z])|[a-z]*+(?:[A-Z][a-z]++)*+)[0-9]{0,4}+(?![A-Za-z0-9])"
_STAND_IN = r"(?:your|my|this|is|not|real|an|example|sample|dummy|placeholder|changeme|test|secret|token|api|key|password|value|x++|0++|123456789?0?)"
#: Candidates that are known to be harmless, each as a whole: words and identifiers without digits or without
#: letters, UUIDs, dates, stand-ins, paths of words and repeated groups; and rulers of equals signs. Groups repeat possessively:
#: Java's matcher would otherwise recurse once a repetition.
ALLOW = (
    r"^[^0-9]++$",
    r"^[^A-Za-z]++$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    rf"(?i)^{_STAND_IN}(?:[-_/+=]?{_STAND_IN})*+$",
    rf"^(?=[^/]*/){_PART}(?:[-_/]{_PART})*+$",
    r"^(.{1,8})\1++$",
    r"=={2,}",
)
#: Elements that scan() takes together.
_BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, zero: Column, join) -> Column:
    """join of all elements up to each element of an array.

    An array grown element by element is copied at each step, so blocks of elements are scanned first, then the blocks' totals.
    """
    none = F.slice(F.array(zero), 1, 0)

    def along(acc, x):
        total = join(acc["total"], x)
        return F.struct(total.alias("total"), F.concat(acc["all"], F.array(total)).alias("all"))

    def whole(array):
        return F.aggregate(array, F.struct(zero.alias("total"), none.alias("all")), along)

    def blocks(array):
        starts = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: whole(F.slice(array, i, _BLOCK)))

    def joined(parts):
        before = whole(F.transform(parts, lambda p: p["total"]))["all"]
        before = F.concat(F.array(zero), before)
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.transform(p["all"], lambda x: join(b, x))))

    return let(values, lambda v: F.when(F.size(v) <= _BLOCK, whole(v)["all"]).otherwise(let(blocks(v), joined)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of all leftmost matches: lengths of what stands between them add up."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct((F.length(gap) + F.length(hit)).alias("step"), hit.alias("hit")))

    def placed(pairs):
        ends = scan(F.transform(pairs, lambda p: p["step"]), F.lit(0), lambda a, b: a + b)
        return F.zip_with(pairs, ends, lambda p, end: F.struct((end - F.length(p["hit"])).alias("start"), end.alias("end"), p["hit"].alias("text")))

    return let(pairs, placed)


def apart(spans: Column, others: Column) -> Column:
    """Of spans (which don't overlap each other) those that meet none of others, in their order.

    Ends of spans and starts of others are sorted together; a span is met if the furthest end so far of others is beyond its start.
    """
    first = F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("other"), o["end"].alias("far"), F.lit("").alias("text")))
    second = F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("other"), s["start"].alias("far"), s["text"].alias("text")))

    def swept(items):
        far = scan(F.transform(items, lambda x: F.when(x["other"] == 1, x["far"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        kept = F.filter(F.zip_with(items, far, lambda x, f: F.struct(x.alias("x"), f.alias("f"))), lambda p: (p["x"]["other"] == 0) & (p["f"] <= p["x"]["far"]))
        return F.transform(kept, lambda p: F.struct(p["x"]["far"].alias("start"), p["x"]["at"].alias("end"), p["x"]["text"].alias("text")))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(F.array_sort(F.concat(first, second)), swept))


def _of_kind(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _clog(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


#: The token alphabet, in the order in which characters are counted.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def max_entropy(word: Column) -> Column:
    """Bits a character of the richest window of WINDOW characters in word (at least that long, of the token alphabet)."""
    none = F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda i: F.lit(0))

    def changed(counts, code, by):
        return F.transform(counts, lambda n, i: n + F.when(i + 1 == code, by).otherwise(0))

    def enter(acc, code):
        n = F.element_at(acc["counts"], code)
        return F.struct((acc["sum"] - _clog(n) + _clog(n + 1)).alias("sum"), changed(acc["counts"], code, 1).alias("counts"))

    def step(acc, pair):
        out, into = pair["leaves"], pair["enters"]
        n, m = F.element_at(acc["counts"], out), F.element_at(acc["counts"], into)
        total = acc["sum"] - _clog(n) + _clog(n - 1) - _clog(m) + _clog(m + 1)
        counts = F.transform(acc["counts"], lambda c, i: c - (i + 1 == out).cast("int") + (i + 1 == into).cast("int"))
        moved = F.struct(total.alias("sum"), F.least(acc["least"], total).alias("least"), counts.alias("counts"))
        return F.when(out == into, acc).otherwise(moved)

    def slide(codes):
        first = F.aggregate(F.slice(codes, 1, WINDOW), F.struct(F.lit(0.0).alias("sum"), none.alias("counts")), enter)
        more = F.size(codes) - WINDOW
        pairs = F.zip_with(F.slice(codes, F.lit(1), more), F.slice(codes, F.lit(WINDOW + 1), more), lambda a, b: F.struct(a.alias("leaves"), b.alias("enters")))
        start = let(first, lambda f: F.struct(f["sum"].alias("sum"), f["sum"].alias("least"), f["counts"].alias("counts")))
        return F.aggregate(pairs, start, step, lambda acc: F.log2(F.lit(float(WINDOW))) - acc["least"] / WINDOW)

    return let(F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c)), slide)


def threshold(word: Column) -> Column:
    return F.when(word.rlike("^[0-9a-fA-F]+$"), THRESHOLD["hex"]).when(word.rlike("^[A-Za-z0-9]+$"), THRESHOLD["alnum"]).otherwise(THRESHOLD["token"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans array<struct<kind, start, end>> of every whole text, by start, then kind. No shuffle, no Python.

    Texts in which a pattern has no match skip the work of that pattern.
    """
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def hits(pattern):
        return F.when(F.col("text").rlike(pattern), matches(F.col("text"), pattern)).otherwise(none)

    value = F.regexp_extract
    rows = rows.select(
        "id",
        F.filter(hits(ASSIGN), lambda m: F.length(value(m["text"], ASSIGN, 2)) >= 6).alias("assign"),
        hits(ACCESS).alias("access"),
        hits(HEX).alias("hex"),
        hits(CANDIDATE).alias("candidates"),
    )
    base = F.concat(*(_of_kind(k, F.col(k)) for k in KINDS[:3]))
    rows = rows.select("id", base.alias("base"), "candidates")

    def known(word):
        harmless = F.lit(False)
        for pattern in ALLOW:
            harmless = harmless | word.rlike(pattern)
        return harmless

    def rich(word):
        return F.when(~known(word), max_entropy(word) >= threshold(word)).otherwise(F.lit(False))

    def any_rich(word):
        parts = F.filter(F.split(word, "/"), lambda part: F.length(part) >= MIN_LEN)
        return rich(word) | F.when(word.contains("/"), F.exists(parts, rich)).otherwise(F.lit(False))

    rank = F.array(*map(F.lit, KINDS))

    def keyed(spans):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    spans = F.concat("base", _of_kind("entropy", F.filter(apart(F.col("candidates"), F.col("base")), lambda m: any_rich(m["text"]))))
    ordered = F.transform(F.array_sort(keyed(spans)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(F.col("id").alias(id_col), ordered.alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(id_col, *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same result in DuckDB, whose patterns need no possessive quantifiers; entropies are counted anew for each window."""
    part = "(?:[A-Z]+|[a-z]*(?:[A-Z][a-z]+)*)[0-9]{0,4}"
    stand_in = _STAND_IN.replace("++", "+")
    found = ", ".join(
        f"""{kind} AS (SELECT rid, '{kind}' AS kind, {rank} AS rank, hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i))::BIGINT AS fin FROM (
        SELECT rid, unnest(regexp_extract_all(t, $p${pattern}$p$)) AS hit, unnest(string_split_regex(t, $p${pattern}$p$)[1:len(regexp_extract_all(t, $p${pattern}$p$))]) AS gap, unnest(range(len(regexp_extract_all(t, $p${pattern}$p$)))) AS i FROM d))"""
        for rank, (kind, pattern) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE)))
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), {found},
    base AS (SELECT rid, kind, rank, fin - length(hit) AS start, fin FROM (
      SELECT * FROM assign WHERE length(regexp_extract(hit, $p${ASSIGN}$p$, 2)) >= 6 UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex)),
    parts AS (SELECT DISTINCT hit, unnest(string_split(hit, '/')) AS part FROM entropy WHERE contains(hit, '/')),
    words AS (SELECT hit AS w FROM entropy UNION SELECT part FROM parts),
    unknown AS (SELECT w FROM words WHERE length(w) >= {MIN_LEN} AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') AND NOT regexp_full_match(w, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')
      AND NOT regexp_full_match(w, '(?i){stand_in}(?:[-_/+=]?{stand_in})*') AND NOT (contains(w, '/') AND regexp_full_match(w, '{part}(?:[-_/]{part})*')) AND NOT contains(w, '===')
      AND len(list_filter(range(1, 9), lambda k: length(w) % k = 0 AND length(w) > k AND w = repeat(left(w, k), length(w) // k))) = 0),
    rich AS (SELECT w FROM unknown WHERE log2({WINDOW}) - list_min(list_transform(range(1, length(w) - {WINDOW - 2}), lambda i: list_sum(list_transform(list_distinct(string_split(substr(w, i, {WINDOW}), '')),
      lambda c: ({WINDOW} - length(replace(substr(w, i, {WINDOW}), c, ''))) * log2({WINDOW} - length(replace(substr(w, i, {WINDOW}), c, ''))))))) / {WINDOW}
      >= CASE WHEN regexp_full_match(w, '[0-9a-fA-F]+') THEN {THRESHOLD["hex"]} WHEN regexp_full_match(w, '[A-Za-z0-9]+') THEN {THRESHOLD["alnum"]} ELSE {THRESHOLD["token"]} END),
    apart AS (SELECT rid, kind, rank, fin - length(hit) AS start, fin, hit FROM entropy e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = e.rid AND b.start < e.fin AND e.fin - length(e.hit) < b.fin)),
    spans AS (SELECT * FROM base UNION ALL SELECT rid, kind, rank, start, fin FROM apart WHERE hit IN (SELECT w FROM rich) OR hit IN (SELECT hit FROM parts WHERE part IN (SELECT w FROM rich))),
    s AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS[:3])},
      coalesce(string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) FILTER (WHERE kind <> 'entropy'), '') AS base, string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY rid)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (rid)
    """


DIGEST_SQL = _sql()
