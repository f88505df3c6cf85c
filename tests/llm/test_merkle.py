import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, i int, n string, h string, path int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:5]))


def tree(hashes, fanout):
    """(root, the siblings of each leaf, (left, right) a level)."""
    paths, own = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for x, at in enumerate(own):
            a = at - at % fanout
            paths[x].append(("".join(hashes[a:at]), "".join(hashes[at + 1 : a + fanout])))
        hashes = [H(*hashes[a : a + fanout]) for a in range(0, len(hashes), fanout)]
        own = [at // fanout for at in own]
    return hashes[0], paths


def brute(rows, fanout=8):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[g] = tree([leaf(r) for r in groups[g]], fanout)
    root, above = tree([made[g][0] for g in order], fanout)
    for g, top in zip(order, above):
        subroot, paths = made[g]
        for r, path in zip(groups[g], paths):
            path = path + top
            now = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                now[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            folded = leaf(now)
            for left, right in path:
                folded = H(left, folded, right)
            yield r[0], leaf(r), subroot, root, H(*(x for s in path for x in s)), folded, folded == root


def corpus(rng, n, langs):
    rows = [(k, rng.choice(["a", None, ""]), rng.choice(langs), rng.choice([None, 5]), rng.choice(["", None, "Ábc Déf", "x y"])) for k in range(n)]
    return rows + [rows[0]] * 3 + [(None, None, None, None, None)] * 2 + [(2, "s", rows[2][2], 1, "other"), (n, "s", "only", 3, "A" * 300_000)]


def held(spark, rows, **parameters):
    docs = spark.createDataFrame([(*r, "k", 1, "n", "h", 2) for r in rows], SCHEMA)
    return Counter(tuple(r)[:7] for r in merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.lower_ascii(F.col("text")), **parameters).drop("proof").collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = corpus(rng, 600, ["en"] * 12 + [None, "de", "é", "", "zz"])
    assert held(spark, rows) == Counter(brute(rows))


def test_many_groups_and_other_fanouts(spark):
    rng = random.Random(6)
    rows = corpus(rng, 150, [f"l{k}" for k in range(90)])  # the tree of the groups has levels of its own
    assert held(spark, rows) == Counter(brute(rows))
    assert held(spark, rows, fanout=3) == Counter(brute(rows, 3))


def test_one_row_and_none(spark):
    row = (1, None, None, None, None)
    only = merkle.audit(spark.createDataFrame([row], "doc_id long, source string, lang string, n_chars long, text string")).first()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.proof_sha256 == H("")
    assert merkle.audit(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


def test_one_group_is_numbered_in_pieces(spark):
    rows = spark.range(5000).select(F.lit("1en").alias("key"), F.lit(7).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    out = merkle.number(rows, ["id", "h"])
    got = [r.i for r in out.orderBy("h").collect()]
    assert got == list(range(5000)) and {r.n for r in out.select("n").distinct().collect()} == {5000}
