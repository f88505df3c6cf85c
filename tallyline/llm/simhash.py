"""SimHash near-duplicates by multi-index hashing.

A fingerprint has bit i set if over half of a text's shingle hashes have it. It is cut into segments, each of which is an
index: a fingerprint stands in the table of its segments' values and asks for the values in a small Hamming ball around
them; what the tables return is verified over all bits. Two forms:

near_duplicates(): 64 bits of 3-word shingles, repeats included, linked within RADIUS = 3 bits. Such pairs differ in at most one bit of their
upper or of their lower half, so two segments and balls of radius one find them all. (Each pair of keys one bit
apart is asked for once, from the key that has the bit clear.) Among the rows of a key only links that join two
groups not yet joined are returned, so a large group of near copies gives few links, and
none that connects is lost. A key with very many fingerprints is dealt to several blocks, and those who
ask for it go to each; its cost is the square of its distinct fingerprints.

similar(): texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8. At 0.8 the bits of two sets
differ with probability 0.151, so 3 of 64 bits would miss most. The fingerprint has two words that every index row carries, and segments with balls
of radius one; how many and how wide follows from the number of texts (shape()): wide enough that a random pair seldom meets, so many that 0.994 of the pairs at
exactly 0.8 share a segment's ball. Up to 2^19 texts these are 16 segments of 16 bits; for each 4 bits more a
segment has, 16 times as many texts keep the number of random meetings per text about the same. What meets is verified in steps: sizes and carried
bits, all bits, then the whole shingle sets.

Near copies meet often, so they are joined first: in each segment's exact buckets every text is linked with the nearest found there, and the verified links
make groups. A group whose nearest found stand in a large group is compared with all of that one and with all others that stand so (its crowd), in
blocks of sets, of which only links return that join two groups: near copies that are not quite similar cost no row a pair. After that only members of
different groups and crowds are compared, and two large ones' members only where a bucket has both. Sets are verified in cells: pairs are dealt by the hashes of both ends to a square grid, sized by the sets' bytes, and a
set goes once to each cell that needs it, not to each pair.

Equal fingerprints (or sets) are one node from the start. Links become classes by distributed connected components.

Null texts have no words; texts without words have the fingerprint zero and are linked like any
other (in similar(): are one class). Repeated rows count like copies. Null ids are kept and take the class of their fingerprint. Of a class's rows
that are equal in id and text, representatives() keeps the least of the whole rows. Empty tables give no rows. Columns beside id and text
don't matter, whatever their names. Very long texts are hashed whole, their shingles in pieces.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import by_bytes, connected_components, keep_one, materialise, row_keys

RADIUS = 3
#: Table rows of a key that are held at once; a key with more is dealt to blocks.
BLOCK = 8192
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _shingle_hashes(text: str | None, words: int, seed: int = 42):
    """Arrays of the hashes of a whole text's shingles, in its order."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: max(1, len(parts) - words + 1)].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), 65536):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + 65536], ends[i : i + 65536])], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a whole text."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(text, words, seed):
        ones += _ones(hashes)
        n += len(hashes)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles."""
    parts = list(_shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


#: How often a bit differs between sets with a similarity of 0.8, and how many such pairs are to share a segment's ball.
FLIP, RECALL = 0.1515, 0.994
#: Words of 64 bits that each index row carries; those of the segments follow.
CHECK = 2
#: Bytes of shingle sets that a verifying task holds for a cell, pairs verified at once, members from which a group counts as large, and rows compared at once.
CELL_BYTES, PAIRS, LARGE, CHUNK = 1 << 26, 1 << 17, 64, 1024
#: Sets on a side of a crowd's cell, and their bytes.
SIDE, SIDE_BYTES = 512, 1 << 24


class Shape(NamedTuple):
    bits: int
    segments: int

    @property
    def words(self) -> int:
        return CHECK + -(-self.segments // (64 // self.bits))


def shape(texts: int) -> Shape:
    """Bits of a segment and how many segments, for so many texts."""
    bits = next(b for b in (16, 20, 24, 28, 32) if texts <= 1 << (b + 3) or b == 32)
    shared = (1 - FLIP) ** bits + bits * FLIP * (1 - FLIP) ** (bits - 1)
    return Shape(bits, math.ceil(math.log(1 - RECALL) / math.log(1 - shared)))


def allowed(bits: int) -> int:
    """Bits of so many in which two similar texts may differ: 3.2 standard deviations over the mean at a similarity of 0.8."""
    return int(FLIP * bits + 3.2 * math.sqrt(bits * FLIP * (1 - FLIP)))


def _seeds(words: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, (words, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(found: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """As many words of fingerprint of a set of shingle hashes as seeds has rows; each word's hashes are mixed anew."""
    ones = np.zeros(64 * len(seeds), np.int64)
    for i in range(0, len(found), 8192):
        mixed = found[i : i + 8192, None] * seeds[:, 0]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * seeds[:, 1]
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. No shuffle."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "id bigint, fp bigint")


def _links(batches, radius: int = RADIUS, held: int = BLOCK):
    """Spanning links within each (key, block), from rows sorted by key, block and ask (table rows first)."""
    group, table, labels = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def work(asks: np.ndarray, own: bool):
        """Links of asks to table; own: they are the table's own rows. Keeps labels up to date."""
        nonlocal labels
        found: list = []
        n = len(table)
        all_fps = table if own else np.concatenate([table, asks])
        mark = labels if own else np.concatenate([labels, np.arange(n, len(all_fps)) + (1 << 40)])
        for i in range(n):
            near = np.bitwise_count(all_fps ^ table[i]) <= radius
            if np.count_nonzero(near) > 1:
                other, first = np.unique(mark[near], return_index=True)
                if len(other) > 1:
                    at = np.flatnonzero(near)[first]
                    found += [(table[i], all_fps[j]) for j, label in zip(at.tolist(), other.tolist()) if label != mark[i]]
                    mark[np.isin(mark, other)] = other[0]
        labels = mark[:n]
        return found

    def flush(found):
        a = np.array([x[0] for x in found], np.uint64).view(np.int64)
        b = np.array([x[1] for x in found], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    fresh = False  # the held table's own links are still to be made
    for batch in batches:
        key, block, ask = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fps = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(key):
            continue
        edge = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (ask[1:] != ask[:-1])) + 1
        starts = np.concatenate([[0], edge])
        ends = np.append(edge, len(key))
        found: list = []
        for a, b, k, s, asks in zip(starts.tolist(), ends.tolist(), key[starts].tolist(), block[starts].tolist(), ask[starts].tolist(), strict=True):
            if (k, s) != group:
                if fresh and len(table) > 1:
                    found += work(table, own=True)
                group, table, fresh = (k, s), np.zeros(0, np.uint64), False
                labels = np.zeros(0, np.int64)
            if not asks:
                table = np.concatenate([table, fps[a:b]])
                labels, fresh = np.arange(len(table)), True
            elif len(table):
                if fresh and len(table) > 1:
                    found += work(table, own=True)
                fresh = False
                for i in range(a, b, held):
                    found += work(fps[i : min(i + held, b)], own=False)
        if found:
            yield flush(found)
    if fresh and len(table) > 1 and (found := work(table, own=True)):
        yield flush(found)


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct fingerprints nodes(fp) that keep everything within RADIUS connected."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = nodes.select("fp", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("key"))
    bits = F.array(*(F.lit(1 << i) for i in range(32)))
    asks = halves.select(
        "fp", F.explode(F.filter(F.transform(bits, lambda b: F.when(F.col("key").bitwiseAND(b) == 0, F.col("key").bitwiseOR(b))), lambda k: k.isNotNull())).alias("key")
    )
    # each half counts its own table; keys over one block are few: at most 2 / block of the fingerprints
    heavy = halves.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    heavy = materialise(heavy.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "heavy")
    if heavy.isEmpty():
        dealt = halves.select("key", F.lit(0).alias("block"), F.lit(0).alias("ask"), "fp").unionByName(
            asks.select("key", F.lit(0).alias("block"), F.lit(1).alias("ask"), "fp")
        )
    else:
        def into(rows):
            return rows.join(heavy, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))

        own = into(halves).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        again = into(halves).where("blocks > 1")
        again = again.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("block", every).where("block <> mine")
        dealt = (
            own.select("key", "block", F.lit(0).alias("ask"), "fp")
            .unionByName(again.select("key", "block", F.lit(1).alias("ask"), "fp"))
            .unionByName(into(asks).withColumn("block", every).select("key", "block", F.lit(1).alias("ask"), "fp"))
        )
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "block").sortWithinPartitions("key", "block", "ask").mapInArrow(_links, "a bigint, b bigint")


def classes(marks: DataFrame) -> DataFrame:
    """(id, fp, component_id) from fingerprints (id, fp): component_id is the smallest id that fp's links reach."""
    marks = materialise(marks, "marks")
    nodes = materialise(marks.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(links(nodes))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = materialise(named.join(least, "root").select("fp", "component_id"), "classes")
    return marks.join(final, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id of every document."""
    out = classes(fingerprints(docs, id_col, text_col))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marks(docs: DataFrame, words: int, seeds: np.ndarray) -> DataFrame:
    """(id, h, k, node, n, fp) of every row: node is its shingle set's hash, n its size, fp the set's wide fingerprint, null without words. No shuffle."""

    def run(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in by_bytes(texts, 1 << 22):
                sets = [shingle_set(x, words) for x in texts[a:b]]
                node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                fps = [wide_fingerprint(x, seeds).view(np.int64) if len(x) else None for x in sets]
                rows = [batch.column(i).slice(a, b - a) for i in range(3)]
                made = [pa.array(node), pa.array([len(x) for x in sets], pa.int32()), pa.array(fps, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*rows, *made], names=["id", "h", "k", "node", "n", "fp"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("id"), *row_keys(docs["text"]), docs["text"].alias("text"))
    return rows.mapInArrow(run, "id bigint, h bigint, k bigint, node bigint, n int, fp array<bigint>")


def _sets(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the shingle sets, as bytes, of rows(node, h, k), from the texts that h and k name."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in by_bytes(texts, 1 << 22):
                sets = [shingle_set(x, words).tobytes() for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["node", "hashes"])

    texts = docs.select(*row_keys(docs["text"]), docs["text"].alias("text")).join(rows, ["h", "k"]).select("node", "text")
    # copies of a text give the same set
    return texts.mapInArrow(run, "node bigint, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _keys(form: Shape) -> list[Column]:
    """Each segment's value beside its number."""
    per_word, low = 64 // form.bits, (1 << form.bits) - 1
    return [
        F.shiftrightunsigned(f"c{CHECK + i // per_word}", form.bits * (i % per_word)).bitwiseAND(F.lit(low)).bitwiseOR(F.lit(i << form.bits)) for i in range(form.segments)
    ]


def _nearest(batches):
    """(a, b): for each row of (key, node, n, c0, c1), sorted by key, the nearest other row of its key (or of a chunk of it) that can be similar."""
    held = None

    def compare(node, size, c0, c1, starts, counts):
        """Rows of small buckets, with all rows of their bucket."""
        per_row = np.repeat(counts, counts)
        i = np.repeat(np.arange(len(node)), per_row)
        first = np.repeat(np.repeat(starts, counts), per_row)
        j = first + np.arange(len(i)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        d = (np.bitwise_count(c0[i] ^ c0[j]) + np.bitwise_count(c1[i] ^ c1[j])).astype(np.int64)
        d[(i == j) | (5 * np.minimum(size[i], size[j]) < 4 * np.maximum(size[i], size[j])) | (d > allowed(64 * CHECK))] = 1 << 20
        best = np.minimum.reduceat((d << 40) | j, np.cumsum(per_row) - per_row)
        ok = np.flatnonzero(best >> 40 < 1 << 20)
        return node[ok], node[best[ok] & ((1 << 40) - 1)]

    def work(cols):
        key, node, size, c0, c1 = cols
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.diff(np.append(starts, len(key)))
        out = []
        for a, n in zip(starts[counts > LARGE].tolist(), counts[counts > LARGE].tolist()):  # a chunk at a time
            for at in range(a, a + n, CHUNK):
                part = slice(at, min(at + CHUNK, a + n))
                out.append(compare(node[part], size[part], c0[part], c1[part], np.array([0]), np.array([part.stop - at])))
        small = np.flatnonzero(np.repeat((counts > 1) & (counts <= LARGE), counts))
        own = counts[(counts > 1) & (counts <= LARGE)]
        if len(small):
            out.append(compare(node[small], size[small], c0[small], c1[small], np.cumsum(own) - own, own))
        return [np.concatenate(x) for x in zip(*out)] if out else None

    def flush(cols):
        for at in range(0, len(cols[0]), 1 << 16):
            if found := work([c[at : at + (1 << 16)] for c in cols]):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], names=["a", "b"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [c.view(np.uint64) if i > 2 else c.astype(np.int64) for i, c in enumerate(cols)]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        whole = int(np.flatnonzero(cols[0] == cols[0][-1])[0])  # the last key's rows may go on
        whole = whole if len(cols[0]) - whole < CHUNK else len(cols[0])
        held = [c[whole:] for c in cols]
        if whole:
            yield from flush([c[:whole] for c in cols])
    if held is not None and len(held[0]):
        yield from flush(held)


def _closest(nodes: DataFrame, form: Shape) -> DataFrame:
    """(a, b): for each segment, each of nodes beside the nearest found of those with its value that can be similar. Dealt by ranges, so a common value is many tasks' work."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select(F.explode(F.array(*_keys(form))).alias("key"), "node", "n", *(f"c{i}" for i in range(CHECK)))
    rows = rows.repartitionByRange(n, "key", "node").sortWithinPartitions("key", "node")
    found = rows.mapInArrow(_nearest, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _distance(a: str, b: str, places) -> Column:
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in places), F.lit(0))


def _same_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _met(nodes: DataFrame, form: Shape, percent: int) -> DataFrame:
    """(a, b): pairs of nodes(node, group, n, c0, ...) of different groups (here a crowd is one) that meet in a segment's ball and agree in size and the carried bits.

    A node stands in a table for each segment and asks for its own value and for those with one more bit set. Members of one large group never meet.
    """
    carried = ["n", *(f"c{i}" for i in range(CHECK))]
    large = materialise(nodes.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > LARGE).select("group", F.lit(True).alias("large")), "large")
    any_large = not large.isEmpty()
    marked = nodes.join(large, "group", "left") if any_large else nodes.withColumn("large", F.lit(None).cast("boolean"))
    marked = marked.withColumn("large", F.coalesce("large", F.lit(False)))
    table = marked.select("node", "group", "large", *carried, F.explode(F.array(*_keys(form))).alias("key"))
    # large stands in the ball's structs, so that the asks of all texts are one generator's whichever are used
    ball = F.array(*(F.struct(F.lit(b).cast("bigint").alias("bit"), F.col("large").alias("large")) for b in (0, *(1 << i for i in range(form.bits)))))
    asks = table.select("node", "group", *carried, "key", F.explode(ball).alias("x")).select("node", "group", *carried, "key", "x.bit", "x.large")
    asks = asks.where("key & bit = 0").withColumn("key", F.col("key").bitwiseOR(F.col("bit")))
    left = table.select("key", "large", *(F.col(c).alias(f"a_{c}") for c in ("node", "group", *carried)))
    right = asks.select("key", "bit", "large", *(F.col(c).alias(f"b_{c}") for c in ("node", "group", *carried)))
    near = (F.col("bit") != 0) | (F.col("a_node") < F.col("b_node"))
    near = near & (F.col("a_group") != F.col("b_group")) & _same_size(F.col("a_n"), F.col("b_n"), percent) & (_distance("a_c", "b_c", range(CHECK)) <= allowed(64 * CHECK))

    def meet(one: DataFrame, other: DataFrame, *more: Column) -> DataFrame:
        # both sides grow with the texts: they are shuffled at every size
        on = [one["key"] == other["key"], near, *more]
        joined = one.hint("merge").join(other, functools.reduce(lambda x, y: x & y, on))
        return joined.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))

    if not any_large:
        return meet(left, right)
    few, many = right.where("NOT large"), right.where("large")
    found = meet(left, few).unionByName(meet(left.where("NOT large"), many))
    one, other = left.where("large"), many
    groups = one.select("key", "a_group").distinct().join(other.select("key", "b_group").distinct(), "key").where("a_group <> b_group")
    one = one.join(groups, ["key", "a_group"]).withColumnRenamed("b_group", "with")
    return found.unionByName(meet(one, other, F.col("with") == F.col("b_group")))


def _shared(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of one shares with each of other."""
    out = np.zeros((len(one), len(other)), np.float32)
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x), dtype=np.int32), [len(y) for y in x])) for x in (one, other)]
    both = np.intersect1d(*(hashes for hashes, _ in sides))
    if not len(both):
        return out.astype(np.int64)
    placed = []
    for hashes, row in sides:
        at = np.minimum(np.searchsorted(both, hashes), len(both) - 1)
        stands = both[at] == hashes
        at, row = at[stands], row[stands]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], row[order]))
    for first in range(0, len(both), CHUNK):  # so many hashes at a time
        marks = []
        for (at, row), n in zip(placed, out.shape):
            lo, hi = np.searchsorted(at, (first, first + CHUNK))
            has = np.zeros((n, CHUNK), np.float32)
            has[row[lo:hi], at[lo:hi] - first] = 1
            marks.append(has)
        out += marks[0] @ marks[1].T
    return out.astype(np.int64)


def _overlaps(sets: dict, a: list, b: list) -> np.ndarray:
    """How many hashes each pair of sets (a[i], b[i]) shares."""
    if len(a) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    # a crowded cell: counts of all its pairs at once
    at = {x: i for i, x in enumerate(sets)}
    (one, i), (other, j) = (np.unique([at[x] for x in side], return_inverse=True) for side in (a, b))
    every = list(sets.values())
    return _shared([every[x] for x in one], [every[x] for x in other])[i, j]


def _agree(batches, percent: int = 80):
    """The pairs (a, b) whose sets are similar, from rows (x, y, a, b, hashes) sorted by cell (x, y), sets (b null) first."""
    cell, sets, a, b = None, {}, [], []

    def made():
        shared = _overlaps(sets, a, b)
        total = np.array([len(sets[x]) + len(sets[y]) for x, y in zip(a, b)])
        ok = np.flatnonzero(100 * shared >= percent * (total - shared)).tolist()
        return pa.RecordBatch.from_arrays([pa.array([side[i] for i in ok], pa.int64()) for side in (a, b)], names=["a", "b"])

    for batch in batches:
        for x, y, one, other, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            if (x, y) != cell:
                if a:
                    yield made()
                cell, sets, a, b = (x, y), {}, [], []
            if other is None:
                sets[one] = np.frombuffer(hashes, np.uint64)
            else:
                a.append(one)
                b.append(other)
                if len(a) == PAIRS:
                    yield made()
                    a, b = [], []
    if a:
        yield made()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, form: Shape) -> DataFrame:
    """The distinct pairs (a, b) that agree in size and all bits and whose sets have a Jaccard similarity of at least percent / 100. Written."""
    both = pairs.distinct()
    for x in "ab":
        both = both.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), *(F.col(f"c{i}").alias(f"{x}_c{i}") for i in range(form.words))), x)
    near = _same_size(F.col("a_n"), F.col("b_n"), percent) & (_distance("a_c", "b_c", range(form.words)) <= allowed(64 * form.words))
    near = materialise(both.where(near).select("a", "b", (8 * (F.col("a_n") + F.col("b_n")).cast("bigint")).alias("bytes")), "near")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = near.agg(F.sum("bytes")).first()[0] or 0
    side = math.ceil(math.sqrt(max(4 * n, total / CELL_BYTES)))
    dealt = near.select(F.pmod(F.xxhash64("a"), F.lit(side)).alias("x"), F.pmod(F.xxhash64("b"), F.lit(side)).alias("y"), "a", "b")
    ends = dealt.select("x", "y", F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = nodes.join(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "h", "k")
    sets = materialise(_sets(docs, texts, words), "sets")
    given = ends.join(sets, "node").select("x", "y", F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "hashes")
    rows = given.unionByName(dealt.withColumn("hashes", F.lit(None).cast("binary"))).repartition(n, "x", "y").sortWithinPartitions("x", "y", "b")
    return materialise(rows.mapInArrow(functools.partial(_agree, percent=percent), "a bigint, b bigint"), "links")


def _joining(batches, percent: int = 80):
    """Links (a, b) of similar sets, from rows (crowd, x, y, side, node, group, hashes) sorted by cell (crowd, x, y): of each cell's sides those that join groups not yet joined."""
    cell, sides = None, ([], [])

    def made():
        (nodes, groups, sets), (others, other_groups, other_sets) = (list(zip(*rows)) for rows in sides)
        shared = _shared(sets, other_sets)
        sizes, other_sizes = (np.array([len(x) for x in y]) for y in (sets, other_sets))
        alike = 100 * shared >= percent * (sizes[:, None] + other_sizes - shared)
        mark = np.unique(np.array(groups + other_groups), return_inverse=True)[1]
        own, mark = mark[: len(nodes)].copy(), mark[len(nodes) :].copy()
        a, b = [], []
        for i, near in enumerate(alike):
            labels, first = np.unique(mark[near], return_index=True)
            at = np.flatnonzero(near)[first]
            new = labels != own[i]
            if new.any():
                a += [nodes[i]] * int(new.sum())
                b += [others[j] for j in at[new].tolist()]
                joined = np.append(labels[new], own[i])
                for x in (own, mark):
                    x[np.isin(x, joined)] = joined[-1]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        for crowd, x, y, side, node, group, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            if (crowd, x, y) != cell:
                if all(sides):
                    yield made()
                cell, sides = (crowd, x, y), ([], [])
            sides[side].append((node, group, np.frombuffer(hashes, np.uint64)))
    if all(sides):
        yield made()


def _crowds(nodes: DataFrame, closest: DataFrame) -> DataFrame:
    """(group, crowd) of the groups of nodes(node, group, ...) that have a crowd: a large group its own, another that of the large one in which most of the nearest found of its members stand.

    closest(a, b): the nearest found, whether similar or not.
    """
    large = materialise(nodes.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > LARGE).select("group"), "large")
    if large.isEmpty():
        return large.withColumn("crowd", F.col("group"))
    members = nodes.join(large, "group", "left_semi").select(F.col("node").alias("member"), F.col("group").alias("crowd"))
    both = closest.select(F.col("a").alias("member"), F.col("b").alias("node")).unionByName(closest.select(F.col("b").alias("member"), F.col("a").alias("node")))
    beside = both.join(members, "member").groupBy("node", "crowd").agg(F.count(F.lit(1)).alias("times"))
    beside = beside.join(nodes.select("node", "group"), "node").join(large, "group", "left_anti").groupBy("group", "crowd").agg(F.sum("times").alias("times"))
    beside = beside.groupBy("group").agg(F.max_by("crowd", F.struct("times", "crowd")).alias("crowd"))
    return materialise(beside.unionByName(large.withColumn("crowd", F.col("group"))), "crowds")


def _within(nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) that join the groups of each crowd of nodes(node, group, crowd, ...) wherever two of its sets are similar. Written.

    Each set of a group that isn't the large one itself stands against all sets of the crowd, in cells of two blocks of sets.
    """
    beside = F.col("group") != F.col("crowd")
    sums = [F.ceil(F.greatest(F.count(x) / SIDE, F.sum(8 * x.cast("bigint")) / SIDE_BYTES)).cast("int") for x in (F.when(beside, F.col("n")), F.col("n"))]
    sides = nodes.groupBy("crowd").agg(sums[0].alias("across"), sums[1].alias("down"), F.count(F.when(beside, True)).alias("beside")).where("beside > 0").select("crowd", "across", "down")
    sides = materialise(sides, "sides")
    if sides.isEmpty():
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    nodes = materialise(nodes.join(sides, "crowd").select("node", "h", "k", "group", "crowd", "across", "down"), "crowded")
    sets = nodes.select("node", "group", "crowd", "across", "down").join(_sets(docs, nodes.select("node", "h", "k"), words), "node")
    sets = materialise(sets, "sets")
    own = ["node", "group", "hashes"]
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    of = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
    one = sets.where(beside).select("crowd", of("across").alias("x"), every("down").alias("y"), F.lit(0).alias("side"), *own)
    other = sets.select("crowd", every("across").alias("x"), of("down").alias("y"), F.lit(1).alias("side"), *own)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = one.unionByName(other).repartition(n, "crowd", "x", "y").sortWithinPartitions("crowd", "x", "y", "side")
    return materialise(rows.mapInArrow(functools.partial(_joining, percent=percent), "a bigint, b bigint"), "links")


def similar(docs: DataFrame, words: int = 5, percent: int = 80, form: Shape | None = None) -> DataFrame:
    """(id, h, k, root) of every row of docs(doc_id, text): root is the smallest node that the row's links reach.

    Links join shingle sets whose Jaccard similarity is at least percent / 100. First every node is linked with the nearest found for each segment; then
    all sets of each crowd are compared, and all other pairs between the groups so made that meet are verified, so no link between candidates is missed.
    """
    form = form or shape(docs.count())
    found = materialise(_marks(docs, words, _seeds(form.words)), "marks")
    made = found.where("fp IS NOT NULL").groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.min(F.struct("h", "k")).alias("text"))
    nodes = materialise(made.select("node", "n", "text.h", "text.k", *(F.col("fp")[i].alias(f"c{i}") for i in range(form.words))), "nodes")
    closest = materialise(_closest(nodes, form).distinct(), "closest")
    links = _verified(closest, nodes, docs, words, percent, form)
    roots = materialise(connected_components(links), "roots")
    named = materialise(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("group"), *(c for c in nodes.columns if c != "node")), "groups")
    crowds = _crowds(named, closest)
    if not crowds.isEmpty():
        inside = named.join(crowds, "group")
        links = links.unionByName(_within(inside, docs, words, percent))
        named = named.join(crowds, "group", "left").withColumn("group", F.coalesce("crowd", "group")).drop("crowd")
    more = _verified(_met(named, form, percent), nodes, docs, words, percent, form)
    roots = connected_components(links.unionByName(more))
    return found.join(roots, "node", "left").select("id", "h", "k", F.coalesce("root", "node").alias("root"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class of similar(), a whole row: of those with the smallest doc_id."""
    return keep_one(docs, similar(docs, words, percent))
