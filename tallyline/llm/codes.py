"""Vector code compression (product quantization) by heap Lloyd.

A vector's components become integers, floor(256 x); it is cut into equal parts, and each part position has a codebook. A part is
assigned to its nearest entry. Lloyd's rounds keep, in blocks of vectors local to a partition, one heap for each entry of each position, of the parts
assigned to it, keyed by how far the entry is ahead: the lower bound of the distance to any other entry less the upper bound of the distance to this one.
When entries move, that slack can shrink by the entry's own drift and the largest drift of the others at most. The sum of these
drifts is kept per entry, and keys are stored with the sum at their time added; so only parts whose key is at most the sum now can have
changed their entry. They are popped, compared with all entries exactly and pushed again; the others are not looked at.
Keys and sums are rounded to the safe side, so ties and rounding errors are popped too: results are those of exact integer arithmetic.

A round is one pass over a written table of blocks. A block carries its own sums and counts by entry, corrected by what moved; they are added up by
Spark, and the codebooks (their size is a parameter) go through the driver.

Rows whose vector is null, holds null, NaN or infinite components, can't be cut into equal parts, or isn't of the commonest length have no code and are left
out. Null ids come last and have codes too. Repeated ids and rows are vectors of their own; of equal ids the smaller vector comes first. Null labels are one
label. With fewer vectors than entries each is an entry. Empty tables give no rows. Columns not named don't matter. Components
must lie within 2^20 of zero, for exact sums of squares in 64 bits; a vector beyond raises an error that says so.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block: what a task holds at once.
BLOCK = 4096
LIMIT = 1 << 28
_STATE = "ids array<bigint>, labels array<{label}>, vectors binary, codes binary, keys binary, members binary, sizes binary, sums array<bigint>, counts array<bigint>"


def integers(rows: DataFrame, vec_col: str, scale: int = SCALE):
    """The column of floor(scale x) of a vector, null where that isn't an integer."""
    v = rows[vec_col]
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.coalesce(bad, F.lit(True)), None).otherwise(F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of points (n, width) to entries (k, width), exact."""
    out = np.zeros((len(points), len(book)), np.int64)
    for d in range(points.shape[1]):
        gap = points[:, d, None].astype(np.int64) - book[None, :, d]
        out += gap * gap
    return out


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, slack) of each point: the nearest entry, the lowest of equals, and how much farther the next one is."""
    squares = distances(points, book)
    code = squares.argmin(axis=1)
    at = np.arange(len(points))
    best = np.sqrt(squares[at, code])
    if len(book) == 1:
        return code, np.full(len(points), np.inf)
    squares[at, code] = np.iinfo(np.int64).max
    return code, np.sqrt(squares.min(axis=1)) - best


def _down(keys: np.ndarray) -> np.ndarray:
    """keys as 32-bit floats, none larger than it was."""
    return np.nextafter(keys.astype(np.float32), np.float32(-np.inf))


class Block:
    """Vectors (n, parts, width) with their codes, heaps (by position and entry, of (key, vector)), and sums and counts by entry."""

    def __init__(self, vectors: np.ndarray, books: np.ndarray):
        self.vectors, self.entries = vectors, books.shape[1]
        self.n, self.parts, self.width = vectors.shape
        # what rounding can change is far below
        self.margin = 1e-9 * (1 + float(np.abs(vectors).max(initial=0)) + float(np.abs(books).max(initial=0)))

    @classmethod
    def first(cls, vectors: np.ndarray, books: np.ndarray) -> Block:
        """Every part is compared with all entries."""
        self = cls(vectors, books)
        self.codes = np.zeros((self.n, self.parts), np.uint8)
        self.sums = np.zeros((self.parts, self.entries, self.width), np.int64)
        self.counts = np.zeros((self.parts, self.entries), np.int64)
        self.heaps: dict[tuple[int, int], list] = {}
        for j in range(self.parts):
            code, slack = nearest(vectors[:, j], books[j])
            self.codes[:, j] = code
            self._moved(j, np.arange(self.n), code, 1)
            keys = _down(slack - self.margin)
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(self.entries + 1))
            for c in range(self.entries):
                own = order[cuts[c] : cuts[c + 1]]
                heap = list(zip(keys[own].tolist(), own.tolist()))
                heapify(heap)
                self.heaps[j, c] = heap
        return self

    def _moved(self, j: int, who: np.ndarray, code: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[j], code, sign * self.vectors[who, j].astype(np.int64))
        np.add.at(self.counts[j], code, sign)

    def advance(self, books: np.ndarray, drift: np.ndarray) -> int:
        """Reassign what drift, the cumulative one (parts, entries), has violated; how many parts that were."""
        popped_all = 0
        for j in range(self.parts):
            popped: list[int] = []
            for c in np.flatnonzero(self._tops(j) <= drift[j]).tolist():
                heap, limit = self.heap(j, c), drift[j, c]
                while heap and heap[0][0] <= limit:
                    popped.append(heappop(heap)[1])
            if not popped:
                continue
            popped_all += len(popped)
            who = np.array(popped)
            code, slack = nearest(self.vectors[who, j], books[j])
            before = self.codes[who, j]
            changed = np.flatnonzero(before != code)
            self._moved(j, who[changed], before[changed], -1)
            self._moved(j, who[changed], code[changed], 1)
            self.codes[who, j] = code
            for c, key, x in zip(code.tolist(), _down(slack + drift[j, code] - self.margin).tolist(), popped):
                heappush(self.heap(j, c), (key, x))
        return popped_all

    def _tops(self, j: int) -> np.ndarray:
        tops = np.full(self.entries, np.inf)
        for c in range(self.entries):
            if (heap := self.heaps.get((j, c))) is not None:
                tops[c] = heap[0][0] if heap else np.inf
            elif self.sizes[j, c]:
                tops[c] = self.keys[self.starts[j, c]]
        return tops

    def heap(self, j: int, c: int) -> list:
        """The heap of an entry, taken out of the block's arrays when it is first touched."""
        heap = self.heaps.get((j, c))
        if heap is None:
            at = slice(self.starts[j, c], self.starts[j, c] + self.sizes[j, c])
            heap = self.heaps[j, c] = list(zip(self.keys[at].tolist(), self.members[at].tolist()))
        return heap

    def errors(self, books: np.ndarray) -> np.ndarray:
        total = np.zeros(self.n, np.int64)
        for j in range(self.parts):
            gap = self.vectors[:, j].astype(np.int64) - books[j][self.codes[:, j]]
            total += (gap * gap).sum(axis=1)
        return total

    def dump(self) -> tuple:
        keys, members, sizes = [], [], []
        for j in range(self.parts):
            for c in range(self.entries):
                if (heap := self.heaps.get((j, c))) is not None:
                    keys.append(np.array([k for k, _ in heap], np.float32))
                    members.append(np.array([x for _, x in heap], np.uint16))
                else:
                    at = slice(self.starts[j, c], self.starts[j, c] + self.sizes[j, c])
                    keys.append(self.keys[at])
                    members.append(self.members[at])
                sizes.append(len(keys[-1]))
        small = np.int16 if self.n and np.abs(self.vectors).max() < 1 << 15 else np.int32
        return (
            self.vectors.astype(small).tobytes(), self.codes.tobytes(), np.concatenate(keys).tobytes(), np.concatenate(members).tobytes(), np.array(sizes, np.uint16).tobytes(), self.sums.ravel(), self.counts.ravel()
        )

    @classmethod
    def load(cls, n: int, books: np.ndarray, vectors: bytes, codes: bytes, keys: bytes, members: bytes, sizes: bytes, sums, counts) -> Block:
        parts, entries, width = books.shape
        kind = np.int16 if len(vectors) == 2 * n * parts * width else np.int32
        self = cls(np.frombuffer(vectors, kind).reshape(n, parts, width), books)
        self.codes = np.frombuffer(codes, np.uint8).reshape(n, parts).copy()
        self.keys, self.members = np.frombuffer(keys, np.float32), np.frombuffer(members, np.uint16)
        self.sizes = np.frombuffer(sizes, np.uint16).astype(np.int64).reshape(parts, entries)
        self.starts = (np.cumsum(self.sizes.ravel()) - self.sizes.ravel()).reshape(parts, entries)
        self.sums, self.counts = np.array(sums, np.int64).reshape(books.shape), np.array(counts, np.int64).reshape(parts, entries)
        self.heaps = {}
        return self


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By how much each entry's slacks can have shrunk at most: its own drift and the largest of the others of its position."""
    own = np.sqrt(((after - before).astype(np.float64) ** 2).sum(axis=2))
    order = np.sort(own, axis=1)
    most = order[:, -1:]
    second = order[:, -2:-1] if own.shape[1] > 1 else np.zeros_like(most)
    other = np.where((own == most) & ((own == most).sum(axis=1, keepdims=True) == 1), second, most)
    return own + other + 1e-9 * (1 + np.abs(after).max(initial=0) + np.abs(before).max(initial=0))


def _beginning(books: np.ndarray, size: int):
    """State rows of blocks of `size` vectors from batches of (id, label, vector)."""

    def run(batches):
        held, n, label_type = [], 0, None
        for batch in batches:
            label_type = batch.schema.field(1).type
            at = 0
            while at < len(batch):
                part = batch.slice(at, size - n)
                held.append(part)
                n, at = n + len(part), at + len(part)
                if n == size:
                    yield made(held, label_type)
                    held, n = [], 0
        if n:
            yield made(held, label_type)

    def made(held, label_type):
        vectors = np.concatenate([x.column(2).flatten().to_numpy(zero_copy_only=False) for x in held]).astype(np.int32)
        ids, labels = ([i for x in held for i in x.column(c).to_pylist()] for c in (0, 1))
        return _state_batch(ids, labels, Block.first(vectors.reshape(-1, books.shape[0], books.shape[2]), books), label_type)

    return run


def _state_batch(ids, labels, block: Block, label_type):
    kinds = [pa.list_(pa.int64()), pa.list_(label_type), *[pa.binary()] * 5, *[pa.list_(pa.int64())] * 2]
    names = ["ids", "labels", "vectors", "codes", "keys", "members", "sizes", "sums", "counts"]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((ids, labels, *block.dump()), kinds)], names=names)


def _loaded(batches, books: np.ndarray):
    """(ids, labels, block, type of labels) of each state row."""
    for batch in batches:
        for i in range(len(batch)):
            ids, labels, *rest = (c[i].as_py() for c in batch.columns)
            yield ids, labels, Block.load(len(ids), books, *rest), batch.schema.field(1).type.value_type


def _advancing(books: np.ndarray, drift: np.ndarray):
    def run(batches):
        for ids, labels, block, label_type in _loaded(batches, books):
            block.advance(books, drift)
            yield _state_batch(ids, labels, block, label_type)

    return run


def _ending(books: np.ndarray, drift: np.ndarray, names: list[str]):
    def run(batches):
        for ids, labels, block, label_type in _loaded(batches, books):
            block.advance(books, drift)
            codes = [x.tobytes().hex() for x in block.codes]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, label_type), pa.array(codes, pa.string()), pa.array(block.errors(books))], names=names)

    return run


def _new_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes its parts' floored mean; one without parts stays."""
    totals = []
    for column in ("sums", "counts"):
        each = state.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        total = np.zeros(books.size if column == "sums" else books.shape[0] * books.shape[1], np.int64)
        for at, x in each.collect():  # as many rows as the codebooks have numbers
            total[at] = x
        totals.append(total)
    sums, counts = totals[0].reshape(books.shape), totals[1].reshape(books.shape[:2])[:, :, None]
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(rows of id_col, label_col, code, error; the codebooks (parts, entries, width)) of rows whose vector can be coded.

    Codebooks start as the parts of the `entries` (256 at most) smallest ids; each of `rounds` assigns all parts and moves the entries; then all are assigned again.
    code is the entries' numbers, two hex digits each, error the sum of squared distances.
    """
    kind = rows.schema[label_col].dataType.simpleString()
    schema = f"`{id_col}` bigint, `{label_col}` {kind}, code string, error bigint"
    kept = rows.select(rows[id_col].cast("bigint").alias("id"), rows[label_col].alias("label"), integers(rows, vec_col, scale).alias("v"))
    kept = kept.where(F.size("v") > 0).where(F.size("v") % parts == 0)
    lengths = kept.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.col("n").desc(), "length").first()
    if common is None:
        return rows.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    far = F.exists("v", lambda x: F.abs(x) > LIMIT)
    kept = kept.where(F.size("v") == common.length).withColumn("v", F.when(far, F.raise_error(F.lit(f"a component lies beyond {LIMIT // scale} of zero"))).otherwise(F.col("v")))
    start = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # as many as there are entries, a parameter
    books = np.array([r.v for r in start], np.int64).reshape(-1, parts, common.length // parts).transpose(1, 0, 2).copy()
    form = _STATE.format(label=kind)
    state = materialise(kept.mapInArrow(_beginning(books, min(block, 1 << 15)), form), "blocks")
    drift = np.full(books.shape[:2], -np.inf)  # nothing is violated before an entry has moved
    for i in range(rounds):
        after = _new_books(state, books)
        drift, books = np.maximum(drift, 0) + drifts(books, after), after
        if i + 1 < rounds:
            state = materialise(state.mapInArrow(_advancing(books, drift), form), "blocks")
    return state.mapInArrow(_ending(books, drift, [id_col, label_col, "code", "error"]), schema), books


def report(rows: DataFrame, **parameters) -> DataFrame:
    """compress() with the default columns, and beside each row label_error, the sum of its label's errors, and the digest of the final codebooks."""
    out, books = compress(rows, **parameters)
    out = materialise(out, "codes")
    totals = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.join(totals, out["label"].eqNullSafe(totals["of"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(n: int, books: str) -> str:
    """a<n>: each part's entry, nearest first, lowest of equals."""
    return f"""a{n} AS (
  SELECT r, j, arg_min(e, (s, e)) AS e, min(s) AS s FROM (
    SELECT p.r, p.j, b.e, sum((p.v - b.v) * (p.v - b.v)) AS s FROM parts p JOIN {books} b ON b.j = p.j AND b.d = p.d GROUP BY p.r, p.j, b.e
  ) GROUP BY r, j
)"""


def _books_sql(n: int) -> str:
    return f"""b{n} AS (
  SELECT b.j, b.e, b.d, coalesce(m.v, b.v) AS v FROM b{n - 1} b LEFT JOIN (
    SELECT p.j, a.e, p.d, CAST(floor(sum(p.v) / count(*)) AS BIGINT) AS v FROM parts p JOIN a{n - 1} a ON a.r = p.r AND a.j = p.j GROUP BY p.j, a.e, p.d
  ) m ON m.j = b.j AND m.e = b.e AND m.d = b.d
)"""


REPORT_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, (p - 1) // w AS j, (p - 1) % w AS d, v FROM (SELECT r, len(v) // {PARTS} AS w, unnest(range(1, len(v) + 1)) AS p, unnest(v) AS v FROM kept)
), b0 AS (SELECT j, r AS e, d, v FROM parts WHERE r < {ENTRIES}),
{", ".join(f"{_round_sql(n, f'b{n}')}, {_books_sql(n + 1)}" for n in range(ROUNDS))}, {_round_sql(ROUNDS, f"b{ROUNDS}")},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY j) AS code, CAST(sum(s) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(v, ',' ORDER BY j, e, d)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r) CROSS JOIN digest
"""
