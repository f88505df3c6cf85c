"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Features of a text are indicators, hashed to BITS bits, of
* the n-grams (1 to 3) of its token shapes, which carry over to words never seen: a shape keeps a token's classes of characters
  (lower and upper letters, digits) and its punctuation, runs shortened;
* its words, A-Z in lower case, and the grams of three bytes of its words and the blanks between them;
* two marks: a token that repeats the one before it, and a line seen before.
Each indicator is scaled by the log ratio of its smoothed relative counts in the two classes (0 if fewer than LEAST
training texts have it), each text's vector has length one, and
a support vector machine is fitted by dual coordinate descent, classes weighted to equal sums. A
logistic curve fitted on rows kept out of the descent turns margins into scores.

The fit reads at most TRAIN_ROWS labelled documents, those with the smallest hashes of their ids; features are
made by many tasks, the descent is one task over that bounded sample. Scoring reads whole texts in
parallel. Null and empty texts have the one feature "empty". Labels other than 0 and 1 and labels without an id are left out;
a document with both counts as 0, and of several texts of one labelled id the one with the smallest hash is learned from. Without
labels every score is 0.5; with one class, all scores are that class's. Repeated rows and rows without an id are scored each on
its own text; empty tables give no rows. Columns beside id and text are not looked at by score() and kept by keep_good().
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import materialise

TRAIN_ROWS = 12_000
BITS, GRAMS, LEAST = 18, 3, 3
COST, EPOCHS, SEED = 0.3, 12, 7


def _classes() -> bytes:
    table = bytearray(range(256))
    for c in range(256):
        if c >= 128 or 97 <= c <= 122:
            table[c] = ord("a")
        elif 65 <= c <= 90:
            table[c] = ord("A")
        elif 48 <= c <= 57:
            table[c] = ord("0")
    return bytes(table)


_CLASSES = _classes()


class _Shapes(dict):
    """Hash of the shape of a token whose characters are replaced by their classes; forgets when it gets large."""

    def __missing__(self, token: bytes) -> int:
        out = bytearray()
        for i, c in enumerate(token):
            keep = 1 if c in b"aA0" else 2
            if i < keep or any(token[i - k] != c for k in range(1, keep + 1)):
                out.append(c)
        if len(self) > 50_000:
            self.clear()
        shape = self[token] = zlib.crc32(out)
        return shape


_shapes = _Shapes()
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULTIPLY = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, (8, GRAMS), np.uint64) * np.uint64(2) + np.uint64(1)
EMPTY, LINE_AGAIN, AGAIN = 0, 1, np.uint64(0x5851F42D)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _grams(hashes: np.ndarray, n: int, family: int) -> np.ndarray:
    """Numbers of the n-grams of a sequence; families (kinds of grams) are numbered apart."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        total += (hashes[k : k + len(total)] + np.uint64(family)) * _MULTIPLY[family, k]
    total ^= total >> np.uint64(29)
    return ((total * _MULTIPLY[7, 0]) >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str | None, marks: bool = True) -> np.ndarray:
    """Sorted numbers of the indicators that are on; marks: with those of repetition."""
    raw = (text or "").encode()
    own = raw.split()
    if not own:
        return np.array([EMPTY], np.int32)
    shapes = np.fromiter(map(_shapes.__getitem__, raw.translate(_CLASSES).split()), np.uint64, len(own))
    joined = b" ".join(own).translate(_LOWER)
    words = _hashes(joined.split(b" "))
    found = []
    if marks:
        shapes[1:][np.fromiter(map(eq, own[1:], own), bool, len(own) - 1)] += AGAIN
        lines = [x for x in raw.split(b"\n") if len(x) > 20]
        if len(set(lines)) < len(lines):
            found.append(np.array([LINE_AGAIN], np.int32))
    found += [_grams(shapes, n, n - 1) for n in range(1, GRAMS + 1)]
    found.append(_grams(words, 1, 3))
    found.append(_grams(np.frombuffer(b" " + joined + b" ", np.uint8).astype(np.uint64), 3, 5))
    ranked = np.sort(np.concatenate(found))
    return ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])]


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratio of each indicator; those that fewer than LEAST rows have say nothing."""
    counts = np.ones((2, 1 << BITS))
    for x, c in zip(rows, y):
        counts[int(c > 0), x] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.where(counts.sum(axis=0) >= LEAST + 2, np.log(share[1]) - np.log(share[0]), 0.0)


def scaled(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    v = r[x]
    return v / (np.sqrt(v @ v) + 1e-12)


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model by dual coordinate descent."""
    w, b, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    values = [scaled(x, r).astype(np.float32) for x in rows]
    square = np.array([v @ v + 1.0 for v in values])
    share = {c: max(1, int((y == c).sum())) for c in (1, -1)}
    cost = {c: COST * max(share.values()) / share[c] for c in share}
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v, c = rows[i], values[i], y[i]
            new = min(max(alpha[i] - (c * (w[x] @ v + b) - 1) / square[i], 0.0), cost[c])
            step = new - alpha[i]
            if step:
                w[x] += step * c * v
                b += step * c
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the score 1 / (1 + exp(-(a * margin + b))), with smoothed targets; a is at least 0."""
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margins**2).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ratios, weights, [bias, a, b]) of the model. Takes rows over: they are cut to what has weight."""
    none = np.zeros(1 << BITS, np.float32)
    if not len(rows) or len(set(y.tolist())) < 2:
        return none, none, np.array([0.0, 0.0, 0.0 if not len(rows) else 20.0 * y[0]])
    apart = np.arange(len(rows)) % 5 == 4
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(rows), bool)
    r = ratios([x for x, z in zip(rows, apart) if not z], y[~apart])
    for i, x in enumerate(rows):
        rows[i] = x[r[x] != 0]  # the others have no weight, and are let go
    w, bias = descend([x for x, z in zip(rows, apart) if not z], y[~apart], r)
    use = apart if apart.any() else ~apart
    margins = np.array([w[x] @ scaled(x, r) + bias for x, z in zip(rows, use) if z])
    a, b = calibrate(margins, y[use])
    return r.astype(np.float32), w.astype(np.float32), np.array([bias, a, b])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS):
    """The model as three arrays on the driver: a fixed 2 MB. labels: (doc_id, quality)."""
    known = labels.select(labels["doc_id"].alias("label_id"), labels["quality"].alias("quality")).where("quality IN (0, 1) AND label_id IS NOT NULL")
    known = known.groupBy("label_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(materialise(chosen, "labelled")), F.col("id") == F.col("label_id")).withColumn("h", F.xxhash64("text"))  # at most train_rows ids

    def marks(batches):
        for batch in batches:
            found = [features(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["id", "quality", "h", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = materialise(rows.select("id", F.col("quality").cast("int").alias("quality"), "h", "text").mapInArrow(marks, f"id {kind}, quality int, h bigint, x array<int>"), "marks")

    def fitted(batches):
        xs, y = [], []
        for batch in batches:
            y += batch.column(0).to_pylist()
            lists = batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            xs += [flat[a:b].copy() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        model = fit(xs, np.where(np.array(y) == 1, 1, -1)) if xs else fit([], np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in model], names=["r", "w", "c"])

    once = made.groupBy("id").agg(F.min_by(F.struct("quality", "x"), "h").alias("row")).select("id", "row.*")  # one text an id, whatever the order
    sample = once.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("quality", "x")
    row = sample.mapInArrow(fitted, "r binary, w binary, c binary").first()
    if row is None:
        return fit([], np.zeros(0))
    return np.frombuffer(row.r, np.float32), np.frombuffer(row.w, np.float32), np.frombuffer(row.c, np.float64)


def _scores(texts, r, w, c) -> list[float]:
    bias, a, b = c
    out = []
    for text in texts:
        x = features(text)
        margin = float(w[x] @ scaled(x, r)) + bias
        out.append(float(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))))
    return out


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1, higher: better) of every whole text. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = _scores(batch.column(1).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels are never learned from; false for those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def keep_good(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = _scores(batch.column(batch.schema.names.index("text")).to_pylist(), *shared.value)
            yield batch.filter(pa.array([x >= threshold for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
