"""Substring dedup by difference-cover anchors.

A window is WINDOW = 35 consecutive words. Two equal windows at positions p and q share an offset t < PERIOD = 21 at
which both p + t and q + t fall on positions of the cover {0, 1, 4, 14, 16} modulo 21, since every
difference modulo 21 is one of two cover members. So only at cover positions anchors of
WINDOW - PERIOD + 1 = 15 words are hashed, 5 in 21 positions: a window that repeats holds a repeated
anchor. Around repeated anchors matches are extended: every window that holds one is hashed whole, with 96 bits,
and those that occur twice are repeats; two different ones of N windows share a hash with a probability under N**2 / 2**97 (for 10**12
windows 6e-6). Windows are judged on the input.

Hot passages: a hash that a batch holds more than once is known to repeat, so only one of its places
goes to the group of that hash, the others are dealt out evenly. What is shuffled is packed: a row
holds the places (or a compressed text) of one batch for one partition, so a place costs its hash
and a few bytes. Texts are shuffled twice, to the anchors and to the windows that repeat in them.
A task holds the places of its partition, which are some four times a text's bytes: there is a partition for each PARTITION_BYTES of the
table, or spark.sql.shuffle.partitions of them if that is more.

Null texts have no words; a text under 35 words has no window. Where ids are null or repeat, rows
are told apart by id and text, and equal rows count as copies of each other. Ties don't arise: all places of a repeated window are repeats. An
empty table gives no rows; columns beside id and text are not looked at. A very long text is hashed whole, in memory some forty times its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import by_bytes, materialise, partitions_for

WINDOW = 35
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
PARTITION_BYTES = 16 << 20
ANCHOR = WINDOW - PERIOD + 1
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_tables: list = [None, None]


def _powers(which: int, n: int):
    if _tables[which] is None or len(_tables[which][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for base in (_ODD[which], pow(_ODD[which], -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            made.append(np.cumprod(factors))
        _tables[which] = made
    return _tables[which]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _run_hashes(hashes: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes of the runs of length words that begin at the positions at."""
    powers, inverse = _powers(which, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers[: len(hashes)], out=sums[1:])
    return _mix((sums[at + length] - sums[at]) * inverse[at])


def _cover(n: int) -> np.ndarray:
    """Cover positions at which an anchor fits into n words."""
    at = np.add.outer(np.arange(0, max(n, 1), PERIOD), np.array(COVER)).ravel()
    return at[at + ANCHOR <= n]


def _candidates(anchors: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors."""
    mark = np.zeros(n + 2, np.int64)
    np.add.at(mark, np.maximum(anchors - (WINDOW - ANCHOR), 0), 1)
    np.add.at(mark, np.minimum(anchors, n - WINDOW) + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: n - WINDOW + 1] > 0)


def _kept(words: list[bytes], starts: np.ndarray) -> tuple[int, str]:
    """(words removed, digest of the others)."""
    if not len(starts):
        return 0, hashlib.sha256(b" ".join(words)).hexdigest()
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + WINDOW, -1)
    gone = np.cumsum(mark)[:-1] > 0
    left = [w for w, g in zip(words, gone.tolist()) if not g]
    return int(gone.sum()), hashlib.sha256(b" ".join(left)).hexdigest()


def _scattered(hashes: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, known): of equal hashes all places are known to repeat, and all but one get a hash of their place."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    later = np.concatenate([[False], same])
    known = np.zeros(len(hashes), bool)
    known[order] = later | np.concatenate([same, [False]])
    extra = np.zeros(len(hashes), bool)
    extra[order] = later
    out = hashes.copy()
    out[extra] = _mix(hashes[extra] + _mix(keys[extra].view(np.uint64) + _mix(at[extra].astype(np.uint64))))
    return out, known


def _pack(bucket: np.ndarray, n: int, *columns: np.ndarray):
    """(bucket, bytes) for each bucket that has rows: the columns' cells, compressed."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    for i in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
        cells = [c[bounds[i] : bounds[i + 1]] for c in columns]
        raw = b"".join((np.diff(c, prepend=c.dtype.type(0)) if c.dtype == np.int64 else c).tobytes() for c in cells)
        yield i, len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], size, "zstd", asbytes=True)
    n, out, at = size // sum(np.dtype(t).itemsize for t in types), [], 0
    for t in types:
        cells = np.frombuffer(raw, t, n, at)
        out.append(np.cumsum(cells) if np.dtype(t) == np.int64 else cells)
        at += cells.nbytes
    return out


_PLACE = (np.uint64, np.uint32, np.int64, np.int32, np.uint8)  # hash, more of the hash, key, position, known to repeat
_PACKED = "part int, kind int, cell binary"
#: Characters of text whose places are packed together.
_BATCH = 16_000_000


def _packed(cells, kind: int):
    cells = list(cells)
    if cells:
        part, blob = zip(*cells)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "cell"])


def _send(n: int, keys: list, places: list, ones: list, twos: list):
    """Places to the partition of their hash."""
    if keys:
        key, at = np.concatenate(keys), np.concatenate(places)
        one, two = np.concatenate(ones), np.concatenate(twos)
        mixed = _mix(one) + two
        sent, known = _scattered(mixed, key, at)
        extra = sent != mixed
        one[extra] = sent[extra]
        yield from _packed(_pack((_mix(one) % np.uint64(n)).astype(np.int64), n, one, two.astype(np.uint32), key, at.astype(np.int32), known.astype(np.uint8)), 0)


def _anchors(n: int):
    def run(batches):
        for batch in batches:
            found, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_bytes(texts, _BATCH):
                keys, places, hashes = [], [], []
                for key, text in zip(found[a:b], texts[a:b]):
                    words = words_of(text)
                    if len(words) >= WINDOW:
                        at = _cover(len(words))
                        keys.append(np.full(len(at), key, np.int64))
                        places.append(at)
                        hashes.append(_run_hashes(_word_hashes(words, 1), at, ANCHOR))
                yield from _send(n, keys, places, hashes, [np.zeros(len(h), np.uint64) for h in hashes])

    return run


def _repeated(n: int):
    """Of a partition's places those whose hash stands at another place too, to the partition of their key."""

    def run(batches):
        parts = [_unpack(cell, *_PLACE) for batch in batches for cell in batch.column(2).to_pylist()]
        if not parts:
            return
        one, two, key, at, known = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        again |= known[order] > 0
        key, at = key[order][again], at[order][again]
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        yield from _packed(_pack(_home(key, n), n, key, at), 0)

    return run


def _home(key: np.ndarray, n: int) -> np.ndarray:
    return (_mix(key.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _texts(n: int):
    """Texts, compressed, to the partition of their key."""

    def run(batches):
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), np.int64)
            cells = []
            for key, home, text in zip(keys.tolist(), _home(keys, n).tolist(), batch.column(1).to_pylist()):
                raw = b" ".join(words_of(text))
                cells.append((home, key.to_bytes(8, "little", signed=True) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)))
            yield from _packed(cells, 1)

    return run


def _met(batches):
    """(key, words, places) of each text of a partition; the places come first. A key that comes again is a copy."""
    parts, index, seen = [], None, set()
    for batch in batches:
        for kind, cell in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if not kind:
                parts.append(_unpack(cell, np.int64, np.int32))
                continue
            if index is None:
                key, at = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32))
                order = np.argsort(key, kind="stable")
                index, at = key[order], at[order]
                parts = []
            key = int.from_bytes(cell[:8], "little", signed=True)
            if key not in seen:
                seen.add(key)
                size = int.from_bytes(cell[8:16], "little")
                a, b = np.searchsorted(index, key, "left"), np.searchsorted(index, key, "right")
                yield key, pa.decompress(cell[16:], size, "zstd", asbytes=True).split() if size else [], np.unique(at[a:b]).astype(np.int64)


def _windows(n: int):
    """Whole hashes of the windows that hold a repeated anchor."""

    def run(batches):
        keys, places, ones, twos, held = [], [], [], [], 0
        for key, words, anchors in _met(batches):
            if len(anchors) and len(words) >= WINDOW:
                starts = _candidates(anchors, len(words))
                keys.append(np.full(len(starts), key, np.int64))
                places.append(starts)
                ones.append(_run_hashes(_word_hashes(words, 1), starts, WINDOW, 0))
                twos.append(_run_hashes(_word_hashes(words, 2), starts, WINDOW, 1) >> np.uint64(32))
                held += len(starts)
                if held >= 1_000_000:
                    yield from _send(n, keys, places, ones, twos)
                    keys, places, ones, twos, held = [], [], [], [], 0
        yield from _send(n, keys, places, ones, twos)

    return run


_RESULT = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _finish(with_text: bool):
    def run(batches):
        part: list = []
        for key, words, starts in _met(batches):
            text = None
            if with_text:
                gone = np.zeros(len(words), bool)
                for s in starts.tolist():
                    gone[s : s + WINDOW] = True
                text = b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()
            part.append((key, len(words), *_kept(words, starts), text))
            if len(part) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _RESULT)], schema=_RESULT)
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _RESULT)], schema=_RESULT)

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id_col, n_words, n_removed and kept_sha256 of every document; with_text adds kept, the words left.

    A word is removed if a window that covers it has a word sequence that also starts anywhere else.
    """
    n = partitions_for(docs, PARTITION_BYTES)
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    plain = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty()
    key = F.col("id") if plain else F.xxhash64("id", "text")
    keyed = rows.select(key.alias("key"), "text")
    texts = keyed.mapInArrow(_texts(n), _PACKED)

    def dealt(packed):
        return packed.repartitionById(n, F.col("part"))

    def met(places):
        return dealt(places.unionByName(texts)).sortWithinPartitions("kind")

    def repeated(places):
        return dealt(places).mapInArrow(_repeated(n), _PACKED)

    anchors = repeated(keyed.mapInArrow(_anchors(n), _PACKED))
    windows = repeated(met(anchors).mapInArrow(_windows(n), _PACKED))
    schema = "key bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    result = met(windows).mapInArrow(_finish(with_text), schema)
    columns = ["n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    if plain:
        return result.select(F.col("key").alias(id_col), *columns)
    ids = materialise(rows.select("id", key.alias("key")), "ids")
    copies = ids.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    twice = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    result = result.join(copies, "key").withColumns(
        {
            "n_removed": F.when(twice, F.col("n_words")).otherwise(F.col("n_removed")),
            "kept_sha256": F.when(twice, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")),
            "kept": F.when(twice, F.lit("")).otherwise(F.col("kept")),
        }
    )
    return ids.join(result, "key").select(F.col("id").alias(id_col), *columns)


#: The same result in DuckDB.
DEDUP_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), w AS (SELECT rid, words, unnest(range(1, len(words) - 33)) AS s FROM d WHERE len(words) >= 35),
h AS (SELECT rid, s, md5(array_to_string(words[s:s + 34], ' ')) AS k FROM w),
r AS (SELECT rid, s FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS i FROM r),
each AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (rid, i) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_removed FROM gone GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""
