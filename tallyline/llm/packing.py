"""Packing token sequences by minimum bin slack.

A document is its token ids and an end id. What fills whole windows is cut off as windows of its own; what remains is
shorter than a window and waits. While a window's worth waits, the multiset of waiting lengths whose sum comes closest to the window is
found by subset-sum dynamic programming on a bitset (bit s: a sum of s can be reached), length by length from the longest, each as often as it
waits (in powers of two), until the window's own bit is set; the bitsets kept on the way give back how often each length was used.
The longest that waits and some shorter ones are tried as members first, which leaves little room to fill; if no multiset with them fills the window wholly, all are open. That multiset fills as many windows as the counts allow. If none fills a window wholly, the longest waiting rest is cut
for the slack: cuts are free. What waits at the end of a partition, less than a window, becomes sequences of powers of two, which are not padded. So no
sequence has padding.

Spark partitions the documents; a partition packs its own, so nothing is shuffled, and a sequence's id is made of the partition's
number and a count. A task holds the ids that wait, at most about POOL, and one batch of texts. Ids come from the tokenizers library, which is asked
once for each distinct piece that its own pattern splits off; a task keeps a bounded table of pieces.

Null texts count as empty: their document is the end id. Empty tables give no rows. Repeated rows and rows without an id are documents of their
own. Very long texts are taken whole. Strings of special tokens in a text are ordinary text. Columns beside id and text are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect, insort
from collections import deque
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyline.llm.bpe import Numbered, splitters
from tallyline.llm.common import by_bytes, chunks

#: Token ids that may wait in a task before windows are filled; half of them stay for better fits.
POOL = 1 << 22
#: Lengths, spread over those that fit beside a window's first member, with which the search begins, and first members that are tried, spread from the longest down.
SPREAD, SEEDS = 8, 32
#: Characters tokenized at once, the pieces that a task remembers, and new pieces given to the library at once.
BATCH_CHARS, MAX_PIECES, NEW = 2_000_000, 1_000_000, 20_000


class Pieces:
    """Token ids of texts, piece by piece; each distinct piece is encoded once by the library."""

    def __init__(self, tokenizer: bytes, pattern: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(tokenizer.decode())
        self.model.encode_special_tokens = True
        self.narrow, self.full = splitters(pattern)
        self.forget()

    def forget(self) -> None:
        self.index = Numbered()
        self.count, self.ids, self.start = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Append the ids of new pieces."""
        counts, ids = [self.count], [self.ids]
        for part in chunks(pieces, NEW):
            found = self.model.encode(part, is_pretokenized=True, add_special_tokens=False)
            counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
            ids.append(np.array(found.ids, np.int32))
        self.count, self.ids = np.concatenate(counts), np.concatenate(ids)
        self.start = np.cumsum(self.count) - self.count

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > MAX_PIECES:
            self.forget()
        parts = [(self.narrow if _latin(x) else self.full).findall(x) for x in texts]
        each = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, int(each.sum()))
        if len(self.index) > len(self.count):
            self.learn(list(islice(self.index, len(self.count), None)))
        n = self.count[at]
        ends = np.cumsum(n)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - n), n)]
        cuts = np.append(0, ends)[np.append(0, np.cumsum(each))]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def fullest(counts: dict[int, int], capacity: int, lengths: list[int] | None = None) -> dict[int, int]:
    """How often to use each length, at most counts times, so that the sum comes closest to capacity without passing it.

    lengths: those in counts that are no longer than capacity, in the order in which they are tried, if they are at hand.
    """
    if lengths is None:
        lengths = sorted((length for length, n in counts.items() if n and length <= capacity), reverse=True)
    reach, whole, trail = 1, 1 << capacity, []
    below = (whole << 1) - 1
    for length in lengths:
        left, some = min(counts[length], capacity // length), 1
        while left and not reach & whole:
            some = min(some, left)
            trail.append((length, some, reach))
            reach |= reach << some * length & below
            left, some = left - some, 2 * some
        if reach & whole:
            break
    at, used = reach.bit_length() - 1, {}
    for length, some, before in reversed(trail):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + some
            at -= some * length
    return used


class Packer:
    """Turns documents, (key, ids), into pieces: (key, start, ids, ids of the document, sequence, offset)."""

    def __init__(self, capacity: int, first: int = 0):
        self.capacity, self.sequence = capacity, first
        self.waiting: dict[int, deque] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []  # that wait, ascending
        self.total = 0
        self.pieces: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            self._sequence([(key, start, ids[start : start + self.capacity], len(ids))])
        if whole < len(ids):
            self._wait((key, whole, ids[whole:], len(ids)))

    def fill(self, most: int) -> None:
        """Fill windows until at most `most` ids, or less than a window, wait."""
        while self.total > most and self.total >= self.capacity:
            used = self._with_a_long_one() or fullest(self.counts, self.capacity, self.lengths[::-1])
            slack = self.capacity - sum(length * n for length, n in used.items())
            times = 1 if slack else min(self.counts[length] // n for length, n in used.items())
            for _ in range(times):
                chosen = [self._take(length) for length, n in used.items() for _ in range(n)]
                if slack:
                    chosen.append(self._cut(slack))
                self._sequence(chosen)

    def _with_a_long_one(self) -> dict[int, int] | None:
        """A multiset that fills a window wholly and holds the longest length, or else a somewhat shorter one, if there is one."""
        for longest in self.lengths[:: -max(1, len(self.lengths) // SEEDS)]:
            room = self.capacity - longest
            self.counts[longest] -= 1
            fits = bisect(self.lengths, room)
            stride = max(1, fits // SPREAD)
            short = self.lengths[:fits][::-1]
            used = fullest(self.counts, room, list(chain.from_iterable(short[k::stride] for k in range(stride))))
            self.counts[longest] += 1
            if sum(length * n for length, n in used.items()) == room:
                used[longest] = used.get(longest, 0) + 1
                return used
        return None

    def end(self) -> None:
        """What is left, as windows and then sequences of powers of two."""
        self.fill(0)
        while self.total:
            size, chosen = 1 << (self.total.bit_length() - 1), []
            while size:
                longest = self.lengths[-1]
                chosen.append(self._take(longest) if longest <= size else self._cut(size))
                size -= len(chosen[-1][2])
            self._sequence(chosen)

    def _wait(self, item: tuple) -> None:
        length = len(item[2])
        self.waiting.setdefault(length, deque()).append(item)
        self.counts[length] = self.counts.get(length, 0) + 1
        if self.counts[length] == 1:
            insort(self.lengths, length)
        self.total += length

    def _take(self, length: int) -> tuple:
        item = self.waiting[length].popleft()
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.lengths[bisect(self.lengths, length) - 1]
        self.total -= length
        return item

    def _cut(self, size: int) -> tuple:
        """The first `size` ids of the longest that waits; its rest waits on."""
        key, start, ids, n = self._take(self.lengths[-1])
        if len(ids) > size:
            self._wait((key, start + size, ids[size:], n))
        return key, start, ids[:size], n

    def _sequence(self, chosen: list[tuple]) -> None:
        offset = 0
        for key, start, ids, n in chosen:
            self.pieces.append((key, start, ids, n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1


@lru_cache(maxsize=2)
def _pieces(tokenizer: bytes, pattern: str) -> Pieces:
    return Pieces(tokenizer, pattern)


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if with_ids.

    Pieces of a sequence_id lie at their offsets, gapless from 0; a sequence has capacity ids or a power of two of them. The tokenizer's file is
    read on the driver and sent to the tasks; it is bounded.
    """
    with open(tokenizer_path, "rb") as file:
        tokenizer = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        pieces, packer = _pieces(tokenizer.value, pattern), Packer(capacity, TaskContext.get().partitionId() << 32)
        id_type = None

        def made():
            key, start, ids, n, sequence, offset = zip(*packer.pieces)
            packer.pieces = []
            columns = [pa.array(key, id_type), *(pa.array(c, pa.int64()) for c in (start, [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], n, sequence, offset))]
            return pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=names)

        for batch in batches:
            keys, id_type = batch.column(0).to_pylist(), batch.column(0).type
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in by_bytes(texts, BATCH_CHARS):
                for key, ids in zip(keys[a:b], pieces.encode(texts[a:b]), strict=True):
                    packer.add(key, np.append(ids, np.int32(end_id)))
                if packer.total > POOL:
                    packer.fill(POOL // 2)
                if packer.pieces:
                    yield made()
        packer.end()
        if packer.pieces:
            yield made()

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    schema = f"id {kind}, " + ", ".join(f"`{c}` bigint" for c in names[1:7]) + (", ids array<int>" if with_ids else "")
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
