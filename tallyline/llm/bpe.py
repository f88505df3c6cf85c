"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A text is split by the pre-tokenizer's pattern. The distinct pieces of a batch become
token-position rows (piece, start, end, token, next token); a recursive query joins them with the
merge table and contracts, round by round, each piece's leftmost pair of minimum rank until no
pair is left; an ordered aggregation returns a piece's ids. Decoding joins the ids of whole documents with the vocabulary and
returns their bytes by an ordered aggregation, so it sees nothing of the text but its ids.
Spark partitions the documents; a worker keeps only a bounded table of pieces that it has seen.

The recursive query holds a row a byte and round, so a piece of over LONG bytes (a run without a border) is first cut wherever no token of the
vocabulary can reach across: where the two bytes are no token and neither three bytes around them stand in any. No contraction ever crosses such
a place, so the parts go through the same query as pieces of their own and their ids follow each other. A part that is still over LONG (the same few tokens again and
again) has few different pairs; its rounds run one by one and contract all separate occurrences of the minimum-rank pair at once, with the same result.

Null texts count as empty and have no tokens. Repeated rows are encoded each on its own; ids may be null; an empty table gives no rows;
columns beside id and text are not looked at. Of equal pairs in a piece the leftmost is contracted first. Very long texts are taken whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyline.llm.common import by_bytes

#: Pieces that a worker remembers at most; when more are met, it starts afresh.
MAX_PIECES = 300_000
#: Token-position rows per recursive query, and the rows that its rounds may add up to.
ROWS, ROUND_ROWS = 60_000, 1_000_000
#: Bytes from which a piece is cut into parts.
LONG = 1500
#: Characters encoded and ids decoded at once.
BATCH_CHARS, TOKENS = 1_500_000, 200_000

_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\\t-\\r \x85\xa0"

_ROUNDS = """
WITH RECURSIVE t(w, p, e, tok, nxt, depth, done) AS (
  SELECT w, p, e, tok, nxt, 0, false FROM init
  UNION ALL (
    WITH c AS MATERIALIZED (
      SELECT t.*, m.rank FROM t LEFT JOIN merges m ON m.l = t.tok AND m.r = t.nxt WHERE NOT done AND depth < {depth}
    ), best AS (
      SELECT w, min((rank::BIGINT << 32) | p) AS k, arg_min(e, (rank::BIGINT << 32) | p) AS q
      FROM c WHERE rank IS NOT NULL GROUP BY w
    ), pair AS (
      SELECT best.w, (k & 4294967295)::BIGINT AS p, (k >> 32)::INT AS tok, q, c.e, c.nxt
      FROM best JOIN c ON c.w = best.w AND c.p = best.q
    )
    SELECT c.w, c.p, CASE WHEN c.p = pair.p THEN pair.e ELSE c.e END,
      CASE WHEN c.p = pair.p THEN pair.tok ELSE c.tok END,
      CASE WHEN c.p = pair.p THEN pair.nxt WHEN c.e = pair.p THEN pair.tok ELSE c.nxt END,
      c.depth + 1, pair.w IS NULL
    FROM c LEFT JOIN pair ON c.w = pair.w WHERE pair.w IS NULL OR c.p <> pair.q
  )
)
SELECT w, p, e, tok, nxt, done FROM t WHERE done OR depth = {depth}
"""

#: One round for one long piece: all separate occurrences of its minimum-rank pair at once. That equals
#: contracting them one by one if the merged token takes part in no pair of lower rank (multi).
_LONG_ROUND = """
CREATE OR REPLACE TEMP TABLE long_next AS
WITH c AS MATERIALIZED (
  SELECT s.*, m.rank, m.multi FROM long s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.nxt
), low AS (SELECT min(rank) AS rank, arg_min(multi, rank) AS multi, arg_min(p, (rank::BIGINT << 32) | p) AS p FROM c WHERE rank IS NOT NULL),
hit AS (
  SELECT c.p, c.e, sum(CASE WHEN c.fresh THEN 1 ELSE 0 END) OVER (ORDER BY c.p) AS run
  FROM (SELECT c.p, c.e, coalesce(lag(c.e) OVER (ORDER BY c.p) <> c.p, true) AS fresh
        FROM c, low WHERE c.rank = low.rank AND (low.multi OR c.p = low.p)) c
), pick AS (SELECT p, e AS q FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY p) AS i FROM hit) WHERE i % 2 = 1),
kept AS (
  SELECT c.p, CASE WHEN a.p IS NULL THEN c.e ELSE r.e END AS e, CASE WHEN a.p IS NULL THEN c.tok ELSE low.rank END AS tok
  FROM c CROSS JOIN low LEFT JOIN pick a ON a.p = c.p LEFT JOIN c r ON r.p = a.q LEFT JOIN pick b ON b.q = c.p
  WHERE b.q IS NULL
)
SELECT p, e, tok, lead(tok) OVER (ORDER BY p) AS nxt FROM kept
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks. Bounded: a vocabulary, not data."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(l, r, rank, multi): every pair of tokens whose bytes make a token."""
    left, right, rank, low = [], [], [], set()
    for token, n in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(n)
                low.update(x for x in (a, b) if x > n)
    return pa.table(
        {
            "l": pa.array(left, pa.int32()),
            "r": pa.array(right, pa.int32()),
            "rank": pa.array(rank, pa.int32()),
            "multi": pa.array([n not in low for n in rank], pa.bool_()),
        }
    )


def splitters(pattern: str):
    """(for texts in Latin-1, for others): what splits a text into pieces by pattern, with Unicode's white space."""
    import regex

    full = regex.compile(
        pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    )
    narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTER}{_NUMBER}]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_NUMBER}]")
    narrow = narrow.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    return (re.compile(narrow) if r"\p" not in narrow else full), full


class Numbered(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Codec:
    """Encodes pieces by a rank table in an own in-memory DuckDB."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb

        self.ranks = ranks
        self.narrow, self.full = splitters(pattern)
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "preserve_insertion_order": False, "temp_directory": ""})
        self.two = np.zeros(1 << 16, bool)  # byte pairs that are tokens
        self.three = np.zeros(1 << 21, np.uint8)  # a bit for each three bytes that stand in a token
        for token in ranks:
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = True
            for i in range(len(token) - 2):
                code = token[i] << 16 | token[i + 1] << 8 | token[i + 2]
                self.three[code >> 3] |= 1 << (code & 7)
        self.con.register("given", merge_table(ranks))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.register("given", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "s": [t.decode("latin-1") for t in ranks]}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM given")
        self.con.unregister("given")
        self.forget()

    def forget(self) -> None:
        self.index = Numbered()
        self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.full.findall(text)
        return self.narrow.findall(text)

    def learn(self, pieces: list[str]) -> None:
        """Append the ids of new pieces."""
        raw, spans = [], []
        for piece in (p.encode() for p in pieces):
            parts = [piece] if len(piece) <= LONG else self.cut(piece)
            spans.append((len(raw), len(raw) + len(parts)))
            raw += parts
        ids: list = [None] * len(raw)
        todo = []
        for i, piece in enumerate(raw):
            rank = self.ranks.get(piece)
            if rank is not None:
                ids[i] = np.array([rank], np.int32)
            elif len(piece) > LONG:
                ids[i] = self.contract_long(piece)
            else:
                todo.append(i)
        start = size = 0
        for j, i in enumerate(todo):
            if j > start and size + len(raw[i]) > ROWS:
                self.contract(raw, todo[start:j], ids)
                start, size = j, 0
            size += len(raw[i])
        if start < len(todo):
            self.contract(raw, todo[start:], ids)
        ids = [ids[a] if b == a + 1 else np.concatenate(ids[a:b]) for a, b in spans]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, flat])

    def cut(self, piece: bytes) -> list[bytes]:
        """The piece's parts between places that no token can reach across."""
        x = np.frombuffer(piece, np.uint8).astype(np.int64)
        crossed = self.two[x[:-1] << 8 | x[1:]]
        code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        stands = (self.three[code >> 3] >> (code & 7) & 1).astype(bool)
        crossed[:-1] |= stands
        crossed[1:] |= stands
        at = [0, *(np.flatnonzero(~crossed) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(at[:-1], at[1:])]

    def contract(self, raw: list[bytes], todo: list[int], ids: list) -> None:
        lens = np.fromiter((len(raw[i]) for i in todo), np.int64, len(todo))
        tok = self.byte[np.frombuffer(b"".join(raw[i] for i in todo), np.uint8)]
        ends = np.cumsum(lens)
        p = np.arange(len(tok)) - np.repeat(ends - lens, lens)
        nxt = np.append(tok[1:], -1)
        nxt[ends - 1] = -1
        state = pa.table({"w": np.repeat(np.arange(len(todo)), lens), "p": p, "e": p + 1, "tok": tok, "nxt": nxt})
        found = []
        while state.num_rows:
            self.con.register("init", state)
            out = self.con.sql(_ROUNDS.format(depth=max(8, ROUND_ROWS // state.num_rows))).to_arrow_table()
            self.con.unregister("init")
            done = out["done"].to_numpy()
            found.append(out.filter(pa.array(done)))
            state = out.filter(pa.array(~done)).select(["w", "p", "e", "tok", "nxt"])
        self.con.register("final", pa.concat_tables(found))
        out = self.con.sql("SELECT w, list(tok ORDER BY p) AS ids FROM final GROUP BY w").to_arrow_table()
        self.con.unregister("final")
        lists = out["ids"].combine_chunks()
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for w, a, b in zip(out["w"].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            ids[todo[w]] = flat[a:b]

    def contract_long(self, piece: bytes) -> np.ndarray:
        tok = self.byte[np.frombuffer(piece, np.uint8)]
        p = np.arange(len(tok))
        self.con.register("init", pa.table({"p": p, "e": p + 1, "tok": tok, "nxt": np.append(tok[1:], -1)}))
        self.con.execute("CREATE OR REPLACE TEMP TABLE long AS SELECT * FROM init")
        self.con.unregister("init")
        pairs = "SELECT count(*) FROM long JOIN merges ON l = tok AND r = nxt"
        while self.con.execute(pairs).fetchall()[0][0]:
            self.con.execute(_LONG_ROUND)
            self.con.execute("CREATE OR REPLACE TEMP TABLE long AS SELECT * FROM long_next")
        return self.con.sql("SELECT tok FROM long ORDER BY p").to_arrow_table()["tok"].to_numpy().astype(np.int32)

    def decode(self, runs: list[np.ndarray]) -> list[bytes]:
        """The bytes that each run of ids stands for."""
        out = [b""] * len(runs)
        for start, stop in by_bytes(runs, TOKENS):
            part = runs[start:stop]
            count = np.fromiter(map(len, part), np.int64, len(part))
            flat = np.concatenate(part)
            self.con.register("runs", pa.table({"w": np.repeat(np.arange(start, stop), count), "p": np.arange(len(flat)), "tok": flat}))
            got = self.con.sql("SELECT w, string_agg(s, '' ORDER BY p) AS s FROM runs JOIN vocab USING (tok) GROUP BY w").to_arrow_table()
            self.con.unregister("runs")
            for w, s in zip(got["w"].to_pylist(), got["s"].to_pylist(), strict=True):
                out[w] = s.encode("latin-1")
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """(ids, the bytes that they decode to) of each text."""
        if len(self.index) > MAX_PIECES:
            self.forget()
        index, rows = self.index, []
        for text in texts:
            rows.append(list(map(index.__getitem__, self.split(text))))
        if len(index) > len(self.count):
            self.learn(list(index)[len(self.count) :])
        starts = np.cumsum(self.count) - self.count
        out = []
        for row in rows:
            at = np.array(row, np.int64)
            n = self.count[at]
            ends = np.cumsum(n)
            take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(starts[at], n)
            out.append(self.ids[take])
        return list(zip(out, self.decode(out)))


@lru_cache(maxsize=2)
def _codec(content: bytes, pattern: str) -> Codec:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
    return Codec(ranks, pattern)


_TYPES = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "n_tokens": ("bigint", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded": ("binary", pa.binary()),
    "decoded_sha256": ("string", pa.string()),
}


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", columns=("ids", "decoded")) -> DataFrame:
    """Encode every whole text, then decode the ids: id_col and the columns asked for.

    columns: of ids, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded (bytes) and decoded_sha256. The vocabulary file is read on the driver and sent to the
    tasks; it is bounded. Ids may be null or repeat; other columns of docs are not looked at.
    """
    with open(ranks_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    columns = list(columns)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(content.value, pattern)
        for batch in batches:
            keys, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in by_bytes(texts, BATCH_CHARS):
                made = codec.encode(texts[a:b])
                cells = {
                    "ids": lambda: [ids for ids, _ in made],
                    "n_tokens": lambda: [len(ids) for ids, _ in made],
                    "ids_sha256": lambda: [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids, _ in made],
                    "decoded": lambda: [raw for _, raw in made],
                    "decoded_sha256": lambda: [hashlib.sha256(raw).hexdigest() for _, raw in made],
                }
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), *(pa.array(cells[c](), _TYPES[c][1]) for c in columns)], names=["id", *columns]
                )
        pa.default_memory_pool().release_unused()  # the worker lives on

    schema = ", ".join([f"id {id_type}", *(f"{c} {_TYPES[c][0]}" for c in columns)])
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
