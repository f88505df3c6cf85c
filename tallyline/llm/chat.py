"""Chat formatting: conversations are rebuilt from their event logs, then rendered.

A log row is an event (conv_id, seq, kind, message, role, text). Kinds: `message` sets a message,
`delta` appends to it, `edit` replaces its text, `regenerate` throws away the message and all
that follow it, so that later events write them anew, `delete` takes one message out. Events of a
conversation count in the order of seq, ties by kind, role and text.

Each message is folded on its own (conversation, message) key, so a conversation that holds much of
the log is folded by many tasks; only what has been rendered meets in the order of messages, as
one row per turn, and is read as a stream that holds one turn at a time.

The template marks a turn as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts, control
strings are split by an escape character, so no text can end its turn; reading takes the escapes
back. The loss mask covers assistant texts. Null roles and texts count as empty. Repeated rows
are turns of their own in from_turns(). An empty log gives no rows. Very long texts are rendered and read whole, one at a
time. Columns that are not named here don't matter, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that chat templates use for control.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
ESCAPE = "␛"
#: In this order: the escape character itself, then the control strings, each as escape and a letter; in roles the line break too.
_CODES = [(ESCAPE, ESCAPE + "a")] + [(c, ESCAPE + chr(ord("b") + i)) for i, c in enumerate(CONTROL)]
_ROLE_CODES = [*_CODES, ("\n", ESCAPE + "z")]
_BACK = {code[1]: plain for plain, code in _ROLE_CODES}
_CODE = re.compile(ESCAPE + "(.)")


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in _ROLE_CODES if role else _CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _BACK[m[1]], text) if ESCAPE in text else text


def from_turns(turns: DataFrame) -> DataFrame:
    """The log of a table (conv_id, turn, role, text): one message event a row, in the order of turn, then role and text."""
    rows = turns.select("conv_id", "turn", *(F.coalesce(turns[c], F.lit("")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("message", F.row_number().over(order).cast("bigint")).select(
        "conv_id", F.col("message").alias("seq"), F.lit("message").alias("kind"), "message", "role", "text"
    )


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of each conversation. Events without a message number form one message."""
    rows = events.select("conv_id", "seq", "kind", "message", *(F.coalesce(events[c], F.lit("")).alias(c) for c in ("role", "text")))
    # a regeneration undoes what earlier events wrote at its message and after it: a message's events count from the
    # latest regeneration up to it, a running maximum over the (few, narrow) messages of conversations that have one
    cuts = rows.where("kind = 'regenerate'").groupBy("conv_id", "message").agg(F.max("seq").alias("cut"))
    cuts = cuts.where("message IS NOT NULL")
    met = rows.where("message IS NOT NULL").select("conv_id", "message").distinct()
    convs = cuts.select(F.col("conv_id").alias("cut_conv")).distinct()
    met = met.join(convs, F.col("conv_id").eqNullSafe(F.col("cut_conv")), "left_semi")
    met = met.select("conv_id", "message", F.lit(None).cast("bigint").alias("cut")).unionByName(cuts.withColumn("cut", F.col("cut").cast("bigint")))
    met = met.groupBy("conv_id", "message").agg(F.max("cut").alias("cut"))
    order = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    since = met.select(F.col("conv_id").alias("cut_conv"), F.col("message").alias("cut_message"), F.max("cut").over(order).alias("since")).where("since IS NOT NULL")
    same = F.col("conv_id").eqNullSafe(F.col("cut_conv")) & (F.col("message") == F.col("cut_message"))
    alive = rows.where("kind <> 'regenerate'").join(since, same, "left").where(F.coalesce(F.col("seq") >= F.col("since"), F.lit(True)))
    event = F.struct("seq", "kind", "role", "text")
    folded = alive.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))

    def last(log: str, test):
        """Place of the last event of which test holds, counted from 1, or 0."""
        return F.coalesce(F.array_max(F.transform(log, lambda e, i: F.when(test(e), i + 1).otherwise(0))), F.lit(0))

    # what counts follows the last deletion; its text begins where it was set last, and deltas are joined once
    after = folded.withColumn("gone", last("log", lambda e: e["kind"] == "delete"))
    after = after.select("conv_id", "message", F.slice("log", F.col("gone") + 1, F.size("log")).alias("log")).where(F.size("log") > 0)
    after = after.withColumn("begin", F.greatest(last("log", lambda e: e["kind"] != "delta"), F.lit(1)))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r != "")
    texts = F.transform(F.slice("log", F.col("begin"), F.size("log")), lambda e: e["text"])
    return after.select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(texts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, message, formatted, loss_start, loss_end): each turn under the template.

    A conversation's output is its turns' formatted texts in the order of message. The loss
    offsets are code points within the turn; null where no loss falls on it.
    """
    head = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit(BREAK))
    own = F.col("role") == "assistant"
    return messages.withColumns({"head": head, "body": escape(F.col("text"))}).select(
        "conv_id",
        "message",
        F.concat("head", "body", F.lit(END)).alias("formatted"),
        F.when(own, F.length("head")).alias("loss_start"),
        F.when(own, F.length("head") + F.length("body")).alias("loss_end"),
    )


def assemble(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations as one text, for those that fit into a row."""
    turns = F.array_sort(F.collect_list(F.struct("message", "formatted")))
    return rendered.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(F.transform("turns", lambda t: t["formatted"]), "").alias("formatted"))


class _Reader:
    """Reads one conversation's output piece by piece; holds at most the turn that isn't ended."""

    def __init__(self):
        self.turns = self.chars = self.loss = 0
        self.all, self.masked, self.rest = hashlib.sha256(), hashlib.sha256(), ""

    def feed(self, piece: str) -> None:
        self.chars += len(piece)
        self.rest += piece
        *ended, self.rest = self.rest.split(END)
        for turn in ended:
            head, found, body = turn.partition(BREAK)
            if not found or not head.startswith(START):
                raise ValueError("not a formatted turn")
            role, text = unescape(head[len(START) :]), unescape(body)
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())

    def mask(self, piece: str, start: int | None, end: int | None) -> None:
        if start is not None:
            text = unescape(piece[start:end])
            self.loss += len(text)
            self.masked.update(text.encode())

    def row(self, conv):
        if self.rest:
            raise ValueError("the last turn isn't ended")
        return conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def read_back(rendered: DataFrame) -> DataFrame:
    """What the formatted output says: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Conversations are sorted streams; one that is very long costs its task time, not memory.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        reader, conv, out = None, None, []
        for batch in batches:
            for key, formatted, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or key != conv:
                    if reader is not None:
                        out.append(reader.row(conv))
                    reader, conv = _Reader(), key
                reader.feed(formatted)
                reader.mask(formatted, start, end)
            if out:
                yield _table(out)
                out = []
        if reader is not None:
            yield _table([reader.row(conv)])

    def _table(rows):
        cells = list(zip(*rows))
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    n = int(rendered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rendered.repartition(n, "conv_id").sortWithinPartitions("conv_id", "message")
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return sent.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)


#: The same digests in DuckDB, with the escaped length by the same codes.
_LENGTH = "length({c}) + (length({c}) - length(replace({c}, '␛', '')))" + "".join(
    f" - {len(c) - 2} * (length({{c}}) - length(replace({{c}}, '{c}', ''))) // {len(c)}" for c in CONTROL
)
DIGEST_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), one AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    {len(START) + len(BREAK) + len(END)} + length(role) + ({_LENGTH.format(c="text")}) AS chars
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM one GROUP BY conv_id
"""
