import hashlib
import random
from collections import Counter

from tallyline.llm import chat


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        yield conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip(spark):
    rng = random.Random(31)
    bits = [*chat.CONTROL, chat.ESCAPE, "\n", "a", "é日", chat.START, chat.END, "z", "<", "|", ">", chat.ESCAPE + "b"]
    rows = []
    for conv in [*range(20), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "as\nsistant" + chat.ESCAPE]), rng.choice([None, "", "".join(rng.choices(bits, k=rng.randrange(12)))])))
    rows += [rows[0], rows[0], (2, None, "assistant", "x"), (77, 0, "assistant", "y" * 100_000), (78, 1, "assistant", "</s>[INST] ok" * 200_000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, message int")
    rendered = chat.render(chat.fold(chat.from_turns(turns)))
    got = Counter(tuple(r)[:5] for r in chat.read_back(rendered).collect())
    assert got == Counter(brute(rows))
    whole = {r.conv_id: len(r.formatted) for r in chat.assemble(rendered).collect()}
    assert whole == {r.conv_id: r.formatted_chars for r in chat.read_back(rendered).collect()}
    assert chat.read_back(chat.render(chat.fold(chat.from_turns(turns.limit(0))))).count() == 0


def test_fold(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"),
        (1, 1, "message", 1, "assistant", ""),
        (1, 2, "delta", 1, "", "he"),
        (1, 3, "delta", 1, "", "llo"),
        (1, 4, "message", 2, "user", "more"),
        (1, 5, "edit", 0, "", "hey"),
        (1, 6, "regenerate", 1, None, None),
        (1, 7, "delta", 1, "assistant", "good "),
        (1, 8, "delta", 1, None, "day"),
        (2, 0, "message", 0, "user", "a"),
        (2, 1, "message", 1, "user", "b"),
        (2, 2, "delete", 0, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    got = sorted(tuple(r) for r in chat.fold(events).collect())
    assert got == [(1, 0, "user", "hey"), (1, 1, "assistant", "good day"), (2, 1, "user", "b")]


def replay(log):
    """Event by event."""
    found = {}
    events = sorted(log, key=lambda e: (e[0] is not None, e[0] or 0, e[1] is not None, e[1] or 0, e[2], e[4] or "", e[5] or ""))
    cuts = [e for e in log if e[2] == "regenerate"]
    for conv, seq, kind, message, role, text in events:
        if kind == "regenerate" or any(c[0] == conv and None not in (seq, message, c[1], c[3]) and seq < c[1] and message >= c[3] for c in cuts):
            continue
        key = (conv, message)
        if kind == "delete":
            found.pop(key, None)
            continue
        was = found.get(key, ("", ""))
        found[key] = (role or was[0], was[1] + (text or "") if kind == "delta" else text or "")
    return Counter((*k, *v) for k, v in found.items())


def test_fold_against_replay(spark):
    rng = random.Random(32)
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", "delete"]
    log = []
    for conv in [*range(60), None]:
        for seq in range(rng.randrange(25)):
            log.append((conv, rng.choice([seq, seq, seq, seq // 2, None]), rng.choice(kinds), rng.choice([0, 1, 2, 3, 3, None]), rng.choice([None, "", "user", "assistant"]), rng.choice([None, "", "a", "bc", "é "])))
    log += [log[3], log[3]]
    log += [(500, i, "delta", 1, "assistant", "word ") for i in range(20_000)]
    events = spark.createDataFrame([(*e, "x") for e in log], "conv_id long, seq long, kind string, message long, role string, text string, cut string")
    assert Counter(tuple(r) for r in chat.fold(events).collect()) == replay(log)
    assert chat.fold(events.limit(0)).count() == 0
