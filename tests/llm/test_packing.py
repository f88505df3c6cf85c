import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, id string, start int, ids string"


@pytest.fixture(scope="module")
def library():
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    return lambda text: model.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, pieces, library, capacity):
    """Every id of every document lies in one piece; sequences are gapless and hold capacity ids or a power of two of them."""
    want = defaultdict(list)
    for key, text in rows:
        want[key].append(library(text))
    got = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        got[p.doc_id].append(p)
    assert set(got) == set(want)
    for key, texts in want.items():
        if len(texts) == 1:
            own = sorted(got[key], key=lambda p: p.start)
            assert [i for p in own for i in p.ids] == texts[0]
            assert [p.start for p in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
            assert {p.doc_tokens for p in own} == {len(texts[0])}
        else:
            assert sum(p.length for p in got[key]) == sum(map(len, texts))
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        total = sum(p.length for p in own)
        assert total == capacity or total < capacity and total & (total - 1) == 0
    return sequences


def corpus(rng, n):
    words = ["paper", "Straße", "el niño", "42", "don't", "  ", "\n\n", "x" * 40, "日本語", "…", "<|endoftext|>", " ", "á"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(int(rng.expovariate(1 / 150))))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, "no id"), (n + 2, "same"), (n + 2, "same"), (n + 3, "long text " * 30_000)]


@pytest.mark.parametrize("capacity", [2048, 100])
def test_pieces(spark, library, capacity):
    rows = corpus(random.Random(capacity), 150)
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    pieces = packing.pack(docs, PATH, public_tokenizers.PATTERN, capacity=capacity, with_ids=True).collect()
    sequences = check(rows, pieces, library, capacity)
    total = sum(p.length for p in pieces)
    assert len(sequences) <= total / capacity + 3 * capacity.bit_length()
    assert packing.pack(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_driver_table(spark, library, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], pieces, library, 2048)


def test_fullest_is_the_best_multiset():
    rng = random.Random(9)
    for _ in range(300):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        capacity = rng.randrange(1, 90)
        best = max(s for n in product(*(range(c + 1) for c in counts.values())) if (s := sum(a * b for a, b in zip(counts, n))) <= capacity)
        used = packing.fullest(counts, capacity)
        assert sum(a * b for a, b in used.items()) == best and all(0 < b <= counts[a] for a, b in used.items())


def test_pool_keeps_a_bounded_number_waiting():
    packer = packing.Packer(64)
    rng = random.Random(2)
    for k in range(2000):
        packer.add(k, np.arange(rng.randrange(1, 150)))
        if packer.total > 10_000:
            packer.fill(5_000)
            assert packer.total <= 5_000
    packer.end()
    assert packer.total == 0 and not packer.lengths
    cut = [p for p in packer.pieces if len(p[2]) < 64 and p[3] < 64 and len(p[2]) < p[3]]
    assert len(cut) <= 20  # short documents are hardly ever cut: multisets fill windows
