import random
import time

import public_tokenizers
import pytest
import tiktoken

from tallyline.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_encodes_as_the_library_does():
    rng = random.Random(41)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    pools = [range(32, 127), range(0, 256), range(0, 0x300), [*range(0x2000, 0x2070), *range(0x3040, 0x3100), *range(0x1F600, 0x1F640), 32, 10]]
    texts = ["", " ", "a" * 4000, "ab" * 2000, "don't  we'll \n\n x", "\x1c\x85\xa0 　", "$$$ " * 300, "".join(rng.choice("abcdefgh") for _ in range(1600))]
    texts += ["".join(chr(rng.choice(p)) for _ in range(rng.randrange(200))) for p in pools for _ in range(60)]
    for text, (ids, raw) in zip(texts, codec.encode(texts)):
        assert ids.tolist() == ENC.encode_ordinary(text) and raw == text.encode()


def test_forgets_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in ["one two three four five", "six seven one", "two one zzzqqx"]:
        assert codec.encode([text])[0][0].tolist() == ENC.encode_ordinary(text)


def test_frame(spark):
    docs = spark.createDataFrame([(1, "hi  there", 2), (1, "hi  there", 2), (None, None, 3)], "doc_id long, text string, ids int")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, columns=("ids", "n_tokens", "decoded"))
    got = sorted((str(r.doc_id), list(r.ids), r.n_tokens, bytes(r.decoded)) for r in out.collect())
    ids = ENC.encode_ordinary("hi  there")
    assert got == [("1", ids, len(ids), b"hi  there")] * 2 + [("None", [], 0, b"")]
    assert bpe.encode(docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("kind", ["letters", "words", "two letters", "same", "han", "bytes"])
def test_long_runs_without_a_border(kind):
    rng = random.Random(kind)
    english = "the of and to in is that for it as was with be by on not he his but at are this have from which one".split()
    text = {
        "letters": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)),
        "words": lambda: "".join(rng.choice(english) for _ in range(20_000)),
        "two letters": lambda: "".join(rng.choice("ab") for _ in range(5_000)),
        "same": lambda: "a" * 50_001,
        "han": lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(20_000)),
        "bytes": lambda: "".join(rng.choice("!#$%&*+-./:;<=>?@^_|~") for _ in range(20_000)),
    }[kind]()
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    began = time.time()
    ids, raw = codec.encode([text])[0]
    assert time.time() - began < 60
    assert raw == text.encode() and ids.tolist() == ENC.encode_ordinary(text)
