import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

import corpus_pipeline
from tallyline.llm import bpe, pii, quality
from tallyline.llm.common import table

from test_decontam import brute as leaks
from test_simhash import alike, slow_set, smallest_of_classes


def test_pipeline_matches_plain_version(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = [r for r, s in zip(rows, quality._scores([t for _, t in rows], *model)) if s >= 0.5]
    least = set(smallest_of_classes(good))
    single = [r for r in good if r[0] in least]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    hit = {r[0] for r in leaks(single, items) if r[5]}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for k, t in single:
        if k not in hit:
            text = pii.redact(t or "", pii.find(t or ""))
            want[k] = (enc.encode_ordinary(text), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_empty_and_odd_documents(spark, sf_dir):
    plain = table(spark, sf_dir, "documents").schema
    clean = spark.read.parquet(f"{sf_dir}/documents.parquet").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(40).collect()
    good = [r for r in clean if r.text and len(r.text) > 200]
    leak = table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    one, two = good[0], good[-1]
    rows = [(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, None, "en", "s", 0), tuple(one), tuple(one), (None, two.text, "en", "s", 1), (one.doc_id, two.text, "en", "s", 1), (900003, two.text + " " + leak, "en", "s", 1)]
    names = "id h k node row key words fp gone _h _k _gone_id part kind spans".split()
    wide = spark.createDataFrame([(*r, *names) for r in rows], StructType([*plain.fields, *(StructField(n, StringType()) for n in names)]))
    for docs in (wide, wide.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            got = Counter(map(tuple, out.collect()))
            if name != "personal_data":
                assert not got - Counter(map(tuple, docs.collect())), name
            if docs.isEmpty():
                assert not got
            elif name == "near_duplicates":  # no words; the first text; the second one, which stands on two rows, and with the leak on a third
                kept = {(r[0], r[1]) for r in got}
                apart = not alike(slow_set(two.text), slow_set(two.text + " " + leak))
                assert sum(got.values()) == len(kept) == 3 + apart and {(900001, ""), (one.doc_id, one.text), (one.doc_id, two.text)} <= kept
            elif name == "benchmark":
                hit = [r[5] for r in leaks([(i, r[1]) for i, r in enumerate(rows)], items)]
                assert Counter(r[:2] for r in got.elements()) == Counter(tuple(r[:2]) for r, h in zip(rows, hit) if not h) and hit[-1]
            elif name == "personal_data":
                assert Counter(r[0] for r in got.elements()) == Counter(r[0] for r in rows) and sum(n for r, n in got.items() if r[1] is None) == 2
        last = corpus_pipeline.tokenize(spark, docs, sf_dir).collect()
        assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in docs.collect()) and all(r.n_tokens == len(r.ids) for r in last)


def test_very_long_documents(spark, sf_dir):
    rng = np.random.default_rng(9)
    leak = table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    long = " ".join(f"w{n}" for n in rng.integers(0, 5000, 150_000).tolist())
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", 1), (3, long[:300_000] + " " + leak, "en", "s", 1)], table(spark, sf_dir, "documents").schema)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == {1, 3}
    assert {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, sf_dir).collect()} == {1, 2}
    assert corpus_pipeline.keep_quality(spark, docs, sf_dir).count() <= 3
    assert [r.n_chars for r in corpus_pipeline.mask_personal_data(spark, docs.where("doc_id = 1"), sf_dir).collect()] == [len(long)]
    assert corpus_pipeline.tokenize(spark, docs.where("doc_id = 1"), sf_dir).first().decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
