"""Language-model scores: counts and base against a dictionary, probabilities that sum to 1."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import lm

SCHEMA = "doc_id long, text string"


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute(docs):
    counts = collections.Counter()
    for doc_id, text in docs:
        if zlib.crc32((str(doc_id) if doc_id is not None else "").encode()) % 10:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in docs:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        out.append((doc_id, zlib.crc32((str(doc_id) if doc_id is not None else "").encode()) % 10 == 0, len(own), sum(counts[t] > 0 for t in own), n, round(base, 5)))
    return sorted(out, key=repr)


def result(df, **options):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in lm.scores(df, **options).collect()), key=repr)


@pytest.mark.parametrize("head", [1 << 20, 40, 1])
def test_base_equals_brute_force(spark, sf, head):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:90]
    docs += [(1000, None), (1001, ""), (1002, "É é Éa unseen\x0bword"), (None, "no id"), (1003, "the " * 30_000), (1004, "twice twice"), (1004, "twice twice"), (1005, "a")]
    df = spark.createDataFrame(docs, SCHEMA)
    for name in ("h", "row", "rare", "logs", "score", "classes"):
        df = df.withColumn(name, F.lit("x"))
    got, want = result(df, head=head), brute(docs)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-4)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lm.scores(df).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = lm.scores(spark.createDataFrame([(held, "a b")], SCHEMA)).collect()[0]  # nothing to learn from
    assert (only.n_tokens, only.n_known, only.train_tokens) == (3, 0, 0) and np.isfinite(only.score)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train = docs.where(~lm.held_out(F.col("doc_id"), 10))
    counts = lm.token_counts(train).cache()
    return docs, counts, lm.learn_model(train, counts)


def test_probabilities_of_a_place_sum_to_one(model):
    _, counts, m = model
    z = m.logits(lm.features(*contexts(m)))
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    rows = counts.toPandas()
    place = m.class_of[rows["tail"].to_numpy()]
    sizes = m.class_tokens + 0.1 * (m.class_types + 1)
    inside = np.bincount(place, (rows["c"] + 0.1) / sizes[place], lm.CLASSES) + 0.1 / sizes
    assert np.allclose(inside, 1) and np.allclose(p @ inside, 1)


def contexts(m):
    hashes, tails = lm.tokens_of([b"the and of", b"der die das", b""])
    return hashes, m.class_of[tails]


def test_a_text_does_not_depend_on_its_neighbours(model):
    m = model[2]
    alone = [m.class_log(h, m.class_of[t]) for h, t in (lm.tokens_of([x]) for x in (b"one two", b"", b"three four five"))]
    hashes, tails = lm.tokens_of([b"one two", b"", b"three four five"])
    assert np.allclose(np.concatenate(alone), m.class_log(hashes, m.class_of[tails]))


def test_held_out_texts_are_likelier_than_by_single_words(spark, model):
    rows = [r for r in lm.scores(model[0]).collect() if r.held_out]
    assert len(rows) > 50
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain > 0.05
