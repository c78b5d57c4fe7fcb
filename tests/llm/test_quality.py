"""The byte network: gradients, whole texts in chunks, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import quality as Q


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 31, 32, 33, 511, 512, 513, 992, 993, 5000):
        text = bytes(1 + k % 250 for k in range(n))
        chunks = Q.chunks_of(text)
        whole = chunks[0].tobytes() + b"".join(c[Q.OVERLAP:].tobytes() for c in chunks[1:])
        assert whole[:n] == text and not any(whole[n:]) and len(whole) - n < Q.CHUNK + Q.OVERLAP


def loss(network, texts, labels, weight):
    p = np.clip(network.scores(texts), 1e-9, 1 - 1e-9)
    return float(np.mean(weight * -(labels * np.log(p) + (1 - labels) * np.log(1 - p))))


def test_gradients_equal_differences():
    draw = np.random.default_rng(1)
    texts = [bytes(draw.integers(97, 123, n).tolist()) for n in (20, 700, 1500)]
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 2.0])
    network = Q.Network()
    for name in ("embedding", "filters", "bias", "weights", "offset"):
        setattr(network, name, (getattr(network, name) + draw.normal(0, 0.1, getattr(network, name).shape)).astype(np.float64))
    network.embedding[0] = 0
    chunks = [Q.chunks_of(t) for t in texts]
    owner = np.repeat(np.arange(3), [len(c) for c in chunks])
    found = network.gradients(np.concatenate(chunks), owner, labels, weight)
    for p, g in zip(network.parameters(), found):
        flat, grad = p.reshape(-1), g.reshape(-1)
        for k in draw.choice(len(flat), min(6, len(flat)), replace=False):
            if p is network.embedding and k < Q.DEPTH:
                continue
            old, step = flat[k], 1e-5
            flat[k] = old + step
            up = loss(network, texts, labels, weight)
            flat[k] = old - step
            down = loss(network, texts, labels, weight)
            flat[k] = old
            assert abs((up - down) / (2 * step) - grad[k]) < 1e-4 + 1e-3 * abs(grad[k])


def test_scores_depend_on_the_text_alone():
    draw = np.random.default_rng(2)
    texts = [bytes(draw.integers(32, 127, n).tolist()) for n in (0, 5, 600, 200_000, 40, 3000)]
    network = Q.Network()
    network.weights[:] = draw.normal(0, 1, network.weights.shape)
    together = network.scores(texts)
    assert np.allclose(together, [network.scores([t])[0] for t in texts], atol=1e-6)
    changed = texts[3][:-20] + b"\xff" * 20
    assert network.scores([changed])[0] != pytest.approx(together[3], abs=1e-12)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, Q.train(docs, labels)


def test_held_out_accuracy(trained):
    docs, labels, network = trained
    rows = Q.quality_scores(docs, network).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and np.mean([r.predicted == r.quality for r in held]) >= 0.93
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_not_learned_from(spark, trained):
    docs, labels, network = trained
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id"), 5), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.train(docs.drop("lang", "source").withColumn("source", F.lit("x")), flipped)
    assert all(np.array_equal(a, b) for a, b in zip(network.parameters(), again.parameters()))


def test_odd_rows(spark, trained):
    network = trained[2]
    rows = [(1, None), (2, ""), (None, "text"), (3, "é" * 90_000), (4, "same"), (4, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))
    found = Q.quality_scores(df, network).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert found[0].score == found[1].score and found[4].score == found[5].score
    assert Q.quality_scores(df.limit(0), network).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.train(df.drop("score", "held_out"), none).scores([b"anything"]) == [0.5]
