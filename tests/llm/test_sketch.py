"""Sketches: the retained hashes, merging, and the edit trial against plain Python."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from alertloom.llm import sketch
from alertloom.llm.common import mixed, span_hashes

SCHEMA = "doc_id long, text string"


def shingles(text):
    data = text.encode()
    return {data[i:i + sketch.WIDTH] for i in range(max(1, len(data) - sketch.WIDTH + 1))} if data else set()


def hash_of(shingle):
    values = mixed(np.frombuffer(shingle, np.uint8).astype(np.uint64))
    return int(span_hashes(values, np.array([0]), np.array([len(values)]))[0])


def brute(text):
    hashes = sorted({hash_of(s) for s in shingles(text)})
    return [h for h in hashes if h < 2**64 // sketch.SCALE] or hashes[:1]


def documents(n=80):
    draw = random.Random(5)
    out = [(i * 3, "".join(draw.choices("abcdé fgh日\n", k=draw.choice([0, 1, 2, 3, 11, 12, 13, 40, 900])))) for i in range(n)]
    return out + [(10_000, None), (10_003, "long é " * 60_000), (-5, "same text here"), (-8, "same text here")]


def test_sketch_retains_what_lies_below_the_threshold():
    for _, text in documents(40):
        assert sketch.sketch((text or "").encode()).tolist() == brute(text or "")


def check(rows, docs):
    order = sorted(docs, key=lambda d: -d[0])
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for k, (doc_id, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        changed = text[:len(text) - third] + other[:third]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        a, b, c = (np.array(brute(t), np.uint64) for t in (text, changed, other))
        assert r.fingerprint == sketch.as_text(a) and r.edited_fingerprint == sketch.as_text(b)
        assert np.isclose(r.near_edited, sketch.likeness(a, b)[0]) and np.isclose(r.near_next, sketch.likeness(a, c)[0])


def test_edit_trial(spark):
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA)
    for name in ("place", "ahead", "packed", "fingerprint", "n_chars"):
        df = df.withColumn(name, F.lit("x"))
    check(sketch.edit_trial(df.repartition(5)).collect(), docs)
    check(sketch.edit_trial(df.repartition(5), bytes_a_range=20_000).collect(), docs)


def test_few_and_odd_rows(spark):
    one = spark.createDataFrame([(7, "abcdefghi")], SCHEMA)
    check(sketch.edit_trial(one).collect(), [(7, "abcdefghi")])
    assert sketch.edit_trial(one.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x"), (None, "y"), (4, "abc"), (4, "abc"), (4, "abd"), (9, "abcdef")], SCHEMA)
    assert sorted(r.doc_id or 0 for r in sketch.edit_trial(odd).collect()) == [0, 0, 4, 4, 4, 9]


def test_equal_texts_are_alike_and_parts_are_contained():
    draw = random.Random(1)
    whole = "".join(draw.choices("abcdefghij ", k=40_000)).encode()
    part = whole[5_000:9_000]
    near, inside = sketch.likeness(sketch.sketch(part), sketch.sketch(whole))
    assert inside == 1.0 and near < 0.2
    assert sketch.likeness(sketch.sketch(whole), sketch.sketch(whole)) == (1.0, 1.0)


def test_merged_sketches_are_unions(spark):
    docs = documents(30)
    df = spark.createDataFrame(docs, SCHEMA).withColumn("source", (F.col("doc_id") % 3).cast("string"))
    rows = sketch.merged_sketches(df, "source").collect()
    want = {}
    for doc_id, text in docs:
        want.setdefault(str(int(np.fmod(doc_id, 3))), set()).update(h for h in brute(text or "") if h < 2**64 // sketch.SCALE)
    got = {}
    for r in rows:
        got.setdefault(r.source, set()).add(r.hash & (2**64 - 1))
    assert got == {k: v for k, v in want.items() if v}


def test_sketches_of_rows(spark):
    rows = sketch.document_sketches(spark.createDataFrame([(1, "abc"), (2, None), (3, "abc")], SCHEMA)).collect()
    assert [r.fingerprint for r in rows][1] == "" and rows[0].fingerprint == rows[2].fingerprint != ""


def test_a_group_of_short_texts_merges_to_the_sketch_of_its_shingles(spark):
    """Hashes that stand in for short texts are not in the union."""
    draw = random.Random(8)
    texts = ["".join(draw.choices("abcdefgh", k=draw.randrange(1, 24))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "g") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.hash & (2**64 - 1) for r in sketch.merged_sketches(df, "source").collect()}
    assert got == {h for t in texts for h in map(hash_of, shingles(t)) if h < 2**64 // sketch.SCALE}
    assert 100 < len(got) < len(texts) * 10


def test_likeness_of_short_texts():
    """60 characters, a third of them changed: the error that README gives."""
    draw, errors = random.Random(9), []
    for _ in range(300):
        text = "".join(draw.choices("abcdefgh ij", k=60))
        other = text[:40] + "".join(draw.choices("abcdefgh ij", k=20))
        a, b = shingles(text), shingles(other)
        errors.append(sketch.likeness(sketch.sketch(text.encode()), sketch.sketch(other.encode()))[0] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.15


def test_ranges_of_ids_of_any_distribution(spark):
    draw = random.Random(10)
    ids = [*range(500), *(10**12 + k for k in range(300)), 2**62, -(2**62), *draw.choices(range(10**9), k=100)] + [77] * 400
    df = spark.createDataFrame([(i, "x" * 99) for i in ids] + [(None, "y")], SCHEMA)
    cuts = sketch.id_cuts(df, 4, 2_000)
    counts = np.bincount(np.searchsorted(np.array(cuts, np.int64), np.array(ids, np.int64), "left"))
    assert cuts == sorted(set(cuts)) and max(c for c in counts) <= 400 + 45 and len(cuts) > 30
    assert sketch.id_cuts(df.limit(0), 4, 2_000) == []
