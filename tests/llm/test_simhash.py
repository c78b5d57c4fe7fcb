"""SimHash: fingerprints, links and components against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from alertloom.llm import simhash
from alertloom.llm.common import components

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest id reachable over links of 3 bits or fewer."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in fps}


def texts(seed=1, n=300):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(400)]
    base = [draw.choices(words, k=draw.choice([1, 2, 5, 60, 300])) for _ in range(n // 5)]
    out = []
    for i in range(n):
        text = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2])):
            text[draw.randrange(len(text))] = draw.choice(words)
        out.append((i, " ".join(text).upper() if i % 7 == 0 else "\t".join(text)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "É é"), (n + 4, "long " * 30_000)]


def check(df, rows):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: g[0] for i, g in got.items()} == fps
    assert {i: g[1] for i, g in got.items()} == brute_components(fps)


def test_components_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("fp", "first", "root", "node", "component_id", "row", "own_id", "kept_id"):
        df = df.withColumn(name, F.lit(1))
    check(df, rows)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(brute_components({i: brute_fingerprint(t) for i, t in rows}).values())


def test_the_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_blocks_of_long_texts(spark):
    words = b" ".join(b"%d" % (i * 7919 % 1000) for i in range(5000))
    assert simhash.fingerprint(words, block=13) == brute_fingerprint(words.decode())


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "other words here now")], SCHEMA)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "component_id").collect()), key=repr)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=repr)
    assert simhash.representatives(df).count() == 3
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("large", [4, 10_000])
def test_dense_buckets_lose_no_link(spark, large):
    """Fingerprints crowded in few bits: buckets are split and still connect the same."""
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 2**63, 4)
    fps = {int(c) ^ int(sum(1 << int(b) for b in draw.choice(64, k, replace=False))) for c in centres for k in range(6) for _ in range(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), large=large)
    rows = links.collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in rows)
    found = {r.node: r.root for r in components(links).collect()}
    wanted = brute_components({s: s & (2**64 - 1) for s in signed})
    assert {s: found.get(s, s) for s in signed} == wanted


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1400)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(5, 5), (3, 2)], "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[i] == 1000 for i in range(1000, 1400))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
