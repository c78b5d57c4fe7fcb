"""Language ID: held-out accuracy, the fused evidence against plain arithmetic, odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from alertloom.llm import language as L

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LANGUAGES = ("en", "de", "fr", "es")


def test_text_alone_finds_the_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = L.train(docs.where("doc_id % 2 = 0"), LANGUAGES)
    rows = L.scored(docs.where("doc_id % 2 = 1 AND n_chars > 100"), table).select("lang", "_scores").collect()
    right = sum(LANGUAGES[int(np.argmax(r._scores[:4]))] == r.lang for r in rows)
    assert len(rows) > 50 and right >= 0.97 * len(rows)


def test_training_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(1, "Ab 12c", "en", "s", 1), (2, None, "de", "s", 1), (3, "ab 34c", " EN ", "s", 1), (4, "zzzz", "xx", "s", 1), (5, "q" * 5000, "fr", "s", 1)], SCHEMA)
    table = np.exp(L.train(docs, ("en", "de", "fr")))
    grams = [g for text in (b"ab 00c", b"ab 00c") for part in L._trigrams(text) for g in part]
    assert len(grams) == 8 and np.isclose(table[0, grams[0]], 0.9 * grams.count(grams[0]) / 8 + 0.1 / L.BUCKETS)
    assert np.allclose(table.sum(axis=1), 1) and np.allclose(table[1], 1 / L.BUCKETS)


def fused(spark, rows, strength=20.0):
    """rows: (id, scores of two languages, n, declared, address, host)"""
    df = spark.createDataFrame(rows, "id long, _scores array<double>, declared string, address string, host string").withColumn("_letters", F.lit(True))
    found = L.fuse(df, ("en", "de"), F.col("declared"), F.col("address"), F.col("host"), strength=strength)
    return {r.id: r for r in found.collect()}


def test_fused_evidence_is_the_product(spark):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-40, 0), draw.uniform(-40, 0), 9.0], draw.choice(["en", "DE-at", "", None]),
             draw.choice(["http://a.org/x", "https://b.de:80/", None, "nonsense"]), draw.choice(["a.x.org", "b.x.org", "x.org", "q.de", None, ""])) for i in range(60)]
    got = fused(spark, rows)
    shares, k = {}, 20.0
    for i, s, *_ in rows:
        odds = [math.exp((x - max(s[:2])) / 3) for x in s[:2]]
        shares[i] = np.array(odds) / sum(odds)
    total = sum(shares.values())
    overall = (total + 1) / (len(rows) + 2)
    suffix = lambda a: a.split("//")[1].split("/")[0].split(":")[0].split(".")[-1] if a and "//" in a else None
    declared = lambda d: d.lower()[:2] if d else None
    domain = lambda h: ".".join(h.split(".")[-2:])

    def given(value, values):
        if value is None:
            return np.zeros(2)
        known = [r for r, v in values if v is not None]
        here = [r for r, v in values if v == value]
        return np.log((sum(shares[r] for r in here) + k * len(here) / len(known)) / (sum(shares[r] for r in known) + k))

    for i, s, d, a, h in rows:
        log = np.array(s[:2]) / 3
        if h:
            mine = [r for r, *_, x in rows if x == h]
            near = [r for r, *_, x in rows if x and domain(x) == domain(h)]
            above = (sum(shares[r] for r in near) + k * overall) / (len(near) + k)
            log += np.log((sum(shares[r] for r in mine) - shares[i] + k * above) / (len(mine) - 1 + k))
        else:
            log += np.log(overall)
        log += given(suffix(a), [(r[0], suffix(r[3])) for r in rows]) + given(declared(d), [(r[0], declared(r[2])) for r in rows])
        p = np.exp(log - log.max())
        assert got[i].language == ("en", "de")[int(np.argmax(log))] and np.isclose(got[i].posterior, p.max() / p.sum())


def test_a_host_decides_for_its_texts_without_evidence(spark):
    rows = [(i, [0.0, -60.0, 30.0], None, None, "en.x.org") for i in range(40)] + [(i, [-60.0, 0.0, 30.0], None, None, "de.y.org") for i in range(40, 80)]
    got = fused(spark, rows + [(100, [0.0, 0.0, 0.0], None, None, "en.x.org"), (101, [0.0, 0.0, 0.0], None, None, "de.y.org"), (102, [0.0, 0.0, 0.0], None, None, "www.y.org")])
    assert (got[100].language, got[101].language, got[102].language) == ("en", "de", "de")
    assert got[100].text_language is None and got[100].posterior > 0.8


def test_odd_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", None, None, 0), (-3, "123 456 !!", "en", "s", 9), (-4, "hi", "en", None, 2),
                                 (None, "the and of the to in", "en", "s", 5), (-5, "�\x01" * 500, "en", "s", 5), (-6, "the " * 40_000, None, None, 1)], SCHEMA)
    both = docs.union(odd).union(odd)
    for name in ("_host", "language", "posterior", "accepted", "_scores", "row"):
        both = both.withColumn(name, F.lit("x"))
    kept = L.accepted_documents(both)
    assert kept.columns == both.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(-4) == 2 and ids.count(None) == 2 and ids.count(-6) == 2 and not {-1, -2, -3} & set(ids)
    assert {r.doc_id for r in docs.collect()} <= set(ids)
    assert L.accepted_documents(odd.limit(0)).count() == 0
