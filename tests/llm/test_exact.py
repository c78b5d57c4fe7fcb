"""Exact duplicates against a dictionary of texts, and the stated results of odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from alertloom.llm.exact import exact_duplicates, kept_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (5, "a b", "en", "s", 3), (3, "ab", "en", "s", 2), (4, "a\tb", "en", "s", 3), (9, None, None, None, None),
    (8, "", "", "", 0), (7, " \n", "en", "s", 2), (1, "x" * 50_000, "en", "s", 1), (2, "x" * 49_999 + "X", "en", "s", 1),
    (None, "only", "en", "s", 4), (11, "é b", "fr", "s", 3), (12, "éb", "fr", "s", 2), (6, "a b", "en", "s", 3),
    (6, "a b", "en", "s", 3), (None, "x" * 50_000, "en", "s", 1), (20, "twice", "en", "s", 5), (20, "twice", "en", "s", 5),
]


def expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(bare, []).append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for bare, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for k, (_, _, doc_id) in enumerate(members):
            out.append((doc_id, members[0][2], len(members), k == 0, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_odd_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert result(exact_duplicates(df)) == expected(ROWS)


def test_names_that_clash_are_not_read(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("_hash", "_bare", "_n", "_keep", "kept", "keep_id", "hash", "row", "rank", "text_sha256"):
        df = df.withColumn(name, F.lit("x"))
    assert result(exact_duplicates(df)) == expected(ROWS)
    assert kept_documents(df).columns == df.columns
    assert kept_documents(df).count() == len({e[4] for e in expected(ROWS)})


def test_equal_hashes_of_other_bytes_stay_apart(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    weak = exact_duplicates(df, hash128=lambda text: F.unhex(F.lpad(F.hex(F.char_length(text) % 3), 32, "0")))
    assert result(weak) == expected(ROWS)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(df).count() == 0 and kept_documents(df).count() == 0


def test_kept_documents_are_the_kept_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in exact_duplicates(df).where("kept").collect()}
    rows = kept_documents(df).collect()
    assert {r.doc_id for r in rows} == kept and len(rows) == len(kept)
    texts = {r.doc_id: tuple(r) for r in df.collect()}
    assert all(tuple(r) == texts[r.doc_id] for r in rows)


@pytest.mark.parametrize("weak", [False, True])
def test_a_large_group(spark, weak):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(
        F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    found = exact_duplicates(df).where("keep_id = 0")
    assert found.count() == 1000 and found.where("kept").count() == 1
