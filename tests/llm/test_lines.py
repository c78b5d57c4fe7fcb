"""Line dedup against a dictionary of lines, and runs that grow by batches."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from alertloom.llm.lines import LineRuns, frequent_lines, line_hash, without_frequent_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def expected(rows, least):
    docs = Counter(k for _, text, *_ in rows for k in {key(x) for x in (text or "").split("\n")})
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or docs[key(x)] < least]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text").collect()), key=repr)


ROWS = [
    (1, "Menu\nfirst text\n", "en", "s", 1), (2, " \tmenu\r\nsecond\nmenu", "en", "s", 1), (3, "MENU \n\n\nthird", "en", "s", 1),
    (4, None, None, None, None), (5, "", "en", "s", 0), (6, "\n\n\n", "en", "s", 3), (None, "menu", "en", "s", 4),
    (7, "twice\nown", "en", "s", 9), (7, "twice\nown", "en", "s", 9), (8, "É Menu\nÄ", "fr", "s", 6), (9, "é menu\nÄ", "fr", "s", 6),
    (10, "menu\n" * 20_000 + "end", "en", "s", 1), (11, " menu", "en", "s", 5), (12, "x" * 100_000, "en", "s", 1),
]


@pytest.mark.parametrize("least", [1, 2, 4])
def test_odd_rows(spark, least):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert result(without_frequent_lines(df, least, batches=3)) == expected(ROWS, least)


def test_names_that_clash_are_not_read(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("hash", "batch", "_own", "gone", "lines", "keys", "kept_text", "place", "n"):
        df = df.withColumn(name, F.lit("x"))
    assert result(without_frequent_lines(df, 4, batches=2)) == expected(ROWS, 4)


def test_empty_table(spark):
    assert without_frequent_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert result(without_frequent_lines(df, 3)) == expected(rows, 3)


@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_grow_by_batches_and_stay_few(spark, fanout):
    runs = LineRuns(spark, least=5, fanout=fanout, buckets=2)
    seen = Counter()
    for batch in range(7):
        words = [f"w{k}" for k in range(batch, batch + 6)] + ["always"] * 2
        seen.update(words)
        runs.add(spark.createDataFrame([(w,) for w in words], "key string").select(line_hash(F.col("key")).alias("hash")))
        assert all(len(level) < fanout for level in runs.levels) and len(runs.settled) <= 1
        got = [bytes(r.hash) for r in runs.frequent().collect()]
        assert len(got) == len(set(got))
        assert set(got) == {hashlib.md5(w.encode()).digest() for w, n in seen.items() if n >= 5}
    runs.close()


def test_a_settled_line_is_not_stored_again(spark):
    runs = LineRuns(spark, least=3, fanout=2, buckets=2)
    batch = spark.createDataFrame([("hot",)] * 4 + [("rare",)], "key string").select(line_hash(F.col("key")).alias("hash"))
    runs.add(batch), runs.add(batch)
    runs.add(batch)
    assert [r.n for r in spark.table(runs.levels[0][0]).collect()] == [1]
    assert [bytes(r.hash) for r in runs.frequent().collect()].count(hashlib.md5(b"hot").digest()) == 1


def test_runs_merge_without_a_shuffle(spark):
    runs = LineRuns(spark, least=3, fanout=4, buckets=2)
    for k in range(3):
        runs.add(spark.range(20).select(line_hash((F.col("id") + k).cast("string")).alias("hash")))
    plan = runs._merged(runs.levels[0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("Bucketed: true") == 3


def test_a_line_of_every_document(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Subscribe now\nbody "), F.col("id").cast("string")).alias("text"))
    found = without_frequent_lines(df)
    assert found.where("n_lines = 2 AND n_dropped = 1").count() == 2000
    assert frequent_lines(df).count() == 1
