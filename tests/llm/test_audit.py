"""The filter audit against sets of rows, one order at a time."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm.audit import common, difference, filter_audit, found_in, union, unions

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
BLANK = " \t\n\x0b\x0c\r"
LONG = " ".join(f"w{k}" for k in range(250))
ROWS = [
    (1, LONG, "en", "s", 1), (2, LONG, "en", "s", 1), (3, LONG + " #", "en", "s", 1), (4, "few words", "en", "s", 9), (5, None, None, None, None),
    (6, "", "", "s", 0), (7, " \t\n", "de", "s", 3), (8, "SHOUT " * 300, "en", "s", 1), (9, "same " * 300, "fr", "s", 1), (10, "same " * 300, "en", "s", 1),
    (None, LONG, "fr", "s", 1), (None, "nobody", "fr", "s", 1), (11, "dup", "en", "s", 3), (11, "dup", "en", "s", 3), (12, "50 % | $ & *", "de", "s", 1),
    (13, "é " * 250, "fr", "s", 1), (14, LONG.replace("w", "W"), "en", "s", 1), (15, "a b " * 90, "en", "s", 1),
]
MARKS = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, 1, 1), (5, None, 1), (8, 0, 1), (9, 1, None), (11, 1, 0), (11, 0, 1), (99, 1, 1), (None, 1, 1)]


def fails(text, doc_id, rows):
    words = [w for w in "".join(" " if c in BLANK else c for c in text).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    smaller = any((t or "") == text and i is not None and (doc_id is None or i < doc_id) for i, t, *_ in rows)
    return {f for f, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text),
                                          any(c in "#$%&*|" for c in text), smaller), strict=True) if bad}


def expected(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = {}
    for doc_id, text, lang, *_ in rows:
        parts.setdefault(lang or "", []).append((fails(text or "", doc_id, rows), doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic))
    out, removed = [], {}
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = list(range(len(members)))
            for step, f in enumerate(order):
                gone = [k for k in left if f in members[k][0]]
                left = [k for k in left if f not in members[k][0]]
                removed[part, f] = removed.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), step + 1, len(left), len(gone), sum(f in m[0] for m in members) - len(gone),
                            sum(m[0] == {f} for m in members), sum(members[k][1] for k in gone), sum(members[k][2] for k in gone)))
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


def result(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


@pytest.mark.parametrize("bits", [1, 16])
def test_odd_rows_in_ranges_of_any_size(spark, bits):
    df, labels = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(MARKS, LABELS)
    assert result(filter_audit(df, labels, bits)) == expected(ROWS, MARKS)


def test_names_that_clash_and_no_labels(spark):
    df, labels = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([], LABELS)
    for name in ("A", "E", "part", "sha", "words", "good", "_first", "place", "range", "name"):
        df = df.withColumn(name, F.lit("x"))
    assert result(filter_audit(df, labels)) == expected(ROWS, [])


def test_empty_table_and_a_part_that_fails_nothing(spark):
    assert filter_audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame(MARKS, LABELS)).count() == 0
    got = result(filter_audit(spark.createDataFrame(ROWS[:1], SCHEMA), spark.createDataFrame(MARKS, LABELS)))
    assert len(got) == 600 and {r[3:] for r in got} == {(1, 0, 0, 0, 0, 0, 0)}


def test_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert result(filter_audit(docs, labels)) == expected(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_merges_equal_sets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        assert union(a, b).tolist() == sorted({*a.tolist(), *b.tolist()})
        assert difference(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
        assert common(a, b) == len({*a.tolist()} & {*b.tolist()})
        assert found_in(a, b)[1].tolist() == [x in set(a.tolist()) for x in b.tolist()]
    lists = [np.unique(rng.integers(0, 99, 30)) for _ in range(4)]
    for bits, got in unions(lists).items():
        assert got.tolist() == sorted({x for k in range(4) if bits >> k & 1 for x in lists[k].tolist()})
