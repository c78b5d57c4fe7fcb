"""Repeated passages against a count of all windows, and the automaton against plain search."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from alertloom.llm import substring

SCHEMA = "doc_id long, text string"


def brute(docs, window):
    counts = collections.Counter()
    for _, text in docs:
        words = (text or "").encode().split()
        counts.update(tuple(words[j:j + window]) for j in range(len(words) - window + 1))
    out = []
    for doc_id, text in docs:
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for j in range(len(words) - window + 1):
            if counts[tuple(words[j:j + window])] > 1:
                covered[j:j + window] = [True] * window
        kept = [w for w, c in zip(words, covered) if not c]
        out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def result(df, window, **options):
    return sorted((tuple(r)[:4] for r in substring.without_repeats(df, window, **options).collect()), key=repr)


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=4))
    passage = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 34, 200)]
    common = [word() for _ in range(35)]
    docs = []
    for i in range(160):
        words = [word() for _ in range(draw.choice([0, 3, 34, 35, 80, 300]))]
        for _ in range(draw.choice([0, 1, 2])):
            p = draw.choice(passage)
            at = draw.randrange(len(words) + 1)
            words[at:at] = p[draw.choice([0, 0, 1]):]
        if i % 3 == 0:
            at = draw.randrange(len(words) + 1)
            words[at:at] = common
        docs.append((i, draw.choice([" ", "\t", " \n"]).join(words)))
    repeated = [word() for _ in range(50)]
    docs += [(500, None), (501, ""), (502, "x " * 120), (503, " ".join(repeated + [word()] + repeated)), (504, docs[3][1]), (504, docs[3][1]),
             (None, docs[7][1]), (505, " ".join(word() for _ in range(60_000))), (506, "É é " * 40)]
    return docs


@pytest.mark.parametrize("options", [{}, {"large": 2}, {"shard_words": 100}])
def test_equals_brute_force(spark, options):
    docs = corpus(len(options))
    df = spark.createDataFrame(docs, SCHEMA)
    for name in ("id", "k", "anchor", "place", "covers", "n_words"):
        df = df.withColumn(name, F.lit("x"))
    assert result(df, 35, **options) == brute(docs, 35)


def test_other_windows_and_empty_table(spark):
    docs = corpus(9)[:60]
    df = spark.createDataFrame(docs, SCHEMA)
    assert result(df, 12, anchor=3) == brute(docs, 12)
    assert substring.without_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring.without_repeats(df, window=200)


def test_the_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(df, 35) == brute([(r.doc_id, r.text) for r in df.collect()], 35)


def test_automaton_counts_every_span():
    draw = random.Random(4)
    texts = [[draw.choice("ab") for _ in range(draw.randrange(12))] for _ in range(12)]
    automaton = substring.SuffixAutomaton()
    for k, text in enumerate(texts):
        automaton.add(text, 1 + k % 2)
    automaton.finish()
    counts = collections.Counter()
    for k, text in enumerate(texts):
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                counts[tuple(text[i:j])] += 1 + k % 2
    for text in texts:
        for end, length in enumerate(automaton.repeats(text), 1):
            assert length == max([n for n in range(end + 1) if counts[tuple(text[end - n:end])] > 1 or n == 0])
    probe = [draw.choice("abc") for _ in range(40)]
    for end, length in enumerate(automaton.statistics(probe), 1):
        assert length == max(n for n in range(end + 1) if n == 0 or tuple(probe[end - n:end]) in counts)


def test_spans_in_a_given_reference(spark):
    draw = random.Random(6)
    words = ["w%d" % draw.randrange(1000) for _ in range(300)]
    reference = spark.createDataFrame([(" ".join(words[:100]),), (" ".join(words[100:200]),), (None,)], "text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[20:70]) + " c"), (2, " ".join(words[60:94])), (3, None), (4, " ".join(words[50:150]))], SCHEMA)
    for size in (200_000, 100):
        got = sorted((r.doc_id, r.begin, r.end) for r in substring.spans_in_reference(docs, reference, 35, shard_words=size).collect())
        assert got == [(1, 2, 52), (4, 0, 50), (4, 50, 100)]
    with pytest.raises(ValueError):
        substring.spans_in_reference(docs, reference, shard_words=10, most_shards=2)
    assert substring.spans_in_reference(docs, reference.limit(0)).count() == 0


def test_spans_of_the_benchmark_equal_trying_every_start(spark, sf):
    """The registered query against every start of every document."""
    from alertloom.llm import queries

    reference = [r.text.encode().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    starts = {}
    for k, words in enumerate(reference):
        for i in range(len(words) - 12):
            starts.setdefault(b" ".join(words[i:i + 13]), []).append((k, i))
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words, reach = (r.text or "").encode().split(), 0
        for begin in range(len(words) - 12):
            ends = []
            for k, i in starts.get(b" ".join(words[begin:begin + 13]), ()):
                n = 13
                while begin + n < len(words) and i + n < len(reference[k]) and words[begin + n] == reference[k][i + n]:
                    n += 1
                ends.append(begin + n)
            if ends and max(ends) > reach:
                reach = max(ends)
                want.add((r.doc_id, begin, reach))
    got = [tuple(r) for r in queries.reference_spans(spark, sf).select("doc_id", "begin", "end").collect()]
    assert sorted(got) == sorted(want) and len(want) >= 3
