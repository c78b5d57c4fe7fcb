"""Raking to marginals and the calibrated draw."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rake_meets_the_marginals_and_keeps_odds():
    draw = np.random.default_rng(0)
    mass = draw.random((4, 3, 2)) + 0.1
    targets = [draw.dirichlet(np.ones(n)) for n in mass.shape]
    table = M.rake(mass, targets)
    for k, t in enumerate(targets):
        assert np.allclose(table.sum(axis=tuple(a for a in range(3) if a != k)), t, atol=1e-8)
    ratio = table / mass  # interaction terms are untouched
    assert np.isclose(ratio[0, 0, 0] * ratio[1, 1, 0], ratio[0, 1, 0] * ratio[1, 0, 0])


def test_rake_leaves_out_what_has_no_mass():
    table = M.rake(np.array([[1.0, 0.0], [3.0, 0.0]]), [np.array([0.5, 0.5]), np.array([0.3, 0.7])])
    assert np.allclose(table, [[0.5, 0], [0.5, 0]])
    assert M.rake(np.zeros((2, 2)), [np.ones(2) / 2] * 2).sum() == 0


@pytest.mark.parametrize("share", [None, 0.5])
def test_draw_approaches_the_targets(spark, share):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + int(id % 7))").alias("text"),
                                    F.expr("CASE WHEN id % 10 < 7 THEN 'en' WHEN id % 10 < 9 THEN 'de' END").alias("lang"),
                                    F.expr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 4) END").alias("source"))
    targets = {"lang": {"en": 0.6, "de": 0.3, M.OTHER: 0.1}, "source": {"hot": 0.2, "s0": 0.3, M.OTHER: 0.5}}
    rows = M.mix(df, targets, {"lang": F.col("lang"), "source": F.col("source")}, share=share).withColumn("t", M.n_tokens(F.col("text"))).toPandas()
    assert (rows.t == 1 + rows.doc_id % 7).all() and len(rows) == 30_000
    drawn = rows[rows.sampled]
    total = (rows.t * rows.mix_probability).sum()
    assert abs(drawn.t.sum() / total - 1) < 0.03
    if share:
        assert abs(drawn.t.sum() / rows.t.sum() - share) < 0.03
    if (rows.mix_probability < 1).all() or share is None:
        for value, want in targets["lang"].items():
            assert abs(drawn.t[drawn.lang.fillna(M.OTHER) == value].sum() / drawn.t.sum() - want) < 0.02
        assert abs(drawn.t[drawn.source == "hot"].sum() / drawn.t.sum() - 0.2) < 0.02


def test_odd_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "x y", "en", "b", 3), (4, "w " * 100_000, "de", "a", 1), (5, "same", "en", "a", 1), (5, "same", "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("cell", "draw", "row", "_t", "_c0", "sampled", "Mix_Weight"):
        df = df.withColumn(name, F.lit("clash"))
    out = M.mixed_documents(df)
    found = out.collect()
    assert len(found) == 6 and out.columns.count("sampled") == 1 and {r.cell for r in found} == {"clash"}
    assert all(0 <= r.mix_probability <= 1 for r in found)
    assert len({r.sampled for r in found if r.doc_id == 5}) == 1
    assert M.mixed_documents(df.limit(0)).count() == 0
    assert [r.sampled for r in M.mixed_documents(df).orderBy("doc_id").collect()] == [r.sampled for r in out.orderBy("doc_id").collect()]


def test_topics_and_token_counts(spark):
    df = spark.createDataFrame([("a | b | c",), ("LOUD WORDS",), ("w&&& x***",), ("quiet words",), ("",), (" \n",)], "text string")
    rows = df.select(M.layout_topic(F.col("text")).alias("t"), M.n_tokens(F.col("text")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [("table", 5), ("shouting", 2), ("marked", 2), ("prose", 2), ("prose", 0), ("prose", 0)]


def test_every_source_has_its_own_target(spark):
    """200 equal sources: none is lumped with others, on the driver or as a table."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.lit("en").alias("lang"),
                                  F.concat(F.lit("s"), F.col("id") % 200).alias("source"), F.lit(5).alias("n_chars"))
    weights = [r.mix_weight for r in M.mixed_documents(df).select("mix_weight").distinct().collect()]
    assert np.allclose(weights, 1)
    dimensions = {"source": F.col("source"), "lang": F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en")}
    counts = M.token_counts(df.where("doc_id % 7 > 0 OR source = 's7'"), dimensions)
    targets = {"source": M.tempered(counts, "source", 0.5), "lang": {"de": 0.5, M.OTHER: 0.5}}
    assert targets["source"].count() == 200
    here, table = ({r.doc_id: (r.mix_weight, r.mix_copies) for r in M.mix(df, targets, dimensions, counts=counts, share=0.8, on_driver=n).collect()}
                   for n in (M.ON_DRIVER, 0))
    assert here.keys() == table.keys() and all(np.isclose(here[i][0], table[i][0]) and here[i][1] == table[i][1] for i in here)


def test_copies_have_the_target_weights(spark):
    """A topic of which there is too little is repeated."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "LOUD WORDS").otherwise("quiet words").alias("text"),
                                    F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(11).alias("n_chars"))
    rows = M.mixed_documents(df).toPandas()
    copies = rows.mix_copies
    assert abs(copies.sum() / len(rows) - 0.8) < 0.02 and (rows.sampled == (copies > 0)).all()
    loud = copies[rows.text == "LOUD WORDS"].sum() / copies.sum()
    assert abs(loud - 0.05 / 0.9) < 0.003  # of the topics that occur


def test_the_query_holds_the_target_weights(spark, sf):
    """Copies as the query returns them, against raking in numpy."""
    from alertloom.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op4_mixing(spark, sf).toPandas()
    assert sorted(rows.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(len(texts[i].encode().split()) == n for i, n in zip(rows.doc_id, rows.n_tokens))
    cells = rows.groupby(["source", "lang", "topic"]).n_tokens.sum().reset_index()
    places, targets = [], []
    for d in ("source", "lang"):
        sums = cells.groupby(d).n_tokens.sum() ** 0.7
        targets.append((sums / sums.sum()).to_numpy())
        places.append(cells[d].map({v: k for k, v in enumerate(sums.index)}).to_numpy())
    topics = sorted(set(cells.topic))
    targets.append(np.array([M.TOPIC_TARGETS[t] for t in topics]))
    places.append(cells.topic.map({t: k for k, t in enumerate(topics)}).to_numpy())
    cells["weight"] = M.rake_cells(cells.n_tokens.to_numpy(float), places, targets) / (cells.n_tokens / cells.n_tokens.sum())
    joined = rows.merge(cells[["source", "lang", "topic", "weight"]], on=["source", "lang", "topic"])
    assert np.allclose(joined.mix_weight, joined.weight, rtol=1e-6)
    assert (rows.sampled == (rows.mix_copies > 0)).all() and (rows.mix_copies <= M.MOST_COPIES).all()
    factor = (joined.mix_probability / joined.mix_weight)[joined.mix_probability < 1]
    assert np.allclose(factor, factor.iloc[0]) and (np.abs(rows.mix_copies - np.minimum(rows.mix_weight * factor.iloc[0], M.MOST_COPIES)) < 1).all()
    whole = M.mixed_documents(docs).select("doc_id", "mix_copies").toPandas()
    assert dict(zip(whole.doc_id, whole.mix_copies)) == dict(zip(rows.doc_id, rows.mix_copies))


def test_one_rare_document_cannot_fill_a_task(spark):
    """A topic with one document among 3,000: repeated 16 times at most, the others make up for it, and the shares say so."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "LOUD WORDS").otherwise("quiet words").alias("text"),
                                  F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(11).alias("n_chars"))
    rows = M.mixed_documents(df).toPandas()
    assert rows.mix_copies[rows.doc_id == 0].iloc[0] == M.MOST_COPIES
    assert abs(rows.mix_copies.sum() / 3000 - 0.8) < 0.03
    topic = {"topic": M.layout_topic(F.col("text"))}
    targets = {"topic": spark.createDataFrame([("prose", 0.9), ("shouting", 0.1)], "value string, target double")}
    shares = {r.value: r for r in M.reached_shares(df, targets, topic).collect()}
    assert np.isclose(shares["shouting"].drawn, 16 / 3000 / 0.8) and np.isclose(shares["prose"].drawn + shares["shouting"].drawn, 1)
    assert np.isclose(shares["shouting"].target, 0.1) and np.isclose(shares["shouting"].own, 1 / 3000)


def test_a_null_value_of_a_dimension_is_raked_as_other(spark):
    cells = spark.createDataFrame([(None, "x", 10), ("a", "x", 30), ("a", None, 20)], "s string, l string, tokens long")
    targets = {"s": spark.createDataFrame([("a", 0.5), (M.OTHER, 0.5)], "value string, target double"),
               "l": spark.createDataFrame([("x", 0.7), (M.OTHER, 0.3)], "value string, target double")}
    found = {(r.s, r.l): r.raked for r in M.rake_table(cells, targets).collect()}
    assert np.isclose(found["a", "x"] + found["a", M.OTHER], 0.5, atol=1e-6) and np.isclose(found["a", M.OTHER], 0.3, atol=1e-6)
