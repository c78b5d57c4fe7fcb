"""The pipeline: what each stage keeps of its own input, and the whole run."""

import pytest

import corpus_pipeline as P
from alertloom.llm import exact, language, mixing
from tests.llm.test_near import brute_kept
from tests.llm.test_packing import check as check_packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*P.COLUMNS)
    found = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, found[-1], sf).write.parquet(f"{folder}/{k}")
        found.append(spark.read.parquet(f"{folder}/{k}"))
    return found


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_all_but_the_last_return_documents(stages):
    for df in stages[:-1]:
        assert df.columns == P.COLUMNS
    originals = {r.doc_id: tuple(r) for r in stages[0].collect()}
    assert all(tuple(r) == originals[r.doc_id] for r in stages[4].collect())


def test_language_stage_keeps_what_is_accepted(stages):
    table = language.train(stages[0], ("en", "de", "fr", "es"))
    found = language.fuse(language.scored(stages[0], table), ("en", "de", "fr", "es"), F.col("lang"), F.lit(None).cast("string"), F.col("source"))
    assert ids(stages[1]) == ids(found.where("accepted"))


def test_exact_stage_keeps_one_of_each_group(stages):
    assert ids(stages[2]) == ids(exact.exact_duplicates(stages[1]).where("kept")) and stages[2].count() == len(ids(stages[2]))


def test_near_stage_keeps_the_first_of_each_component(stages):
    assert ids(stages[3]) == brute_kept([(r.doc_id, r.text) for r in stages[2].collect()])


def test_mixing_stage_keeps_what_is_drawn(stages):
    assert ids(stages[4]) == ids(mixing.mixed_documents(stages[3]).where("sampled")) < ids(stages[3])


def test_packing_stage_holds_every_token(stages):
    check_packing(stages[5].collect(), Tokenizer.from_str(P.tokenizer_json()), [(r.doc_id, r.text) for r in stages[4].collect()])


def test_run_applies_all_stages(spark, sf, stages):
    got = {(r.doc_id, r.piece, r.ids_crc32) for r in P.run(spark, sf).collect()}
    assert got == {(r.doc_id, r.piece, r.ids_crc32) for r in stages[5].collect()}
    assert P.ORACLE_SQL is None and 4 <= len(P.STAGES) <= 5


CLASHES = ("_copy", "sampled", "mix_copies", "mix_weight", "row", "cell", "draw", "accepted", "language", "posterior", "hash", "bare", "rank", "node", "size", "tile")


def test_every_stage_takes_odd_rows_and_clashing_names(spark, sf):
    rows = [(1, "plain words in english that the model of letters can tell " * 3, "en", "web", 1), (2, None, None, None, None), (3, "", "en", "web", 0), (None, "no id here at all", "en", "a", 1),
            (4, "twice the same", "en", "a", 1), (4, "twice the same", "en", "a", 1), (5, "wort " * 20_000, "de", "b", 1), (6, "\t\n ", "fr", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        df = df.withColumn(name, F.lit("own"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        found = out.collect()
        assert {r.row for r in found} | {r.sampled for r in found} | {r.mix_copies for r in found} <= {"own"} and len(found) > 0, name
        assert stage(spark, df.limit(0), sf).count() == 0, name
    packed = P.STAGES[-1][1](spark, df, sf).collect()
    assert len({(r.doc_id, r.piece) for r in packed}) >= 6 and P.STAGES[-1][1](spark, df.limit(0), sf).count() == 0

