"""Exact duplicates: groups by a 128-bit hash of the content, told apart by their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import BLANKS, text_of


def without_blanks(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(text, BLANKS, "")


def _content(docs: DataFrame, hash128) -> DataFrame:
    text = text_of()
    bare = without_blanks(text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("_n"),
        bare.alias("_bare"), hash128(bare).alias("_hash"),
        F.unhex(F.sha2(bare.cast("binary"), 256)).alias("_sha"))


def exact_duplicates(docs: DataFrame, hash128=lambda text: F.unhex(F.md5(text.cast("binary")))) -> DataFrame:
    """Which row of each group of equal texts stays.

    ``docs``: ``doc_id``, ``text`` and any other columns, which are not read. Texts are equal when
    they are without ASCII white space. The row with the most code points in its original text,
    then the smallest ``doc_id``, stays. Returns a row for each row of ``docs``: ``doc_id``,
    ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Groups form on the 128-bit hash *and* the bytes, so texts of one hash and other bytes do not
    meet; each task first reduces its copies to one row, so a group of any size reaches the
    shuffle as a row a task. Back to the rows goes the result by hash and SHA-256, narrow, in a
    join whose large keys Spark splits.

    Null text counts as empty; empty texts equal each other. Of rows that repeat ``doc_id`` and
    length in one group exactly one is kept. A null ``doc_id`` comes after all others; a group of
    null ids only has a null ``keep_id`` and keeps one row. An empty table gives no rows.
    """
    rows = _content(docs, hash128)
    rank = F.struct((-F.col("_n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    groups = rows.groupBy("_hash", "_bare").agg(
        F.min(rank).alias("_keep"), F.count(F.lit(1)).alias("group_size"), F.first("_sha").alias("_sha"))
    # Rows alike in id, length and content: counted here, unfolded below.
    alike = rows.groupBy("_hash", "_sha", "doc_id", "_n").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    found = alike.join(groups.drop("_bare"), ["_hash", "_sha"])
    keeper = (F.col("_keep.id").eqNullSafe(F.col("doc_id")) & (-F.col("_keep.n") == F.col("_n")))
    return found.select(
        "doc_id", F.col("_keep.id").alias("keep_id"), "group_size", keeper.alias("_keeper"),
        F.lower(F.hex("_sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_nth"),
    ).select("doc_id", "keep_id", "group_size", (F.col("_keeper") & (F.col("_nth") == 1)).alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each group.

    Decided as in ``exact_duplicates``. Rows that repeat id and length of the row that stays are one
    document; of these the one with the smallest hash of its columns (but maps) is given.
    """
    text = text_of()
    bare = without_blanks(text)
    plain = [F.col(f"`{name}`") for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct((-F.char_length(text)).alias("n"), F.col("doc_id").isNull().alias("none"),
                     F.col("doc_id").cast("long").alias("id"), F.xxhash64(*plain).alias("h"))
    best = docs.select(F.md5(bare.cast("binary")).alias("hash"), bare.alias("bare"), order.alias("rank"), F.struct("*").alias("row"))
    return best.groupBy("hash", "bare").agg(F.min_by("row", "rank").alias("row")).select("row.*")
