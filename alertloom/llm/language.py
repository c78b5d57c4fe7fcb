"""Language by fused evidence: text, declared markup language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import frugal, text_of
from alertloom.session import arrow_batches, stored

BUCKETS = 1 << 14
#: Byte trigrams overlap threefold, so a trigram counts as a third of a piece of evidence.
OVERLAP = 3.0
#: Texts that a worker gets at a time where counts are made.
BATCH = 2_000
_FOLD = np.arange(256, dtype=np.int32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[9:14] = 32


def _trigrams(text: bytes, block: int = 1 << 20):
    """Hashed byte trigrams of a text, a block at a time; case, digits and blanks are folded."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - 2), block):
        x = _FOLD[data[at:at + block + 2]]
        yield (x[:-2] * 8009 + x[1:-1] * 131 + x[2:]) & (BUCKETS - 1)


def train(docs: DataFrame, languages: tuple[str, ...], label: str = "lang") -> np.ndarray:
    """Log-probabilities of trigram buckets by language, from all documents labelled with one.

    Each task sums its counts; what is collected is ``len(languages) * 16384`` numbers at most. One
    tenth of each distribution is spread evenly. Null texts and other labels give nothing.
    """

    def counts(frames):
        sums = np.zeros((len(languages), BUCKETS), np.int64)
        for frame in frames:
            for label, text in zip(frame["label"], frame["text"]):
                if label in languages:
                    for grams in _trigrams(text.encode()):
                        sums[languages.index(label)] += np.bincount(grams, minlength=BUCKETS)
        language, bucket = np.nonzero(sums)
        yield pd.DataFrame({"language": language, "bucket": bucket, "n": sums[language, bucket]})

    found = docs.select(F.lower(F.trim(F.col(label).cast("string"))).alias("label"), text_of().alias("text")).where(
        F.col("label").isin(*languages)).mapInPandas(frugal(counts), "language int, bucket int, n long").groupBy(
        "language", "bucket").agg(F.sum("n").alias("n"))
    with arrow_batches(docs.sparkSession, BATCH):
        found = found.toPandas()
    sums = np.zeros((len(languages), BUCKETS))
    sums[found["language"], found["bucket"]] = found["n"]
    share = (sums + 1e-9) / (sums.sum(axis=1, keepdims=True) + 1e-9 * BUCKETS)
    return np.log(0.9 * share + 0.1 / BUCKETS)


def text_scores(table: np.ndarray, text: Column) -> Column:
    """Array: the log-likelihood of the text in each language, then its number of trigrams."""
    rows = np.ascontiguousarray(table.T.astype(np.float32))

    def of_batches(batches):
        for texts in batches:
            out = []
            for text in texts:
                sums, n = np.zeros(rows.shape[1]), 0
                for grams in _trigrams(text.encode()):
                    sums += rows[grams].sum(axis=0, dtype=np.float64)
                    n += len(grams)
                out.append([*sums, float(n)])
            yield pd.Series(out)

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from frugal(of_batches)(batches)

    return scores(text)


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def fuse(scored: DataFrame, languages: tuple[str, ...], declared: Column, address: Column, host: Column,
         least: float = 0.5, strength: float = 20.0) -> DataFrame:
    """Adds ``language``, ``posterior``, ``text_language`` and ``accepted`` to rows with ``_scores``.

    The evidence is multiplied, after Bayes:

    * the text's likelihood, tempered for the overlap of trigrams;
    * the probability of the declared language, and of the address suffix (last label of the host in
      the address), in each language: shares among the rows by their text, smoothed by the shares
      among all rows;
    * the prior of the host: shares of languages by text among its other rows, smoothed with
      ``strength`` rows of its domain's, which is smoothed with as many of the whole table's.

    All shares are sums by group, combined per task, so a host with a third of all rows is one row
    a task. They are written to the checkpoint folder; Spark sees their size and broadcasts them
    if it is small, else joins by shuffle.

    Accepted are rows whose best posterior is at least ``least`` and whose text is no less likely in
    the best language than one unit (log) a trigram below even chances. Missing evidence (null or
    empty) is left out of the product; null or empty text is not accepted, nor is one without a
    letter.
    """
    size = len(languages)
    named = scored.withColumns({
        "_declared": F.when(F.length(F.trim(declared)) > 0, F.lower(F.substring(F.trim(declared), 1, 2))),
        "_host": F.when(F.length(host) > 0, F.lower(host)),
        "_suffix": F.substring_index(F.regexp_extract(F.lower(address), r"^[a-z]+://([^/:?#]+)", 1), ".", -1),
        "_n": F.col("_scores")[size],
        "_text": F.transform(F.slice("_scores", 1, size), lambda s: s / F.lit(OVERLAP)),
    }).withColumn("_suffix", F.when(F.length("_suffix") > 0, F.col("_suffix")))
    named = named.withColumn("_domain", domain_of(F.col("_host")))
    top = F.array_max("_text")
    named = named.withColumn("_odds", F.transform("_text", lambda s: F.exp(s - top)))
    total = F.aggregate("_odds", F.lit(0.0), lambda a, x: a + x)
    named = named.withColumn("_share", F.transform("_odds", lambda x: x / total)).drop("_odds")

    sums = [F.sum(F.col("_share")[k]).alias(f"c{k}") for k in range(size)]
    again = [F.sum(f"c{k}").alias(f"c{k}") for k in range(size)]
    counts = stored(named.groupBy("_host", "_domain", "_suffix", "_declared").agg(*sums, F.count(F.lit(1)).alias("n")), BATCH)
    everything = counts.agg(*again, F.sum("n")).first()
    whole = [(everything[k] or 0.0) for k in range(size)]
    rows = everything[size] or 0
    overall = [(w + 1.0) / (rows + size) for w in whole]

    def prior(counted: list[Column], n: Column, above: list[Column]) -> list[Column]:
        return [(c + strength * a) / (n + strength) for c, a in zip(counted, above)]

    c = [F.col(f"c{k}") for k in range(size)]
    domains = counts.where("_domain IS NOT NULL").groupBy("_domain").agg(*again, F.sum("n").alias("n"))
    domains = domains.select("_domain", *[p.alias(f"d{k}") for k, p in enumerate(prior(c, F.col("n"), [F.lit(x) for x in overall]))])
    hosts = counts.where("_host IS NOT NULL").groupBy("_host", "_domain").agg(*again, F.sum("n").alias("n"))
    hosts = stored(hosts.join(domains, "_domain").select(
        "_host", F.array(*c).alias("_seen"), F.col("n").alias("_rows"), F.array(*[f"d{k}" for k in range(size)]).alias("_above")))

    def given(name: str) -> DataFrame:
        """P(value | language), smoothed by the value's share among all rows."""
        found = counts.where(F.col(name).isNotNull()).groupBy(name).agg(*again, F.sum("n").alias("n"))
        known = counts.where(F.col(name).isNotNull()).agg(*again, F.sum("n")).first()
        n = known[size] or 1
        return stored(found.select(name, F.array(*[
            F.log((c[k] + strength * F.col("n") / n) / ((known[k] or 0.0) + strength)) for k in range(size)]).alias(f"{name}_log")))

    joined = named.join(hosts, "_host", "left").join(given("_suffix"), "_suffix", "left").join(given("_declared"), "_declared", "left")
    nothing = F.lit(0.0)

    def posterior(k: int) -> Column:
        others = F.col("_seen")[k] - F.col("_share")[k]
        at_host = F.log((others + strength * F.col("_above")[k]) / (F.col("_rows") - 1 + strength))
        return (F.col("_text")[k] + F.coalesce(at_host, F.lit(float(np.log(overall[k]))))
                + F.coalesce(F.col("_suffix_log")[k], nothing) + F.coalesce(F.col("_declared_log")[k], nothing))

    names = F.array(*[F.lit(x) for x in languages])
    logs = joined.withColumn("_log", F.array(*[posterior(k) for k in range(size)]))
    logs = logs.withColumn("_top", F.array_max("_log"))
    best = F.array_position("_log", F.col("_top")).cast("int")
    chance = F.lit(float(-np.log(BUCKETS)) - 1.0)
    per_gram = F.element_at("_scores", best) / F.greatest(F.col("_n"), F.lit(1.0))
    return logs.withColumns({
        "language": F.element_at(names, best),
        "text_language": F.when(F.col("_n") > 0, F.element_at(names, F.array_position("_text", F.array_max("_text")).cast("int"))),
        "posterior": 1.0 / F.aggregate("_log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top"))),
    }).withColumn("accepted", (F.col("posterior") >= least) & ((F.col("_n") == 0) | (per_gram >= chance)) & F.col("_letters")).select(
        *[x for x in scored.columns if x not in ("_scores", "_letters")], "language", "posterior", "text_language", "accepted")


def scored(rows: DataFrame, table: np.ndarray, text: str = "text") -> DataFrame:
    """``rows`` with the columns that ``fuse`` reads."""
    return rows.withColumns({"_scores": text_scores(table, text_of(text)), "_letters": text_of(text).rlike(r"\p{L}")})


def accepted_documents(docs: DataFrame, languages: tuple[str, ...] = ("en", "de", "fr", "es")) -> DataFrame:
    """The documents whose language is identified, with their columns.

    Documents declare their language in ``lang`` and have their ``source`` for a host. Null text counts as empty, so that only
    what is declared speaks for it; a null ``lang`` or ``source`` says nothing. Rows that repeat are decided alike and
    each stay or go; columns of any name are kept; an empty table gives no rows.
    """
    table = train(docs, languages)
    rows = docs.select(F.struct("*").alias("row"), "text", F.col("lang").cast("string"), F.col("source").cast("string"))
    found = fuse(scored(rows, table), languages, F.col("lang"), F.lit(None).cast("string"), F.col("source"))
    return found.where("accepted").select("row.*")
