"""Language-model scores: a hashed maximum-entropy model over word classes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import as_signed, mixed, span_hashes, text_of, word_spans
from alertloom.llm.packing import blocks_of
from alertloom.llm.quality import held_out
from alertloom.session import stored

#: Most frequent tokens whose counts are sent to the tasks, at most; the others are joined.
HEAD = 1 << 18
#: Word classes, rows of hashed features, tokens of one update.
CLASSES, ROWS, STEP = 32, 1 << 14, 8192
#: The end of a text is a token of its own: a byte that no UTF-8 text holds.
END = b"\xff"
_END_HASH = span_hashes(mixed(np.frombuffer(END, np.uint8).astype(np.uint64)), np.array([0]), np.array([1]))[0]


def tokens_of(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, one end after each, and their last two bytes."""
    hashes, tails = [], []
    for block in blocks_of(b" \xff\n".join([*(t.lower() for t in texts), b""])):
        data = np.frombuffer(block, np.uint8)
        starts, ends = word_spans(data)
        hashes.append(span_hashes(mixed(data.astype(np.uint64)), starts, ends))
        before = np.where(ends - starts > 1, data[ends - 2], 0) if len(ends) else ends
        tails.append(before.astype(np.int64) << 8 | data[ends - 1])
    return np.concatenate(hashes), np.concatenate(tails)


def token_batches(texts: Iterable[bytes], size: int = 1 << 19) -> Iterator[list[bytes]]:
    """Texts in lists of about ``size`` bytes."""
    batch, room = [], size
    for text in texts:
        batch.append(text)
        room -= len(text)
        if room < 0:
            yield batch
            batch, room = [], size
    if batch:
        yield batch


def features(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows of the features of each token: the word before, the one before that, both, and the
    classes of the three before. What lies before the beginning of a text is an end."""
    end = hashes == _END_HASH

    def earlier(values: np.ndarray, first, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values one token earlier; ``first`` where an end lies between."""
        moved = np.concatenate([[first], values[:-1]]).astype(values.dtype)
        cut = np.concatenate([[True], gone[:-1]])
        return np.where(cut, first, moved), cut

    word1, cut = earlier(hashes, _END_HASH, end)
    word2, _ = earlier(word1, _END_HASH, end)
    last = classes[end][0] if end.any() else 0
    class1, _ = earlier(classes, last, end)
    class2, _ = earlier(class1, last, end)
    class3, _ = earlier(class2, last, end)
    several = (class1 * CLASSES + class2) * CLASSES + class3
    kinds = (mixed(word1), mixed(word2 ^ np.uint64(0x5851F42D4C957F2D)), mixed(mixed(word1) + word2),
             mixed(several.astype(np.uint64) + np.uint64(1)))
    return np.stack([k % np.uint64(ROWS) for k in kinds], axis=1).astype(np.int64)


@dataclass
class Model:
    """What scoring needs, of bounded size: at most ``HEAD`` tokens and ``ROWS * CLASSES`` weights."""

    head: np.ndarray  # hashes of frequent tokens, ascending
    head_counts: np.ndarray
    class_of: np.ndarray  # by the last two bytes of a token
    class_tokens: np.ndarray
    class_types: np.ndarray
    tokens: int
    types: int
    weights: np.ndarray
    bias: np.ndarray

    def class_log(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token's class after what precedes it."""
        rows, out = features(hashes, classes), np.empty(len(hashes))
        for k in range(0, len(rows), STEP):
            z = self.logits(rows[k:k + STEP])
            top = z.max(axis=1)
            sums = np.exp(z - top[:, None]).sum(axis=1)
            out[k:k + STEP] = z[np.arange(len(z)), classes[k:k + STEP]] - top - np.log(sums)
        return out

    def logits(self, rows: np.ndarray) -> np.ndarray:
        z = self.weights[rows[:, 0]] + self.bias
        for k in range(1, rows.shape[1]):
            z += self.weights[rows[:, k]]
        return z

    def learn(self, texts: Iterable[bytes], rate: float = 0.5) -> np.ndarray:
        """Gradient updates over texts, in place; returns how often each row was seen.

        Steps are scaled by the gradients that a row has had so far, so frequent ones settle.
        """
        seen, had, had_bias = np.zeros(ROWS), np.full(ROWS, 1.0, np.float32), 1.0
        for batch in token_batches(texts):
            hashes, tails = tokens_of(batch)
            classes = self.class_of[tails]
            rows = features(hashes, classes)
            for k in range(0, len(rows), STEP):
                part, target = rows[k:k + STEP], classes[k:k + STEP]
                z = self.logits(part)
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(z)), target] -= 1
                total = z.sum(axis=0)
                had_bias += float(total @ total)
                self.bias -= rate * total / np.sqrt(had_bias)
                for f in range(part.shape[1]):
                    order = np.argsort(part[:, f], kind="stable")
                    ids = part[order, f]
                    begins = np.flatnonzero(np.diff(ids, prepend=-1))
                    sums = np.add.reduceat(z[order], begins, axis=0)
                    ids = ids[begins]
                    had[ids] += np.einsum("ij,ij->i", sums, sums)
                    self.weights[ids] -= rate / part.shape[1] * sums / np.sqrt(had[ids])[:, None]
                    seen[ids] += np.diff(np.append(begins, len(part)))
        return seen


def token_counts(docs: DataFrame) -> DataFrame:
    """Counts of the tokens of all texts: ``h`` (hash), ``tail`` (last two bytes), ``c``."""

    def counted(batches):
        for batch in batches:
            for texts in token_batches(t.as_buffer().to_pybytes() for t in batch.column(0)):
                hashes, tails = tokens_of(texts)
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(found)), pa.array(tails[first].astype(np.int32)), pa.array(n)], ["h", "tail", "c"])

    return docs.select(text_of().alias("text")).mapInArrow(counted, "h long, tail int, c long").groupBy("h").agg(
        F.min("tail").alias("tail"), F.sum("c").alias("c"))


def classes_by_tail(tails: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The class of each pair of last bytes: 0 for the end, a class of their own for the most
    frequent pairs, the others spread over the last quarter."""
    own = CLASSES - CLASSES // 4
    classes = own + np.arange(1 << 16) % (CLASSES // 4)
    order = tails[np.lexsort((tails, -tokens))]
    order = order[order != END[0]][:own - 1]
    classes[order] = 1 + np.arange(len(order))
    classes[END[0]] = 0
    return classes


def learn_model(docs: DataFrame, counts: DataFrame, head: int = HEAD, rounds: int = 2) -> Model:
    """Model of the training documents from their stored token counts.

    Collected are the counts by last two bytes (65,536 rows at most), the number of types by count
    up to 100,000, and at most ``head`` frequent tokens. The weights are trained in ``rounds``, each over
    its own part of the documents: every task goes over its texts in gradient steps from the common
    weights; rows are averaged by how often the tasks saw them. So every token is seen once.
    """
    spark = docs.sparkSession
    tails = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("types")).toPandas()
    class_of = classes_by_tail(tails["tail"].to_numpy(np.int64), tails["c"].to_numpy(np.int64))
    place = class_of[tails["tail"].to_numpy(np.int64)]
    class_tokens = np.bincount(place, tails["c"], CLASSES)
    class_types = np.bincount(place, tails["types"], CLASSES)
    most = 100_000
    levels = counts.groupBy(F.least("c", F.lit(most)).alias("c")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(
        "c", ascending=False)
    fit = levels["c"][levels["n"].cumsum() <= head]
    frequent = counts.where(F.col("c") >= int(fit.min())).select("h", "c").toPandas() if len(fit) else pd.DataFrame(
        {"h": np.zeros(0, np.int64), "c": np.zeros(0, np.int64)})
    hashes = frequent["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], frequent["c"].to_numpy(np.int64)[order], class_of, class_tokens, class_types,
                  int(tails["c"].sum()), int(tails["types"].sum()),
                  np.zeros((ROWS, CLASSES), np.float32), np.zeros(CLASSES, np.float32))
    columns = [f"w{k}" for k in range(CLASSES)]
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((class_of, model.weights, model.bias))

        def updates(batches, sent=sent):
            class_of, weights, bias = sent.value
            own = Model(None, None, class_of, None, None, 0, 0, weights.copy(), bias.copy())
            seen = own.learn(t.as_buffer().to_pybytes() for batch in batches for t in batch.column(0))
            rows = np.flatnonzero(seen)
            if not len(rows):
                return
            total = seen.sum()
            table = np.concatenate([own.weights[rows] * seen[rows, None], (own.bias * total)[None]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(rows, ROWS)), pa.array(np.append(seen[rows], total)), *[pa.array(c.astype(np.float64)) for c in table.T]],
                ["row", "n", *columns])

        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select(text_of().alias("text"))
        found = part.mapInArrow(updates, ", ".join(["row long", "n double", *[f"{c} double" for c in columns]])).groupBy("row").agg(
            *[(F.sum(c) / F.sum("n")).cast("float").alias(c) for c in columns]).toPandas()
        table = found[columns].to_numpy(np.float32)
        rows = found["row"].to_numpy(np.int64)
        model.weights[rows[rows < ROWS]] = table[rows < ROWS]
        if (rows == ROWS).any():
            model.bias = table[rows == ROWS][0]
    return model


def _partial_scores(sent):
    kinds = ["n_tokens", "n_known", "logs", "places", "classes"]

    def partial(batches):
        model: Model = sent.value
        sizes = np.log10(model.class_tokens + 0.1 * (model.class_types + 1))
        for batch in batches:
            at = 0
            for texts in token_batches(t.as_buffer().to_pybytes() for t in batch.column(1)):
                hashes, tails = tokens_of(texts)
                ends = np.flatnonzero(hashes == _END_HASH)
                starts = np.concatenate([[0], ends[:-1] + 1])
                classes = model.class_of[tails]
                place = np.minimum(np.searchsorted(model.head, hashes), max(len(model.head) - 1, 0))
                known = model.head[place] == hashes if len(model.head) else np.zeros(len(hashes), bool)
                counts = np.where(known, model.head_counts[place] if len(model.head) else 0, 0)
                sums = [np.add.reduceat(x, starts) for x in (
                    known.astype(np.int64), np.log10(counts + 0.1), -sizes[classes], model.class_log(hashes, classes) / np.log(10))]
                # Other tokens may be known too; their counts are joined.
                owner = np.repeat(np.arange(len(starts)), ends - starts + 1)[~known]
                order = np.lexsort((hashes[~known], owner))
                owner, rare = owner[order], hashes[~known][order]
                new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(rare, prepend=0) != 0)) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rare)))
                offsets = np.searchsorted(owner[new], np.arange(len(starts) + 1))
                pairs = pa.StructArray.from_arrays([pa.array(as_signed(rare[new])), pa.array(times)], ["h", "tf"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(ends - starts + 1), *[pa.array(x) for x in sums],
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["doc_id", *kinds, "rare"])
                at += len(texts)

    return partial


def scores(docs: DataFrame, folds: int = 10, head: int = HEAD, rounds: int = 2) -> DataFrame:
    """Unigram and model scores of every document.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, a row
    for each row of ``docs``. Tokens are words, upper case ASCII lowered, and an end after each text.
    Counts are those of all documents outside the held-out fold.

    The model is P(class | words before) P(word | class): the class follows from a word's last two
    bytes, its probability is a softmax over hashed n-gram and skip features, and within
    the class a word has its smoothed share: (c + 0.1) / (tokens + 0.1 (types + 1)). Unknown words of a class share one
    place, so the probabilities of a position sum to 1.

    Counts of the ``head`` most frequent tokens go to the tasks; the other tokens of a document are
    joined with the counts by shuffle, one row for each distinct one. Tokens are compared by 64-bit hash.

    Null text is empty: its one token is the end. A null ``doc_id`` is hashed as an empty text.
    Repeated rows are scored each; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    train = rows.where(~held_out(F.col("doc_id"), folds))
    counts = stored(token_counts(train))
    model = learn_model(train, counts, head, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = stored(rows.mapInArrow(_partial_scores(sent), (
        "doc_id long, n_tokens long, n_known long, logs double, places double, classes double, rare array<struct<h: long, tf: long>>"
    )).withColumn("row", F.monotonically_increasing_id()))
    least = int(model.head_counts.min()) if len(model.head_counts) else 1 << 62
    rare = scored.select("row", F.explode("rare").alias("t")).select("row", "t.h", "t.tf").join(
        counts.where(F.col("c") < least).select("h", "c"), "h").groupBy("row").agg(
        F.sum("tf").alias("more"), F.sum(F.col("tf") * (F.log10(F.col("c") + 0.1) + 1.0)).alias("added"))
    size = float(np.log10(model.tokens + 0.1 * (model.types + 1)))
    logs = F.col("logs") + F.coalesce("added", F.lit(0.0))
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(size)).alias("base_score"), (logs + F.col("places") + F.col("classes")).alias("score"))
