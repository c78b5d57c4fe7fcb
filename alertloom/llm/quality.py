"""Document quality by a convolutional network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import text_of

#: Bytes of a chunk and how many of them the next chunk repeats.
CHUNK, OVERLAP = 512, 32
#: Bytes a filter sees, bytes between its places, filters, numbers that stand for a byte.
WIDTH, STRIDE, FILTERS, DEPTH = 12, 2, 32, 6
#: Labelled rows that the network is fitted on, about; the documented bound of the sample.
SAMPLE = 4000
#: Chunks that go through the filters at a time.
BATCH = 128


def chunks_of(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole text, the last one filled up with zeros.

    An empty text is one chunk of zeros.
    """
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    data = np.zeros((n - 1) * step + CHUNK, np.uint8)
    data[:len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::step]


class Network:
    """Byte embedding, filters, maximum over the places of a chunk, mean and maximum over the
    chunks of a document, one probability."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.embedding = draw.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        self.filters = draw.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weights = np.zeros(2 * FILTERS, np.float32)
        self.offset = np.zeros(1, np.float32)
        self.embedding[0] = 0

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.offset]

    def seen(self, chunks: np.ndarray) -> np.ndarray:
        """What the filters see at each place: (chunks, places, WIDTH * DEPTH)."""
        places = np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)[:, ::STRIDE]
        return self.embedding[places].reshape(*places.shape[:2], WIDTH * DEPTH)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """The strongest answer of each filter in each chunk, nothing below 0."""
        out = [(self.seen(chunks[k:k + BATCH]) @ self.filters).max(axis=1) for k in range(0, len(chunks), BATCH)]
        return np.maximum(np.concatenate(out) + self.bias, 0)

    def scores(self, texts: Iterable[bytes]) -> list[float]:
        """Probabilities of label 1. A text's chunks are pooled as they come, in bounded memory."""
        out, waiting, owners, size = [], [], [], 0
        sums: list = []

        def flush() -> None:
            pooled = self.pooled(np.concatenate(waiting))
            for owner, start, end in owners:
                part, state = pooled[start:end], sums[owner]
                state[0] += part.sum(axis=0, dtype=np.float64)
                np.maximum(state[1], part.max(axis=0), out=state[1])
                state[2] += len(part)

        for text in texts:
            chunks = chunks_of(text)
            sums.append([np.zeros(FILTERS), np.zeros(FILTERS), 0])
            for k in range(0, len(chunks), 4 * BATCH):
                part = chunks[k:k + 4 * BATCH]
                waiting.append(part)
                owners.append((len(sums) - 1, size, size + len(part)))
                size += len(part)
                if size >= 4 * BATCH:
                    flush()
                    waiting, owners, size = [], [], 0
        if size:
            flush()
        for total, most, n in sums:
            z = float(np.concatenate([total / n, most]) @ self.weights + self.offset[0])
            out.append(1 / (1 + np.exp(-z)))
        return out

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the logarithmic loss of whole documents; ``owner`` is each chunk's document."""
        docs = len(labels)
        tops, args, answers = [], [], []
        for k in range(0, len(chunks), BATCH):
            answer = self.seen(chunks[k:k + BATCH]) @ self.filters
            arg = answer.argmax(axis=1)
            args.append(arg)
            tops.append(np.take_along_axis(answer, arg[:, None], axis=1)[:, 0])
        top, arg = np.concatenate(tops) + self.bias, np.concatenate(args)
        pooled = np.maximum(top, 0)
        starts = np.searchsorted(owner, np.arange(docs))
        counts = np.diff(np.append(starts, len(owner)))[:, None]
        mean = np.add.reduceat(pooled, starts, axis=0) / counts
        most = np.maximum.reduceat(pooled, starts, axis=0)
        features = np.concatenate([mean, most], axis=1)
        z = features @ self.weights + self.offset[0]
        error = (weight * (1 / (1 + np.exp(-z)) - labels) / docs).astype(np.float32)
        back = error[:, None] * self.weights[None]
        first = (pooled == most[owner]) & (pooled > 0)
        down = ((back[:, :FILTERS] / counts)[owner] + first * back[owner][:, FILTERS:]) * (top > 0)
        # Only the strongest place of each filter passes its gradient on.
        bytes_at = chunks[np.arange(len(chunks))[:, None, None], arg[:, :, None] * STRIDE + np.arange(WIDTH)]
        inputs = self.embedding[bytes_at].reshape(len(chunks), FILTERS, WIDTH * DEPTH)
        filters = np.einsum("cf,cfk->kf", down, inputs)
        spread = (down[:, :, None] * self.filters.T[None]).reshape(-1, DEPTH)
        embedding = np.stack([np.bincount(bytes_at.ravel(), spread[:, d], 256) for d in range(DEPTH)], axis=1)
        embedding[0] = 0
        return [embedding, filters, down.sum(axis=0), features.T @ error, np.array([error.sum()])]

    def fit(self, texts: list[bytes], labels: np.ndarray, passes: int = 6, least_steps: int = 400, docs: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
        """Adam over batches of whole documents, ``passes`` times and at least ``least_steps`` batches. The two labels get equal weight in the sum, so that
        the rarer one is learned; the offset is then set back to the labels' shares."""
        chunks = [chunks_of(t) for t in texts]
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        draw = np.random.default_rng(seed)
        first, second = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        passes = max(passes, -(-least_steps * docs // len(texts)))
        step, steps = 0, passes * -(-len(texts) // docs)
        for _ in range(passes):
            order = draw.permutation(len(texts))
            for at in range(0, len(order), docs):
                batch = order[at:at + docs]
                owner = np.repeat(np.arange(len(batch)), [len(chunks[k]) for k in batch])
                found = self.gradients(np.concatenate([chunks[k] for k in batch]), owner, labels[batch], weights[batch])
                step += 1
                pace = rate * (1 - step / (steps + 1))
                for p, g, m, v in zip(self.parameters(), found, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        self.offset += np.float32(np.log(share / (1 - share)))
        return self


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo ``folds``, is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Network:
    """Fit the network on about ``sample`` of the labelled rows outside the held-out fold.

    The rows with the smallest hash of their id, by their share among all: no more reach the driver
    than ``sample`` and its chance deviation. Rows without label or text are left out; without
    any labelled row the network answers 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "text IS NOT NULL").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").limit(2 * sample).toPandas()
    texts = [t.encode() for t in rows["text"]]
    network = Network()
    return network.fit(texts, rows["quality"].to_numpy(np.float32)) if texts else network


def quality_scores(docs: DataFrame, network: Network, folds: int = 5, least: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (probability of label 1) and ``predicted`` of each row.

    Every text is read whole, in overlapping chunks; null counts as empty. The network (about
    4000 numbers) goes to the tasks; no row is shuffled. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.scores(t.encode() for t in texts), dtype="float64")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(text_of()).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score",
                       (F.col("score") >= least).cast("int").alias("predicted"))
