"""Packing token pieces into sequences by a configuration linear program."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import KEPT, frugal, text_of
from alertloom.session import stored

#: Numbers that pieces of one length class are spread over, so that no class meets in one task: as many as
#: tens of millions of pieces ask for, between these.
SLOTS, MOST_SLOTS = 256, 4096
#: Pieces up to this length are told apart by it, longer ones by the next multiple of the grid.
SHORT = 64
#: Texts that a worker gets at a time, some MB.
BATCH = 4_000


class WordEncoder:
    """Token ids of texts for vocabularies whose words end at white space.

    The distinct words of the given texts are found first, in Arrow. Upper case ASCII and a tail of ASCII marks after a
    letter or digit don't change how the rest of a word is encoded (but for special tokens and marks that join
    with a small letter only), so a word is the part before such a tail, in small letters, and the tail. Parts are encoded by the
    tokenizer once and remembered, about ``most_words`` of them: beyond that, those that were not met again
    are forgotten, and of the others all but the half as many that were learned first.
    """

    TAIL = ".,!*&%$#|;:?)"

    def __init__(self, spec: str, most_words: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.most_words = most_words
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        #: Bytes of words that keep their case: of special tokens ("<") and of combining marks (U+0300 to U+036F).
        self.cased = np.zeros(256, bool)
        self.cased[[0x3C, 0xCC, 0xCD]] = True
        #: Bytes after which a tail is a part of its own: ASCII digits and small letters.
        self.ends = np.zeros(256, bool)
        self.ends[[*range(48, 58), *range(97, 123)]] = True
        self.clear()

    def clear(self) -> None:
        #: Row of each known part; rows say where the ids of a part are.
        self.rows: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        #: Whether a row was met after the texts that it was learned from.
        self.again = np.zeros(1 << 14, bool)

    def _forget(self) -> None:
        kept = [(part, row) for part, row in self.rows.items() if self.again[row]][:self.most_words // 2]
        there = np.array([row for _, row in kept], np.int64)
        ids, lengths = _gather(self.ids, self.starts, self.lengths, there), self.lengths[there]
        self.clear()
        self.rows = dict(zip([part for part, _ in kept], self._append(ids, lengths)))

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        """New rows for parts of the given ids, one after the other."""
        n, total = len(lengths), len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.ids[self.used:self.used + total] = ids
        self.starts[self.known:self.known + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.known:self.known + n] = lengths
        rows = range(self.known, self.known + n)
        self.used, self.known = self.used + total, self.known + n
        return rows

    def _learn(self, parts: list[bytes]) -> None:
        texts = [p.decode("utf-8", "replace") for p in parts]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        done = set()
        for at in range(0, len(plain), 200):
            block = plain[at:at + 200]
            ids = np.array(self.tokenizer.encode_batch_fast(
                [" ".join([texts[i] for i in block])], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) == len(block) and cuts[-1] == len(ids):  # else some word is more than one part
                self.rows.update(zip([parts[i] for i in block], self._append(ids, np.diff(cuts, prepend=0))))
                done.update(block)
        alone = [i for i in range(len(parts)) if i not in done]
        for at in range(0, len(alone), 2000):
            block = alone[at:at + 2000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in block], add_special_tokens=False)]
            self.rows.update(zip([parts[i] for i in block], self._append(
                np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64))))

    def _parts(self, words: pa.Array) -> pa.Array:
        """Two parts of each word, one after the other: in small letters up to a tail of marks, and the tail or nothing."""
        places, data = _buffers(words)
        cased = np.zeros(len(words), bool)
        cased[np.searchsorted(places, np.flatnonzero(self.cased[data]), "right") - 1] = True
        words = pc.if_else(pa.array(cased), words, pc.ascii_lower(words))
        places, data = _buffers(words)
        starts, ends = places[:-1], places[1:]
        cuts = starts + pc.binary_length(pc.ascii_rtrim(words, characters=self.TAIL)).to_numpy()
        cuts = np.where((cuts > starts) & self.ends[data[np.maximum(cuts - 1, 0)]], cuts, ends) if len(data) else ends
        places = np.append(np.stack([starts, cuts], axis=1).ravel(), ends[-1:])
        return pa.Array.from_buffers(pa.large_binary(), 2 * len(words), [None, pa.py_buffer(places), pa.py_buffer(data)])

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. New parts of words of all of them are learned together."""
        if len(self.rows) > self.most_words:
            self._forget()
        known, split = self.known, pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        words = split.flatten().dictionary_encode()
        parts = self._parts(words.dictionary).dictionary_encode()
        names = parts.dictionary.to_pylist()
        rows = list(map(self.rows.get, names))
        if new := [k for k, row in enumerate(rows) if row is None]:
            self._learn([names[k] for k in new])
            for k in new:
                rows[k] = self.rows[names[k]]
        at = np.array(rows, np.int64)
        self.again[at[at < known]] = True
        # The ids of each distinct word, one after the other, then those of all words.
        at = at[parts.indices.to_numpy()]
        ids, lengths = _gather(self.ids, self.starts, self.lengths, at), self.lengths[at].reshape(-1, 2).sum(axis=1)
        at = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths[at])])[split.offsets.to_numpy()[1:]]
        return np.split(_gather(ids, np.cumsum(lengths) - lengths, lengths, at), ends[:-1])

    def __call__(self, text: bytes) -> np.ndarray:
        return self.many([text])[0]


def _gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The ids of the given rows, one after the other."""
    lengths = lengths[rows]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts[rows] - (ends - lengths), lengths) + np.arange(total)]


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and the last ends, from 0, and their bytes."""
    _, places, data = words.buffers()
    places = np.frombuffer(places, np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[places[0]:places[-1]] if data else np.zeros(0, np.uint8)
    return places - places[0], data


def encoder_of(spec: str) -> WordEncoder:
    """The encoder of a tokenizer in this worker process, with the words that earlier tasks met."""
    if KEPT.get("packing", (None, None))[0] != spec:
        # A task has one core: threads of the tokenizer's own would wait for work at the cost of other tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        KEPT["packing"] = spec, WordEncoder(spec)
    return KEPT["packing"][1]


def blocks_of(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in blocks of about ``size`` bytes that end at white space."""
    begin = 0
    while len(text) - begin > size:
        end = begin + size
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[begin:end]
        begin = end
    yield text[begin:]


def _grouped(texts: Iterable[bytes], size: int = 1 << 22) -> Iterator[list[tuple[bytes, bool]]]:
    """Blocks of the texts, each with whether it is the last of its text, in lists of about ``size`` bytes."""
    group, room = [], size
    for text in texts:
        for block in (blocks := list(blocks_of(text))):
            group.append((block, block is blocks[-1]))
            room -= len(block)
            if room < 0:
                yield group
                group, room = [], size
    if group:
        yield group


def token_pieces(docs: DataFrame, spec: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of the documents' token ids: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    ``spec`` is the tokenizer's JSON, sent to the executors (a fixed file of a few MB). Ids of a
    text, then ``end_id``; documents of more than ``capacity`` ids are cut at its multiples. Texts
    are encoded in blocks, so that a very long one needs no more memory than its bytes. A null or
    empty text is the one piece ``[end_id]``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def pieces(batches):
        encoder = encoder_of(sent.value)
        for batch in batches:
            ids = batch.column(0)
            out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc")}
            row, rest, at = 0, np.zeros(0, np.uint32), 0
            for blocks in _grouped(t.as_buffer().to_pybytes() for t in batch.column(1)):
                for (_, last), found in zip(blocks, encoder.many([b for b, _ in blocks])):
                    rest = np.concatenate([rest, found])
                    whole = len(rest) // capacity
                    for k in range(whole):
                        _add(out, row, at, rest[k * capacity:(k + 1) * capacity], capacity)
                        at += capacity
                    rest = rest[whole * capacity:]
                    if last:
                        _add(out, row, at, np.append(rest, np.uint32(end_id)), capacity)
                        row, rest, at = row + 1, np.zeros(0, np.uint32), 0
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out["row"], pa.int32())), pa.array(out["piece"], pa.int32()),
                 pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()),
                 pa.array(out["crc"], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        frugal(pieces, keeps="packing"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _add(out: dict[str, list], row: int, start: int, ids: np.ndarray, capacity: int) -> None:
    out["row"].append(row)
    out["piece"].append(start // capacity)
    out["start"].append(start)
    out["length"].append(len(ids))
    out["crc"].append(zlib.crc32(ids.astype("<u4").tobytes()))


def knapsack(prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size 1..capacity (``prices[size]``, 0: not for sale) for the highest
    total price. Dynamic program over the space used, all sizes at once."""
    sizes = np.flatnonzero(prices > 0)
    values = prices[sizes]
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for space in range(1, capacity + 1):
        best[space], n = best[space - 1], upto[space]
        if n:
            worth = values[:n] + best[space - sizes[:n]]
            k = worth.argmax()
            if worth[k] > best[space]:
                best[space], last[space] = worth[k], sizes[k]
    taken, space = np.zeros(capacity + 1, np.int64), capacity
    while space > 0:
        if last[space]:
            taken[last[space]] += 1
            space -= last[space]
        else:
            space -= 1
    return taken


def fractional_round(counts: np.ndarray, steps: int, pace: float) -> list[tuple[np.ndarray, float]]:
    """Multiplicative weights for the program "as few sequences as possible that hold all pieces".

    A size starts at the price of its space; each step takes the dearest pattern (knapsack) until
    the scarcest of its sizes has had ``pace`` of its pieces placed, and lowers the prices of what it placed.
    Scaled so that no size is placed more often than it exists.
    """
    capacity = len(counts) - 1
    prices = np.where(counts > 0, np.arange(capacity + 1) / capacity, 0.0)
    covered, used = np.zeros(capacity + 1), {}
    for _ in range(steps):
        # A size of which fewer pieces exist than a pattern takes sets the pace of that pattern.
        pattern = knapsack(prices, capacity)
        has = pattern > 0
        if not has.any():
            break
        times = pace * (counts[has] / pattern[has]).min()
        key = pattern.tobytes()
        used[key] = used.get(key, 0.0) + times
        share = times * pattern[has] / counts[has]
        covered[has] += share
        prices[has] *= np.exp(-share / 4)
        prices[has & (covered >= 1)] = 0
    most = max(1.0, covered.max())
    return [(np.frombuffer(key, np.int64), times / most) for key, times in used.items()]


def _plan(counts: np.ndarray, steps: int, rounds: int, pace: float) -> list[tuple[np.ndarray, int]]:
    left, plan = counts.astype(np.int64).copy(), []
    sizes = np.arange(len(left))
    capacity = len(left) - 1

    def place(pattern: np.ndarray, times: int) -> None:
        plan.append((pattern, times))
        left[:] -= pattern * times

    if left[capacity]:
        one = np.zeros(capacity + 1, np.int64)
        one[capacity] = 1
        place(one, int(left[capacity]))
    for _ in range(rounds):
        before = int(left.sum())
        if not before:
            break
        found = fractional_round(left, min(steps, 20 + 4 * int((left > 0).sum())), pace)
        for pattern, times in found:
            if times >= 1:
                place(pattern, int(times))
        # What rounding down took from nearly full patterns, as far as pieces are left for it.
        for pattern, _ in sorted(found, key=lambda p: p[1] % 1, reverse=True):
            if pattern @ sizes >= 0.98 * capacity and (pattern <= left).all():
                place(pattern, 1)
        if left.sum() == before:
            break
    while left.any():
        pattern, space = np.zeros(capacity + 1, np.int64), capacity
        while space and (fits := np.flatnonzero(left[:space + 1] > pattern[:space + 1])).size:
            size = int(fits[-1])
            n = min(space // size, int(left[size] - pattern[size]))
            pattern[size] += n
            space -= n * size
        has = pattern > 0
        place(pattern, int((left[has] // pattern[has]).min()))
    return plan


def packing_plan(counts: np.ndarray, steps: int = 500, rounds: int = 3, pace: float = 0.5) -> list[tuple[np.ndarray, int]]:
    """Patterns and how many sequences have each, for ``counts[size]`` pieces of each size.

    Rounds of the fractional program, each rounded down and then up where pieces are left for it; what remains goes to
    sequences filled with the largest size that fits, many equal ones at once. Where there are so few pieces that
    rounding spoils the program, filling alone may need fewer sequences, and is taken. Work depends on
    the number of sizes, not of pieces.
    """
    return min(_plan(counts, steps, rounds, pace), _plan(counts, 0, 0, pace), key=lambda plan: sum(n for _, n in plan))


def place_table(counts: np.ndarray, capacity: int, grid: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of each class go: whole sequences of one short length, then the plan.

    ``counts`` is by class: lengths up to ``short`` as they are, then multiples of ``grid``. Returns for each class how many go
    to sequences of its own, how many fill one, its first sequence and its rank among its size in the plan; and the
    plan's rows: size, first rank, first sequence, pieces a sequence. Both ways, with sequences of one length and without, are tried.
    """
    units = capacity // grid
    lengths = np.arange(short + 1)
    size_of = np.concatenate([-(-lengths // grid), np.arange(1, units + 1)])
    per = np.concatenate([[1], capacity // lengths[1:], np.ones(units, np.int64)])

    def tried(whole: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        rest = counts - whole * per
        sizes = np.bincount(size_of, rest, units + 1).astype(np.int64)
        own = np.stack([whole * per, per, np.cumsum(whole) - whole, np.zeros(len(counts), np.int64)], axis=1)
        for k in range(len(counts)):
            own[k, 3] = rest[:k][size_of[:k] == size_of[k]].sum()
        rows, base, filled = [], int(whole.sum()), np.zeros(units + 1, np.int64)
        for pattern, times in packing_plan(sizes):
            for size in np.flatnonzero(pattern):
                rows.append((size, filled[size], base, pattern[size]))
                filled[size] += pattern[size] * times
            base += times
        return base, own, np.array(sorted(rows), np.int64).reshape(-1, 4)

    whole = np.where(np.arange(len(counts)) <= short, counts // per, 0)
    ways = [tried(np.zeros_like(whole))] + ([tried(whole)] if whole.any() else [])
    _, own, table = min(ways, key=lambda way: way[0])
    return own, table, size_of


def pack(pieces: DataFrame, capacity: int = 4096, grid: int = 4, slots: int | None = None, short: int = SHORT) -> DataFrame:
    """Give each piece its ``sequence_id`` and its ``offset`` there.

    Full pieces are sequences of their own, numbered apart without a rank. Of the others, the linear program sees sizes
    rounded up to ``grid``, so it has at most ``capacity / grid`` rows whatever the data; pieces of up to ``short`` tokens also
    fill whole sequences by their exact length, if that is better. The only things collected are the
    counts by length class and slot (a hash of the piece), ``(short + capacity / grid) * slots`` numbers at most. A piece finds its
    sequence by its rank among the pieces of its class: its number within the slot plus the pieces in earlier slots.
    ``pieces`` is read several times: give a stored table. An empty table gives an empty one.
    """
    spark, units, short = pieces.sparkSession, capacity // grid, min(short, capacity)
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    if slots is None:
        slots = int(min(MOST_SLOTS, max(SLOTS, rest.count() // 20_000_000)))
    length = F.col("length")
    marked = rest.withColumn("_size", F.when(length <= short, length).otherwise(short + F.ceil(length / grid)).cast("int")).withColumn(
        "_slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)).cast("int"))
    counts = np.zeros((short + units + 1, slots), np.int64)
    found = marked.groupBy("_size", "_slot").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts[found["_size"], found["_slot"]] = found["n"]
    before = np.cumsum(counts, axis=1) - counts
    own, table, size_of = place_table(counts.sum(axis=1), capacity, grid, short)
    sent = spark.sparkContext.broadcast((before, own, table, size_of))
    first_full = int((table[:, 2].max(initial=0) + counts.sum() + 1) if len(table) else counts.sum() + 1)

    @F.pandas_udf("long")
    def sequence(kind: pd.Series, slot: pd.Series, number: pd.Series) -> pd.Series:
        before, own, table, size_of = sent.value
        kind = kind.to_numpy()
        rank = before[kind, slot.to_numpy()] + number.to_numpy() - 1
        placed, per, base, ahead = own[kind].T
        size, later = size_of[kind], rank - placed + ahead
        wide = np.int64(1) << 44
        row = np.maximum(np.searchsorted(table[:, 0] * wide + table[:, 1], size * wide + later, "right") - 1, 0)
        planned = table[row, 2] + (later - table[row, 1]) // table[row, 3] if len(table) else base
        return pd.Series(np.where(rank < placed, base + rank // per, planned))

    order = ["doc_id", "piece", "ids_crc32"]
    placed = marked.withColumn(
        "_number", F.row_number().over(Window.partitionBy("_size", "_slot").orderBy(*order))
    ).withColumn("sequence_id", sequence("_size", "_slot", "_number"))
    inside = Window.partitionBy("sequence_id").orderBy(*order, "_number", "_size", "_slot").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(
        *pieces.columns, "sequence_id", "offset")
    return placed.union(full.select("*", (F.lit(first_full) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def packed_documents(docs: DataFrame, spec: str, capacity: int = 4096) -> DataFrame:
    """Pieces of ``docs`` with their places. Pieces, narrow rows, are written to the checkpoint folder.

    A null ``doc_id`` is kept as it is; repeated rows are packed each. Other columns are not read.
    """
    return pack(stored(token_pieces(docs, spec, capacity), BATCH), capacity)
