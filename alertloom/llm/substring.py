"""Passages that repeat: removal of long word spans that occur elsewhere, by suffix automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import as_signed, mixed, span_hashes, split_join, text_of, word_spans
from alertloom.llm.packing import blocks_of
from alertloom.session import stored

#: Words of an anchor; anchors with more different surroundings than LARGE are split by window.
ANCHOR, LARGE = 8, 128
#: Words of one automaton, so that a task's memory has a bound.
SHARD_WORDS = 20_000


class SuffixAutomaton:
    """All word spans of some sequences, with the number of times each occurs.

    A state stands for spans that end at the same places; ``longest`` is the length of the longest
    of them, ``link`` the state of its longest suffix that ends at more places.
    """

    def __init__(self) -> None:
        self.moves: list[dict] = [{}]
        self.link, self.longest, self.count = [-1], [0], [0]

    def _state(self, moves: dict, link: int, longest: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.longest.append(longest)
        self.count.append(0)
        return len(self.link) - 1

    def _parted(self, at: int, word, state: int) -> int:
        """The state reached from ``at``, apart from longer spans that share it now."""
        if self.longest[state] == self.longest[at] + 1:
            return state
        new = self._state(dict(self.moves[state]), self.link[state], self.longest[at] + 1)
        self.link[state] = new
        while at >= 0 and self.moves[at].get(word) == state:
            self.moves[at][word] = new
            at = self.link[at]
        return new

    def add(self, words: Sequence, times: int = 1) -> None:
        last = 0
        for word in words:
            known = self.moves[last].get(word)
            if known is not None:
                last = self._parted(last, word, known)
            else:
                new = self._state({}, 0, self.longest[last] + 1)
                at = last
                while at >= 0 and word not in self.moves[at]:
                    self.moves[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    self.link[new] = self._parted(at, word, self.moves[at][word])
                last = new
            self.count[last] += times

    def finish(self) -> None:
        """Sum the counts; after this, ``twice`` has the length of the longest suffix of a state's
        spans that occurs more than once."""
        order = np.argsort(self.longest, kind="stable").tolist()
        for state in reversed(order[1:]):
            self.count[self.link[state]] += self.count[state]
        self.twice = [0] * len(order)
        for state in order[1:]:
            self.twice[state] = self.longest[state] if self.count[state] > 1 else self.twice[self.link[state]]

    def statistics(self, words: Iterable) -> list[int]:
        """For each word, the length of the longest span ending there that the automaton holds."""
        out, at, length = [], 0, 0
        for word in words:
            while at and word not in self.moves[at]:
                at = self.link[at]
                length = self.longest[at]
            if word in self.moves[at]:
                at, length = self.moves[at][word], length + 1
            out.append(length)
        return out

    def repeats(self, words: Iterable) -> list[int]:
        """The same for words that were added, of the spans that occur more than once."""
        out, at = [], 0
        for word in words:
            at = self.moves[at][word]
            out.append(self.twice[at])
        return out


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, a block of the text at a time."""
    found = []
    for block in blocks_of(text):
        data = np.frombuffer(block, np.uint8)
        found.append(span_hashes(mixed(data.astype(np.uint64)), *word_spans(data)))
    return np.concatenate(found)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its least one, the first of equals."""
    least, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        have += step
    return place


def anchored(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor, first word and length of the segments of a document.

    The anchor of a window is the ``anchor`` words in it with the least hash: equal windows have
    equal anchors. A segment is the words of neighbouring windows with one anchor, so each
    window lies in exactly one segment.
    """
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(words) - anchor + 1)
    grams = span_hashes(words, at, at + anchor)
    place = least_places(grams, window - anchor + 1)
    begins = np.flatnonzero(np.diff(place, prepend=-1))
    ends = np.append(begins[1:], len(place))
    return grams[place[begins]], begins, ends - begins + window - 1


def _segments(window: int, anchor: int):
    def scan(batches):
        for batch in batches:
            parts, rows = [], []
            for row, text in enumerate(batch.column(2)):
                words = word_hashes(text.as_buffer().to_pybytes())
                anchors, begins, lengths = anchored(words, window, anchor)
                segs = span_hashes(words, begins, begins + lengths)
                parts.append((anchors, segs, begins << 8 | lengths))
                rows.append(len(begins))
            at = pa.array(np.repeat(np.arange(len(rows)), rows))
            anchors, segs, places = (np.concatenate([p[k] for p in parts]) for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_signed(anchors)), pa.array(as_signed(segs)), batch.column(0).take(at),
                 batch.column(1).take(at), pa.array(places)], ["anchor", "seg", "id", "k", "place"])

    return scan


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [pack.compress(t.as_buffer().to_pybytes()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(texts, pa.binary()), *batch.columns[3:]], batch.schema.names)


def _cut(window: int, large: int):
    """Words of the segments asked for; of large anchors one row for each window instead."""

    def cut(frames):
        unpack = zstandard.ZstdDecompressor()
        names = ["route", "seg", "id", "k", "place", "times", "words"]
        for frame in frames:
            out = []
            for row_id, k, packed, wanted in zip(frame["id"], frame["k"], frame["text"], frame["wanted"]):
                text = unpack.decompress(packed)
                words, hashes = text.split(), None
                for x in wanted:
                    at, length = x["place"] >> 8, x["place"] & 255
                    if x["around"] <= large:
                        out.append((x["anchor"], x["seg"], row_id, k, x["place"], x["n"], b" ".join(words[at:at + length])))
                        continue
                    if hashes is None:
                        hashes = word_hashes(text)
                    begins = np.arange(at, at + length - window + 1)
                    for begin, h in zip(begins.tolist(), as_signed(span_hashes(hashes, begins, begins + window)).tolist()):
                        out.append((h, x["seg"], row_id, k, begin << 8 | window, x["n"], None))
            if out:
                yield pd.DataFrame(out, columns=names)

    return cut


def _marks(window: int, shard_words: int):
    """Streams the segments of a shard through its automaton: bit j of ``mask`` says that the
    window from the j-th word of the segment occurs again."""

    def marked(rows: list) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        for *_, times, words in rows:
            automaton.add(words, times)
        automaton.finish()
        out = []
        for route, seg, _, words in rows:
            repeats = automaton.repeats(words)[window - 1:]
            mask = sum(1 << j for j, length in enumerate(repeats) if length >= window)
            if mask:
                out.append((route, seg, mask))
        return pd.DataFrame(out, columns=["route", "seg", "mask"])

    def marks(frames):
        rows, size, last = [], 0, (None, None)
        for frame in frames:
            for route, seg, times, words in zip(frame["route"], frame["seg"], frame["times"], frame["words"]):
                if (route, seg) == last:
                    continue  # from a row that repeats another's id and text
                if size >= shard_words and route != last[0]:
                    yield marked(rows)
                    rows, size = [], 0
                rows.append((route, seg, times, words.split()))
                size, last = size + len(rows[-1][-1]), (route, seg)
        if rows:
            yield marked(rows)

    return marks


def _removed(window: int):
    def removed(frames):
        unpack = zstandard.ZstdDecompressor()
        for frame in frames:
            out = []
            for doc_id, packed, covers in zip(frame["doc_id"], frame["text"], frame["covers"]):
                text = unpack.decompress(packed)
                covered = covered_words(covers, window) if covers is not None else np.zeros(0, bool)
                out.append((doc_id, *kept_digest(text, covered)))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]).astype({"doc_id": "Int64"})

    return removed


def covered_words(covers: Iterable, window: int) -> np.ndarray:
    """Which words lie in a repeated window, up to the last one that does."""
    starts = np.array([(x["place"] >> 8) + j for x in covers for j in range(x["mask"].bit_length()) if x["mask"] >> j & 1], np.int64)
    change = np.bincount(starts, minlength=starts.max() + window + 1) - np.bincount(
        starts + window, minlength=starts.max() + window + 1)
    return np.cumsum(change) > 0


def kept_digest(text: bytes, covered: np.ndarray) -> tuple[int, int, str, str]:
    """Numbers of words and of words removed, SHA-256 of the kept words and these words."""
    kept, at = [], 0
    for block in blocks_of(text):
        words = block.split()
        out = covered[at:at + len(words)].tolist()
        kept += [w for w, c in zip(words, out) if not c] + words[len(out):] if True in out else words
        at += len(words)
    whole = b" ".join(kept)
    return at, at - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode("utf-8", "replace")


def without_repeats(docs: DataFrame, window: int = 35, anchor: int = ANCHOR, large: int = LARGE,
                    shard_words: int = SHARD_WORDS) -> DataFrame:
    """Documents without the words of windows that start anywhere else in the corpus too.

    Returns a row for each row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``,
    ``kept_text``. A window is ``window`` words in a row; its copies may be in the same document.

    The corpus is its own reference, as large as what is compared with it, so its shards are not
    broadcast but built where what can match arrives:

    1. Windows are grouped by anchors (minimizers), about 7 in 100 words. Only anchors that occur
       twice go on.
    2. A segment (the windows of one anchor occurrence) that occurs twice as a whole is repeated.
    3. Of other segments of anchors with several surroundings, and one copy of the repeated
       ones, the words go to the shard of the anchor. A task builds the suffix automaton of a
       shard and streams its segments through it: windows whose matching statistic, among spans
       that occur more than once, reaches ``window`` are repeated.
    4. An anchor with more than ``large`` surroundings (a common line) would make a shard without
       bound. Its windows are dealt by their own hash instead and counted there.

    Words, anchors and segments are compared by 64-bit hashes before the words themselves. Joins on
    anchors and segments are by shuffle, so Spark splits their hot keys; counts are combined per task.
    Segments and marks are narrow and lie in the checkpoint folder; texts move compressed, twice.

    Null text has no words; documents of fewer than ``window`` words keep all. Rows that repeat id
    and text are copies of each other, so all their windows are removed. Null ids are kept.
    An empty table gives no rows.
    """
    if not anchor <= window < anchor + 60:
        raise ValueError("a segment must have fewer than 60 windows")
    text = text_of()
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"),
                        F.xxhash64(F.col("doc_id").cast("string"), text).alias("k"), text.alias("text"),
                        F.col("doc_id").cast("long").alias("doc_id"))
    scan = keyed.select("id", "k", "text").mapInArrow(
        _segments(window, anchor), "anchor long, seg long, id long, k long, place long")
    often = scan.select("anchor").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = stored(split_join(scan, often, ["anchor"], "left_semi"))
    place = F.struct("id", "k", "place")
    segments = stored(found.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")))
    around = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("around")).where("around > 1")
    wanted = split_join(segments, around, ["anchor"]).select("first.*", "anchor", "seg", "n", "around")
    wanted = wanted.groupBy("id", "k").agg(F.collect_list(F.struct("place", "anchor", "seg", "n", "around")).alias("wanted"))
    packed = keyed.select("id", "k", F.col("text").cast("binary").alias("text"), "doc_id").mapInArrow(
        _packed, "id long, k long, text binary, doc_id long")
    cut = stored(packed.select("id", "k", "text").join(wanted, ["id", "k"]).mapInPandas(
        _cut(window, large), "route long, seg long, id long, k long, place long, times long, words binary"))

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = cut.where("words IS NOT NULL").select("route", "seg", "times", "words")
    marks = shards.repartition(width, "route").sortWithinPartitions("route", "seg").mapInPandas(
        _marks(window, shard_words), "route long, seg long, mask long")
    light = cut.where("words IS NOT NULL AND times = 1").select("route", "seg", "id", "k", "place").join(
        marks, ["route", "seg"]).select("id", "k", "place", "mask")
    windows = cut.where("words IS NULL").select("route", "id", "k", "place", "times").distinct()
    again = windows.groupBy("route").agg(F.sum("times").alias("n")).where("n > 1").drop("n")
    heavy = split_join(windows.where("times = 1"), again, ["route"], "left_semi").select("id", "k", "place", F.lit(1).cast("long").alias("mask"))
    whole = found.join(segments.where("n > 1").select("anchor", "seg"), ["anchor", "seg"], "left_semi").select(
        "id", "k", "place", (F.expr(f"shiftleft(1L, CAST((place & 255) - {window - 1} AS int))") - 1).alias("mask"))
    covers = light.union(heavy).union(whole).distinct().groupBy("id", "k").agg(
        F.collect_list(F.struct("place", "mask")).alias("covers"))
    return packed.join(covers, ["id", "k"], "left").select("doc_id", "text", "covers").mapInPandas(
        _removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def spans_in_reference(docs: DataFrame, reference: DataFrame, least: int = 35, shard_words: int = 200_000,
                       most_shards: int = 64) -> DataFrame:
    """Maximal spans of at least ``least`` words of the documents that a given reference holds.

    ``reference`` (``text``) is a list of bounded size, such as benchmark items: its words are
    counted first, and more than ``shard_words * most_shards`` are an error. Its shards are collected,
    made suffix automata and broadcast one after the other; the documents stream past each for their
    matching statistics. Returns ``doc_id``, ``begin``, ``end`` (words), a row for each span and shard.
    Null texts have no spans.
    """
    spark = docs.sparkSession
    texts = reference.select(text_of().alias("text"))
    size = texts.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if size > shard_words * most_shards:
        raise ValueError(f"the reference has {size} words, more than {shard_words * most_shards}")
    shards: list[SuffixAutomaton] = []
    room = 0
    for row in texts.toLocalIterator():
        words = row["text"].encode().split()
        if len(words) >= least:
            if not shards or room < len(words):
                shards.append(SuffixAutomaton())
                room = shard_words
            shards[-1].add(words)
            room -= len(words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = None
    for shard in shards:
        sent = spark.sparkContext.broadcast(shard)

        def spans(frames, sent=sent):
            for frame in frames:
                out = []
                for doc_id, text in zip(frame["doc_id"], frame["text"]):
                    lengths = [*sent.value.statistics(text.encode().split()), 0]
                    # A match is maximal where the next word does not prolong it.
                    out += [(doc_id, e + 1 - n, e + 1) for e, n in enumerate(lengths[:-1]) if n >= least and lengths[e + 1] <= n]
                yield pd.DataFrame(out, columns=["doc_id", "begin", "end"]).astype({"doc_id": "Int64"})

        part = rows.mapInPandas(spans, "doc_id long, begin long, end long")
        found = part if found is None else found.union(part)
    return found if found is not None else rows.select("doc_id", F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("end")).limit(0)
