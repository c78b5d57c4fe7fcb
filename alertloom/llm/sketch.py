"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import mixed, span_hashes, text_of

#: One in so many shingle hashes is retained; a shingle is so many bytes of UTF-8.
SCALE, WIDTH = 4, 12
#: Slots in which ids are counted to cut them into ranges, and ranges, at most.
SLOTS, RANGES = 1 << 16, 1 << 14


def sketch(text: bytes, scale: int = SCALE, width: int = WIDTH) -> np.ndarray:
    """The retained hashes, sorted: those of the distinct shingles that lie below 2**64 / scale.

    A shingle is ``width`` bytes in a row, or the whole text if it is shorter. Whether a hash is
    retained depends on it alone, so sketches of parts merge by union and sketches of texts of
    very different lengths stay comparable. A text with none below the threshold, a short one, gets its least
    hash instead, so that it can be told from others; that hash lies above the threshold, which marks it, and
    ``retained`` drops it before sketches are merged. An empty text has none.
    """
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    limit, found = np.uint64(2**64 // scale), []
    step = 1 << 18  # bytes hashed at a time
    for at in range(0, max(1, len(data) - width + 1), step):
        part = data[at:at + step + width - 1]
        starts = np.arange(max(1, len(part) - width + 1))
        hashes = span_hashes(mixed(part.astype(np.uint64)), starts, np.minimum(starts + width, len(part)))
        few = hashes[hashes < limit]
        found.append(few if len(few) else hashes.min(keepdims=True))
    hashes = np.unique(np.concatenate(found))
    few = hashes[hashes < limit]
    return few if len(few) else hashes[:1]


def retained(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """A sketch without the hash that stands in for a short text's."""
    return hashes[hashes < np.uint64(2**64 // scale)]


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Shared part of all hashes of both (resemblance) and of the smaller sketch (containment).

    Two empty sketches are alike (1), an empty and another are not (0).
    """
    if not len(a) or not len(b):
        return (1.0, 1.0) if len(a) == len(b) else (0.0, 0.0)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared), shared / min(len(a), len(b))


def as_text(hashes: np.ndarray) -> str:
    """Twelve hex digits a hash: the leading digit is 0, the last three are dropped."""
    digits = (hashes >> np.uint64(12)).astype(">u8").tobytes().hex()
    return "".join([digits[i + 4:i + 16] for i in range(0, len(digits), 16)])


def fingerprint_text(text: bytes, scale: int = SCALE, width: int = WIDTH) -> str:
    return as_text(sketch(text, scale, width))


def document_sketches(docs: DataFrame, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row; null text counts as empty. No shuffle."""

    def sketched(batches):
        for batch in batches:
            prints = [fingerprint_text(t.as_buffer().to_pybytes(), scale, width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        sketched, "doc_id long, fingerprint string")


def merged_sketches(docs: DataFrame, group: str, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """Sketches of whole groups of documents as rows ``group``, ``hash`` (retained, distinct).

    The union of the members' retained hashes, that is the sketch of the group's shingles; hashes that stand in for
    short texts are left out. Containment of one group in another is a join on ``hash``. The hashes of a group are never gathered.
    """

    def sketched(batches):
        for batch in batches:
            hashes = [retained(sketch(t.as_buffer().to_pybytes(), scale, width), scale) for t in batch.column(1)]
            rows = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
            flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(flat.view(np.int64))], [group, "hash"])

    return docs.select(F.col(group).cast("string").alias(group), text_of().alias("text")).mapInArrow(
        sketched, f"`{group}` string, hash long").distinct()


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Number of code points, and the text whose last third is replaced by as much of the next."""
    chars, other = text.decode("utf-8", "replace"), following.decode("utf-8", "replace")
    third = len(chars) // 3
    return len(chars), (chars[:len(chars) - third] + other[:third]).encode()


def edit_trial(docs: DataFrame, scale: int = SCALE, width: int = WIDTH, bytes_a_range: int = 32 << 20) -> DataFrame:
    """Fingerprints of the documents, of their edited texts, and how alike these are.

    The edit puts the beginning of the next document, in descending order of ``doc_id`` (the first
    after the last), in place of the last third. Documents are dealt to ranges of ``doc_id``, their
    texts compressed, and streamed in order; a range also gets the first document of the range
    after it. Collected are the bytes by slot of ids and the largest ids of the ranges, whose numbers are bounded whatever
    the table: with more bytes the ranges grow, and a range is streamed. Rows of one ``doc_id`` go by their
    compressed bytes; null ids come last; null text counts as empty.
    A single document follows itself. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    width_of = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = id_cuts(rows, width_of, bytes_a_range)
    # Range 0 has the largest ids; a null id is in the last.
    sent = spark.sparkContext.broadcast(np.array(cuts, np.int64))
    tops = {r["place"]: r["top"] for r in rows.select("doc_id").mapInArrow(
        _places(sent), "place int, doc_id long").groupBy("place").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    # The range whose documents end before this one starts; the last one goes on with the first.
    before = {order[k]: order[k - 1] for k in range(len(order))}
    heads = spark.sparkContext.broadcast((before, tops))
    dealt = rows.mapInArrow(_dealt(sent, heads), "place int, ahead boolean, doc_id long, packed binary")
    columns = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double, contained_edited double, contained_next double")
    parts = max(1, len(order))
    return dealt.repartition(parts, "place").sortWithinPartitions(
        "place", "ahead", F.desc_nulls_last("doc_id"), "packed").mapInArrow(_streamed(scale, width), columns)


def id_cuts(rows: DataFrame, least: int, bytes_a_range: int) -> list[int]:
    """Ids that cut ``rows`` (``doc_id``, ``text``) into ranges of about equal bytes: each is the largest id of its range.

    Bytes are counted by slots of ids, equal stretches of their values. Slots that hold more than a range are cut into slots
    again, until they do not or are single ids. Collected are at most ``SLOTS`` sums a pass; a pass splits an id by 8 bits
    at least. There are ``least`` to ``RANGES`` ranges.
    """
    known = rows.where("doc_id IS NOT NULL").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    bounds = known.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    if not bounds.n:
        return []
    # Each row counts for a byte more, so that empty texts are dealt out too.
    total = bounds.bytes + bounds.n
    size = max(1, min(total // least, max(bytes_a_range, total // RANGES)))
    shift = max(0, (bounds.high - bounds.low).bit_length() - 16)

    def slot(width: int) -> Column:
        away = F.col("doc_id").cast("decimal(20,0)") - F.lit(Decimal(bounds.low)).cast("decimal(20,0)")
        return F.floor(away / F.lit(Decimal(1 << width)).cast("decimal(20,0)")).cast("decimal(20,0)")

    def sums(part: DataFrame, slot: Column) -> list[tuple[int, int]]:
        found = part.groupBy(slot.alias("s")).agg((F.sum("bytes") + F.count(F.lit(1))).alias("b")).collect()
        return [(int(r.s), r.b) for r in found]

    slots = [(s << shift, shift, b) for s, b in sums(known, slot(shift))]
    while shift and (heavy := [(s, b) for s, width, b in slots if width == shift and b > size]):
        # The heavy slots share what may be collected.
        step = max(1, min(shift, 16 - max(len(heavy) - 1, 0).bit_length()))
        sent = rows.sparkSession.createDataFrame([(Decimal(s >> shift),) for s, _ in heavy], "_slot decimal(20,0)")
        inside = known.withColumn("_slot", slot(shift)).join(F.broadcast(sent), "_slot")
        below = shift - step
        gone = {s for s, _ in heavy}
        slots = [x for x in slots if not (x[1] == shift and x[0] in gone)] + [(s << below, below, b) for s, b in sums(inside, slot(below))]
        shift = below
    cuts, held = [], 0
    for begin, width, b in sorted(slots):
        held += b
        if held >= size:
            cuts.append(min(bounds.low + begin + (1 << width) - 1, bounds.high))
            held = 0
    return sorted(set(cuts))


def _place(cuts: np.ndarray, ids: pa.Array) -> np.ndarray:
    known = ids.fill_null(0).to_numpy(zero_copy_only=False)
    place = len(cuts) - np.searchsorted(cuts, known, "left")
    return np.where(np.asarray(ids.is_null()), len(cuts), place).astype(np.int32)


def _places(sent):
    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(sent.value, batch.column(0))), batch.column(0)], ["place", "doc_id"])

    return places


def _dealt(sent, heads):
    def deal(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            before, tops = heads.value
            places, ids = _place(sent.value, batch.column(0)), batch.column(0).to_pylist()
            packed = pa.array([pack.compress(t.as_buffer().to_pybytes()) for t in batch.column(1)], pa.binary())
            first = [k for k, (p, i) in enumerate(zip(places.tolist(), ids)) if tops[p] == i]
            rows = pa.array([*range(len(ids)), *first], pa.int32())
            place = pa.array([*places.tolist(), *(before[places[k]] for k in first)], pa.int32())
            ahead = pa.array([False] * len(ids) + [True] * len(first))
            yield pa.RecordBatch.from_arrays(
                [place, ahead, batch.column(0).take(rows), packed.take(rows)], ["place", "ahead", "doc_id", "packed"])

    return deal


def _streamed(scale: int, width: int):
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next", "contained_edited", "contained_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4)

    def trial(doc, following) -> tuple:
        (_, doc_id, text, own), (_, _, other, theirs) = doc, following
        n, changed = edited(text, other)
        new = sketch(changed, scale, width)
        near, inside = likeness(own, new)
        near_next, inside_next = likeness(own, theirs)
        return (doc_id, n, hashlib.sha256(changed).hexdigest(), as_text(own), as_text(new),
                near, near_next, inside, inside_next)

    def stream(batches):
        unpack = zstandard.ZstdDecompressor()
        waiting, done = None, None  # the document that waits for its next; the range that has it
        for batch in batches:
            out = []
            for place, ahead, doc_id, packed in zip(*[c.to_pylist() for c in batch.columns]):
                if done == place:
                    continue  # further rows that repeat the id of the first document of the next range
                text = unpack.decompress(packed)
                doc = (place, doc_id, text, sketch(text, scale, width))
                if waiting is not None:
                    out.append(trial(waiting, doc))
                waiting, done = (None, place) if ahead else (doc, None)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], list(names))

    return stream
