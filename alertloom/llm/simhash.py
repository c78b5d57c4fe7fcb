"""SimHash fingerprints and their links by pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import as_signed, components, row_key, split_join, text_of
from alertloom.session import stored

#: Keys with more fingerprints than this are split once more.
LARGE_BUCKET = 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42, block: int = 100_000) -> int:
    """64-bit SimHash of a text: the majority of the bits of its shingles' XXH64.

    Upper case ASCII counts as lower case; a shingle is ``width`` words joined by a space, the whole
    text if it has fewer; without words it is 0. Long texts are hashed ``block`` shingles at a time.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    begins, ends = begins[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, len(ends), block):
        hashes = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(begins[at:at + block], ends[at:at + block])], ">u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``key`` (of id and text) and ``fp``, the fingerprint as a signed long, for each row.

    Null text counts as empty. Other columns are not read.
    """

    def hashed(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes(), width, seed) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(as_signed(fps))], ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), text_of().alias("text")).mapInArrow(
        hashed, "doc_id long, key long, fp long")


def _spans(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal blocks of the given bit places."""
    cuts = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(bits: list[int], blocks: int, distance: int) -> list[int]:
    """Masks of which two fingerprints at most ``distance`` apart share one: the ``distance``
    differing bits touch as many blocks at most, and each choice of the other blocks is a mask."""
    parts = _spans(bits, blocks)
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def linked_in_bucket(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected in a bucket, fewer than it has fingerprints.

    Each fingerprint is once compared with those not yet reached, all at once.
    """
    rest, edges = fps, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                edges += [(at, x) for x in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def _bucket_links(distance: int):
    def links(frames):
        carried = None
        for frame in frames:
            if carried is not None:
                frame = pd.concat([carried, frame], ignore_index=True)
            table, key, sub, rest = (frame[c].to_numpy() for c in ("t", "key", "s", "sub"))
            new = np.ones(len(frame), bool)
            new[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]) | (rest[1:] != rest[:-1])
            begins = np.flatnonzero(new)
            carried = frame.iloc[begins[-1]:]  # the last bucket may go on in the next batch
            yield _links(frame["fp"].to_numpy()[:begins[-1]], begins, distance)
        if carried is not None:
            yield _links(carried["fp"].to_numpy(), np.array([0, len(carried)]), distance)

    return links


def _links(fps: np.ndarray, bounds: np.ndarray, distance: int) -> pd.DataFrame:
    fps = fps.view(np.uint64)
    sizes = np.diff(bounds)
    two = bounds[:-1][sizes == 2]
    two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
    edges = [np.stack([fps[two], fps[two + 1]], axis=1)]
    for k in np.flatnonzero(sizes > 2):
        if found := linked_in_bucket(fps[bounds[k]:bounds[k + 1]], distance):
            edges.append(np.array(found, np.uint64))
    edges = as_signed(np.concatenate(edges))
    return pd.DataFrame({"a": edges.min(axis=1), "b": edges.max(axis=1)}).drop_duplicates()


def _keys(masks: list[int], fp: Column) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key"))
                               for i, m in enumerate(masks)]))


def fingerprint_links(distinct: DataFrame, distance: int = 3, blocks: int = 6, sub_blocks: int = 8,
                      large: int = LARGE_BUCKET) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that connect all within ``distance`` bits.

    Each fingerprint goes to one bucket for each choice of ``blocks - distance`` of its blocks (20
    buckets of about 32 bits), so close ones meet in a bucket. Buckets of one are dropped. In a
    bucket of more than ``large``, the free bits are cut into ``sub_blocks`` again and members are
    dealt to the choices of these; what is then still free has 13 bits, so that no bucket can hold
    more than 8192 fingerprints whatever the data. A bucket gives fewer links than it has members:
    those that connect what is linked there, not all pairs.
    """
    bits = list(range(64))
    masks = block_masks(bits, blocks, distance)
    keyed = distinct.select("fp", _keys(masks, F.col("fp")).alias("k")).select("fp", "k.t", "k.key")
    counts = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    keyed = stored(split_join(keyed, counts, ["t", "key"]))
    whole = keyed.where(F.col("n") <= large).select("t", "key", F.lit(-1).alias("s"), F.lit(0).cast("long").alias("sub"), "fp")
    subs = F.array(*[F.array(*[F.lit(_signed(m)) for m in block_masks([b for b in bits if not mask >> b & 1], sub_blocks, distance)])
                     for mask in masks])
    dealt = keyed.where(F.col("n") > large).select("t", "key", "fp", F.posexplode(F.element_at(subs, F.col("t") + 1)).alias("s", "mask")).select(
        "t", "key", "s", F.col("fp").bitwiseAND(F.col("mask")).alias("sub"), "fp")
    width = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["t", "key", "s", "sub"]
    return whole.union(dealt).repartition(width, *place).sortWithinPartitions(*place, "fp").mapInPandas(
        _bucket_links(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """Groups of documents connected by fingerprints at most ``distance`` bits apart.

    Returns a row for each row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits),
    ``component_id`` (the smallest ``doc_id`` reachable, its own included). Rows of one fingerprint
    are linked; they count once in all that follows. Only fingerprints, 8 bytes a document, are
    shuffled; they are written to the checkpoint folder, so texts are read once.
    Texts without words have fingerprint 0 and are linked like any other. Null ids do not name a
    component unless it has no other; an empty table gives no rows.
    """
    return _grouped(docs, distance, width, seed).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, distance: int, width: int, seed: int) -> DataFrame:
    rows = stored(fingerprints(docs, width, seed))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(fingerprint_links(distinct, distance))
    roots = distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    names = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = split_join(roots, names, ["root"]).select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "key", "fp", "component_id")


def representatives(docs: DataFrame, distance: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """The documents that stay, with all their columns: of each component the one with its smallest ``doc_id``.

    Rows that repeat the id and the text of one that stays are the same document and stay too. A
    component of null ids only keeps all its rows, since nothing tells which comes first.
    """
    kept = _grouped(docs, distance, width, seed).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), row_key().alias("own_key"))
    return rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_key") == F.col("kept_key")), "left_semi").select("row.*")
