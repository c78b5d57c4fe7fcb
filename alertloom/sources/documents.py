"""Records of JSON documents of any size: a document is cut at closing braces, as Spark splits any text, and read in parallel.

What a stretch of a document means depends on what stands before it: whether a string is open, how deep it lies, which array
it belongs to. Each split says what it does to either state; the states at the splits' beginnings follow from these few numbers; then
each split cuts out its records, and the parts of records that lie in several splits are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.session import package_on_workers, stored

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[\[\]{},]', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*+("?)', re.S)
#: The field of a wrapping object that holds the records.
WRAPPED_IN = '"incidents"'
KEY = ("file", "block")


def shift(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open behind a stretch, and how much deeper it ends, if a string is open before or not."""
    at, depth = 0, 0
    if inside:
        rest = _REST.match(text)
        if not rest[1]:
            return True, 0
        at = rest.end()
    for token in _TOKEN.finditer(text, at):
        c = text[token.start()]
        if c == '"':
            if not token[1]:
                return True, depth
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
    return False, depth


class Cutter:
    """Cuts the records out of consecutive stretches of a document.

    ``level``: 1 for records of the outer array, 2 for those of an array in an outer object. ``mine`` says whether the array
    at hand is the records'; None where it began before the first stretch.
    """

    def __init__(self, inside: bool, depth: int, level: int):
        self.inside, self.depth, self.level = inside, depth, level
        self.mine = False if depth < level else True if level == 1 else None
        self.head = self.mine is not False  # a record goes on from before
        self.parts: list[str] = []
        self.last, self.seen = "", False
        self.ended = {None: 0, True: 0}
        self.first: tuple[str, bool] | None = None

    def _end(self, text: str) -> str | None:
        whole = "".join([*self.parts, text])
        self.parts = []
        if self.head:
            self.head, self.first = False, (whole, True)
        elif not whole.strip():
            return None
        self.ended[self.mine] += 1
        return None if self.first and self.first[0] is whole else whole.strip()

    def feed(self, text: str) -> Iterator[tuple[int, bool | None, str]]:
        """The records that end in a stretch: their number among those that end here, whose array, text. The first is left out if
        it began before."""
        at, begin = 0, 0
        if self.inside:
            rest = _REST.match(text)
            self.inside, at = not rest[1], rest.end()
        if not self.inside:
            for token in _TOKEN.finditer(text, at):
                c = text[token.start()]
                if c == '"':
                    if not token[1]:
                        self.inside = True
                        break
                    if self.depth == 1 and self.level == 2:
                        self.last = token[0]
                elif c in "[{":
                    self.depth += 1
                    if self.depth == self.level:
                        self.mine = c == "[" and (self.level == 1 or self.last == WRAPPED_IN)
                        self.seen |= self.mine
                        begin, self.parts = token.end(), []
                elif self.depth == self.level and self.mine is not False and c in ",]}":
                    mine, record = self.mine, self._end(text[begin:token.start()])
                    if record is not None:
                        yield sum(self.ended.values()) - 1, mine, record
                    begin = token.end()
                    if c != ",":
                        self.depth, self.mine = self.depth - 1, False
                elif c in "]}":
                    self.depth -= 1
        if self.mine is not False and self.depth >= self.level:
            self.parts.append(text[begin:])

    def tail(self) -> str | None:
        return "".join(self.parts) if self.mine is not False and self.depth >= self.level else None


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The text of the files cut behind each closing brace, in order within a split."""
    return spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[str], int]]:
    """File and block with the consecutive pieces of a batch that belong to it, and the first one's place."""
    files, blocks, values = (batch.column(k).to_pylist() for k in (0, 1, 2))
    begin = 0
    for k in range(1, len(files) + 1):
        if k == len(files) or (files[k], blocks[k]) != (files[begin], blocks[begin]):
            yield (files[begin], blocks[begin]), [v + "}" for v in values[begin:k]], begin
            begin = k


def _shifts(batches):
    """What each split does to a state outside and inside a string, and its first character."""
    held, key = None, None

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(("file", "block"), key, strict=True)) | held])

    for batch in batches:
        for own, texts, _ in _runs(batch):
            if own != key:
                if key is not None:
                    yield row()
                key, held = own, {"out_in": False, "out_depth": 0, "in_in": True, "in_depth": 0, "first": ""}
            text = "".join(texts)
            for name in ("out", "in"):
                inside, depth = shift(text, held[f"{name}_in"])
                held |= {f"{name}_in": inside, f"{name}_depth": held[f"{name}_depth"] + depth}
            held["first"] = held["first"] or text.lstrip()[:1]
    if key is not None:
        yield row()


def _states(batches):
    """For each split of a file the state at its beginning, out of the shifts before it."""
    for batch in batches:
        for r in batch.to_pylist():
            inside, depth, rows = False, 0, []
            for s in r["splits"]:
                rows.append({"file": r["file"], "block": s["block"], "inside": inside, "depth": depth, "first": r["splits"][0]["first"]})
                name = "in" if inside else "out"
                inside, depth = s[f"{name}_in"], depth + s[f"{name}_depth"]
            # The last piece may have had no brace behind it.
            whole = not inside and depth in (0, -1)
            yield pa.RecordBatch.from_pylist([x | {"whole": whole} for x in rows])


def _cut(edges: bool):
    """The edges of each split (counts, what belongs to records that began before or end later), or the records within it."""
    def cut(batches):
        cutter, key, number = None, None, None

        def edge():
            tail = cutter.tail()
            first = cutter.first or ((tail, False) if cutter.head else None)
            return pa.RecordBatch.from_pylist([{
                "file": key[0], "block": key[1], "inherited": cutter.ended[None], "own": cutter.ended[True], "head": first and first[0],
                "tail": None if cutter.head else tail, "tail_mine": cutter.mine, "seen": cutter.seen}], schema=_EDGES)

        for batch in batches:
            inside, depth, first, base, mine = (batch.column(k) for k in range(3, 8))
            found = []
            for own, texts, at in _runs(batch):
                if own != key:
                    if key is not None and edges:
                        yield edge()
                    key, cutter = own, Cutter(inside[at].as_py(), depth[at].as_py(), 1 if first[at].as_py() == "[" else 2)
                    number, inherits = base[at].as_py(), mine[at].as_py()
                    known: dict = {True: True, None: inherits}
                # Records that end while the array's owner is inherited count only if it is the records'.
                for n, whose, record in cutter.feed("".join(texts)):
                    if not edges and known[whose]:
                        lost = 0 if inherits else cutter.ended[None]
                        found.append((own[0], number + n - lost, record))
            if not edges and found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["file", "pos", "raw"])
        if key is not None and edges:
            yield edge()

    return cut


_EDGES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("inherited", pa.int64()), ("own", pa.int64()), ("head", pa.string()),
                    ("tail", pa.string()), ("tail_mine", pa.bool_()), ("seen", pa.bool_())])


def _bases(batches):
    """For each split whether it begins in the records' array and how many records end before it."""
    for batch in batches:
        for r in batch.to_pylist():
            mine, base, rows, found = r["first"] == "[", 0, [], r["first"] == "["
            for s in r["splits"]:
                ended = s["own"] + (s["inherited"] if mine else 0)
                rows.append({"file": r["file"], "block": s["block"], "base": base, "mine": mine, "ended": ended})
                base, found = base + ended, found or s["seen"]
                mine = mine if s["tail_mine"] is None else s["tail_mine"]
            yield pa.RecordBatch.from_pylist([x | {"found": found} for x in rows])


def document_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The records of all documents and what was seen of each document.

    Returns ``file``, ``pos`` (from 0), ``raw`` (its text) of each record of an outer array, or of the array ``incidents`` in an outer
    object, and ``file``, ``first`` (its first character), ``whole`` (its brackets and strings are closed), ``found`` (it has such an
    array) of each file that is not empty. The files are scanned three times, for the states, for the edges of the
    splits, and for the records; only a few numbers a split and the parts of records across splits are stored or shuffled.
    """
    package_on_workers(spark)
    pieces = _pieces(spark, paths)
    shifts = pieces.mapInArrow(_shifts, "file string, block long, out_in boolean, out_depth long, in_in boolean, in_depth long, first string")
    files = shifts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "out_in", "out_depth", "in_in", "in_depth", "first"))).alias("splits"))
    states = stored(files.mapInArrow(_states, "file string, block long, inside boolean, depth long, first string, whole boolean"))

    def placed(known: DataFrame) -> DataFrame:
        """Each piece with what is known of its split, a row for 128 MB of text."""
        return pieces.join(F.broadcast(known), [*KEY]).select("file", "block", "value", "inside", "depth", "first", "base", "mine")

    begun = states.withColumns({"base": F.lit(0).cast("long"), "mine": F.lit(True)})
    edges = stored(placed(begun).mapInArrow(
        _cut(True), "file string, block long, inherited long, own long, head string, tail string, tail_mine boolean, seen boolean"))
    counts = edges.join(states.select(*KEY, "first"), [*KEY]).groupBy("file").agg(F.first("first").alias("first"), F.array_sort(F.collect_list(
        F.struct("block", "inherited", "own", "tail_mine", "seen"))).alias("splits"))
    bases = stored(counts.mapInArrow(_bases, "file string, block long, base long, mine boolean, ended long, found boolean"))
    records = placed(states.join(bases, [*KEY])).mapInArrow(_cut(False), "file string, pos long, raw string")

    known = edges.join(bases, [*KEY])
    parts = known.where("head IS NOT NULL AND mine").select("file", F.col("base").alias("pos"), "block", F.col("head").alias("text")).union(
        known.where(F.col("tail").isNotNull() & F.coalesce("tail_mine", "mine")).select("file", (F.col("base") + F.col("ended")).alias("pos"), "block", "tail"))
    across = parts.groupBy("file", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("raw"))
    across = across.select("file", "pos", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw")).where("raw <> ''")
    seen = states.join(bases.select(*KEY, "found"), [*KEY]).select("file", "first", "whole", "found").distinct()
    return records.union(across), seen
