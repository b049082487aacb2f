"""Operator 8, best-fit packing planned on a histogram of lengths.

Texts are tokenised once; longer documents are cut, and what moves from there on are narrow rows of piece lengths. Best-fit decreasing
runs on the driver over counts by length (at most `capacity` numbers, whatever the number of documents): sequences with the same
room are one group, and a step fills a whole group. The plan is a list of runs of slots for each length. Pieces take them by
rank within their length; the rank is a row number within one of many salts of the length plus the counts of the salts before,
so a length that a third of the pieces share is dealt over many tasks.

Edge cases: null and empty texts are one end token; null ids are packed like others; repeated rows are packed each; a
document of exactly `capacity` tokens isn't cut; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import sys
import zlib
from array import array
from collections.abc import Iterator, Mapping
from itertools import chain
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textbytes

CAPACITY = 2048
END_ID = 0
ROWS_PER_SALT = 500_000
#: Distinct parts of texts whose ids a task remembers.
CACHE_PARTS = 500_000

#: Parts encoded as one text.
LINES = 1_000
#: Characters of all parts that a task remembers.
CACHE_CHARS = 1 << 26

assert sys.byteorder == "little"
_SPECIAL = "<|endoftext|>"
#: Numbers that Python takes for letters, to U+FFFF; they are sought by a table of bits.
_NUMBERS = "".join(c for c in map(chr, range(0x10000)) if category(c) in ("Nl", "No"))
#: The parts that the tokeniser splits a text into before it encodes each by itself. Texts with a character that isn't `_agreed` are encoded whole.
_PART = re.compile(rf" ?[^\W\d_{_NUMBERS}]++|'(?:s|t|re|ve|m|ll|d)| ?[\d{_NUMBERS}]++| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+")


def _agreed(c: str) -> bool:
    """Whether _PART and the tokeniser take a character for the same: not where its letters and numbers may be newer than Python's, which
    calls them unassigned, nor where _PART takes it for another class than its own."""
    kind = category(c)
    seen = "S" if c.isspace() else ("N" if c.isdecimal() or c in _NUMBERS else "L") if c.isalnum() else "other"
    own = "S" if c in "\t\n\v\f\r\x85" or kind[0] == "Z" else kind[0] if kind[0] in "LN" else "other"
    return kind != "Cn" and seen == own


#: What stands for the end among parts; no part has white space after a letter.
_END = "end "
_encoders: dict[tuple[str, int], Encoder] = {}


class _Numbers(dict):
    """Numbers strings as they come and lists the new ones."""

    def __init__(self, *known: str) -> None:
        super().__init__({x: k for k, x in enumerate(known)})
        self.new: list[str] = []

    def __missing__(self, name: str) -> int:
        self[name] = number = len(self)
        self.new.append(name)
        return number

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


class _Runs:
    """Runs of ids: all ids one after another, where each run begins, and its size."""

    def __init__(self, *runs: list[int]) -> None:
        self.ids, self.size = np.array([x for r in runs for x in r], np.uint32), np.array([len(r) for r in runs], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.at = np.append(self.at, len(self.ids) + np.cumsum(size) - size)
        self.ids, self.size = np.append(self.ids, ids), np.append(self.size, size)

    def take(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of the runs of those numbers, one after another."""
        size = self.size[numbers]
        return self.ids[np.repeat(self.at[numbers] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class Encoder:
    """Token ids of whole texts: distinct parts are encoded once for many texts, which gather their ids."""

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.break_id, *more = self.tokenizer.encode("\n", add_special_tokens=False).ids
        if more:
            raise ValueError("a line break must be one token")
        self.known: set[str] = set()
        self.strange: set[str] = set()
        self.clear()

    @classmethod
    def of(cls, path: str, end_id: int = END_ID) -> Encoder:
        if (path, end_id) not in _encoders:
            _encoders[path, end_id] = cls(path, end_id)
        return _encoders[path, end_id]

    def clear(self) -> None:
        self.parts, self.runs = _Numbers(_END), _Runs([self.end_id])
        self.odd, self.chars = np.zeros(1, bool), 0

    def _learn(self, parts: list[str]) -> None:
        """Ids of new parts, and which of them hold a character that isn't agreed on."""
        new = set().union(*parts) - self.known
        self.strange |= {c for c in new if not _agreed(c)}
        self.known |= new
        self.odd = np.append(self.odd, [not self.strange.isdisjoint(p) for p in parts] if self.strange else np.zeros(len(parts), bool))
        self.chars += sum(map(len, parts))
        self.runs.add(*self._encoded_parts(parts))

    def _encoded_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encoded. A line break is a part and an id by itself beside any part that isn't white space, so those are encoded as lines of a text."""
        lines, spaces = [x for x in parts if not x.isspace()], [x for x in parts if x.isspace()]
        ids, _ = self._encoded(["\n".join([*lines[k : k + LINES], ""]) for k in range(0, len(lines), LINES)])
        ends = np.flatnonzero(ids == self.break_id)
        own, size = self._encoded(spaces)
        sizes = np.zeros(len(parts), np.int64)
        blank = np.array([x.isspace() for x in parts], bool)
        sizes[~blank], sizes[blank] = np.diff(ends, prepend=-1) - 1, size
        out = np.empty(int(sizes.sum()), np.uint32)
        of_blank = np.repeat(blank, sizes)
        out[of_blank], out[~of_blank] = own, np.delete(ids, ends)
        return out, sizes

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another, and how many each text has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with an end id, and how many each text has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.parts) > CACHE_PARTS or self.chars > CACHE_CHARS:
            self.clear()
        numbers, begins, whole = array("q"), [], []
        for k, text in enumerate(texts):
            begins.append(len(numbers))
            if _SPECIAL in text:
                whole.append(k)
            else:
                numbers.extend(map(self.parts.__getitem__, _PART.findall(text)))
            numbers.append(0)
        self._learn(self.parts.taken())
        parts = np.frombuffer(numbers, np.int64)
        odd = np.logical_or.reduceat(self.odd[parts], np.array(begins))
        odd[whole] = True
        ids, size = self.runs.take(parts), np.add.reduceat(self.runs.size[parts], np.array(begins))
        if odd.any():
            each = np.split(ids, np.cumsum(size)[:-1])
            whole = np.flatnonzero(odd)
            found, n = self._encoded([texts[k] for k in whole])
            for k, own in zip(whole, np.split(found, np.cumsum(n)[:-1]), strict=True):
                each[k] = np.append(own, np.uint32(self.end_id))
                size[k] = len(each[k])
            ids = np.concatenate(each)
        return ids, size


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row."""
    common.require(docs, "doc_id", "text")
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, end_id)
        for b in batches:
            for t in textbytes.chunks(b.column("text")):
                own = b.slice(t.first, len(t))
                ids, n = encoder.encode([x or "" for x in own.column("text").to_pylist()])
                many = -(-n // capacity)
                owner = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                first = (n - (many - 1) * capacity)[owner]
                start = np.where(piece, first + (piece - 1) * capacity, 0)
                length = np.where(piece, capacity, first)
                at = ((np.cumsum(n) - n)[owner] + start) * 4
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[i:j]) for i, j in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=schema.names)
        encoder.clear()

    return rows.mapInArrow(lambda b: textbytes.released(cut(b)), schema)


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs of slots: length, first rank, slots, first sequence, slots in each sequence, offset of the first slot in each.

    Best-fit decreasing over counts. Sequences with equal room form groups of consecutive ids. Best-fit gives a group as many pieces of
    one length in each sequence as there is room for, since the sequence just filled is the fullest that fits the next.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = room // length
            full = min(n, left // each)
            for take, seqs in ((each, full), (left - full * each, 1 if full < n and left - full * each else 0)):
                if seqs:
                    runs.append((length, rank, take * seqs, first, take, capacity - room))
                    put(room - take * length, first, seqs)
                    rank, left, first, n = rank + take * seqs, left - take * seqs, first + seqs, n - seqs
                if not left:
                    break
            put(room, first, n)
    return np.array(runs, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    rows = common.stored(spark, pieces(docs, tokenizer, capacity, end_id), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    runs = plan(histogram, capacity)
    salts = max(8, -(-sum(histogram.values()) // ROWS_PER_SALT))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy(*order)
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    held = spark.sparkContext.broadcast(runs)
    span = 1 << 48

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value[:, 0] * span + held.value[:, 1]
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            run = held.value[np.searchsorted(keys, length * span + rank, side="right") - 1]
            k = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 3] + k // run[:, 4]), pa.array(run[:, 5] + k % run[:, 4] * length)], names=schema.names)

    return ranked.mapInArrow(lambda b: textbytes.released(placed(b)), schema)
