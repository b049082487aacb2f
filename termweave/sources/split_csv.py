"""CSV whose quoted cells hold line breaks, read in splits (A-1).

Spark's text reader deals the lines of a file to splits. Whether a split begins within a quoted cell depends on all before it, so each split reports
where it would end from either beginning; these reports, one row a split, are composed in order of a file. Then every split knows its beginning and joins its
lines to records; a record that crosses splits leaves a piece in each, and only such pieces meet. Spark's own parser makes columns of records.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits up to this many (some 100 bytes each) are broadcast to their lines.
BROADCAST_SPLITS = 100_000
_PLACE = "file string, start bigint"


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether the end of a line is within a quoted cell; inside: whether its beginning is. A quote opens a cell only as its first character."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
            at += 1
        inside = False
        while True:  # the end of the quoted cell, past doubled quotes
            at = line.find('"', at)
            if at < 0:
                return True
            if not line.startswith('""', at):
                break
            at += 2
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """(file, start, ...) and lines of consecutive rows of one split; a split may come in several pieces."""
    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
        first = 0
        for i in range(1, b.num_rows + 1):
            if i == b.num_rows or columns[1][i] != columns[1][first] or columns[0][i] != columns[0][first]:
                yield tuple(c[first] for c in columns[:-1]), columns[-1][first:i]
                first = i


def _batch(rows: list[tuple], *kinds: tuple[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def records(spark: SparkSession, path: str, sep: str = ",", put: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """file, start, line and record: the text of each record and where it begins (byte of its split, line of the split). put: cuts lineage."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, within = None, False, True
        for key, values in _by_split(batches):
            if key != now:
                if now is not None:
                    yield _batch([(*now, out, within)], ("file", pa.string()), ("start", pa.int64()), ("out", pa.bool_()), ("within", pa.bool_()))
                now, out, within = key, False, True
            for x in values:
                out, within = ends_inside(x, out, sep), ends_inside(x, within, sep)
        if now is not None:
            yield _batch([(*now, out, within)], ("file", pa.string()), ("start", pa.int64()), ("out", pa.bool_()), ("within", pa.bool_()))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, inside = None, False
        for b in batches:
            rows = []
            for f, start, out, within in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if f != file:
                    file, inside = f, False
                rows.append((f, start, inside))
                inside = within if inside else out
            yield _batch(rows, ("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()))

    put = put or (lambda df, name: df)
    splits = lines.mapInArrow(report, f"{_PLACE}, out boolean, within boolean").repartition("file").sortWithinPartitions("file", "start")
    begins = put(splits.mapInArrow(compose, f"{_PLACE}, inside boolean"), "csv-splits")
    few = begins.count() <= BROADCAST_SPLITS

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for key, values in _by_split(batches):
            n = n if key == now else 0
            now = key
            yield _batch([(*key, n + i, x) for i, x in enumerate(values)], ("file", pa.string()), ("start", pa.int64()), ("line", pa.int64()), ("value", pa.string()))
            n += len(values)

    numbered = lines.mapInArrow(number, f"{_PLACE}, line bigint, value string")
    told = numbered.join(F.broadcast(begins) if few else begins, ["file", "start"])
    if not few:
        told = told.sortWithinPartitions("file", "start", "line")
    told = told.select("file", "start", "inside", "line", "value")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records, whole (kind 0) or the pieces of those that cross a split: their beginning (1), middle (2) or end (3)."""
        kinds = (("file", pa.string()), ("start", pa.int64()), ("line", pa.int64()), ("kind", pa.int32()), ("record", pa.string()))
        now, inside, held, first, headless = None, False, [], 0, False
        for b in batches:
            rows = []
            for f, start, begins_inside, line, x in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (f, start) != now:
                    if held:
                        rows.append((*now, first, 2 if headless else 1, "\n".join(held)))
                    now, inside, held, first, headless = (f, start), begins_inside, [], line, begins_inside
                held.append(x)
                inside = ends_inside(x, inside, sep)
                if not inside:
                    rows.append((*now, first, 3 if headless else 0, "\n".join(held)))
                    held, first, headless = [], line + 1, False
            yield _batch(rows, *kinds)
        if held:
            yield _batch([(*now, first, 2 if headless else 1, "\n".join(held))], *kinds)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (("file", pa.string()), ("start", pa.int64()), ("line", pa.int64()), ("record", pa.string()))
        held: list[str] = []
        place = None
        for b in batches:
            rows = []
            for f, start, line, kind, x in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (kind == 1 or f != place[0]):  # a cell that nothing closes ends with its file
                    rows.append((*place, "\n".join(held)))
                    held = []
                if not held:
                    place = (f, start, line)
                held.append(x)
                if kind == 3:
                    rows.append((*place, "\n".join(held)))
                    held = []
            yield _batch(rows, *kinds)
        if held:
            yield _batch([(*place, "\n".join(held))], *kinds)

    pieces = told.mapInArrow(assemble, f"{_PLACE}, line bigint, kind int, record string")
    crossing = pieces.where("kind > 0").repartition("file").sortWithinPartitions("file", "start", "line").mapInArrow(stitch, f"{_PLACE}, line bigint, record string")
    return pieces.where("kind = 0").drop("kind").unionByName(crossing).withColumn("record", F.regexp_replace("record", "\\r\\z", ""))


def read_csv(spark: SparkSession, path: str, sep: str = ",", put: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """All cells as text (empty ones null), columns by the first file's header; each file's header goes, and so do blank lines."""
    found = records(spark, path, sep, put)
    head = found.where("start = 0 and line = 0")
    first = head.orderBy("file").head()
    if first is None:
        return spark.createDataFrame([], "value string").drop("value")
    names = next(csv.reader([first["record"].removeprefix("﻿")], delimiter=sep), [])
    names = [n or f"_c{i}" for i, n in enumerate(names)]
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    body = found.where("not (start = 0 and line = 0)").where(F.trim("record") != "")
    return body.select(F.from_csv("record", schema, {"escape": '"', "sep": sep, "multiLine": "true"}).alias("r")).select("r.*")
