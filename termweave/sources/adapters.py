"""Input adapters by source type (N-2): Spark data sources that read batches of other shapes into rows of text.

An adapter says which columns it gives and how a part of its input is read; parts are read in tasks of their own. Registered adapters are read with
`spark.read.format("adapter").option("source_type", ...)`; a type that nobody registered is an error before any row is read.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT = "adapter"


@dataclass(frozen=True)
class Adapter:
    """columns: what rows hold. rows: of a line of input, its records as tuples of text in order of the columns."""

    columns: tuple[str, ...]
    rows: Callable[[str], Iterator[tuple[str | None, ...]]]


def field_rows(line: str) -> Iterator[tuple[str | None, ...]]:
    """A line is the value."""
    yield (line,)


def record_rows(line: str) -> Iterator[tuple[str | None, ...]]:
    """A line of `name=value` pairs apart by `;`: the value named `value`, its id named `id`, and the rest as it stands."""
    pairs = dict(x.split("=", 1) for x in line.split(";") if "=" in x)
    rest = ";".join(f"{k}={v}" for k, v in sorted(pairs.items()) if k not in ("id", "value"))
    yield pairs.get("id"), pairs.get("value"), rest


def list_rows(line: str) -> Iterator[tuple[str | None, ...]]:
    """A line of values apart by `|`, numbered from 1."""
    for i, x in enumerate(line.split("|"), 1):
        yield str(i), x


ADAPTERS: dict[str, Adapter] = {
    "structured_field": Adapter(("value",), field_rows),
    "structured_record": Adapter(("id", "value", "context"), record_rows),
    "structured_batch": Adapter(("batch_index", "value"), list_rows),
}


def adapter(source_type: str, adapters: dict[str, Adapter] | None = None) -> Adapter:
    known = ADAPTERS if adapters is None else adapters
    if source_type not in known:
        raise ValueError(f"no adapter reads {source_type!r}; there are {sorted(known)}")
    return known[source_type]


@dataclass
class Part(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, own: Adapter, paths: Sequence[str]) -> None:
        self.own, self.paths = own, paths

    def partitions(self) -> list[Part]:
        return [Part(p) for p in self.paths]

    def read(self, part: Part) -> Iterator[tuple]:
        with open(part.path, encoding="utf-8") as lines:
            for line in lines:
                yield from self.own.rows(line.rstrip("\n"))


class AdapterSource(DataSource):
    """Options: source_type, and path: a file, a folder or a pattern on a file system that all workers mount; each file is a part, read as a stream.
    Lines in any other store are read by Spark and go through `adapt`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in adapter(self.options.get("source_type", "")).columns)

    def reader(self, schema: StructType) -> _Reader:
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(f"{path}/*" if os.path.isdir(path) else path))
        if not found:
            raise ValueError(f"no file at {path!r}")
        return _Reader(adapter(self.options["source_type"]), [x for x in found if not os.path.basename(x).startswith(("_", "."))])


def read_adapted(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    adapter(source_type)
    spark.dataSource.register(AdapterSource)
    return spark.read.format(FORMAT).option("source_type", source_type).load(path)


def adapt(lines: DataFrame, source_type: str, line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """A table's lines by an adapter, in tasks where they stand; keep: columns that each row takes along. Null lines give no rows."""
    own = adapter(source_type)
    kept = [f.name for f in lines.select(*keep).schema] if keep else []
    schema = StructType([*lines.select(*keep).schema.fields] if keep else [])
    for c in own.columns:
        schema = schema.add(c, "string")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = [(*(r[:-1]), *x) for r in b.itertuples(index=False, name=None) for x in own.rows(r[-1])]
            yield pd.DataFrame(out, columns=[*kept, *own.columns])

    return lines.select(*kept, F.col(line).cast("string").alias("_line")).where("_line is not null").mapInPandas(run, schema)
