"""Operator 10, WARC: archives written and read back, records found by a chain of verified boundaries.

Writing: one record for each page. Payload digests are grouped first, on narrow rows, so that only pages whose payload another page
with a smaller id holds become revisit records without a payload; all else is Spark's text writer, whose line separator ends each record.

Reading: Spark's text reader splits the archives at the magic that begins a record, wherever it stands, so files of any size are read
in parallel and a record that crosses a split is whole. Each piece is a candidate: a task knows how many bytes of its split came before,
sums of the splits before give the offset, and a well-formed header gives the successor's. Pointer jumping from offset 0 of each file
doubles its stride each round and keeps the candidates that the chain of records reaches; magic inside payloads is never reached,
and belongs to the record before it. Records of WARC/1.0 and WARC/1.1 are read, their contents as bytes of any encoding, compressed files as far as
Spark's reader opens them by their name (each of those by one task).

Edge cases: a file that holds something but no record at its beginning is an error that names it; a null html is an empty payload; a null page_id is kept (an empty header field) and is never another's original unless all
ids of that payload are null; pages repeated with one id are all responses where that id is the smallest; payloads under min_bytes are
all responses; an empty table writes an archive without records. Columns besides page_id, url and html are ignored. Records of other types
(warcinfo, request, metadata) are links of the chain and aren't returned; a header without a type or a length is no record, so the
chain of its file ends there and what follows belongs to the record before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textbytes

MAGIC = "WARC/1."
#: What follows the magic where a record begins; the first is written.
VERSIONS = ("0\r\n", "1\r\n")
END = "\r\n\r\n"
#: Revisits up to this many are broadcast to the pages; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
RECORDS_PER_FILE = 50_000
DATE = "2024-01-01T00:00:00Z"


def _revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, refers_to, sha of the pages whose payload one with a smaller id holds."""
    narrow = pages.select("page_id", F.sha2(F.col("payload"), 256).alias("sha"), F.octet_length("payload").alias("size")).where(F.col("size") >= min_bytes)
    firsts = narrow.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "refers_to")
    return narrow.join(firsts, "sha").where(F.col("page_id") > F.col("refers_to")).select("page_id", "refers_to", "sha").distinct()


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One WARC record for each page, in files of RECORDS_PER_FILE records at most."""
    common.require(pages, "page_id", "html")
    spark = pages.sparkSession
    url = F.coalesce(F.col("url"), F.lit("")) if "url" in pages.columns else F.lit("")
    rows = pages.select("page_id", F.regexp_replace(url, "[\\r\\n]", "").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    revisits = common.stored(spark, _revisits(rows, min_bytes), "warc-revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    rows = rows.withColumn("sha", F.sha2(F.col("payload"), 256)).join(revisits, ["page_id", "sha"], "left")
    rows = rows.withColumn("body", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit("")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    header = F.concat(
        F.lit(MAGIC + VERSIONS[0]),
        _header("WARC-Type", F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text("page_id"), F.lit(">"))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.sha1(F.col("payload"))))),
        _header("WARC-Payload-Length", F.octet_length("payload").cast("string")),
        F.when(F.col("refers_to").isNotNull(), _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), text("refers_to"), F.lit(">")))).otherwise(F.lit("")),
        _header("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(header, F.col("body")).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _base32(hexed: Column) -> Column:
    """Bare upper-case base32 of 40 hex digits: eight groups of 20 bits, each four digits of 5 bits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        value = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("long")
        parts += [F.substring(alphabet, (F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


_FIELD = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")
_VERSIONS = tuple(v.encode() for v in VERSIONS)
_NUMBER = re.compile(rb"\d{1,18}")
_PIECE = "file string, split long, before long, bytes long, head long, content long, type string, page_id string, refers_to string, payload_bytes long, digest string, whole boolean, sha1 string"


def _piece(data: bytes) -> list:
    """head, content, type, page_id, refers_to, payload_bytes and digest as the header has them, whole, sha1 of a whole payload."""
    head = data.find(END.encode()) if data.startswith(_VERSIONS) else -1
    fields = {k.lower(): v for k, v in _FIELD.findall(data[: head + 2])} if head >= 0 else {}
    kind, size = fields.get(b"warc-type", b"").decode("latin-1"), fields.get(b"content-length", b"")
    if not kind or not _NUMBER.fullmatch(size):
        return [None] * 7 + [False, None]
    head, content = head + len(END), int(size)
    ids = [re.sub(r"^<urn:page:|>$", "", fields.get(k, b"").decode("utf-8", "replace")) for k in (b"warc-record-id", b"warc-refers-to")]
    full = fields.get(b"warc-payload-length", b"")
    digest = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
    whole = len(data) == head + content + len(END) and data.endswith(END.encode())
    sha1 = base64.b32encode(hashlib.sha1(data[head : head + content]).digest()).decode() if whole else None
    return [head, content, kind, *ids, int(full) if _NUMBER.fullmatch(full) else None, digest, whole, sha1]


def pieces(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """What follows each magic, wherever it stands: its place and its fields if it begins with a header; text: all that it holds,
    else only (as `part`) of pieces that aren't whole records by themselves."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    schema = f"{_PIECE}, part binary"
    kinds = [pa.string(), *[pa.int64()] * 5, *[pa.string()] * 3, pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = None, 0
        for b in batches:
            out: list[list] = []
            for value, file, split in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = value.as_py()
                if now != (file, split):
                    now, before = (file, split), 0
                found = _piece(data)
                out.append([file, split, before, len(data), *found, None if found[-2] and not text else data])
                before += len(data) + len(MAGIC)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return raw.mapInArrow(lambda b: textbytes.released(parse(b)), schema)


def reachable(links: DataFrame, stop: int | None = None) -> DataFrame:
    """Rows of file, at, next (offsets of a candidate and of what its header says follows; null: no header) to the file, at
    of the candidates that the chain from each file's offset 0 reaches. stop: candidates in a file at most, if known."""
    spark = links.sparkSession
    if stop is None:
        stop = links.groupBy("file").count().agg(F.max("count")).head()[0] or 0
    now = common.stored(spark, links.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("known")), "warc-jump")
    stride = 1
    while stride < stop + 1:
        ahead = now.select(F.col("file").alias("file_"), F.col("at").alias("at_"), F.col("jump").alias("jump_"))
        hit = now.where("known and jump is not null").select(F.col("file").alias("hit_file"), F.col("jump").alias("hit_at"))
        step = now.join(ahead, (F.col("file") == F.col("file_")) & (F.col("jump") == F.col("at_")), "left").join(hit, (F.col("file") == F.col("hit_file")) & (F.col("at") == F.col("hit_at")), "left")
        now = common.stored(spark, step.select("file", "at", F.col("jump_").alias("jump"), (F.col("known") | F.col("hit_at").isNotNull()).alias("known")), "warc-jump")
        stride *= 2
    return now.where("known").select("file", "at")


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each true response or revisit record: file, split, before (place of its first piece), page_id, refers_to (text), type, content,
    payload_bytes, digest (of the payload that was read; of the header for revisits), head, payload (only of records that hold a magic)."""
    found = common.stored(spark, pieces(spark, path), "warc-pieces")
    sizes = found.groupBy("file", "split").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("size"))
    run = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "split", F.coalesce(F.sum("size").over(run), F.lit(0)).alias("start"))
    placed = found.join(starts, ["file", "split"]).withColumn("at", F.col("start") + F.col("before") - len(MAGIC)).where("at >= 0").drop("start")
    strange = [r["file"] for r in found.groupBy("file").agg(F.sum("bytes").alias("size")).where("size > 0").join(placed.where("at = 0 and type is not null").select("file"), "file", "left_anti").select("file").limit(5).collect()]
    if strange:
        raise ValueError(f"no record at the beginning of {strange}")
    links = placed.select("file", "at", (F.col("at") + len(MAGIC) + F.col("head") + F.col("content") + len(END)).alias("next"))
    chain = reachable(links).withColumn("reached", F.lit(True))
    placed = placed.join(chain, ["file", "at"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))
    alone = placed.where("reached and whole and type in ('response', 'revisit')").select("file", "split", "before", "page_id", "refers_to", "type", "content", "payload_bytes", "head", F.when(F.col("type") == "response", F.col("sha1")).otherwise(F.col("digest")).alias("digest"), F.lit(None).cast("binary").alias("payload"))
    # a record that holds a magic lies in several pieces: the reached one and those up to the next reached one
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    narrow = placed.select("file", "at", F.last(F.when(F.col("reached"), F.struct("at", "whole")), ignorenulls=True).over(upto).alias("owner"))
    owned = narrow.where("owner is not null and not owner.whole").select("file", "at", F.col("owner.at").alias("record"))
    owned = common.stored(spark, owned.join(placed.drop("part", "reached"), ["file", "at"]), "warc-owned")
    if owned.isEmpty():
        return alone
    # what looks like a whole record inside a payload has left its text behind: those places are read again
    owned = owned.join(pieces(spark, path, text=True).select("file", "split", "before", "part"), ["file", "split", "before"])
    parts = owned.groupBy("file", "record").agg(
        F.min_by(F.struct("split", "before", "page_id", "refers_to", "type", "content", "payload_bytes", "head", "digest"), "at").alias("r"),
        F.array_sort(F.collect_list(F.struct("at", F.col("part").alias("part")))).alias("parts"),
    )
    joined = F.array_join(F.transform("parts", lambda x: x["part"].cast("string")), MAGIC).cast("binary")  # a cast keeps bytes of any encoding
    body = F.expr("substring(joined, cast(r.head + 1 as int), cast(r.content as int))")
    broken = parts.withColumn("joined", joined).withColumn("body", body).select("file", "r.split", "r.before", "r.page_id", "r.refers_to", "r.type", "r.content", "r.payload_bytes", "r.head", F.when(F.col("r.type") == "response", _base32(F.sha1("body"))).otherwise(F.col("r.digest")).alias("digest"), F.col("body").alias("payload"))
    return alone.unionByName(broken.where("type in ('response', 'revisit')"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id (text), type, refers_to (text; null for responses), payload (text; null for revisits and for what isn't UTF-8), content (its bytes),
    payload_bytes, digest of each true record."""
    known = index(spark, path)
    bodies = pieces(spark, path, text=True).where("whole").select("file", "split", "before", "part")
    own = F.expr("substring(part, cast(head + 1 as int), cast(content as int))")
    body = F.when(F.col("type") == "response", F.coalesce("payload", own))
    return known.join(bodies, ["file", "split", "before"], "left").select(
        "page_id", "type", F.when(F.col("type") == "revisit", F.col("refers_to")).alias("refers_to"),
        F.try_validate_utf8(body.cast("string")).alias("payload"), body.alias("content"), "payload_bytes", "digest",
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from the archives."""
    spark = pages.sparkSession
    path = common.scratch_path(spark, "warc")
    write(pages, path, min_bytes)
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return index(spark, path).select(
        number("page_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", number("refers_to")).alias("refers_to"),
    )


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hexed, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST(('0x' || substr(hexed, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""
