"""Operator 12, Merkle manifest of a dataset: leaf, roots and inclusion proof of each row, by incremental witnesses.

Leaves are digests that Spark computes; only they travel. Ranges of (lang, doc_id), cut where a sample has them, are numbered by themselves and
moved by the counts before them, so each leaf has its place in its language without a global sort in one task. Aligned blocks of 2**LEVELS leaves are
appended as streams: a block keeps its open subtrees, and when a subtree's sibling completes, each leaf below either gets the other's
digest as the next part of its witness. Block roots are the leaves of the next tier, appended in the same way until a language has one root, and
languages' roots are appended likewise. A leaf's proof is its witness, then its block's, and so on up to the root.

Nodes: every two consecutive ones of a level become the digest of their hex texts, a last one alone the digest of its own, while a level has
more than one; a lone leaf is its tree's root.

Edge cases: a null field is `-`; a null lang is a language (the first); a null doc_id comes first and isn't tampered with; rows with one doc_id go by leaf, equal
rows are interchangeable; a count that is the largest of its type can't grow, so it stays; an empty table gives no row. A text is digested whole by Spark and
then dropped, so long ones cost nothing later. Columns besides the five are ignored.
"""

from __future__ import annotations

from binascii import hexlify, unhexlify
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, textbytes

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Blocks of 4,096 leaves: a block's open witnesses are at most 1.6 MB.
LEVELS = 12
RANGE_ROWS = 1_000_000
#: Blocks, ranges or languages up to this many (each of some 500 bytes at most) are broadcast to their leaves.
BROADCAST_ROWS = 100_000
#: Every id whose checksum this divides is tampered with.
TAMPERED = 7


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    """The digest of a row's fields (with another n_chars, if given), as hex text."""
    return F.sha2(F.concat(*[_field(n_chars if c == "n_chars" and n_chars is not None else F.col(c)) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, own (the language, ordered as its bytes, null first), leaf and tampered (null: not) as bytes."""
    common.require(docs, *FIELDS)
    more = F.coalesce(F.expr("try_add(n_chars, cast(1 as bigint))"), F.col("n_chars"))
    hit = F.coalesce(common.crc_rest(F.col("doc_id"), TAMPERED) == 0, F.lit(False))
    own = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    return docs.select("doc_id", own.alias("own"), F.unhex(leaf()).alias("leaf"), F.when(hit, F.unhex(leaf(more))).alias("tampered"))


def _beside(df: DataFrame, name: str) -> DataFrame:
    """df stored, to be joined: broadcast if it has BROADCAST_ROWS rows at most, else shuffled."""
    kept = common.stored(df.sparkSession, df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with place (from 0 within their key, in order of the columns named, nulls first) and total (rows of the key)."""
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    # equal rows may be cut anywhere: what is read from files has the same ids on every try
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, key, *[F.col(c).asc_nulls_first() for c in order], "_tie")
    dealt = dealt.withColumn("_range", F.spark_partition_id()).sortWithinPartitions(key, *[F.col(c).asc_nulls_first() for c in order], "_tie").drop("_tie")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema)}, _k bigint"
    at = dealt.columns.index(key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k = None, 0
        for b in batches:
            out = []
            for x in b.column(at).to_pylist():
                k = k + 1 if x == now else 0
                now = x
                out.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "_k"])

    kept = common.stored(spark, dealt.mapInArrow(count, schema), "merkle-numbered")
    sizes = kept.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("_range")
    sizes = sizes.select(key, "_range", (F.sum("n").over(before) - F.col("n")).alias("_first"), F.sum("n").over(Window.partitionBy(key)).alias("total"))
    return kept.join(_beside(sizes, "merkle-sizes"), [key, "_range"]).withColumn("place", F.col("_first") + F.col("_k")).drop("_first", "_k", "_range")


def levels(total: int) -> int:
    """Levels above the leaves of a tree with so many."""
    return (total - 1).bit_length()


class Block:
    """Open subtrees of an aligned block, larger ones first: level, digest (hex bytes), first leaf. Leaves' witnesses grow as siblings complete."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, int]] = []
        self.witnesses: list[list[bytes]] = []

    def append(self, digest: bytes) -> None:
        node = (0, digest, len(self.witnesses))
        self.witnesses.append([])
        while self.open and self.open[-1][0] == node[0]:
            node = self._joined(self.open.pop(), node)
        self.open.append(node)

    def _joined(self, left: tuple[int, bytes, int], right: tuple[int, bytes, int]) -> tuple[int, bytes, int]:
        for i in range(left[2], right[2]):
            self.witnesses[i].append(right[1])
        for i in range(right[2], len(self.witnesses)):
            self.witnesses[i].append(left[1])
        return left[0] + 1, sha256(left[1] + right[1]).hexdigest().encode(), left[2]

    def close(self, top: int) -> bytes:
        """The block's root after `top` levels; a last node alone becomes the digest of its own at each."""
        level, digest, first = self.open.pop()
        while level < top:
            if self.open and self.open[-1][0] == level:
                level, digest, first = self._joined(self.open.pop(), (level, digest, first))
            else:
                level, digest = level + 1, sha256(digest).hexdigest().encode()
        return digest


def fold(digest: bytes, place: int, total: int, witness: list[bytes]) -> bytes:
    """The root from a leaf's digest, its place among so many leaves and what of the witness belongs to this tree (taken off its front)."""
    for level in range(levels(total)):
        at, width = place >> level, -(-total >> level)
        if at ^ 1 >= width:
            digest = sha256(digest).hexdigest().encode()
        else:
            other = witness.pop(0)
            digest = sha256(other + digest if at & 1 else digest + other).hexdigest().encode()
    return digest


def appended(rows: DataFrame, height: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """rows (own, place, total, node and others) with block and witness; and of each block own, place (its number), total (of blocks), node."""
    spark = rows.sparkSession
    dealt = rows.withColumn("block", F.shiftright("place", height)).repartition("own", "block").sortWithinPartitions("own", "place")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema)}, witness binary, root binary"
    names = dealt.columns
    own, place, total, node = (names.index(c) for c in ("own", "place", "total", "node"))

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, now, size = [], Block(), None, 0

        def done() -> pa.RecordBatch:
            root = unhexlify(block.close(min(height, levels(size))))
            whole = pa.concat_batches(held).columns
            parts = pa.array([unhexlify(b"".join(w)) for w in block.witnesses], pa.binary())
            return pa.RecordBatch.from_arrays([*whole, parts, pa.array([root] + [None] * (len(parts) - 1), pa.binary())], names=[*names, "witness", "root"])

        for b in textbytes.released(batches):
            first = 0
            for i, (k, p, n, digest) in enumerate(zip(b.column(own).to_pylist(), b.column(place).to_pylist(), b.column(total).to_pylist(), b.column(node).to_pylist(), strict=True)):
                if now != (k, p >> height):
                    if i > first:
                        held.append(b.slice(first, i - first))
                    if held:
                        yield done()
                    held, block, now, size, first = [], Block(), (k, p >> height), n, i
                block.append(hexlify(digest))
            held.append(b.slice(first))
        if held:
            yield done()

    kept = common.stored(spark, dealt.mapInArrow(append, schema), "merkle-witnesses")
    roots = kept.where("root is not null").select("own", F.col("block").alias("place"), F.expr(f"cast(ceil(total / {1 << height}) as bigint)").alias("total"), F.col("root").alias("node"))
    return kept.drop("root"), roots


def _tree(rows: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """rows (own, place, total, node and others) with witness (up to their tree's root); and own, node: the roots."""
    found, roots = appended(rows, height)
    lone, more = roots.where("total = 1"), roots.where("total > 1")
    if more.isEmpty():
        return found.drop("block"), roots.select("own", "node")
    upper, tops = _tree(more, height)
    up = upper.select("own", F.col("place").alias("block"), F.col("witness").alias("_up"))
    found = found.join(_beside(up, "merkle-blocks"), ["own", "block"], "left").withColumn("witness", F.concat("witness", F.coalesce("_up", F.lit(b""))))
    return found.drop("block", "_up"), lone.select("own", "node").unionByName(tops)


def manifest(docs: DataFrame, height: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row; lang_place and place as well."""
    spark = docs.sparkSession
    rows = numbered(common.stored(spark, leaves(docs), "merkle-leaves"), "own", "doc_id", "leaf")
    found, subroots = _tree(rows.withColumn("node", F.col("leaf")), height)
    subroots = common.stored(spark, subroots.select(F.lit("").alias("all"), F.col("own").alias("of"), "node"), "merkle-subroots")
    tops = numbered(subroots, "all", "of").withColumnRenamed("all", "own")
    upper, roots = _tree(tops, height)
    upper = upper.join(roots.select("own", F.col("node").alias("root")), "own")
    upper = upper.select(F.col("of").alias("own"), F.col("place").alias("lang_place"), F.col("total").alias("langs"), F.col("node").alias("subroot"), F.col("witness").alias("_up"), "root")
    whole = found.join(_beside(upper, "merkle-languages"), "own").select(
        "doc_id", "leaf", F.coalesce("tampered", "leaf").alias("told"), "place", "total", "lang_place", "langs", "subroot", "root", F.concat("witness", "_up").alias("witness")
    )

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textbytes.released(batches):
            proofs, folded = [], []
            for told, place, total, lang, langs, witness in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5, 6, 9)), strict=True):
                text = hexlify(witness)
                proofs.append(sha256(text).hexdigest())
                parts = [text[i : i + 64] for i in range(0, len(text), 64)]
                folded.append(fold(fold(hexlify(told), place, total, parts), lang, langs, parts).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(7), b.column(8), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), b.column(5), b.column(3)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "lang_place", "place"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = whole.mapInArrow(prove, f"doc_id {kind}, leaf binary, subroot binary, root binary, proof_sha256 string, folded_root string, lang_place bigint, place bigint")
    told = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", told("leaf").alias("leaf"), told("subroot").alias("subroot"), told("root").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == told("root")).alias("verified"), "lang_place", "place")


MANIFEST_SQL = f"""
WITH RECURSIVE {common.CRC_TABLE_SQL},
docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang,
    [CASE WHEN f IS NULL THEN '-' ELSE octet_length(encode(f)) || ':' || f END FOR f IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text]] AS own,
    CASE WHEN n_chars IS NOT NULL AND {common.crc_sql("doc_id::VARCHAR")} % {TAMPERED} = 0 THEN (n_chars + 1)::VARCHAR END AS more
  FROM documents, crc_table),
leaves AS (
  SELECT r, doc_id, lang, sha256(array_to_string(own, '')) AS leaf,
    sha256(array_to_string(CASE WHEN more IS NULL THEN own ELSE own[:3] || [octet_length(encode(more)) || ':' || more] || own[5:] END, '')) AS told FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS total FROM leaves),
tree AS (
  SELECT lang, 0 AS level, place AS i, total AS width, leaf AS h FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 2, (width + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE width > 1 GROUP BY lang, level, i // 2, width),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM tree WHERE width = 1),
upper AS (
  SELECT 0 AS level, place AS i, total AS width, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (width + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE width > 1 GROUP BY level, i // 2, width),
paths AS (
  SELECT p.r, t.level, p.place >> t.level AS i, s.h AS other FROM placed p
    JOIN (SELECT DISTINCT lang, level, width FROM tree) t ON t.lang IS NOT DISTINCT FROM p.lang AND t.width > 1
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = t.level AND s.i = xor(p.place >> t.level, 1)
  UNION ALL
  SELECT p.r, 1000 + t.level, b.place >> t.level, s.h FROM placed p JOIN subroots b ON b.lang IS NOT DISTINCT FROM p.lang
    JOIN (SELECT DISTINCT level, width FROM upper) t ON t.width > 1 LEFT JOIN upper s ON s.level = t.level AND s.i = xor(b.place >> t.level, 1)),
steps AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS k FROM paths),
folded AS (
  SELECT r, 0::BIGINT AS k, told AS h FROM placed
  UNION ALL
  SELECT f.r, s.k, sha256(CASE WHEN s.other IS NULL THEN f.h WHEN s.i & 1 = 1 THEN s.other || f.h ELSE f.h || s.other END) FROM folded f JOIN steps s ON s.r = f.r AND s.k = f.k + 1),
proofs AS (SELECT r, max(k) AS n, sha256(coalesce(string_agg(other, '' ORDER BY k), '')) AS proof FROM steps GROUP BY r)
SELECT p.doc_id, p.leaf, b.h AS subroot, u.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = u.h AS verified, b.place AS lang_place, p.place
FROM placed p JOIN subroots b ON b.lang IS NOT DISTINCT FROM p.lang JOIN upper u ON u.width = 1 LEFT JOIN proofs q ON q.r = p.r JOIN folded f ON f.r = p.r AND f.k = coalesce(q.n, 0)
"""
