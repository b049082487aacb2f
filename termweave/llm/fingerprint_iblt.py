"""Operator 2, document fingerprints: invertible Bloom lookup sketches of paragraphs (DataFrame functions only).

A text is cut at line ends, and long lines at the first sentence end after STEP characters; a piece's digest is a 64-bit hash, and a
text's set of digests goes into a sketch: each digest adds to three cells a count, itself and a check (both by exclusive or).
Sketches of two versions subtract cell by cell; what both hold cancels. Cells with count 1 or -1 and a matching check then give up their
digest, which is taken out of its other cells, and so on (peeling): when all cells are empty the differing digests are known, and
with the two counts so is the Jaccard likeness. The fingerprint is the sketch of CELLS cells. If its difference can't be peeled, the
digests are dealt by hash to blocks of a few digests each and each block is sketched again, at twice and eight times the cells if
need be; at last the block's difference is taken from the sets themselves. So work grows in proportion to a text, and nothing is grouped:
all of it is expressions over one row.

The next document comes from a window over ranges of ids of about RANGE_ROWS rows, cut where the ids are (as Spark's range
partitioning samples them), MAX_RANGES at most; the first row of each range is also dealt, as a copy, to the range before it, so one shuffle of texts suffices and no
window spans the table.

Edge cases: a null text is the empty text; its set is empty, and two empty sets are alike (1.0); null ids come first, ids may be of any type that
orders; rows with one id are ordered by a hash of the text, so many of them are several ranges; a single row is its own next; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CELLS = 24
STEP = 80
#: Digests of both versions in a block, at each level that a long text's are dealt by.
BLOCKS = (32_768, 1024, 14)
RANGE_ROWS, MAX_RANGES = 256, 1 << 13
_DIGESTS = "array<struct<k:bigint,c:int>>"

_PIECE = rf"[^\\n]{{0,{STEP}}}[^\\n.!?]*[.!?]*"


def digests(text: str) -> str:
    """SQL: the sorted set of 64-bit digests of a text's pieces."""
    return f"array_sort(array_distinct(transform(filter(transform(regexp_extract_all({text}, '{_PIECE}', 0), p -> trim(p)), p -> p <> ''), p -> xxhash64(p))))"


def _place(k: str, j: int, cells: int) -> str:
    return f"cast(pmod(shiftright({k}, {20 * j}), {cells // 3}) + {j * (cells // 3)} as int)"


def _keyed(keys: str, cells: int) -> str:
    """SQL: digests with their check and cells."""
    return f"transform({keys}, k -> named_struct('k', k, 'h', xxhash64(k, 77), 'p', array({', '.join(_place('k', j, cells) for j in range(3))})))"


def sketch(keys: str, cells: int = CELLS) -> str:
    """SQL: cells (c count, k digests, h checks) of a set of digests."""
    hit = "filter(e, x -> array_contains(x.p, i))"
    cell = f"transform(array({hit}), m -> named_struct('c', size(m), 'k', aggregate(m, 0L, (s, x) -> s ^ x.k), 'h', aggregate(m, 0L, (s, x) -> s ^ x.h)))[0]"
    return f"transform(array({_keyed(keys, cells)}), e -> transform(sequence(0, {cells - 1}), i -> {cell}))[0]"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel(difference: str, cells: int = CELLS) -> str:
    """SQL: the digests that a difference holds (k, c: 1 in the first set only, -1 in the second only); null if it can't be peeled."""
    pure = "filter(s.cells, x -> abs(x.c) = 1 and xxhash64(x.k, 77) = x.h)"
    places = ", ".join(_place("u.k", j, cells) for j in range(3))
    taken = f"transform(s.cells, (x, i) -> if(i in ({places}), named_struct('c', x.c - u.c, 'k', x.k ^ u.k, 'h', x.h ^ u.h), x))"
    step = f"if(s.over, s, transform(array(get({pure}, 0)), u -> if(u is null, named_struct('cells', s.cells, 'out', s.out, 'over', true), named_struct('cells', {taken}, 'out', concat(s.out, array(named_struct('k', u.k, 'c', u.c))), 'over', false)))[0])"
    empty = "not exists(s.cells, x -> x.c <> 0 or x.k <> 0 or x.h <> 0)"
    return f"aggregate(sequence(1, {cells + 1}), named_struct('cells', {difference}, 'out', cast(array() as {_DIGESTS}), 'over', false), (s, i) -> {step}, s -> if({empty}, s.out, cast(null as {_DIGESTS})))"


def differing(a: str, b: str) -> str:
    """SQL: the digests in just one of two sets, as `peel` gives them, by blocks of sketches, larger ones where peeling fails."""

    def block(cells: int) -> str:
        return peel(subtract(sketch("q.a", cells), sketch("q.b", cells)), cells)

    signed = lambda x, y, c: f"transform(array_except({x}, {y}), k -> named_struct('k', k, 'c', {c}))"
    out = f"coalesce({block(CELLS)}, {block(2 * CELLS)}, {block(8 * CELLS)}, concat({signed('q.a', 'q.b', 1)}, {signed('q.b', 'q.a', -1)}))"
    # each level deals what a block of the level above holds
    for level, size in enumerate(reversed(BLOCKS)):
        top = level == len(BLOCKS) - 1
        x, y, seed = (a, b, 3) if top else ("w.a", "w.b", 3 + 2 * level + 2)
        n = f"cast(greatest(ceil((size({x}) + size({y})) / {size}.0), 1) as int)"
        part = lambda z: f"filter({z}, k -> pmod(xxhash64(k, {seed}), g.n) = g.i)"  # noqa: B023, E731
        dealt = f"transform(transform(sequence(0, {n} - 1), i -> named_struct('i', i, 'n', {n})), g -> named_struct('a', {part(x)}, 'b', {part(y)}))"
        out = f"flatten(transform({dealt}, {'q' if not level else 'w'} -> {out}))"
    return out


def difference(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    """SQL: the digests in just one of two sets, from their sketches if those can be peeled."""
    return f"coalesce({peel(subtract(sketch_a, sketch_b))}, {differing(a, b)})"


def likeness(a: str, b: str, d: str) -> str:
    """SQL: Jaccard of two sets of digests of which d differ."""
    return f"if(size({a}) + size({b}) = 0, 1.0D, cast(size({a}) + size({b}) - size({d}) as double) / (size({a}) + size({b}) + size({d})))"


def serialised(cells: str) -> str:
    return f"array_join(transform({cells}, x -> concat(lpad(hex(x.c), 4, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.h), 16, '0'))), '')"


def _bounds(keys: DataFrame) -> str:
    """SQL: the sorted array of the least key (doc_id, h) of each of at most MAX_RANGES ranges with about equally many rows."""
    spark = keys.sparkSession
    ranges = min(MAX_RANGES, max(1, -(-keys.count() // RANGE_ROWS)))
    dealt = keys.repartitionByRange(ranges, "doc_id", "h").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("doc_id", "h")).alias("first"))
    found = dealt.agg(F.sort_array(F.collect_set("first")).alias("all"))  # one row of at most MAX_RANGES keys
    text = found.select(F.to_json("all")).head()[0] or "[]"
    quoted = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{quoted}', '{found.schema['all'].dataType.simpleString()}')"


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows (doc_id, h and carried columns) with next_<column> of the next row in order of doc_id, then h, then the first carried column."""
    bounds = _bounds(rows.select("doc_id", "h"))
    # the range of a row is that of the last bound not above its key
    half = "transform(array(shiftright(s.lo + s.hi, 1)), m -> if(key >= all[m], named_struct('lo', m, 'hi', s.hi), named_struct('lo', s.lo, 'hi', m)))[0]"
    own = f"transform(array({bounds}), all -> aggregate(sequence(1, {MAX_RANGES.bit_length()}), named_struct('lo', 0, 'hi', size(all)), (s, i) -> if(s.hi - s.lo <= 1, s, {half}), s -> named_struct('range', s.lo, 'first', key = all[s.lo], 'before', if(s.lo = 0, size(all) - 1, s.lo - 1))))[0]"
    located = rows.withColumn("key", F.struct("doc_id", "h")).withColumn("own", F.expr(own))
    place = lambda copy, span: F.struct(F.lit(copy).alias("copy"), F.col(span).alias("span"))
    dealt = located.withColumn("place", F.explode(F.when(F.col("own.first"), F.array(place(False, "own.range"), place(True, "own.before"))).otherwise(F.array(place(False, "own.range")))))
    order = Window.partitionBy("span").orderBy("copy", "doc_id", "h", carried[0])
    out = dealt.select("doc_id", "h", *carried, "place.span", "place.copy")
    return out.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("not copy").drop("copy")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_digests of every row."""
    common.require(docs, "doc_id", "text")
    keys = docs.select("doc_id", F.expr(digests("coalesce(text, '')")).alias("keys"))
    return keys.select("doc_id", F.expr(serialised(sketch("keys"))).alias("fingerprint"), F.size("keys").alias("n_digests"))


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_lost, edited_new (digests of the edit)."""
    common.require(docs, "doc_id", "text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = with_next(rows.withColumn("keys", F.expr(digests("text"))).withColumn("cells", F.expr(sketch("keys"))), ["text", "keys", "cells"])
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 2) as int))"))
    out = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "keys", "cells", "next_keys", "next_cells")
    out = out.withColumn("edited_keys", F.expr(digests("edited"))).withColumn("edited_cells", F.expr(sketch("edited_keys")))
    out = out.withColumn("change", F.expr(difference("keys", "edited_keys", "cells", "edited_cells"))).withColumn("gap", F.expr(difference("keys", "next_keys", "cells", "next_cells")))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.expr(serialised("cells")).alias("fingerprint"), F.expr(serialised("edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("keys", "edited_keys", "change")).alias("near_edited"), F.expr(likeness("keys", "next_keys", "gap")).alias("near_next"),
        F.expr("array_sort(transform(filter(change, x -> x.c = 1), x -> x.k))").alias("edited_lost"), F.expr("array_sort(transform(filter(change, x -> x.c = -1), x -> x.k))").alias("edited_new"),
    )
