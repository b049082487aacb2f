"""Candidates for reported values from terminology tables (C-5, D-1 to D-7, D-10): hits of unit_key, channel, query, concept_id, name, score, hit_rank."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text, vocab
from ..profile import Profile

#: Names that are compared with a value at once.
NAME_BLOCK = 2_000
#: Names of a key that meet a value in one task at most, or so.
HOT_NAMES = 500
#: Sizes of names, in character runs, are classed by powers of this.
GRADE = 1.2
SUGGESTIONS, CORROBORATION = 3, 0.5
NAME_SIDE_ROWS = 200_000


@dataclass
class Terminology:
    """concepts: vocabulary, release, concept_id, preferred_label, concept_class, status, synonyms, remapped_to; names: vocabulary, release, concept_id,
    name, is_current; edges: vocabulary, release, subject_id, predicate, object_id, object_label, object_class, edge_order."""

    concepts: DataFrame
    names: DataFrame
    edges: DataFrame

    def stored(self, put: Callable[[DataFrame, str], DataFrame]) -> Terminology:
        """The same, written once: steps that read it don't each derive it."""
        return Terminology(put(self.concepts, "concepts"), put(self.names, "names"), put(self.edges, "edges"))

    def union(self, other: Terminology) -> Terminology:
        return Terminology(self.concepts.unionByName(other.concepts), self.names.unionByName(other.names), self.edges.unionByName(other.edges))


def pin_release(df: DataFrame, release: str) -> DataFrame:
    """The rows of one release; raises if there are none of it."""
    rows = df.where(F.col("release") == release)
    if rows.isEmpty():
        raise ValueError(f"no rows of release {release!r}")
    return rows


def release_violations(df: DataFrame, release: str) -> DataFrame:
    """Rows by release other than the pinned one (null: none given)."""
    return df.where(~F.col("release").eqNullSafe(F.lit(release))).groupBy("release").agg(F.count(F.lit(1)).alias("n"))


def _ranked(hits: DataFrame, *order: Column) -> DataFrame:
    return hits.withColumn("hit_rank", F.row_number().over(Window.partitionBy("unit_key").orderBy(*order)))


def forms(names: DataFrame) -> DataFrame:
    """key, concept_id, name: the normal forms of each concept's names, each with its least name. Where lookups repeat, this is stored and given to exact_hits for names."""
    return names.select("concept_id", "name", text.normalize_text(F.col("name")).alias("key")).where("key <> ''").groupBy("key", "concept_id").agg(F.min("name").alias("name"))


def exact_hits(units: DataFrame, names: DataFrame, channel: str = "normalized_lookup") -> DataFrame:
    """units: unit_key, value. One hit for each concept of which a name is the value after normalization. names: concept_id and name, or their forms."""
    own = names if "key" in names.columns else forms(names)
    hits = units.select("unit_key", F.col("value").alias("query"), text.normalize_text(F.col("value")).alias("key")).distinct().join(own, "key")
    return _ranked(hits.withColumns({"channel": F.lit(channel), "score": F.lit(100.0)}), F.col("concept_id")).select("unit_key", "channel", "query", "concept_id", "name", "score", "hit_rank")


def unmet(units: DataFrame, names: DataFrame) -> DataFrame:
    """The units (unit_key, value) that have no exact hit: forms of names are asked for, not their concepts. units should be stored, as Spark moves an anti join
    below a distinct, to the rows that it was made of."""
    own = names.select(text.normalize_text(F.col("name")).alias("_key")).where("_key <> ''").distinct()
    return units.withColumn("_key", text.normalize_text(F.col("value"))).join(own, "_key", "left_anti").drop("_key")


def _grams(own: Column) -> Column:
    """The runs of three characters of a normal form with a space on either side."""
    return F.regexp_extract_all(F.concat(F.lit(" "), own, F.lit(" ")), F.lit("(?s)(?=(.{3}))"), F.lit(1))


def _least(share: float, of: Column) -> Column:
    """The least whole number that is such a share."""
    return F.ceil(of * F.lit(share) - F.lit(1e-9)).cast("int")


def _ordered(rows: DataFrame, parts: str, often: DataFrame, kept: Column) -> DataFrame:
    """own, key, n (names that have it), place (from 0) and before (the keys of lower places): the first `kept` of the array `parts`, those first that
    fewest names have."""
    split = rows.select("own", kept.alias("_kept"), F.explode(parts).alias("part")).join(often, "part", "left")
    order = split.groupBy("own").agg(F.first("_kept").alias("_kept"), F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part"))).alias("parts"))
    first = order.select("own", F.slice("parts", F.lit(1), F.col("_kept")).alias("first"))
    first = first.select("own", "first", F.posexplode("first").alias("place", "x"))
    return first.select("own", F.col("x.part").alias("key"), "x.n", "place", F.slice("first.part", F.lit(1), F.col("place")).alias("before"))


def _met(asked: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """The join of two tables with n by keys. Keys of many names are split: each name has one part of such a key, each value all."""
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.ceil(F.greatest(F.col("n"), F.lit(1)) / HOT_NAMES).cast("int")
    left = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n").repartition(tasks, *keys, "part")
    right = names.withColumn("part", F.pmod(F.xxhash64("name"), parts).cast("int")).drop("n").repartition(tasks, *keys, "part")
    return left.join(right, [*keys, "part"])


def _often(rows: DataFrame, parts: str) -> DataFrame:
    return rows.select(F.explode(parts).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


Put = Callable[[DataFrame, str], DataFrame]


def _as_it_is(df: DataFrame, name: str) -> DataFrame:
    return df


def alike(values: DataFrame, names: DataFrame, p: Profile, put: Put = _as_it_is) -> DataFrame:
    """own, name, overlap: the pairs of distinct normal forms (values and names: own) that are alike, each once, at the first key that both have.

    Alike are a value and a name that has a share of its tokens of `approximate_overlap` or more, or whose character runs are as many of both's as
    `approximate_runs`. Of a set's parts in any one order, those that can miss from the shared ones are fewer than the first size - needed + 1, so
    pairs that are alike meet in these. Rarest ones come first, and what follows the place of a meeting in both orders bounds what they can share.
    """
    hashed = lambda c: F.array_distinct(F.transform(c, lambda x: F.xxhash64(x)))
    tokens = lambda df: df.select("own", hashed(text.tokenize(F.col("own"))).alias("tokens"), hashed(_grams(F.col("own"))).alias("runs"))
    left, right = put(tokens(values), "alike-values"), put(tokens(names), "alike-names")
    share, half = p.approximate_runs, p.approximate_overlap
    t, g = F.size("tokens"), F.size("runs")
    often = put(_often(right, "tokens"), "alike-words")
    words = _ordered(left.where(t > 0), "tokens", often, t - _least(half, t) + 1).join(left.select("own", "tokens"), "own")
    other = right.select(F.col("own").alias("name"), F.explode("tokens").alias("key"), F.col("tokens").alias("others")).join(often.withColumnRenamed("part", "key"), "key")
    overlap = F.size(F.array_intersect("tokens", "others")) / F.size("tokens")
    by_words = _met(words, other, "key").where(~F.arrays_overlap("before", "others")).withColumn("overlap", overlap).where(F.col("overlap") >= half - 1e-9).select("own", "name", "overlap")
    often = put(_often(right, "runs"), "alike-often")
    runs = _ordered(left, "runs", often, g - _least(share, g) + 1).join(left, "own").withColumn("size", g)
    other = _ordered(right, "runs", often, g - _least(share, g) + 1).join(right, "own").select(F.col("own").alias("name"), "key", "n", F.col("place").alias("at"), F.col("before").alias("other_before"), F.col("tokens").alias("others"), F.col("runs").alias("other_runs"), g.alias("other_size"))
    a, b = F.col("size"), F.col("other_size")
    # sets meet by a class of the name's size too: the larger the name, the fewer of the value's runs can miss
    grade = lambda c: F.floor(F.log(c) / F.log(F.lit(GRADE)) + 1e-9).cast("int")
    runs = runs.withColumn("class", F.explode(F.sequence(grade(F.greatest(F.lit(1), share * a)), grade(a / share))))
    runs = runs.where(a - F.col("place") >= (share / (1 + share)) * (a + F.pow(F.lit(GRADE), "class")) - 1e-6)
    other = other.withColumn("class", grade(b))
    fits = (b >= share * a - 1e-9) & (a >= share * b - 1e-9) & (F.least(a - F.col("place"), b - F.col("at")) >= (share / (1 + share)) * (a + b) - 1e-9)
    met = _met(runs, other, "key", "class").where(fits).where(~F.arrays_overlap("before", "other_before")).withColumn("both", F.size(F.array_intersect("runs", "other_runs"))).where(F.col("both") >= share * (a + b - F.col("both")) - 1e-9)
    by_runs = met.select("own", "name", F.when(F.size("tokens") > 0, overlap).otherwise(F.lit(0.0)).alias("overlap")).where(F.col("overlap") < half - 1e-9)
    return by_words.unionByName(by_runs)


_HASHED = 64


def _characters(texts: list[str]) -> np.ndarray:
    """How often each text has characters of each hash."""
    size = np.array([len(x) for x in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % _HASHED
    return np.bincount(np.repeat(np.arange(len(texts)), size) * _HASHED + code, minlength=len(texts) * _HASHED).reshape(-1, _HASHED).astype(np.int32)


def _common(own: str, table: np.ndarray) -> np.ndarray:
    """At most so many characters of each text of the table can match those of own."""
    return np.minimum(table, _characters([own])).sum(1)


def _coded(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The texts' alphabet (from 1), and their characters by it: a row for each place, a column for each text, 0 behind its end."""
    size = np.array([len(x) for x in texts], np.int64)
    alphabet, code = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    out = np.zeros((int(size.max(initial=0)), len(texts)), np.int32)
    out[np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(texts)), size)] = code + 1
    return {chr(c): i + 1 for i, c in enumerate(alphabet.tolist())}, out


def _matched(own: str, alphabet: dict[str, int], coded: np.ndarray, names: list[str]) -> np.ndarray:
    """At most so many characters of each text can match own's in order: the longest common subsequence, bit by bit, where own fits a word."""
    if len(own) > 64:
        return _common(own, _characters(names))
    masks = np.zeros(len(alphabet) + 1, np.uint64)
    for i, c in enumerate(own):
        if c in alphabet:
            masks[alphabet[c]] |= np.uint64(1 << i)
    whole = np.uint64((1 << len(own)) - 1)
    row = np.full(coded.shape[1], whole)
    for codes in coded:
        u = row & masks[codes]
        row = ((row + u) | (row - u)) & whole
    return len(own) - np.bitwise_count(row).astype(np.int64)


def _best(own: str, names: list[str], overlap: np.ndarray, concepts: Callable[[int], list], k: int, found: dict) -> dict:
    """The k best concepts (to score and name) of those found before and of these names, which come by the most that their similarity can be; once that is
    less than what k concepts have, no other name counts. concepts: those of the name at a place, asked for only where its score counts."""
    sizes = np.array([len(x) for x in names])
    matched = _matched(own, *_coded(names), names)
    most = np.maximum(overlap, 2.0 * matched / (len(own) + sizes))
    last = max((-x[0], concept) for concept, x in found.items()) if len(found) >= k else None
    least = -last[0] if last else 0.0
    for i in np.argsort(-most, kind="stable").tolist():
        if most[i] < least:
            break
        b, score = names[i], float(overlap[i])
        if own == b:
            score = 1.0
        elif score < most[i]:
            score = max(score, SequenceMatcher(None, own, b).ratio())
        if score <= 0 or score < least:
            continue
        new = False
        for concept in concepts(i):
            if concept in found:
                if (score, b) > found[concept]:
                    found[concept], new = (score, b), True
            elif last is None or (-score, concept) < last:
                found[concept], new = (score, b), True
        # many names can be as good as the last of the k: only what changes them is sorted
        if new and len(found) >= k:
            found = dict(sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[:k])
            last = max((-x[0], concept) for concept, x in found.items())
            least = -last[0]
    return found


def _none(units: DataFrame, names: DataFrame) -> DataFrame:
    """No hits."""
    kinds = [("channel", T.StringType()), ("query", T.StringType()), ("concept_id", names.schema["concept_id"].dataType), ("name", T.StringType()), ("score", T.DoubleType()), ("hit_rank", T.IntegerType())]
    return units.sparkSession.createDataFrame([], T.StructType([units.schema["unit_key"], *[T.StructField(n, k) for n, k in kinds]]))


def approx_hits(units: DataFrame, names: DataFrame, p: Profile, current: bool = True, put: Put = _as_it_is) -> DataFrame:
    """The best concepts of each unit by similarity to any of the names that are alike (see `alike`); score 100 x similarity, one hit for a concept.

    Distinct normal forms meet, and of a name's concepts the first k by id, as no other can be among a unit's first k. A value's names stream through its
    task in runs of NAME_BLOCK, of which the k best concepts stay."""
    k = p.maximum_candidates
    kind = names.schema["concept_id"].dataType
    own = (names.where("is_current") if current else names).select("concept_id", "name", text.normalize_text(F.col("name")).alias("own")).where("own <> ''")
    own = own.groupBy("own", "concept_id").agg(F.max("name").alias("name"))
    few = put(own.withColumn("place", F.row_number().over(Window.partitionBy("own").orderBy("concept_id"))).where(F.col("place") <= k), "approx-few")
    forms = put(few.groupBy(F.col("own").alias("name")).agg(F.sort_array(F.collect_list("concept_id")).alias("concepts")), "approx-names")
    asked = put(units.select("unit_key", F.col("value").alias("query"), text.normalize_text(F.col("value")).alias("own")).where("own <> ''"), "approx-values")
    if asked.isEmpty():
        return _none(units, names)
    pairs = alike(asked.select("own").distinct(), forms.select(F.col("name").alias("own")), p, put).join(forms, "name")
    schema = T.StructType([T.StructField("own", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("concept_id", kind), T.StructField("form", T.StringType())])
    kinds = [("own", pa.string()), ("score", pa.float64()), ("concept_id", to_arrow_type(kind)), ("form", pa.string())]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, found, held, last = None, {}, [], None

        def out() -> pa.RecordBatch:
            rows = [(value, score, concept, form) for concept, (score, form) in found.items()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

        def best() -> dict:
            return _best(value, [x[0] for x in held], np.array([x[1] for x in held]), lambda i: held[i][2][held[i][3] : held[i][4]].tolist(), k, found) if held else found

        for b in batches:
            # all at once: one by one, a list of concepts costs as much as a comparison
            told = [b.column(j).to_numpy(zero_copy_only=False).tolist() for j in range(3)]
            concepts, ends = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_pylist()
            for v, name, overlap, start, stop in zip(*told, ends[:-1], ends[1:], strict=True):
                if v != value:
                    if value is not None:
                        found = best()
                        yield out()
                    value, found, held, last = v, {}, [], None
                if name != last:
                    held.append((name, overlap, concepts, start, stop))
                    last = name
                if len(held) >= NAME_BLOCK:
                    found, held = best(), []
        if value is not None:
            found = best()
            yield out()

    near = pairs.select("own", "name", "overlap", "concepts").repartition("own").sortWithinPartitions("own", "name").mapInArrow(compare, schema)
    channel = "terminology_approximate_current" if current else vocab.HISTORICAL
    shown = few.select(F.col("own").alias("form"), "concept_id", "name")
    hits = asked.join(near.join(shown, ["form", "concept_id"]), "own").select("unit_key", F.lit(channel).alias("channel"), "query", "concept_id", "name", (100 * F.col("score")).alias("score"))
    return _ranked(hits, F.desc("score"), F.col("concept_id"))


def _segments(names: DataFrame, edits: int) -> DataFrame:
    """name, long, segment, piece: each name cut into edits + 1 pieces, as even as can be."""
    cut = names.withColumn("long", F.length("name")).where(F.col("long") > edits).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(edits))))
    first, after = F.floor(F.col("segment") * F.col("long") / (edits + 1)), F.floor((F.col("segment") + 1) * F.col("long") / (edits + 1))
    return cut.select("name", "long", "segment", F.substring("name", (first + 1).cast("int"), (after - first).cast("int")).alias("piece"))


def _within(values: DataFrame, names: DataFrame, edits: int) -> DataFrame:
    """own, name, distance of the pairs of distinct values (own) and names that so many edits or fewer part.

    Of edits + 1 pieces of a name one stands in the value as it is. The edits before it and after it are too many unless it stands near its own
    place, counted from both ends, so a value looks for pieces of the names of each length at few places."""
    size, n = F.length("own"), F.lit(edits + 1)
    # stored values and names are few bytes, read by one task, but each has many pieces
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values, names = values.repartition(tasks, "own"), names.repartition(tasks, "name")
    asked = values.withColumn("size", size).withColumn("long", F.explode(F.sequence(F.greatest(size - edits, n), size + edits))).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(edits))))
    first, after = F.floor(F.col("segment") * F.col("long") / n).cast("int"), F.floor((F.col("segment") + 1) * F.col("long") / n).cast("int")
    off, left = F.col("size") - F.col("long"), edits - F.col("segment")
    asked = asked.withColumns({"length": after - first, "low": F.greatest(F.lit(0), first - F.col("segment"), first + off - left), "high": F.least(F.col("size") - (after - first), first + F.col("segment"), first + off + left)})
    asked = asked.where("low <= high").withColumn("at", F.explode(F.sequence("low", "high"))).select("own", "long", "segment", F.expr("substring(own, at + 1, length)").alias("piece"))
    met = asked.join(_segments(names, edits), ["long", "segment", "piece"]).select("own", "name").distinct()
    return met.withColumn("distance", F.levenshtein("own", "name", edits)).where("distance >= 0")


def suggestions(units: DataFrame, names: DataFrame, count: int = SUGGESTIONS, put: Put = _as_it_is) -> DataFrame:
    """unit_key, suggestion, place, distance: the nearest of all names by edit distance, not further than a third of the value.

    Distances of 1, 2, 4 and so on are searched until a value has `count` names or a third of its length is reached: the nearest are among them."""
    asked = put(units.select("unit_key", text.normalize_text(F.col("value")).alias("own")).where("own <> ''"), "spelling-values")
    own = put(names.select(text.normalize_text(F.col("name")).alias("name")).where("name <> ''").distinct(), "spelling-names")
    most = F.floor(F.length("own") / 3)
    rest, found, edits = put(asked.select("own").distinct().where(F.length("own") >= 3), "spelling-rest"), None, 1
    longest = rest.agg(F.max(most)).head()[0] or 0
    if not longest:
        return rest.sparkSession.createDataFrame([], T.StructType([units.schema["unit_key"], *[T.StructField(n, k) for n, k in (("suggestion", T.StringType()), ("place", T.IntegerType()), ("distance", T.IntegerType()))]]))
    while True:
        near = _within(rest, own, min(edits, max(1, longest))).where((F.col("distance") > 0) & (F.col("distance") <= most))
        place = F.row_number().over(Window.partitionBy("own").orderBy("distance", "name"))
        near = put(near.withColumn("place", place).where(F.col("place") <= count), "spelling-near")
        done = near.where(F.col("place") == count).select("own")
        last = rest.join(done, "own", "left_anti").where(most > edits)
        last = put(last, "spelling-rest") if edits < longest else None
        kept = near if last is None else near.join(last, "own", "left_anti")
        found = kept if found is None else found.unionByName(kept)
        if last is None or last.isEmpty():
            return asked.join(found, "own").select("unit_key", F.col("name").alias("suggestion"), "place", "distance")
        rest, edits = last, 2 * edits


def spelling_hits(units: DataFrame, names: DataFrame, put: Put = _as_it_is) -> DataFrame:
    """Exact hits of suggested spellings; the query is the suggestion, the score 90."""
    told = put(suggestions(units, names.where("is_current"), put=put), "spelling-told")
    hits = exact_hits(told.select(F.col("suggestion").alias("unit_key"), F.col("suggestion").alias("value")).distinct(), names.where("is_current"))
    joined = told.join(hits.select(F.col("unit_key").alias("suggestion"), "concept_id", "name"), "suggestion")
    first = joined.groupBy("unit_key", "concept_id").agg(F.min_by(F.struct("suggestion", "name", "place"), F.struct("place", "name")).alias("m"))
    out = first.select("unit_key", F.lit("spelling_suggestion").alias("channel"), F.col("m.suggestion").alias("query"), "concept_id", F.col("m.name").alias("name"), F.lit(90.0).alias("score"), F.col("m.place").alias("place"))
    return _ranked(out, F.col("place"), F.col("concept_id")).drop("place")


def _first_similarity(units: DataFrame, hits: DataFrame) -> DataFrame:
    """unit_key, similarity of the value to the name of its first hit."""
    first = hits.where("hit_rank = 1").select("unit_key", "name")
    return units.join(first, "unit_key").select("unit_key", text.lexical_similarity(F.col("value"), F.col("name")).alias("similarity"))


def retrieve(units: DataFrame, t: Terminology, p: Profile, stored: Put) -> DataFrame:
    """All channels' hits of units (unit_key, value). Exact first; approximate without an exact hit or if the first one is unlike the value; spelling if
    the first approximate one is unlike it or nothing was found; historical names only for units with no hit at all. stored: cuts lineage."""
    names = t.names.where("is_current")
    none = _none(units, names)
    exact = stored(exact_hits(units, names), "exact") if p.exact_lookup else none
    sure = _first_similarity(units, exact).where(F.col("similarity") >= CORROBORATION).select("unit_key")
    rest = stored(units.join(sure, "unit_key", "left_anti"), "rest")
    approx = stored(approx_hits(rest, t.names, p, put=stored), "approx") if p.approximate_match else none
    like = _first_similarity(rest, approx).where(F.col("similarity") >= CORROBORATION).select("unit_key")
    spelling = stored(spelling_hits(rest.join(like, "unit_key", "left_anti"), t.names, stored), "spelling")
    found = exact.unionByName(approx).unionByName(spelling)
    if not p.historical:
        return found
    unmet = units.join(found.select("unit_key").distinct(), "unit_key", "left_anti")
    return found.unionByName(approx_hits(unmet, t.names, p, current=False, put=stored))


def lookup(found: DataFrame, concepts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """found: concept_id. Label and class from the properties, else from history; concepts that neither names are dropped."""
    own = found.select("concept_id").distinct().join(concepts.select("concept_id", "preferred_label", "concept_class", "status"), "concept_id", "left")
    if history is not None:
        past = history.select("concept_id", F.col("preferred_label").alias("_label"), F.col("concept_class").alias("_class"), F.col("status").alias("_status"))
        own = own.join(past, "concept_id", "left").select("concept_id", F.coalesce("preferred_label", "_label").alias("preferred_label"), F.coalesce("concept_class", "_class").alias("concept_class"), F.coalesce("status", "_status").alias("status"))
    return own.where("preferred_label is not null").withColumn("status", text.parse_status(F.col("status")))


def validate_concepts(found: DataFrame, history: DataFrame) -> DataFrame:
    """concept_id, exists, status, concept_class: a concept exists if history names it and says a source (not blank, not NONE)."""
    source = F.col("source") if "source" in history.columns else F.lit("terminology")
    own = history.select("concept_id", "preferred_label", "concept_class", "status", source.alias("source"))
    known = F.col("preferred_label").isNotNull() & F.col("source").isNotNull() & ~F.col("source").isin("", "NONE")
    out = found.select("concept_id").distinct().join(own, "concept_id", "left").withColumn("exists", F.coalesce(known, F.lit(False)))
    return out.select("concept_id", "exists", F.when(F.col("exists"), text.parse_status(F.col("status"))).otherwise(F.lit("unknown")).alias("status"), F.when(F.col("exists"), F.col("concept_class")).alias("concept_class"))


def resolve_remaps(concepts: DataFrame, put: Put) -> DataFrame:
    """concept_id, current (sorted), steps, cyclic for each remapped concept (concept_id, remapped_to): the concepts where its remaps end, the most of them on
    a way there, and whether a way never ends.

    Pointer jumping: each round joins ways with ways, so their length doubles; what still goes on after more steps than there are remapped concepts
    is in a cycle. Ways that have ended take no part any more. All sides of these joins grow with the input, so none is broadcast."""
    edges = put(concepts.select(F.col("concept_id").alias("a"), F.explode("remapped_to").alias("b")).distinct(), "remaps")
    starts = edges.select(F.col("a").alias("b")).distinct()
    n, steps = starts.count(), 1
    ways = edges.join(starts.withColumn("on", F.lit(True)).hint("merge"), "b", "left")
    ways = put(ways.select("a", "b", F.lit(1).cast("long").alias("steps"), F.col("on").isNull().alias("done")), "remaps-ways")
    ended, going = ways.where("done"), ways.where("not done")
    while left := going.select("a").distinct().count():
        n = min(n, left + steps)  # no way without a cycle is longer
        if steps > n:
            break
        # a way to b goes on by what is known of b: where it has ended, and where its own ways of the same length go
        known = ended.unionByName(going).select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("steps").alias("more"), F.col("done").alias("last"))
        longer = going.drop("done").join(known.hint("merge"), "b").groupBy("a", F.col("c").alias("b"), F.col("last").alias("done")).agg(F.max(F.col("steps") + F.col("more")).alias("steps"))
        longer = put(longer, "remaps-longer")
        new, going = longer.where("done"), longer.where("not done")
        if not new.isEmpty():
            ended = put(ended.unionByName(new).groupBy("a", "b", "done").agg(F.max("steps").alias("steps")), "remaps-ended")
        steps *= 2
    looping = going.select("a").distinct().withColumn("cyclic", F.lit(True))
    found = ended.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("current"), F.max("steps").alias("steps"))
    out = starts.select(F.col("b").alias("a")).join(found.hint("merge"), "a", "left").join(looping.hint("merge"), "a", "left")
    kind = concepts.schema["concept_id"].dataType.simpleString()
    return out.select(F.col("a").alias("concept_id"), F.coalesce("current", F.array().cast(f"array<{kind}>")).alias("current"), "steps", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def search(queries: DataFrame, t: Terminology, p: Profile, top: int) -> DataFrame:
    """Exact and approximate hits of unit_key, value: the first hit of a concept stays, `top` for a query."""
    both = exact_hits(queries, t.names.where("is_current")).withColumn("c", F.lit(0)).unionByName(approx_hits(queries, t.names, p).withColumn("c", F.lit(1)))
    first = both.withColumn("k", F.row_number().over(Window.partitionBy("unit_key", "concept_id").orderBy("c", "hit_rank"))).where("k = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("unit_key").orderBy("c", "hit_rank"))).where(F.col("place") <= top).drop("c", "k")
