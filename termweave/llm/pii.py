r"""Operator 9, personal data: patterns, then information-theoretic sanitisation (DataFrame functions only).

Four patterns give the protected entities and their spans. Then the corpus says which terms give an entity away: the words of all its texts,
wherever they stand outside spans, are counted by entity, and a term discloses entity e if its pointwise mutual information with e is at least
ALPHA of all the information in e, -log2 P(e), probabilities being shares of all documents. In one document alone every rare word would
disclose all that it mentions, so entity and term must meet in MIN_SUPPORT documents at least. Copies are documents, and
words that only they hold do give their entities away; where that is too strict, remove copies first (as the pipeline does) or ask for more support.
Disclosing terms become spans of kind `term` in the texts that mention the entity; redact() generalises all spans to their kind.

Positions come from splitting a text at a pattern's matches and adding up lengths. Only texts with mentions move, copies as one
row, and only words that pass the support test are counted over the whole corpus, by their 64-bit hashes. The patterns are those of
`SPANS`, with possessive repeats and look-behinds that leave out starts that can't match, so long runs of one kind of character take linear time.

Edge cases: null texts are empty texts without spans; null ids are kept; spans depend on the text alone, so rows that repeat are answered each
and alike; overlapping spans of different kinds all stay, and redact() covers their union; an empty table gives an empty result; other columns, whatever
their names, are carried by redact() and ignored by find(). A text of a million numbers takes seconds, one of 400,000 matches about 10 s to locate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: kind: pattern. email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+){3}, card [0-9]([\x20-]?[0-9])+ (a match
#: is a whole run of digits, so only runs of 14 to 19 need be looked at), phone \+[0-9][\x20().0-9-]+[0-9]
SPANS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*SPANS, "term"]
WORD = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’-]++"
ALPHA, MIN_SUPPORT = 0.9, 2
#: Rows of small tables, and 64-bit hashes of terms, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_TERMS = 50_000, 1_000_000
#: Items that are walked in one run.
RUN = 64


def walked(items: Column, end: Callable[[Column, Column], Column], made: Callable[[Column, Column, Column, Column], Column], kind: str, text: Column | None = None) -> Column:
    """What `made` makes of each item and the place before it, as an array of type `kind`. The place is 0 and after each item z end(place, z), which
    must be associative (a sum, a maximum) in z's share of it.

    An array that grows is copied at each step, so the items are cut into runs of about the square root of their number: first the
    place before each run, then the runs, each by itself. made(place, z, part, base): part is text from code point `base` on, as far as the run goes.
    """
    source = F.lit("") if text is None else text

    def one_run(run: Column, at: Column, part: Column, base: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(run, start, lambda s, z: F.struct(end(s["at"], z).alias("at"), F.concat(s["out"], F.array(made(s["at"], z, part, base))).alias("out")), lambda s: s["out"])

    def last(run: Column) -> Column:
        return F.aggregate(run, F.lit(0), end)

    def all_runs(items: Column) -> Column:
        size = F.greatest(F.lit(RUN), F.ceil(2 * F.cbrt(F.size(items)) if text is None else F.sqrt(F.size(items))).cast("int"))
        runs = _bound(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int")), lambda k: F.slice(items, k * n + 1, n)))
        return F.when(F.size(items) <= RUN, one_run(items, F.lit(0), source, F.lit(0))).otherwise(_bound(runs, many))

    def many(runs: Column) -> Column:
        step = lambda s, z: F.struct(end(s["at"], z).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        ends = F.transform(runs, lambda r: F.struct(F.lit(0).alias("gap"), last(r).alias("size"), last(r).alias("end")))
        starts = F.aggregate(ends, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])

        def at_place(run: Column, at: Column) -> Column:
            if text is None:
                return one_run(run, at, source, F.lit(0))
            upto = F.aggregate(run, at, end)
            return _bound(F.substring(source, at + 1, upto - at), lambda part: one_run(run, at, part, at))

        return F.flatten(F.zip_with(runs, starts, at_place))

    return _bound(items, all_runs)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and value of each match."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = _bound(found, lambda v: F.zip_with(F.slice(between, F.lit(1), F.size(v)), v, lambda x, y: F.struct(F.length(x).alias("gap"), F.length(y).alias("size"), y.alias("value"))))

    def end(at: Column, z: Column) -> Column:
        return at + z["gap"] + z["size"]

    def made(at: Column, z: Column, part: Column, base: Column) -> Column:
        return F.struct((at + z["gap"]).alias("start"), end(at, z).alias("end"), z["value"].alias("value"))

    return walked(pairs, end, made, "struct<start:int,end:int,value:string>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.right(x, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """kind (its place in KINDS), start, end, value of all spans of the four patterns."""
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")

    def spans(k: int, kind: str, pattern: str) -> Column:
        kept = F.filter(located(text, pattern), lambda s: _valid(kind, s["value"]))
        return F.when(needs[kind], F.transform(kept, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))).otherwise(none)

    return F.concat(*(spans(k, kind, pattern) for k, (kind, pattern) in enumerate(SPANS.items())))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entity(kind: Column, value: Column) -> Column:
    """One name for the spellings of an entity."""
    return F.xxhash64(kind, F.when(kind == 0, F.lower(value)).otherwise(_digits(value)))


def _uncovered(text: Column, spans: Column) -> Column:
    """For each span, by start, the text before it that no span covers, and its kind (null in an overlap)."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))

    def made(at: Column, x: Column, part: Column, base: Column) -> Column:
        free = x["start"] >= at
        return F.struct(F.when(free, F.substring(part, at - base + 1, x["start"] - at)).alias("piece"), F.when(free, x["kind"]).alias("kind"))

    return walked(order, lambda at, x: F.greatest(at, x["end"]), made, "struct<piece:string,kind:int>", text)


def _rest(text: Column, spans: Column) -> Column:
    """The text after all spans."""
    return F.substring(text, F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)) + 1, F.length(text))


def _between(text: Column, spans: Column) -> Column:
    """The pieces of text that no span covers."""
    return F.concat(F.transform(_uncovered(text, spans), lambda x: F.coalesce(x["piece"], F.lit(""))), F.array(_rest(text, spans)))


def _words(pieces: Column) -> Column:
    """The distinct words, in small letters, of the pieces."""
    return F.array_distinct(F.transform(F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0)))), lambda w: F.lower(w)))


def _key(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, which is a stored table, for a broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def protected(mentions: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """key, party, with_entity: the protected parties of each text, from mentions (key, n, spans).

    Entities that stand in the same texts can't be told apart by co-occurrence: they are one party, so a text of many entities has few.
    """
    spark = mentions.sparkSession
    one = mentions.select("key", "n", F.explode("spans").alias("s")).select("key", "n", _entity(F.col("s.kind"), F.col("s.value")).alias("entity")).distinct()
    one = common.stored(spark, one, "pii-entities")
    # no term of an entity in fewer documents has the support
    own = one.groupBy("entity").agg(F.sum("n").alias("with_entity"), F.count(F.lit(1)).alias("texts"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b"))
    own = own.where(F.col("with_entity") >= min_support).select("entity", F.xxhash64("a", "b", "texts").alias("party"), "with_entity")
    own = common.stored(spark, own, "pii-own")
    return common.stored(spark, one.join(_small(own), "entity").select("key", "party", "with_entity").distinct(), "pii-parties")


def disclosing(docs: DataFrame, mentions: DataFrame, parties: DataFrame, alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """party, term: the terms that exceed the disclosure threshold. docs: text of each document; mentions: key, n, text, spans of each text."""
    spark = docs.sparkSession
    texts = mentions.join(_small(common.stored(spark, parties.select("key").distinct(), "pii-keys")), "key", "left_semi")
    words = texts.select("key", "n", F.explode(_words(_between(F.col("text"), F.col("spans")))).alias("term"))
    joint = words.join(_small(parties), "key").groupBy("party", "term").agg(F.sum("n").alias("both"), F.first("with_entity").alias("with_entity"))
    joint = common.stored(spark, joint.where(F.col("both") >= min_support).withColumn("word", F.xxhash64("term")), "pii-joint")
    if joint.isEmpty():
        return joint.select("party", "term")
    terms = common.stored(spark, joint.select("word").distinct(), "pii-candidates")
    seen = docs.select(F.explode(F.transform(_words(F.array("text")), lambda w: F.xxhash64(w))).alias("word"))
    if terms.count() <= BROADCAST_TERMS:
        seen = seen.join(F.broadcast(terms), "word", "left_semi")
    seen = seen.groupBy("word").agg(F.count(F.lit(1)).alias("with_term"))
    size = docs.count()
    told = F.log2(F.col("both") * F.lit(float(size)) / (F.col("with_entity") * F.col("with_term")))
    whole = F.log2(F.lit(float(size)) / F.col("with_entity"))
    return joint.join(seen, "word").where((whole > 0) & (told >= alpha * whole)).select("party", "term")


def term_spans(docs: DataFrame, alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """key (hash of a text) and terms: the spans that the method adds."""
    spark = docs.sparkSession
    rows = docs.select("text")
    mentions = rows.withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    # copies of a text are one row
    mentions = mentions.groupBy(_key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"), F.first("spans").alias("spans"))
    mentions = common.stored(spark, mentions, "pii-mentions")
    parties = protected(mentions, min_support)
    found = common.stored(spark, disclosing(rows, mentions, parties, alpha, min_support), "pii-terms")
    told = common.stored(spark, parties.join(found, "party").select("key", "term").distinct(), "pii-told")
    texts = mentions.join(_small(common.stored(spark, told.select("key").distinct(), "pii-told-keys")), "key", "left_semi")
    placed = texts.select("key", F.explode(located(F.col("text"), WORD)).alias("s")).withColumn("term", F.lower("s.value")).join(told, ["key", "term"], "left_semi")
    span = F.struct(F.lit(len(SPANS)).alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))
    return common.stored(spark, placed.groupBy("key").agg(F.collect_list(span).alias("terms")), "pii-spans")


def _with_spans(docs: DataFrame, alpha: float, min_support: int) -> tuple[DataFrame, str, str]:
    """docs (doc_id, text not null) with two more columns, and their names: the spans of the patterns, and all spans."""
    base, every, key, own_key, terms = common.fresh(docs, "base", "every", "key", "own_key", "terms")
    extra = _small(term_spans(docs, alpha, min_support)).select(F.col("key").alias(key), F.col("terms").alias(terms))
    rows = docs.withColumn(base, base_spans(F.col("text")))
    rows = rows.withColumn(own_key, F.when(F.size(base) > 0, _key(F.col("text"))))
    rows = rows.join(extra, F.col(own_key) == F.col(key), "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    return rows.withColumn(every, F.concat(F.col(base), F.coalesce(F.col(terms), none))).drop(key, own_key, terms), base, every


def find(docs: DataFrame, alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    common.require(docs, "doc_id", "text")
    rows, base, every = _with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), alpha, min_support)

    def count(k: int) -> Column:
        return F.size(F.filter(F.col(base), lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(SPANS)]
    return rows.select("doc_id", *counts, F.sha2(F.encode(listed(F.col(base)), "UTF-8"), 256).alias("base_sha256"), listed(F.col(every)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span generalised to its kind; where spans overlap, their union is covered once."""
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    cover = lambda x: F.coalesce(F.concat(x["piece"], F.get(name, x["kind"])), F.lit(""))
    return F.concat(F.array_join(F.transform(_uncovered(text, spans), cover), ""), _rest(text, spans))


def redact(docs: DataFrame, alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """docs with their columns, `text` redacted (null stays null) and `n_chars`, if there, counted anew."""
    common.require(docs, "doc_id", "text")
    was_null, new = common.fresh(docs, "was_null", "new")
    rows, _, every = _with_spans(docs.withColumn(was_null, F.col("text").isNull()).withColumn("text", F.coalesce("text", F.lit(""))), alpha, min_support)
    rows = rows.withColumn(new, F.when(F.size(every) == 0, F.col("text")).otherwise(redacted(F.col("text"), F.col(every))))
    out = {"text": F.when(~F.col(was_null), F.col(new)).alias("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.size(every) == 0, F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*[out[c] if c in out else F.col(f"`{c}`") for c in docs.columns])
