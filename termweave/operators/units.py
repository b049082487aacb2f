"""Rows to alignment units (B-8 to B-18)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text, vocab
from ..profile import Profile


def _key(name: str) -> str:
    return name.strip().casefold().replace(" ", "_")


def _by_field(columns: Sequence[str], aliases: Mapping[str, str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for c in columns:
        if (field := aliases.get(_key(c))) is not None:
            found.setdefault(field, []).append(c)
    return found


def _value(c: str) -> Column:
    """A cell as text, null if blank."""
    cell = F.col(f"`{c}`").cast("string")
    return F.when(~text.is_blank(cell), cell)


Cell = Callable[[str], Column]


def neighbours(columns: Sequence[str], cell: Cell = _value) -> list[tuple[str, Column]]:
    """The cells that may be an envelope's neighbours; those that aren't null are."""
    pairs = [(c, cell(c)) for c in columns if vocab.ENVELOPE_ALIASES.get(_key(c)) is None]
    for cols in _by_field(columns, vocab.ENVELOPE_ALIASES).values():
        for k, c in enumerate(cols[1:], 1):
            earlier = F.coalesce(*map(cell, cols[:k]))
            pairs.append((c, F.when(earlier.isNotNull(), cell(c))))
    return pairs


def build_envelope(columns: Sequence[str], explicit: Mapping[str, Column] | None = None, cell: Cell = _value) -> Column:
    """struct of envelope fields and neighboring_fields: the first cell that isn't blank wins a field, later aliases and unknown keys are neighbours.

    explicit: fields whose own value, where not null, wins over what the row says. cell: a column's text, null if blank, where it is known already.
    """
    fields = _by_field(columns, vocab.ENVELOPE_ALIASES)
    values = {f: F.coalesce(*map(cell, cols)) for f, cols in fields.items()}
    for name, value in (explicit or {}).items():
        values[name] = F.coalesce(value, values[name]) if name in values else value
    names = list(dict.fromkeys(vocab.ENVELOPE_ALIASES.values()))
    pairs = neighbours(columns, cell)
    left = F.map_from_arrays(F.array(*[F.lit(c) for c, _ in pairs]), F.array(*[v for _, v in pairs])) if pairs else F.create_map().cast("map<string,string>")
    left = F.map_filter(left, lambda _, v: v.isNotNull())
    return F.struct(*[(values[n] if n in values else F.lit(None).cast("string")).alias(n) for n in names], left.alias("neighboring_fields"))


def build_attributes(columns: Sequence[str], cell: Cell = _value) -> Column:
    """struct of attributes; `negation` is boolean."""
    fields = _by_field(columns, vocab.ATTRIBUTE_ALIASES)
    names = list(dict.fromkeys(vocab.ATTRIBUTE_ALIASES.values()))
    value = lambda n: F.coalesce(*map(cell, fields[n])) if n in fields else F.lit(None).cast("string")
    return F.struct(*[(value(n).try_cast("boolean") if n == "negation" else value(n)).alias(n) for n in names])


def assess_readiness(value: Column, envelope: Column, attributes: Column, p: Profile, around: Mapping[str, Column] | None = None) -> Column:
    """struct status, missing_context, warnings: sorted missing fields; presence is over envelope, attributes and neighbours.

    around: the cells that the envelope's neighbours come from, where they are known: else the map of them is made for each field that is asked for."""
    names, own = list(dict.fromkeys(vocab.ENVELOPE_ALIASES.values())), list(dict.fromkeys(vocab.ATTRIBUTE_ALIASES.values()))

    def present(name: str) -> Column:
        parts = [F.map_contains_key(envelope["neighboring_fields"], F.lit(name))] if around is None else [around[name].isNotNull()] if name in around else []
        parts += [envelope[name].isNotNull()] if name in names else []
        parts += [attributes[name].isNotNull()] if name in own else []
        out = parts[0] if parts else F.lit(False)
        for x in parts[1:]:
            out = out | x
        return out

    def missing(fields: Sequence[str], told: str = "") -> Column:
        return F.array_compact(F.array(*[F.when(~present(f), F.lit(told + f)) for f in sorted(fields)])) if fields else none

    def lacks(fields: Sequence[str]) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | ~present(f)
        return out

    none = F.array().cast("array<string>")
    status = F.when(text.is_blank(value), F.lit("UNSUPPORTED_INPUT")).when(lacks(p.required_context), F.lit("INSUFFICIENT_CONTEXT")).when(lacks(p.optional_context), F.lit("READY_WITH_LIMITED_CONTEXT")).otherwise(F.lit("READY_FOR_MAPPING"))
    warnings = F.when(status == "READY_WITH_LIMITED_CONTEXT", missing(p.optional_context, "optional context missing: ")).otherwise(none)
    return F.struct(status.alias("status"), F.when(status == "INSUFFICIENT_CONTEXT", missing(p.required_context)).otherwise(none).alias("missing_context"), warnings.alias("warnings"))


def expand_requests(df: DataFrame, value_field: str | None, batch: str | None = None) -> DataFrame:
    """A batch column (array of maps) becomes a row for each element with a 1-based batch_index; a record (map column `row`) gives its value_field
    as raw_value and keeps the rest as `row`; a field request has raw_value already."""
    if batch is not None:
        rest = [c for c in df.columns if c != batch]
        df = df.select(*rest, F.posexplode(batch).alias("_at", "row")).withColumn("batch_index", F.col("_at") + 1).drop("_at")
    if value_field is not None:
        df = df.withColumn("raw_value", F.col("row")[value_field]).withColumn("row", F.map_filter("row", lambda k, _: k != value_field))
    return df


def check_requests(df: DataFrame, p: Profile) -> DataFrame:
    """df with `mismatched`: the fields in which a request contradicts the profile."""
    wanted = {"source_type": p.source_type, "mention_mode": p.mention_mode, "task": p.task, "mapping_intent": p.mapping_intent, "target_terminology": p.target_terminology, "desired_granularity": p.granularity}
    tests = []
    for field, value in wanted.items():
        a, b = F.col(field), F.lit(value)
        if field == "target_terminology":
            a, b = text.casefold(a), text.casefold(b)
        tests.append(F.when(~a.eqNullSafe(b), F.lit(field)))
    return df.withColumn("mismatched", F.array_compact(F.array(*tests)))


#: Rows that are numbered in one task, or so.
RANGE_ROWS = 100_000


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Contiguous numbers from 1 in order of `order` (any types that order), without bringing all rows to one task: Spark's range partitioning
    samples the order columns, each range is counted, and each row is numbered within its range. Rows equal in `order` share a range.

    The ranges' first keys are taken once, so counting and numbering cut alike.
    """
    n = df.count()
    if not n:
        return df.withColumn(name, F.lit(1))
    ranges = max(1, min(1 << 14, -(-n // RANGE_ROWS)))
    span = "_span"
    while span in df.columns:
        span = f"_{span}"
    # the least key of each range, ranges in order; as literals, so that both uses cut alike
    keys = df.select(F.struct(*order).alias("key"))
    firsts = keys.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first")).agg(F.sort_array(F.collect_set("first")).alias("all"))
    kind = firsts.schema["all"].dataType.simpleString()
    text_of = (firsts.select(F.to_json("all")).head()[0] or "[]").replace("\\", "\\\\").replace("'", "\\'")
    half = "transform(array(shiftright(s.lo + s.hi, 1)), m -> if(key >= all[m], named_struct('lo', m, 'hi', s.hi), named_struct('lo', s.lo, 'hi', m)))[0]"
    key = f"struct({', '.join(f'`{c}`' for c in order)})"
    own = f"transform(array(from_json('{text_of}', '{kind}')), all -> transform(array({key}), key -> aggregate(sequence(1, 15), named_struct('lo', 0, 'hi', size(all)), (s, i) -> if(s.hi - s.lo <= 1, s, {half}), s -> s.lo))[0])[0]"
    df = df.withColumn(span, F.expr(own))
    before = Window.orderBy(span).rowsBetween(Window.unboundedPreceding, -1)  # at most 16,384 rows, one for each range
    offsets = df.groupBy(span).agg(F.count(F.lit(1)).alias("n_")).withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).select(F.col(span).alias("of_"), "before_")
    inside = F.row_number().over(Window.partitionBy(span).orderBy(*order))
    return df.withColumn(name, inside).join(F.broadcast(offsets), F.col(span) == F.col("of_")).withColumn(name, F.col(name) + F.col("before_")).drop(span, "of_", "before_")


def classify_rows(df: DataFrame, value: str, id_columns: Sequence[str], context: Sequence[str] = (), corrupt: str = "_corrupt_record", absent: Sequence[str] = ()) -> DataFrame:
    """df with status, error_code, error_message. Order of the tests: unreadable line, value column absent, ids absent or blank, blank value (skipped),
    context columns absent. Every row stays. absent: columns that the input doesn't have."""
    code = F.lit(None).cast("string")
    message = F.lit(None).cast("string")
    missing = [c for c in context if c in absent]
    tests: list[tuple[Column, str, Column]] = []
    if corrupt in df.columns:
        object_like = F.col(corrupt).rlike(r"^\s*[\[\"\-0-9tfn]") & F.try_parse_json(F.col(corrupt)).isNotNull()
        tests.append((F.col(corrupt).isNotNull() & object_like, "UnsupportedInput", F.lit("the line is not a JSON object")))
        tests.append((F.col(corrupt).isNotNull(), "JSONDecodeError", F.lit("the line is not valid JSON")))
    tests.append((F.lit(value in absent), "MISSING_VALUE_COLUMN", F.lit(f"column {value!r} is absent")))
    have = [F.col(f"`{c}`") for c in id_columns if c not in absent]
    no_id = F.lit(True) if len(have) < len(id_columns) else (ids.record_id(*have).isNull() if have else F.lit(False))
    tests.append((no_id, "MISSING_RECORD_ID", F.lit("an id column is absent or blank")))
    blank = text.is_blank(F.col(f"`{value}`").cast("string")) if value not in absent else F.lit(False)
    tests.append((blank, "BLANK_VALUE", F.lit("the value is blank")))
    tests.append((F.lit(bool(missing)), "MISSING_CONTEXT_COLUMN", F.lit(f"context columns are absent: {', '.join(missing)}")))
    for test, name, told in reversed(tests):
        code, message = F.when(test, F.lit(name)).otherwise(code), F.when(test, told).otherwise(message)
    status = F.when(code == "BLANK_VALUE", F.lit("skipped")).when(code.isNotNull(), F.lit("error")).otherwise(F.lit("success"))
    return df.withColumns({"status": status, "error_code": code, "error_message": message})


def mapping_key(normalized: Column, envelope: Column | None, attributes: Column | None, p: Profile, names: Sequence[str] | None = None) -> Column:
    """MAP- and 32 hex digits over the normalized value, the task, the profile and the context fields that the profile names (attributes first)."""
    fields = {"value": normalized, "task": F.lit(p.task), "profile": F.lit(f"{p.name}@{p.version}")}
    own, around = list(dict.fromkeys(vocab.ATTRIBUTE_ALIASES.values())), list(dict.fromkeys(vocab.ENVELOPE_ALIASES.values()))
    for name in p.mapping_key_context if names is None else names:
        parts = ([attributes[name]] if attributes is not None and name in own else []) + ([envelope[name]] if envelope is not None and name in around else [])
        if parts:
            fields[f"context.{name}"] = F.coalesce(*parts)
    return ids.stable_id("MAP", fields)


def sau_id(key: Column, envelope: Column | None = None, attributes: Column | None = None) -> Column:
    """SAU- and 32 hex digits over all of a unit's own: record, row, value, context, attributes and mapping key. envelope, attributes: their JSON, where it is made already."""
    context, own = F.to_json("envelope") if envelope is None else envelope, F.to_json("attributes") if attributes is None else attributes
    return ids.stable_id("SAU", {"record": F.col("record_id"), "row": F.col("source_row_number").cast("string"), "value": F.col("raw_value"), "key": key, "context": context, "attributes": own})


def build_units(df: DataFrame, value: str, id_columns: Sequence[str], context: Sequence[str], p: Profile, number: str | None = None, carried: Sequence[str] = (), deal: bool = True) -> DataFrame:
    """sau_id, mapping_key, record_id, source_row_number, raw_value, normalized, envelope, attributes, readiness, status, error_code, error_message.

    carried: columns of df that stay beside them. deal: deal the rows out first, as a file of one row group is read by one task, however many there are.
    """
    dealt = df.repartition(*[F.col(f"`{c}`") for c in dict.fromkeys([*id_columns, value])]) if deal else df
    cells = [c for c in context if c in df.columns]
    rid = ids.record_id(*[F.col(f"`{c}`") for c in id_columns]) if id_columns else F.lit(None).cast("string")
    raw = F.col(f"`{value}`").cast("string")
    # what is used more than once is a column first, as Spark writes out again what a struct is made of
    rows = classify_rows(dealt, value, id_columns, context).select(
        rid.alias("record_id"), (F.col(number).cast("long") if number else F.lit(None).cast("long")).alias("source_row_number"), raw.alias("raw_value"),
        text.normalize_text(raw).alias("normalized"), *[_value(c).alias(f"_cell_{k}") for k, c in enumerate(cells)], "status", "error_code", "error_message", *carried,
    )
    cell = lambda c: F.col(f"_cell_{cells.index(c)}")
    envelope, attributes = build_envelope(cells, {"record_id": F.col("record_id")}, cell), build_attributes(cells, cell)
    readiness = assess_readiness(F.col("raw_value"), envelope, attributes, p, dict(neighbours(cells, cell)))
    rest = [c for c in rows.columns if not c.startswith("_cell_")]
    out = rows.select(*rest, envelope.alias("envelope"), attributes.alias("attributes"), readiness.alias("readiness"), mapping_key(F.col("normalized"), envelope, attributes, p).alias("mapping_key"))
    out = out.withColumns({"_context": F.to_json("envelope"), "_own": F.to_json("attributes")}).withColumn("sau_id", sau_id(F.col("mapping_key"), F.col("_context"), F.col("_own")))
    return out.select("record_id", "source_row_number", "raw_value", "normalized", "envelope", "attributes", "status", "error_code", "error_message", "readiness", "mapping_key", "sau_id", *carried)
