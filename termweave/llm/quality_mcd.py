"""Operator 3, quality rules: counted rules, then robust multivariate outliers per language and source.

One pass over the texts leaves a narrow table of counts and transformed statistics. For each language and source,
concentration steps look for the three quarters of the rows with the covariance of least determinant: squared Mahalanobis
distances from the present estimate are counted in logarithmic bins, the bin that holds the quantile is the cut, and
the rows within it give the next mean and covariance. All steps are aggregations over all rows with partial sums, so a source
with a third of the rows costs no task more than another. Two starts (medians with absolute deviations; plain moments)
run side by side and the smaller determinant wins. A row is rejected if its distance, shrunk where its group's median
exceeds the chi-squared one, is beyond a far quantile.

Edge cases: null and empty texts have no words and fail the base rules; null lang or source is a value of its own;
groups under MIN_ROWS rows share an estimate with the small groups of their language, then of all languages, and
if even those are too few the method keeps their rows; a variance never falls under a documented floor, so ties and constant
statistics don't make every other value an outlier. Repeated rows count and return as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textbytes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics with the least standard deviation that an estimate may give them.
STATISTICS = {"x_length": 0.12, "x_symbols": 0.45, "x_dup_lines": 0.9, "x_repeats": 0.8, "x_upper": 0.35, "x_marks": 0.35}
PRIOR = 20
MIN_ROWS, SUPPORT, STEPS, TAIL = 50, 0.75, 4, 1e-6
BINS_PER_DOUBLING = 16

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?;:")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _counts(t: textbytes.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The COUNTS and the STATISTICS of each text."""
    n = len(t)
    w = textbytes.words(t)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[t.at[1:]] - sums[t.at[:-1]]

    n_words = np.bincount(w.doc, minlength=n)
    word_chars = total(~textbytes.SPACE[t.data] & ((t.data & 0xC0) != 0x80))
    symbols = total(_SYMBOL[t.data])
    rows = textbytes.lines(t, w)
    n_lines = np.bincount(rows.doc, minlength=n)
    doc, _, often = textbytes.counted(rows.doc, rows.hash)
    dup_lines = np.bincount(doc, weights=often - 1, minlength=n).astype(np.int64)
    repeats = np.zeros(n, np.int64)
    m = len(w) - 4
    if m > 0:
        doc, h = w.doc[:m], np.zeros(m, np.uint64)
        for k in range(5):
            h += w.hash[k : k + m] * textbytes.powers(6)[k + 1]
        at = np.flatnonzero(doc == w.doc[4:])
        order = at[np.lexsort((h[at], doc[at]))]
        same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        cover = np.zeros(len(w) + 1, np.int64)
        np.add.at(cover, order[twice], 1)
        np.add.at(cover, order[twice] + 5, -1)
        repeats = np.bincount(w.doc, weights=np.cumsum(cover)[:-1] > 0, minlength=n).astype(np.int64)
    # shares of few words vary by chance, so PRIOR words are added to each denominator; length alone says nothing of quality
    per = n_words + PRIOR
    stats = np.column_stack([
        np.log1p((word_chars + 5.5 * PRIOR) / per),
        np.log1p(100 * symbols / per),
        np.log1p(100 * dup_lines / (n_lines + 2)),
        np.log1p(100 * repeats / per),
        np.log1p(100 * total(_UPPER[t.data]) / (word_chars + 5.5 * PRIOR)),
        np.log1p(100 * total(_MARK[t.data]) / per),
    ])
    return np.column_stack([n_words, word_chars, symbols, dup_lines, repeats]).astype(np.int64), stats


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed and STATISTICS of every row."""
    common.require(docs, "doc_id", "text", "lang", "source")
    rows = docs.select("doc_id", "lang", "source", "text")
    schema = rows.drop("text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    for c in STATISTICS:
        schema = schema.add(c, "double")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textbytes.chunks(b.column("text")):
                own = b.slice(t.first, len(t))
                counts, stats = _counts(t)
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(3)), *(pa.array(counts[:, k]) for k in range(counts.shape[1])), *(pa.array(stats[:, k]) for k in range(stats.shape[1]))], names=schema.names)

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.mapInArrow(lambda b: textbytes.released(counted(b)), schema).withColumn("base_failed", failed)


def chi2_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3


def _names(p: int) -> tuple[list[str], list[tuple[int, int]]]:
    return [f"m{i}" for i in range(p)], [(i, j) for i in range(p) for j in range(i, p)]


def _distance(stats: list[str]) -> F.Column:
    """Squared Mahalanobis distance from the joined columns m*, p*_*."""
    _, pairs = _names(len(stats))
    d = [F.col(s) - F.col(f"m{i}") for i, s in enumerate(stats)]
    total = F.lit(0.0)
    for i, j in pairs:
        total = total + F.col(f"p{i}_{j}") * d[i] * d[j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _bin(d2: F.Column) -> F.Column:
    return F.floor(F.log2(d2 + F.lit(1e-6)) * BINS_PER_DOUBLING).cast("int")


def estimates(moments: DataFrame, floors: list[float]) -> DataFrame:
    """Rows of g, start, n, s*, q*_* (sums and sums of products) to g, start, mean, inverse covariance, log determinant."""
    p = len(floors)
    means, pairs = _names(p)
    schema = "g string, start int, " + ", ".join([*(f"{m} double" for m in means), *(f"p{i}_{j} double" for i, j in pairs), "logdet double"])
    least = np.diag(np.square(floors))

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                mean = np.array([getattr(r, f"s{i}") for i in range(p)]) / r.n
                cov = np.zeros((p, p))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = getattr(r, f"q{i}_{j}") / r.n - mean[i] * mean[j]
                # a floor for each variance: what a statistic's own spread lacks is added to its diagonal
                cov[np.diag_indices(p)] = np.maximum(np.diag(cov), np.diag(least)) * 1.0001 + 1e-9
                scale = np.sqrt(np.diag(cov))
                values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
                values = np.maximum(values, 0.05)
                inverse = (vectors / values) @ vectors.T / np.outer(scale, scale)
                out.append([r.g, r.start, *mean, *(inverse[i, j] for i, j in pairs), float(np.log(values).sum() + 2 * np.log(scale).sum())])
            yield pd.DataFrame(out, columns=["g", "start", *means, *(f"p{i}_{j}" for i, j in pairs), "logdet"])

    return moments.mapInPandas(invert, schema)


def _moments(rows: DataFrame, stats: list[str]) -> DataFrame:
    _, pairs = _names(len(stats))
    return rows.groupBy("g", "start").agg(F.count(F.lit(1)).alias("n"), *(F.sum(s).alias(f"s{i}") for i, s in enumerate(stats)), *(F.sum(F.col(stats[i]) * F.col(stats[j])).alias(f"q{i}_{j}") for i, j in pairs))


def _cuts(distances: DataFrame, shares: dict[str, float]) -> DataFrame:
    """g, start and, for each share, the upper edge of the bin that holds that quantile of d2."""
    from pyspark.sql import Window

    binned = distances.groupBy("g", "start", _bin(F.col("d2")).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("g", "start")
    binned = binned.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(every))
    return binned.groupBy("g", "start").agg(*(F.pow(F.lit(2.0), (F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * share), F.col("bin"))) + 1) / F.lit(float(BINS_PER_DOUBLING))).alias(name) for name, share in shares.items()))


def fit(table: DataFrame, stats: dict[str, float], g: str = "g", support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """Rows with a group column and statistics to one estimate for each group: g, m*, p*_*, logdet, median (of d2)."""
    spark, names = table.sparkSession, list(stats)
    rows = table.where(F.col(g).isNotNull()).select(F.col(g).alias("g"), *names)
    p = len(names)
    means, pairs = _names(p)
    medians = rows.groupBy("g").agg(*(F.percentile_approx(s, 0.5, 1000).alias(f"m{i}") for i, s in enumerate(names)))
    spread = rows.join(medians, "g").groupBy("g").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(p)), *(F.percentile_approx(F.abs(F.col(s) - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i, s in enumerate(names)))
    robust = spread.select("g", F.lit(0).alias("start"), *means, *((F.pow(F.greatest(F.col(f"a{i}") * 1.4826, F.lit(stats[names[i]])), F.lit(-2.0)) if i == j else F.lit(0.0)).alias(f"p{i}_{j}") for i, j in pairs), F.lit(0.0).alias("logdet"))
    plain = estimates(_moments(rows.withColumn("start", F.lit(1)), names), list(stats.values()))
    model = common.stored(spark, robust.unionByName(plain), "mcd-start")
    for _ in range(steps):
        near = rows.join(model, "g").withColumn("d2", _distance(names)).select("g", "start", "d2", *names)
        cuts = common.stored(spark, _cuts(near, {"cut": support}), "mcd-cut")
        inner = near.join(cuts, ["g", "start"]).where(F.col("d2") <= F.col("cut"))
        model = common.stored(spark, estimates(_moments(inner, names), list(stats.values())), "mcd-step")
    best = model.groupBy("g").agg(F.min_by(F.struct("start", *means, *(f"p{i}_{j}" for i, j in pairs), "logdet"), F.struct("logdet", "start")).alias("m")).select("g", "m.*")
    near = rows.join(best, "g").withColumn("d2", _distance(names)).select("g", "start", "d2")
    return common.stored(spark, best.join(_cuts(near, {"median": 0.5}), ["g", "start"]), "mcd")


def grouped(table: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """table with fit_g: the group whose estimate judges the row (null: none can), from the rows that pass the base rules."""
    key = F.to_json(F.struct("lang", "source"))
    sizes = table.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < min_rows, F.col("n"))
    by_lang = sizes.groupBy("lang").agg(F.sum(small).alias("n_lang"))
    sizes = sizes.join(by_lang.withColumnRenamed("lang", "lang_"), F.col("lang").eqNullSafe(F.col("lang_"))).drop("lang_")
    left = sizes.where((F.col("n") < min_rows) & (F.col("n_lang") < min_rows)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))
    choice = sizes.join(F.broadcast(left)).select(
        key.alias("key"),
        F.when(F.col("n") >= min_rows, F.concat(F.lit("s"), key)).when(F.col("n_lang") >= min_rows, F.concat(F.lit("l"), F.to_json(F.struct("lang")))).when(F.col("n_all") >= min_rows, F.lit("*")).alias("fit_g"),
    )
    return table.withColumn("key", key).join(choice, "key", "left").drop("key")


def judge(docs: DataFrame, tail: float = TAIL, min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, distance (null where the method has no estimate)."""
    spark, names = docs.sparkSession, list(STATISTICS)
    table = common.stored(spark, grouped(common.stored(spark, statistics(docs), "mcd-counts"), min_rows), "mcd-rows")
    model = fit(table.withColumn("g", F.when(~F.col("base_failed"), F.col("fit_g"))), STATISTICS)
    far, middle = chi2_quantile(1 - tail, len(names)), chi2_quantile(0.5, len(names))
    scaled = _distance(names) * middle / F.greatest(F.col("median"), F.lit(middle))
    out = table.join(model, F.col("fit_g") == F.col("g"), "left").withColumn("distance", F.when(F.col("g").isNotNull(), scaled))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= far, F.lit(True))).alias("kept"), "distance")
