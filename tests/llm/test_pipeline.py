import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from termweave.llm import mixing, packing, quality_gam, quality_mcd
from termweave.llm.registry import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents (good ones, junk, copies, near copies, personal data, nulls) and labels."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    good = [(" ".join(word() for _ in range(rng.randint(30, 120))) + ".").capitalize() for _ in range(120)]
    junk = ["BUY!!! NOW!!! " + " ".join(f"{word()}### $$$" for _ in range(40)) for _ in range(60)]
    near = [f"{x} {word()}" for x in good[:10]]
    private = [f"{x} Write to {word()}{i}@mail.example.com or 10.0.0.{i}." for i, x in enumerate(good[100:110])]
    texts = [*good, *junk, *near, *private, good[0], good[0], "", None]
    rows = [(i, x, "en", ("web", "books", None)[i % 3 if i % 7 else 0], None if x is None else len(x)) for i, x in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOC).withColumn("_key", F.lit(1)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, tables)
        path = f"{tables}/{name}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    scores = quality_gam.classify(spark.read.parquet(f"{tables}/documents.parquet"), labels).collect()
    good = kept["quality_classifier"]
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r in scores if r["predicted"] == 1)
    assert {r["doc_id"] for r in good} >= set(range(120)) and not {r["doc_id"] for r in good} & set(range(120, 180))
    # one row of each class of links of 0.8 or more stays, that with the least id
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in good}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in label):
            break
    single = kept["near_dedup"]
    assert sorted(r["doc_id"] for r in single) == sorted(i for i in sets if label[i] == i) and len(single) < len(good)
    # personal data: patterns become their kinds, all else stays
    clean = {r["doc_id"]: r for r in kept["personal_data"]}
    assert clean.keys() == {r["doc_id"] for r in single}
    for r in single:
        want = None if r["text"] is None else re.sub(r"[0-9]+(\.[0-9]+){3}", "<IP>", re.sub(r"[a-z0-9]+@[a-z.]+[a-z]", "<EMAIL>", r["text"]))
        assert clean[r["doc_id"]]["text"] == want and clean[r["doc_id"]]["n_chars"] == (None if want is None else len(want))
    # mixture: counts are those of the source's rate at the document's uniform number
    chars = collections.Counter()
    for r in clean.values():
        chars[r["source"]] += len(r["text"] or "")
    chars = {s: c for s, c in chars.items() if c}
    rate = {s: sum(chars.values()) * c**0.5 / sum(x**0.5 for x in chars.values()) / c for s, c in chars.items()}
    copies = collections.Counter(r["doc_id"] for r in kept["source_mixture"])
    import hashlib
    import math

    for i, r in clean.items():
        u = (int(hashlib.md5(f"{mixing.SEED}/{i}/0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p, total = 0, math.exp(-rate.get(r["source"], 0)), math.exp(-rate.get(r["source"], 0))
        while r["source"] in rate and total < u:
            n, p = n + 1, p * rate[r["source"]] / (n + 1)
            total += p
        assert copies[i] == n
    # packing: each row's tokens, gapless in sequences of at most the capacity
    t = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for r in kept["source_mixture"]:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in kept["best_fit_packing"]) == want
    places = collections.defaultdict(list)
    for r in kept["best_fit_packing"]:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= packing.CAPACITY


def test_run_is_the_stages_one_after_another(spark, tables):
    out = __spark_entry__.queries()["pipeline"](spark, tables)
    assert out.count() > 100 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_gam_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 4))
    m = quality_gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    assert m.pairs
    for row in x[:60]:
        place = [sum(float(e) <= v for e in edges) for edges, v in zip(m.edges, row, strict=True)]
        total = m.intercept + sum(float(m.single[k][place[k]]) for k in range(4)) + sum(float(t[place[a], place[b]]) for a, b, t in m.pairs)
        assert m.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_gam_trees_make_the_best_cut():
    rng = np.random.default_rng(4)
    for _ in range(20):
        g, h, ridge = rng.normal(size=9), rng.random(9) + 0.1, 0.5
        gain = lambda lo, hi: g[lo:hi].sum() ** 2 / (h[lo:hi].sum() + ridge)  # noqa: B023, E731
        cut = max(range(1, 9), key=lambda k: gain(0, k) + gain(k, 9))  # noqa: B023
        want = np.where(np.arange(9) < cut, g[:cut].sum() / (h[:cut].sum() + ridge), g[cut:].sum() / (h[cut:].sum() + ridge))
        if gain(0, cut) + gain(cut, 9) - gain(0, 9) > 1e-9:
            assert quality_gam._tree(g, h, 2, ridge) == pytest.approx(want)


def test_mcd_is_that_of_the_subset_of_least_determinant(spark):
    from itertools import combinations

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(9, 2)), rng.normal(size=(3, 2)) + 40])
    best = min(combinations(range(12), 9), key=lambda s: np.linalg.det(np.cov(x[list(s)].T)))
    rows = spark.createDataFrame([("g", float(a), float(b)) for a, b in x], "g string, a double, b double")
    model = quality_mcd.fit(rows, {"a": 1e-3, "b": 1e-3}).head()
    assert (model["m0"], model["m1"]) == pytest.approx(tuple(x[list(best)].mean(0)))
    assert np.linalg.inv([[model["p0_0"], model["p0_1"]], [model["p0_1"], model["p1_1"]]]) == pytest.approx(np.cov(x[list(best)].T, bias=True), rel=1e-2)
