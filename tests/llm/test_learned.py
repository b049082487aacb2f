import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.llm import langid, ppm, quality_gam, quality_mcd, textbytes

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en", source="s", start=0):
    return spark.createDataFrame([(start + i, x, lang, source, None if x is None else len(x)) for i, x in enumerate(texts)], DOC)


def test_words_lines_shingles_against_python():
    texts = ["a  bb\tc\n\nbb é.", "", " \n", "x", "one two three four five six", "a\nb\na\n a", None]
    (t,) = textbytes.chunks(pa.array(texts))
    w = textbytes.words(t)
    wanted = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
    assert [sum(w.doc == i) for i in range(len(texts))] == [len(x) for x in wanted]
    assert len({int(h) for h in w.hash}) == len({x for ws in wanted for x in ws})
    assert [sum(textbytes.lines(t, w).doc == i) for i in range(len(texts))] == [2, 0, 0, 1, 1, 4, 0]
    doc, _ = textbytes.shingles(w, len(texts))
    assert [sum(doc == i) for i in range(len(texts))] == [1, 0, 0, 1, 2, 1, 0]


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality_gam.fit(x, y)
    assert {m.pairs[0][0], m.pairs[0][1]} == {0, 1}
    assert ((m.score(x) > 0.5) == y).mean() > 0.95
    assert quality_gam.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_gam_query_edges(spark):
    good = [f"The quiet text number {i} goes on, and on, about things of every day." for i in range(80)]
    bad = [f"BUY!!! NOW!!! {i} ### $$$ %%%" for i in range(80)]
    d = docs(spark, [*good, *bad, None, ""]).withColumn("score", F.lit("taken"))
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(0, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_gam.classify(d, labels).collect()}
    assert len(out) == 162 and all(0 <= r["score"] <= 1 for r in out.values())
    assert np.mean([out[i]["predicted"] == int(i < 80) for i in range(160)]) > 0.95
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    kept = quality_gam.keep_good(d, labels)
    assert kept.columns == d.columns and kept.where("doc_id < 80").count() == 80
    assert quality_gam.classify(d.limit(0), labels).count() == 0


def brute_counts(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    lines = [k for k in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", k)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    marked = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x or ""), len(lines) - len(set(lines)), len(marked)


def test_rules_count_as_brute_force_and_reject_outliers(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    plain = [" ".join(word() for _ in range(rng.randint(15, 90))) + ".\n" + " ".join(word() for _ in range(12)) for _ in range(300)]
    odd = [" ".join(word() + "###" for _ in range(40)) for _ in range(5)]
    edge = [None, "", "a b\na b\né | ü", "x y z w v " * 9]
    out = {r["doc_id"]: r for r in quality_mcd.judge(docs(spark, [*plain, *odd, *edge])).collect()}
    for i, x in enumerate([*plain, *odd, *edge]):
        assert tuple(out[i][c] for c in quality_mcd.COUNTS) == brute_counts(x)
    assert np.mean([out[i]["kept"] for i in range(300)]) > 0.99
    assert not any(out[i]["kept"] for i in range(300, 309) if i < 305 or i >= 305)
    assert quality_mcd.judge(docs(spark, [])).count() == 0


def test_small_groups_share_estimates(spark):
    d = docs(spark, ["some words in a row that make ten or more of them"] * 3, source=None)
    assert [r["kept"] for r in quality_mcd.judge(d).collect()] == [True] * 3


def test_viterbi_equals_search_over_all_paths():
    rng = np.random.default_rng(3)
    from itertools import product

    for n in (1, 2, 5):
        scores, sizes = rng.normal(scale=4, size=(n, 3)), np.array([0, n])
        value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        best = max(product(range(3), repeat=n), key=value)
        assert value(langid.viterbi(scores, sizes, 2.0)) == pytest.approx(value(best))


def test_languages_and_spans(spark):
    rng = random.Random(4)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(30))
    latin, other, cyrillic = ["tha", "ing", "er"], ["ung", "sch", "ße"], ["при", "вет", "мир"]
    d = docs(spark, [make(latin) for _ in range(60)], "aa").union(docs(spark, [make(other) for _ in range(60)], "bb", start=100)).union(docs(spark, [make(cyrillic) for _ in range(60)], "cc", start=200))
    mixed = docs(spark, [make(latin) + " " + make(cyrillic), None, "12 -- !", "", "Ω", "ⴰⵣⵓⵍ"], None, start=900)
    out = {r["doc_id"]: r for r in langid.identify(d.union(mixed)).collect()}
    assert all(out[i]["lang_pred"] == {0: "aa", 1: "bb", 2: "cc"}[i // 100] for i in out if i < 900)
    assert out[900]["spans"] in ("aa:0:30,cc:30:60",)
    assert [out[i]["lang_pred"] for i in (901, 902, 903)] == ["und"] * 3 and out[904]["lang_pred"] != "und" != out[905]["lang_pred"]
    assert langid.identify(d.limit(0)).count() == 0


def test_many_languages_are_all_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD_LANGUAGES", 4)
    monkeypatch.setattr(langid, "SCORED_AT_ONCE", 1000)
    rng = random.Random(8)
    parts = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(3)] for _ in range(40)]
    make = lambda k: " ".join(rng.choice(parts[k]) + rng.choice(parts[k]) for _ in range(25))
    d = spark.createDataFrame([(i, make(i % 40), f"l{i % 40}", None) for i in range(400)], "doc_id long, text string, lang string, source string")
    model = langid.train(d)
    assert len(model.langs) == 40
    (t,) = textbytes.chunks(pa.array(["Tha ing", "", "é 12"]))
    w = textbytes.words(t, hashed=False)
    scores, _ = langid.word_scores(model, t, w)
    for j, word in enumerate((b" tha ", b" ing ", " é ".encode(), b" 12 ")):
        want = np.zeros(40)
        for k, n in enumerate(langid.ORDERS):
            for i in range(len(word) - n + 1):
                value = int.from_bytes(word[i : i + n], "big")
                want += model.tables[k][(value * 0x9E3779B97F4A7C15 % 2**64) >> (64 - 15)]
        script = {0: 1, 1: 1, 2: 1}.get(j)
        if script is None:
            want[:] = 0
        elif model.allowed[script].any():
            want -= np.where(model.allowed[script], 0, langid.OUTSIDE)
        assert scores[j] == pytest.approx(want, rel=1e-4)
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] % 40}" for r in langid.identify(d).collect()]) > 0.97


def test_ppm_is_the_same_whatever_is_broadcast(spark):
    rng = random.Random(9)
    d = docs(spark, [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["", None, "Zz é"])
    whole, few = ({r["doc_id"]: r["score"] for r in ppm.score(d, max_nodes=n).collect()} for n in (ppm.MAX_NODES, 20))
    assert few == pytest.approx(whole, rel=1e-5)


def test_ppm_equals_brute_force(spark):
    import collections
    import math

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["", None, "Zz é\t\n q"]
    out = {r["doc_id"]: r for r in ppm.score(docs(spark, texts), top_tokens=3).collect()}
    stream = lambda x: b"\n" * 5 + b"".join(b" " + w.lower().encode() for w in re.findall(r"[^\x20\x09-\x0D]+", x or "")) + b"\n"
    train = [x for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    counts = [collections.Counter() for _ in range(7)]
    for x in train:
        s = stream(x)
        counts[6].update(s[i - 5 : i + 1] for i in range(5, len(s)))
    for m in range(5, 0, -1):
        counts[m].update(k[1:] for k in counts[m + 1])
    after = [collections.defaultdict(dict) for _ in range(6)]
    for m in range(1, 7):
        for k, c in counts[m].items():
            after[m - 1][k[:-1]][k[-1]] = c

    def log_p(s, i):
        out, seen = 0.0, set()
        for k in range(5, -1, -1):
            left = {b: c for b, c in after[k].get(s[i - k : i], {}).items() if b not in seen}
            if left:
                if s[i] in left:
                    return out + math.log10((left[s[i]] - 0.5) / sum(left.values()))
                out += math.log10(0.5 * len(left) / sum(left.values()))
                seen |= set(left)
        return out - math.log10(256 - len(seen))

    for i, x in enumerate(texts):
        s = stream(x)
        assert out[i]["score"] == pytest.approx(sum(log_p(s, k) for k in range(5, len(s))), rel=1e-5)
    tokens = collections.Counter(w for x in train for w in [*re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower()), "END"])
    total, below = sum(tokens.values()), sum(tokens.values()) + 0.1 * (len(tokens) + 1)
    for i, x in enumerate(texts):
        own = [*re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower()), "END"]
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 0.1) / below) for w in own))
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(own), sum(tokens[w] > 0 for w in own), total)
