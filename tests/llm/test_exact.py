import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termweave.llm import components, fingerprint_iblt, minhash, mixing, packing, pii, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, texts, source="s", ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], x, None, source, None if x is None else len(x)) for i, x in enumerate(texts)], DOC)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_fingerprints_against_sets(spark):
    rng = random.Random(1)
    texts = ["\n".join(prose(rng, rng.randint(1, 40)) + "." for _ in range(rng.randint(1, 25))) for _ in range(20)] + [None, "", "same. text", "same. text", "é" * 301]
    out = {r["doc_id"]: r for r in fingerprint_iblt.versions(docs(spark, texts)).collect()}
    piece = re.compile(r"[^\n]{0,80}[^\n.!?]*[.!?]*")
    cut = lambda x: {p.strip(" ") for p in piece.findall(x)} - {""}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, x in enumerate(texts):
        x, following = x or "", texts[(i + 1) % len(texts)] or ""
        edited = x[: len(x) - len(x) // 2] + following[: len(x) // 2]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[i]["n_chars"] == len(x)
        assert (len(out[i]["edited_lost"]), len(out[i]["edited_new"])) == (len(cut(x) - cut(edited)), len(cut(edited) - cut(x)))
        assert out[i]["near_edited"] == pytest.approx(near(cut(x), cut(edited))) and out[i]["near_next"] == pytest.approx(near(cut(x), cut(following)))
    assert out[22]["fingerprint"] == out[23]["fingerprint"] != out[24]["fingerprint"]
    assert fingerprint_iblt.versions(docs(spark, [])).count() == 0
    assert fingerprint_iblt.versions(docs(spark, ["a", "b"], ids=[None, None])).count() == 2


def test_next_rows_with_any_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint_iblt, "RANGE_ROWS", 8)
    rng = random.Random(2)
    for kind, ids in (("string", [f"id'{rng.random()}\\" for _ in range(100)]), ("double", [1e300, -5.0, *(rng.random() for _ in range(98))]), ("long", [None] * 60 + [3] * 40)):
        d = spark.createDataFrame([(x, f"text {i}.\n{prose(rng, 3)}") for i, x in enumerate(ids)], f"doc_id {kind}, text string").repartition(5)
        rows = d.select("doc_id", F.xxhash64("text").alias("h"), "text")
        got = {r["text"]: r["next_text"] for r in fingerprint_iblt.with_next(rows, ["text"]).collect()}
        order = [r["text"] for r in rows.orderBy("doc_id", "h").collect()]
        assert got == dict(zip(order, [*order[1:], order[0]], strict=True))
        assert fingerprint_iblt.with_next(rows, ["text"]).select("span").distinct().count() > 4


def test_rows_without_ids_are_drawn_by_their_text_and_dealt_apart(spark):
    d = docs(spark, [f"text {i:04}" for i in range(2000)], ids=[None] * 2000).repartition(4)
    out = mixing.replicate(d, ratio=1.5)
    counts = {r["text"]: r["count"] for r in out.groupBy("text").count().collect()}
    for t, n in counts.items():
        u = (int(hashlib.md5(f"{mixing.SEED}/{hashlib.md5(t.encode()).hexdigest()}/0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = [math.exp(-1.5) * 1.5**k / math.factorial(k) for k in range(12)]
        assert n == sum(sum(p[: k + 1]) < u for k in range(12))
    assert 2700 < sum(counts.values()) < 3300
    same = mixing.replicate(docs(spark, ["one"] * 4000, ids=[7] * 4000).repartition(8), ratio=3.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert same.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert same.columns == [*d.columns, "copies", "copy", "shuffle_key"]


def test_mixture_counts_follow_rates(spark):
    d = docs(spark, ["x" * 10] * 3000, "big").union(docs(spark, ["y" * 10] * 200, "small", ids=range(5000, 5200))).union(docs(spark, ["z", None], None, ids=[9000, None]))
    d = d.withColumns({c: F.lit("taken") for c in ("copies", "_parts", "cdf", "_source", "of", "own_of")})
    out = mixing.replicate(d, {"big": 0.5, "small": 0.5})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    total = 3200 * 10 + 1
    assert abs(n["big"] - total / 20) < 200 and abs(n["small"] - total / 20) < 200 and None not in n
    assert sorted(map(tuple, out.select("doc_id", "copy").collect())) == sorted(map(tuple, mixing.replicate(d.repartition(7), {"big": 0.5, "small": 0.5}).select("doc_id", "copy").collect()))
    assert mixing.replicate(d.limit(0)).count() == 0


def test_large_rates_are_sums_of_parts(spark):
    d = docs(spark, ["aaaa"] * 30, "rare").union(docs(spark, ["b" * 4000] * 30, "common", ids=range(100, 130)))
    out = mixing.replicate(d, {"rare": 0.5, "common": 0.5})
    rate = (30 * 4004) / 2 / 120
    assert abs(out.where("source = 'rare'").count() - 30 * rate) < 6 * (30 * rate) ** 0.5


@pytest.mark.parametrize("seed", range(3))
def test_minhash_classes_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = [prose(rng, 120).split() for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(rng.randint(1, 25)):
            w = list(words)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w))
    texts += ["", None, "a b", "A  b", "a b c", texts[0]]
    found = minhash.classes(docs(spark, texts)).collect()
    got = {r["doc_id"]: r["class_id"] for r in found}
    sets = []
    for x in texts:
        w = (x or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(label)
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    assert [got[i] for i in range(len(texts))] == label
    rows = {r["doc_id"]: r for r in found}
    for i, a in enumerate(sets):
        best = max((len(a & b) / len(a | b) for j, b in enumerate(sets) if j != i and a and b), default=0)
        assert (rows[i]["likeness"] or 0) <= best + 1e-9 and (best < 0.8 or (rows[i]["likeness"] or 0) >= 0.8) and (rows[i]["links"] > 0) == any(a != b and a and b and len(a & b) >= 0.8 * len(a | b) for b in sets)


def test_minhash_finds_likeness_of_sets_where_lines_repeat(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        body, footer = prose(rng, 100), " ".join(["\n" + prose(rng, 16)] * 20)
        texts += [body, body + footer]
    d = docs(spark, texts)
    sets = [{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in texts]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    bands = {r["doc_id"]: set(r["bands"]) for r in minhash.sketches(d).collect()}
    assert all(len(bands[i]) == 20 for i in range(0, 80, 2)) and all(bands[i] & bands[i + 1] for i in range(0, 80, 2))
    assert all(r["class_id"] == r["doc_id"] // 2 * 2 for r in minhash.classes(d).collect())


def test_deduplicate_keeps_one_and_all_columns(spark):
    d = docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "other words", "", ""], ids=[5, 3, 3, 1, 7, None]).withColumns({c: F.lit(1) for c in ("n", "_id", "own_h", "twice", "_Twice", "of")})
    kept = minhash.deduplicate(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 7), (True, 0)]
    assert minhash.deduplicate(d.limit(0)).count() == 0


def test_probminhash_estimates_weighted_similarity():
    doc = np.repeat([0, 1], 300)
    h = np.concatenate([np.arange(300), np.arange(100, 400)]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = minhash.signatures(doc, h, np.ones(600), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.05
    assert (minhash.signatures(np.zeros(1, int), h[:1], np.ones(1), 1, 64) == h[0]).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90


def test_tokens_pieces_and_gapless_sequences(spark):
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (5, 700, 3000, 20, 20)] + ["", None, "a  b \n c", "it's. x! <|endoftext|> y", " lead", "ünï çödé.\n\nx  y"]
    out = packing.pack(docs(spark, texts), BPE, capacity=256).collect()
    t = Tokenizer.from_file(BPE)
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] == i)
        assert sum(p[2] for p in own) == len(ids) and [p[1] for p in own] == [sum(q[2] for q in own[:k]) for k in range(len(own))]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in own) and all(p[2] == 256 for p in own[1:])
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert all(a == sum(n for _, n in p[:k]) for k, (a, _) in enumerate(p)) and sum(n for _, n in p) <= 256
    assert packing.pack(docs(spark, []), BPE).count() == 0


def test_tokens_of_all_plain_characters_and_odd_spaces():
    encoder, t = packing.Encoder(BPE), Tokenizer.from_file(BPE)
    rng = random.Random(1)
    texts = [f"a{c}b 1{c}2 {c} '{c}s{c}{c}\n{c}" for c in map(chr, [*range(9, 14), *range(0x1C, 0x500)])]
    texts += ["".join(rng.choice(" \n\t.,'’s é中1²ab-\x1c\x85\r") for _ in range(rng.randrange(12))) for _ in range(5000)]
    ids, n = encoder.encode([*texts, "a <|endoftext|> b", ""])
    cut = np.split(ids, np.cumsum(n)[:-1])
    assert all(got.tolist() == [*t.encode(x, add_special_tokens=False).ids, 0] for x, got in zip([*texts, "a <|endoftext|> b", ""], cut, strict=True))


def test_tokens_of_any_character_equal_the_tokeniser():
    encoder, t = packing.Encoder(BPE), Tokenizer.from_file(BPE)
    rng = random.Random(2)
    anything = [chr(c) for c in range(0x32000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b1{c}2 {c}" for c in anything[k : k + 8]) for k in range(0, len(anything), 8)]
    pools = [anything, "日本語のテキスト、。 abc12", "“curly” — it’s… 1½Ⅷ", "नमस्ते दुनिया १२३ ", "👍🏽👩‍👩‍👧 ok ", "مرحبا بالعالم ٣٤ "]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(40))) for _ in range(4000)]
    ids, n = encoder.encode(texts)
    cut = np.split(ids, np.cumsum(n)[:-1])
    assert all(got.tolist() == [*t.encode(x, add_special_tokens=False).ids, 0] for x, got in zip(texts, cut, strict=True))
    assert not any(map(packing._agreed, "\x1c\x1f\u0378\U00010107")) and all(map(packing._agreed, "a1½一’—👍\u3000é"))


def test_plan_equals_best_fit_decreasing_one_by_one():
    rng = random.Random(4)
    for _ in range(30):
        counts = {rng.randint(1, 50): rng.randint(1, 30) for _ in range(12)}
        bins = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [b for b in bins if b[0] >= length]
                if fits:
                    min(fits)[0] -= length
                else:
                    bins.append([50 - length])
        runs = packing.plan(counts, 50)
        used = {int(r[3]) + k // int(r[4]) for r in runs for k in range(int(r[2]))}
        assert len(used) == len(bins) and sum(int(r[2]) for r in runs) == sum(counts.values())


def luhn(s):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(s)))) % 10 == 0


def test_personal_data_against_python(spark):
    texts = ["a@b.c_d@e.fg x 1.2.3.4.5.6 +1 (234) 555-0000. 4111 1111 1111 1111 é 4111-1111-1111-1111 300.1.1.1 0255.01.1.1 5 6 +12", None, "", "a@b.c@d.e ..@x.y +1" + "(" * 50 + "2345678901 9", "x" * 3000 + "@", "1" * 3000]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda v, g: True, "ip": lambda v, g: all(int(p) <= 255 for p in v.split(".")), "card": lambda v, g: 14 <= len(g) <= 19 and luhn(g), "phone": lambda v, g: 10 <= len(g) <= 15}
    out = {r["doc_id"]: r for r in pii.find(docs(spark, texts)).collect()}
    for i, x in enumerate(texts):
        spans = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, x or "") if ok[kind](m[0], re.sub("[^0-9]", "", m[0]))]
        listed = ",".join(s for *_, s in sorted(spans))
        assert out[i]["spans"] == listed and out[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, texts)).collect()}
    assert clean[0].startswith("<EMAIL><EMAIL> x <IP>.5.6") and clean[1] is None and clean[2] == ""


def test_terms_by_mutual_information_against_brute_force(spark):
    rng = random.Random(6)
    people = ["boss@x.yz", "who@x.yz", "10.1.2.3", "+1 (234) 555-0000"]
    texts = []
    for i in range(150):
        words = [rng.choice("abcdefghijklmnopqrst") * rng.randint(2, 6) for _ in range(rng.randint(3, 30))]
        if i % 5 < 3:
            person = rng.randrange(4)
            words.insert(rng.randrange(len(words)), people[person])
            if rng.random() < 0.8:
                words.insert(rng.randrange(len(words)), ["Zorro", "quaxo", "48213x", "né"][person])
        texts.append(" ".join(words))
    texts += texts[:6] + [None, "boss@x.yz", "x" * 300]
    word = re.compile(r"[^\W_][\w'’-]+")
    entities = [{p for p in people if p in (x or "").split(" ") or p in (x or "")} for x in texts]
    outside = [[w.lower() for w in word.findall(re.sub("|".join(map(re.escape, people)), "\n", x or ""))] for x in texts]
    anywhere = [{w.lower() for w in word.findall(x or "")} for x in texts]
    n = len(texts)
    told = set()
    for e in people:
        docs_e = [i for i in range(n) if e in entities[i]]
        whole = np.log2(n / len(docs_e))
        for t in {w for i in docs_e for w in outside[i]}:
            both, with_t = sum(t in outside[i] for i in docs_e), sum(t in w for w in anywhere)
            if both >= 3 and np.log2(both * n / (len(docs_e) * with_t)) >= 0.9 * whole:
                told.add((e, t))
    assert len(told) >= 4
    out = {r["doc_id"]: r["spans"] for r in pii.find(docs(spark, texts), min_support=3).collect()}
    for i, x in enumerate(texts):
        want = [f"term:{m.start()}:{m.end()}" for m in word.finditer(x or "") if any((e, m[0].lower()) in told for e in entities[i])]
        assert [s for s in out[i].split(",") if s.startswith("term")] == want
    assert sum("term" in s for s in out.values()) > 20


def test_disclosure_needs_two_documents_and_copies_are_documents(spark):
    rng = random.Random(7)
    alone, copied = f"a quaxo with one@x.yz {prose(rng, 60)}", f"so zorro {'far ' * 40} knows two@x.yz"
    d = docs(spark, [alone, copied, copied, *[f"so far with a text that knows {prose(rng, 20)}" for _ in range(60)]])
    out = [r["spans"] for r in pii.find(d).orderBy("doc_id").collect()]
    assert "term" not in out[0] and out[1] == out[2] == "term:3:8,email:176:184"
    assert all("term" not in r["spans"] for r in pii.find(d, min_support=3).collect())
    clean = {r["doc_id"]: r["text"] for r in pii.redact(d.withColumnsRenamed({"source": "base", "lang": "key"})).collect()}
    assert clean[1].startswith("so <TERM> far") and clean[1].endswith("<EMAIL>")


def test_personal_data_in_very_long_texts(spark):
    numbers = " ".join(str(10 + i % 90) + "x" * (i % 2) for i in range(1_000_000))
    many = " ".join(f"1.2.3.{i % 256}" for i in range(30_000))
    out = {r["doc_id"]: r for r in pii.find(docs(spark, [numbers, many])).collect()}
    assert out[0]["spans"] == "" and out[1]["n_ip"] == 30_000
    assert out[1]["spans"] == ",".join(f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9.]+", many))
    assert pii.redact(docs(spark, [many])).head()["text"] == " ".join(["<IP>"] * 30_000)


def test_archives_round_trip(spark):
    inner = "a WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n end"
    rows = [(1, "u", inner), (2, None, None), (3, "v", ""), (4, "x\r\ny", "WARC/1.0\r\n"), (5, "x", "é€ WARC/1.0\r\n"), (6, "x", "WARC/1.0\r\n"), (7, "x", "p" * 5000), (7, "x", "p" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    out = [r for r in warc.round_trip(pages.coalesce(2)).collect()]
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    for i, _, html in rows:
        body = (html or "").encode()
        assert by[i]["payload_bytes"] == len(body) and by[i]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert {i: r["refers_to"] for i, r in by.items() if r["record_type"] == "revisit"} == {3: 2, 6: 4}
    path = warc.common.scratch_path(spark, "w")
    warc.write(pages, path)
    read = {r["page_id"]: r["payload"] for r in warc.read(spark, path).where("type = 'response'").collect()}
    assert read["1"] == inner and read["5"] == "é€ WARC/1.0\r\n" and read["7"] == "p" * 5000
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_records_of_other_types_are_links_of_the_chain(spark):
    path = warc.common.scratch_path(spark, "w")
    record = lambda kind, i, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}"
    rows = [record("warcinfo", 0, "software: x"), record("response", 1, "one"), record("request", 2, "GET WARC/1.0\r\nx"), record("metadata", 3, ""), record("response", 4, "a WARC/1.0\r\nb")]
    spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.option("lineSep", warc.END).text(path)
    assert sorted((r["page_id"], r["payload"]) for r in warc.read(spark, path).collect()) == [("1", "one"), ("4", "a WARC/1.0\r\nb")]


def test_archives_of_both_versions_and_any_bytes(spark, tmp_path):
    def record(version, i, body):
        head = f"WARC/1.{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    inner = b"\xff\xfe WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nx\r\n\r\n \x80"
    bodies = {1: b"\xff\xfe\x00\x80", 2: b"plain", 3: inner, 4: "é WARC/1.2\r\n WARC/1.".encode(), 5: b""}
    (tmp_path / "a.warc").write_bytes(b"".join(record(i % 2, i, x) for i, x in bodies.items()))
    got = {r["page_id"]: r for r in warc.read(spark, f"file://{tmp_path}/a.warc").collect()}
    assert {int(i): bytes(r["content"]) for i, r in got.items()} == bodies
    assert got["2"]["payload"] == "plain" and got["4"]["payload"] == bodies[4].decode() and got["1"]["payload"] is None and got["3"]["payload"] is None
    assert all(r["digest"] == base64.b32encode(hashlib.sha1(bodies[int(i)]).digest()).decode() for i, r in got.items())
    (tmp_path / "b.warc").write_bytes(b"no record here\r\n" + record(0, 9, b"z"))
    with pytest.raises(ValueError, match="b.warc"):
        warc.index(spark, f"file://{tmp_path}/b.warc")


def test_one_id_with_two_payloads_keeps_both(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "own"), (0, "u", "other"), (2, "u", "other")]
    path = warc.common.scratch_path(spark, "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    out = sorted((r["page_id"], r["type"], r["payload"] or "") for r in warc.read(spark, path).select("page_id", "type", "payload").collect())
    assert len(out) == 5 and ("2", "response", "own") in out and [r[:2] for r in out].count(("2", "revisit")) == 2
