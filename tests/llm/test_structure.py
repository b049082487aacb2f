"""Conversation repair, Merkle manifests and license scans against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from termweave.llm import licenses, merkle, repair

SPACES = " \t\n\x0b\f\r"
PATTERN = re.compile("(s?(ua)+)?")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cheapest(rows):
    """rows: (role, text, must, unfinished). All complete edits by dynamic programming over whole strings: cost, audit, repaired."""
    states = {"": (0, "", ())}  # the last two roles that matter: "", s, u, a

    def inserted(now):
        for a, role, b in (("", "user", "u"), ("s", "user", "u"), ("a", "user", "u"), ("u", "assistant", "a")):
            if a in now:
                c, x, out = now[a]
                new = (c + 5, x + "I", (*out, f"{role}:"))
                now[b] = min(now.get(b, new), new)
        return now

    states = inserted(states)
    for role, text, must, unfinished in rows:
        found = {}
        for a, (c, x, out) in states.items():
            offers = [(a, (c + 2, x + "D", out))]
            if not must:
                extra = 5 if unfinished else 0
                after = {"": "su", "s": "u", "u": "a", "a": "u"}[a]
                if role[:1] and role[:1] in after:
                    offers.append((role[:1], (c + extra, x + "K", (*out, f"{role}:{text}"))))
                for other in ("user", "assistant"):
                    if other[0] in after:
                        offers.append((other[0], (c + 1 + extra, x + "R", (*out, f"{other}:{text}"))))
            for b, new in offers:
                found[b] = min(found.get(b, new), new)
        states = inserted(found)
    return min(states[a] for a in ("", "a") if a in states)


def test_cheapest_is_that_of_all_edits():
    """The dynamic programme itself against every sequence of edits."""
    rng = random.Random(5)
    for _ in range(25):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"t{i}.", rng.random() < 0.2, rng.random() < 0.2) for i in range(rng.randint(0, 3))]
        best = None
        per_row = [["D"] if must else ["D", "K", "user", "assistant"] for _, _, must, _ in rows]
        gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
        for edits in itertools.product(*per_row):
            for adds in itertools.product(gaps, repeat=len(rows) + 1):
                cost, audit, roles, out = 0, "", "", []
                for i in range(len(rows) + 1):
                    for g in adds[i]:
                        cost, audit, roles = cost + 5, audit + "I", roles + g[0]
                        out.append(f"{g}:")
                    if i < len(rows):
                        role, text, _, unfinished = rows[i]
                        e = edits[i]
                        cost += {"D": 2, "K": 0}.get(e, 1) + (5 if unfinished and e != "D" else 0)
                        audit += e if e in "DK" else "R"
                        if e != "D":
                            told = role if e == "K" else e
                            roles += told[:1]
                            out.append(f"{told}:{text}")
                if PATTERN.fullmatch(roles):
                    best = min(best or (99, "", ()), (cost, audit, tuple(out)))
        assert best == cheapest(rows)


@pytest.mark.parametrize("held", [0, 40, 1 << 20])
def test_repairer_against_whole_strings(held):
    rng = random.Random(held)
    for n in [*range(60), 300, 900]:
        kinds = rng.choice([["user", "assistant"], ["system", "user", "assistant", "tool", ""], ["tool"], ["user"], ["assistant", "system"]])
        p = rng.choice([0.05, 0.5, 0.95])
        rows = [(rng.choice(kinds), f"text {i}", rng.random() < p / 2, rng.random() < p / 2) for i in range(n)]
        rows = [(a, b, m, u and not m) for a, b, m, u in rows]
        r = repair.Repairer(None, held)
        for row in rows:
            r.row(*row)
        cost, final = r.end()
        want = cheapest(rows)
        assert (cost, "".join(final.letters), final.sha.hexdigest()) == (want[0], want[1], sha("\n".join(want[2])))


def test_final_edits_leave_memory():
    r = repair.Repairer(None)
    for i in range(5_000):
        r.row("user" if i % 2 == 0 else "assistant", "x" * 100, False, False)
        assert r.held <= 400
    out = repair.Repairer(None, 1_000)
    for _ in range(5_000):  # two ways that stay tied: the first row goes, or the last
        out.row("tool", "x" * 100, False, False)
        assert out.held <= 1_000
    assert out.end()[0] == 5_000


def brute_audits(rows):
    """rows (conv, turn, role, text): what `damaged_audits` returns, by conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, ready, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            last = text.rstrip(SPACES)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            ready.append((role, text, fault in (0, 1), fault == 2))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, kept = cheapest(ready)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, sha("\n".join(kept)))
    return out


def test_damaged_audits_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rng.randint(0, 14)):
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice([None, "", "system", "user", "user", "assistant", "tool"]), rng.choice([None, "", " \t", "a.", "a.", "b", "c! ", "é?", "x\ny"])))
    rows += rows[:30] + [(77, t, "user" if t % 2 else "assistant", f"long {t}." * 200) for t in range(900)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"kind": F.lit(1), "digest": F.lit("x"), "copy": F.lit(2)})
    got = {r[0]: tuple(r)[1:] for r in repair.damaged_audits(d.repartition(5)).collect()}
    assert got == brute_audits(rows)
    assert repair.damaged_audits(d.limit(0)).count() == 0
    kept = {}
    for r in sorted(repair.repaired(repair.damage(d)).collect(), key=lambda r: r["place"]):
        kept.setdefault(r["conv_id"], []).append(r)
    for conv, (*_, audit, digest) in got.items():
        mine = kept.get(conv, [])
        assert "".join(r["edit"] for r in mine) == audit and sha("\n".join(f"{r['role']}:{r['text']}" for r in mine if r["edit"] != "D")) == digest


def brute_tree(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


@pytest.mark.parametrize("height", [1, 3, 12])
def test_manifest_against_brute_force(spark, height):
    rng = random.Random(height)
    rows = [(rng.choice([None, i, i]), rng.choice(["x" * rng.randint(0, 50), None, "é☃"]), rng.choice(["en", "en", "en", None, "dé", "ZZ", "one" if i == 5 else "en"]), rng.choice(["s", None]), rng.choice([None, i, 2**63 - 1])) for i in range(83)]
    rows += rows[:4]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"own": F.lit(1), "place": F.lit(2), "_range": F.lit(3)})
    digest = lambda r: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], r[1])))
    langs = {}
    for r in rows:
        told = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 or r[4] is None or r[4] == 2**63 - 1 else (*r[:4], r[4] + 1)
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, digest(r), digest(told), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: brute_tree([x[2] for x in sorted(v)]) for k, v in langs.items()}
    top = brute_tree([trees[k][-1][0] for k in order])
    want = []
    for k, v in langs.items():
        for i, x in enumerate(sorted(v)):
            others, h = [], x[3]
            for tree, at in ((trees[k], i), (top, order.index(k))):
                for level in tree[:-1]:
                    if at ^ 1 < len(level):
                        others.append(level[at ^ 1])
                        h = sha(others[-1] + h if at & 1 else h + others[-1])
                    else:
                        h = sha(h)
                    at >>= 1
            want.append((x[4][0], x[2], trees[k][-1][0], top[-1][0], sha("".join(others)), h, h == top[-1][0]))
    got = [tuple(r)[:7] for r in merkle.manifest(d.repartition(3), height).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert merkle.manifest(d.limit(0)).count() == 0
    assert merkle.manifest(d.limit(1)).head()["leaf"] == merkle.manifest(d.limit(1)).head()["root"]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_scan_against_all_windows(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["the", "of", "software", "license", "mit", "Über", "a1", "any", "general", "public", "apache"]) for _ in range(n))
    texts, planted = ["", None, "MIT License", "mit-LICENSE, mit license", "General\tPublic  License" * 3, prose(4000)], {}
    for i, (label, text) in enumerate(licenses.TEXTS):
        words = text.split()
        for j in range(3):  # each tenth word changed, left out or with another before it
            own = list(words)
            for k in range(rng.randrange(10), len(words), 10) if len(words) > 20 and j else []:
                own[k] = rng.choice(["", "zzz", f"zzz {own[k]}"])
            planted[len(texts)] = (label, i)
            texts.append(f"{prose(rng.randint(0, 60))} . {' '.join(own)} . {prose(rng.randint(0, 60))}")
    texts += [texts[10], " ".join([licenses.TEXTS[0][1]] * 2000)]
    d = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"spans": F.lit(1), "digest": F.lit(2)})
    got = licenses.scan(d.repartition(3)).collect()
    rows = {r["doc_id"]: r for r in got}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        w, at, labels = split(text), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at, labels = at + found, labels | ({label} if found else set())
        r = rows[None if i == 3 else i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        for s in r["spans"]:  # every span is one of its template
            assert max(licenses.verified([x.encode() for x in w[s["first"] : s["last"] + 1]], t)[0] for t, (name, _) in zip(licenses.templates(), licenses.TEXTS, strict=True) if name == s["label"]) >= licenses.SIMILARITY
    for i, (label, _) in planted.items():
        assert label in rows[i]["labels"].split(","), (i, label, rows[i])
    assert rows[5]["labels"] == rows[5]["base_labels"] and len(rows[len(texts) - 1]["spans"]) == 2000
    assert licenses.scan(d.limit(0)).count() == 0
