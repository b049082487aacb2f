"""Known keys of a stream, and packages kept across runs and releases."""

import os
import re

import pytest
from pyspark.sql import functions as F

from termweave.jobs import align, queries_align, reuse
from termweave.operators import retrieve, units
from termweave.operators.retrieve import Terminology
from termweave.profile import Profile
from termweave.sources import batch, keyed
from termweave.streaming import align as streaming

P = Profile()
D = "/root/testdata/sf0.001"


def test_cover_is_whole_and_short():
    for n in range(300):
        parts = keyed.cover(n)
        assert [k for first, length in parts for k in range(first, first + length)] == list(range(n))
        assert len(parts) <= (keyed.SPAN - 1) * 5 and all(first % length == 0 for first, length in parts)


@pytest.mark.parametrize("bucket_keys", [50_000, 2])
def test_look_up_equals_a_dict_through_merges_and_retries(spark, tmp_path, monkeypatch, bucket_keys):
    """19 batches, so segments of 4 and 16; empty batches, null and repeated keys, rows of a try that failed."""
    monkeypatch.setattr(keyed, "BUCKET_KEYS", bucket_keys)
    schema = spark.createDataFrame([], "k string, n int").schema
    table, told = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", schema), {}
    for n in range(19):
        own = [] if n % 5 == 3 else [(f"k{(n * 7 + j) % 23}", n) for j in range(3)] + [(None, n)]
        asked = spark.createDataFrame([(f"k{n}",), ("absent",), (None,), (f"k{n}",)], "k string")
        if n % 4 == 0:  # a try that got as far as to write
            table.begin(n)
            table.write(spark.createDataFrame([("bad", n)], schema), n, 1)
        got = sorted((r["k"], r["n"]) for r in table.look_up(asked, n).collect())
        assert got == sorted(told.get(f"k{n}", []))
        table.write(spark.createDataFrame(own, schema), n, len(own))
        for k, v in own:
            told.setdefault(k, []).append((k, v))
    rows = table.all(19).collect()
    assert sorted((r["k"] or "", r["n"]) for r in rows) == sorted((k or "", v) for x in told.values() for k, v in x)
    assert sorted(os.listdir(tmp_path / "t" / "length=16")) == ["first=0"] and "first=0" not in os.listdir(tmp_path / "t" / "length=4")


def test_only_buckets_of_asked_keys_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_KEYS", 100)
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", spark.createDataFrame([], "k string, n int").schema)
    rows = spark.range(5_000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("n"))
    table.write(rows, 0, 5_000)
    found = table.look_up(rows.where("n in (7, 4000)").select("k"), 1)
    assert sorted(r["n"] for r in found.collect()) == [7, 4000]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan)


def test_scratch_tables_go(spark):
    with align.scratch(spark) as put:
        df = put(spark.range(3), "x")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_batch_tried_again_changes_nothing(spark, tmp_path):
    """A batch that fails after its known keys were written is looked up and written anew."""
    t = queries_align.terminology(spark, D)
    asked = queries_align.values(spark, D).limit(40)
    hits = lambda new: retrieve.exact_hits(new, t.names)
    known = streaming.known_hits(spark, str(tmp_path / "known"), t)
    got = []
    for number in (0, 0, 1, 1):
        with align.scratch(spark) as put:
            got.append(sorted((r["unit_key"], r["concept_id"]) for r in streaming.reuse_hits(asked, known, number, hits, put).collect()))
    assert got[0] and all(x == got[0] for x in got)
    assert known.all(2).where("batch = 1").isEmpty()


def _crosswalk(rows):
    flat = batch.to_crosswalk(rows)
    return sorted(tuple(r) for r in flat.drop("run_id", "release").collect())


@pytest.fixture(scope="module")
def releases(spark):
    """A concept each renamed, expired, gone, new, and one whose edge is gone, and an ingredient that expires; names that nothing touches."""
    c = [("IN1", "metoprolol", "IN", "active"), ("PIN1", "metoprolol succinate", "PIN", "active"), ("SBD1", "metoprolol succinate 50 MG [Toprol]", "SBD", "active"), ("IN2", "lisinopril", "IN", "active"), ("SCD2", "lisinopril 10 MG", "SCD", "active"), ("IN3", "warfarin", "IN", "active"),
         ("SCD3", "warfarin 5 MG", "SCD", "active"), ("IN4", "ibuprofen", "IN", "active"), ("SCD4", "ibuprofen 200 MG", "SCD", "active"), ("IN5", "amoxicillin", "IN", "active"), ("SCD5", "amoxicillin 250 MG", "SCD", "active"), ("OLD1", "oldiumqx", "SCD", "obsolete")]
    e = [("SBD1", "has_ingredient", "IN1"), ("SBD1", "has_precise_ingredient", "PIN1"), ("PIN1", "has_ingredient", "IN1"), ("SCD2", "has_ingredient", "IN2"), ("SCD3", "has_ingredient", "IN3"), ("SCD5", "has_ingredient", "IN5"), ("SCD4", "has_ingredient", "IN4")]

    def made(concepts, edges):
        label = {x[0]: x for x in concepts}
        cs = spark.createDataFrame([("RxNorm", "r", *x, [], []) for x in concepts], "vocabulary string, release string, concept_id string, preferred_label string, concept_class string, status string, synonyms array<string>, remapped_to array<string>")
        names = cs.select("vocabulary", "release", "concept_id", F.col("preferred_label").alias("name"), (F.col("status") == "active").alias("is_current"))
        es = spark.createDataFrame([("RxNorm", "r", a, p, b, label[b][1], label[b][2], k) for k, (a, p, b) in enumerate(edges)], "vocabulary string, release string, subject_id string, predicate string, object_id string, object_label string, object_class string, edge_order int")
        return Terminology(cs, names, es)

    new = [("IN2", "lisinopril", "IN", "obsolete") if x[0] == "IN2" else ("SCD3", "coumadin 5 MG", "SCD", "active") if x[0] == "SCD3" else x for x in c if x[0] != "OLD1"] + [("SCD6", "zzqq nonesuch", "SCD", "active")]
    return made(c, e), made(new, [x for x in e if x[0] != "SCD4"])


VALUES = ["metoprolol", "Metoprolol  Succinate", "metoprolol succinate 50 mg [toprol]", "metoprolo", "lisinopril 10 mg", "lisinopril", "warfarin 5 mg", "coumadin 5 mg", "ibuprofen 200 mg", "ibuprofin 200 mg", "amoxicillin 250 mg", "amoxicilin", "oldiumqx", "zzqq none", "zzqq nonesuch", " "]


def test_next_release_redoes_what_changes_reach_and_nothing_else(spark, releases, tmp_path):
    old, new = releases
    df = spark.createDataFrame([(str(k), v) for k, v in enumerate(VALUES + VALUES[:3])], "id string, drug string")
    rows = units.build_units(df, "drug", ["id"], [], P)
    kept, origins = reuse.PackageStore(str(tmp_path / "kept")), {}
    out = {}
    with align.scratch(spark) as put:

        def run(run_id, release, t, previous=None):
            told = reuse.reuse_packages(kept, release, run_id, t, P, put, previous)

            def packages(keys):
                found = put(told(keys), "told")
                origins[run_id] = {r["unit_key"]: r["origin"] for r in found.select("unit_key", "origin").collect()}
                return found

            out[run_id] = _crosswalk(align.align(rows, t, P, packages=packages, put=put))

        run("a", "1", old)
        keys = spark.createDataFrame([("lisinopril", "lisinopril"), ("zzqq none", "zzqq none")], "unit_key string, raw_value string")
        again = reuse.reuse_packages(kept, "1", "b", old, P, put)(keys)
        assert {(r["unit_key"], r["origin"]) for r in again.collect()} == {("lisinopril", "stored"), ("zzqq none", "stored")}
        run("c", "2", new, ("1", old))
        fresh = _crosswalk(align.align(rows, new, P, put=put))
    assert out["c"] == fresh != out["a"]
    assert set(origins["a"].values()) == {"built"}
    carried = {k for k, v in origins["c"].items() if v == "carried"}
    assert {"metoprolol", "metoprolol succinate", "metoprolo", "amoxicillin 250 mg", "amoxicilin"} <= carried
    assert not carried & {"lisinopril 10 mg", "lisinopril", "warfarin 5 mg", "coumadin 5 mg", "ibuprofen 200 mg", "ibuprofin 200 mg", "oldiumqx", "zzqq nonesuch"}


def test_changed_concepts_and_reach(releases, spark):
    old, new = releases
    found = {}
    for r in reuse.changed_concepts(old, new).collect():
        found.setdefault(r["concept_id"], set()).add(r["what"])
    assert found == {"IN2": {"concept", "name"}, "SCD3": {"concept", "name"}, "OLD1": {"concept", "name"}, "SCD6": {"concept", "name"}, "SCD4": {"edge"}}
    changed = spark.createDataFrame([("IN1",)], "concept_id string")
    assert sorted(r[0] for r in reuse.reaching(changed, old.edges, P).collect()) == ["IN1", "PIN1", "SBD1"]
    assert reuse.changed_concepts(old, old).isEmpty()


def test_names_take_their_normal_forms_once_for_all_batches(spark, monkeypatch):
    from termweave.jobs import queries_align, queries_results
    from termweave.operators import retrieve

    made, forms = [], retrieve.forms
    monkeypatch.setattr(retrieve, "forms", lambda names: made.append(1) or forms(names))
    d = "/root/testdata/sf0.001"
    assert queries_results.QUERIES["stream_lookups"](spark, d).count() and len(made) == 1
    t = queries_align.terminology(spark, d)
    asked = queries_align.values(spark, d)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(retrieve.exact_hits(asked, forms(t.names))) == rows(retrieve.exact_hits(asked, t.names))


def test_keys_are_told_apart_before_their_normal_forms_are_made(spark):
    from termweave.jobs import queries_align

    d = "/root/testdata/sf0.001"
    got = queries_align.alignment_keys(spark, d)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "l_orderkey" not in plan and "reported" not in plan
    want = {}
    for r in queries_align.values(spark, d).collect():
        key = " ".join(r["value"].split()).lower()
        want[key] = min(r["value"], want.get(key, r["value"]))
    assert {r["unit_key"]: r["raw_value"] for r in got.collect()} == want
