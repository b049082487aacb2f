"""Adapters, remap chains and run logs against plain versions."""

import random
import tempfile

import pytest

from termweave.jobs import align
from termweave.operators import audit, retrieve
from termweave.sources import adapters


def test_adapters_read_files_in_parts(spark):
    folder = tempfile.mkdtemp(prefix="spark-adapters-")
    for i in range(3):
        with open(f"{folder}/{i}.txt", "w") as f:
            f.write(f"id={i};value=a;x=1;w=2\nvalue=b\n")
    df = adapters.read_adapted(spark, folder, "structured_record")
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([(str(i), "a", "w=2;x=1") for i in range(3)] + [(None, "b", "")] * 3, key=repr)
    assert [tuple(r) for r in adapters.adapt(spark.createDataFrame([("p|q",), (None,)], "line string"), "structured_batch", "line").collect()] == [("1", "p"), ("2", "q")]


def test_unknown_types_are_refused(spark):
    with pytest.raises(ValueError, match="no adapter reads 'unstructured_text'"):
        adapters.read_adapted(spark, "/nowhere", "unstructured_text")
    with pytest.raises(ValueError, match="no adapter"):
        adapters.adapt(spark.createDataFrame([("x",)], "value string"), "")


def test_remap_chains_and_cycles(spark):
    edges = {"a": ["b"], "b": ["c"], "c": ["d"], "d": ["e"], "e": ["f"], "g": ["h"], "h": ["i"], "i": ["g"], "j": ["g", "k"], "l": ["l"], "m": ["a", "n"], "o": []}
    df = spark.createDataFrame(list(edges.items()), "concept_id string, remapped_to array<string>")
    got = {r["concept_id"]: (r["current"], r["steps"], r["cyclic"]) for r in retrieve.resolve_remaps(df, align.store(spark)).collect()}
    assert got["a"] == (["f"], 5, False) and got["e"] == (["f"], 1, False) and got["m"] == (["f", "n"], 6, False)
    assert all(got[x] == ([], None, True) for x in "ghil") and got["j"] == (["k"], 1, True) and "o" not in got
    assert retrieve.resolve_remaps(df.limit(0), align.store(spark)).count() == 0


def test_run_logs_in_ranges_equal_one_pass(spark):
    rng = random.Random(1)
    rows, state, number = [], {}, 0
    for _ in range(4_000):
        number += 1 if rng.random() < 0.99 else 2
        key = (rng.choice("RS"), rng.choice(["p", "P ", "q"]))
        hits, calls = state.get(key, (0, 0))
        state[key] = (hits + 1, calls + 1) if rng.random() < 0.98 else (0, 0)
        rows.append(("run", number, *key, *state[key], rng.choice(["v1"] * 50 + ["v2", None]), rng.choice(["live"] * 60 + ["replay"])))
    df = spark.createDataFrame(rows, "run_id string, row_number long, resource_name string, provider_name string, cache_hits long, network_calls long, provider_version string, mode string")
    want, seen, last = {}, {}, 0
    for r in rows:
        codes = ["ROW_NUMBER_GAP"] if r[1] != last + 1 else []
        last, key = r[1], (r[2].lower(), r[3].strip().lower())
        if key in seen:
            b = seen[key]
            codes += ["CACHE_HITS_FELL"] * (r[4] < b[4]) + ["NETWORK_CALLS_FELL"] * (r[5] < b[5]) + ["PROVIDER_VERSION_CHANGED"] * (r[6] != b[6]) + ["MODE_CHANGED"] * (r[7] != b[7])
        seen[key] = r
        if codes:
            want[r[1]] = codes
    kept = []

    def put(x, name):
        kept.append(align.store(spark)(x, name))
        return kept[-1]

    got = {r["row_number"]: r["codes"] for r in audit.audit_sequence(df.repartition(3), put).collect()}
    assert got == want
    assert kept[0].groupBy("_range").count().count() > 1


def test_remaps_broadcast_no_table_that_grows(spark):
    edges = {f"R{i}": [f"R{i + 1}"] for i in range(40)} | {"L0": ["L1"], "L1": ["L0", "R3"]}
    df = spark.createDataFrame(list(edges.items()), "concept_id string, remapped_to array<string>")
    plans, store = [], align.store(spark)

    def put(rows, name):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return store(rows, name)

    out = retrieve.resolve_remaps(df, put)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.where("cyclic").count() == 2 and out.where("concept_id = 'L1'").head()["current"] == ["R40"]
    assert len(plans) > 5 and not any("BroadcastHashJoin" in x for x in plans)


def test_rederived_ids_derive_their_parts_once(spark):
    from termweave.operators import audit, units
    from termweave.profile import Profile

    df = spark.createDataFrame([("1", " A  b", "oral"), ("2", "c", None)], "id string, v string, route string")
    own = align.store(spark)(units.build_units(df, "v", ["id"], ["route"], Profile()), "units")
    found = audit.rederived(own, Profile())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2  # in the filter and in the column
    assert found.count() == 0


def _tests(df):
    """The filters of a plan, as they are written out."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if line.lstrip(" :+-").startswith("Filter")]


def test_findings_are_not_worked_out_again_to_see_whether_there_are_any(spark):
    from termweave.jobs import queries_results

    d = "/root/testdata/sf0.001"
    for name in ("findings_losses", "findings_structure", "finding_profile", "findings_lookup"):
        tests = _tests(queries_results.QUERIES[name](spark, d))
        assert tests and not any("_MISMATCH" in line or "CONCEPT_REMAPPED" in line for line in tests), name
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["c"])], "id int, found array<string>")
    assert sorted(tuple(r) for r in audit.spread(rows, "found", "x", "id").collect()) == [(1, "a"), (1, "b"), (4, "c")]


def test_a_review_queue_is_routed_once(spark):
    from termweave.jobs import queries_results

    got = queries_results.QUERIES["review_queue"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "routing_status" in plan and "HUMAN_REVIEW_REQUIRED" not in plan and "NAME_EQUAL" not in plan
    told = [(-r["priority"], r["sau_id"]) for r in got.collect()]
    assert told and told == sorted(told)
