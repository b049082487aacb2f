import re

import pytest

from pyspark.sql import functions as F

from termweave.jobs import align
from termweave.operators import audit, evaluate, retrieve, units, validate
from termweave.operators.retrieve import Terminology
from termweave.profile import Profile
from termweave.sources import batch
from termweave.streaming import align as streaming

P = Profile()


@pytest.fixture(scope="module")
def terms(spark):
    concepts = [("IN1", "metoprolol", "IN", "active", []), ("PIN1", "metoprolol succinate", "PIN", "active", []), ("SBD1", "metoprolol succinate 50 MG Oral Tablet [Toprol]", "SBD", "active", ["TOPROL XL 50 MG"]),
                ("IN2", "lisinopril", "IN", "active", []), ("SCD2", "lisinopril 10 MG / metoprolol 50 MG Oral Tablet", "SCD", "active", []), ("SCD3", "oldiumqx", "SCD", "obsolete", [])]
    c = spark.createDataFrame([("RxNorm", "r", *x, []) for x in concepts], "vocabulary string, release string, concept_id string, preferred_label string, concept_class string, status string, synonyms array<string>, remapped_to array<string>")
    names = c.select("vocabulary", "release", "concept_id", F.explode(F.concat(F.array("preferred_label"), "synonyms")).alias("name"), (F.col("status") == "active").alias("is_current"))
    e = [("SBD1", "has_ingredient", "IN1", "metoprolol", "IN"), ("SBD1", "has_precise_ingredient", "PIN1", "metoprolol succinate", "PIN"), ("SBD1", "has_dose_form", "DF1", "Oral Tablet", "DF"), ("SBD1", "has_tradename", "BN1", "Toprol", "BN"),
         ("PIN1", "has_ingredient", "IN1", "metoprolol", "IN"), ("SCD2", "has_ingredient", "IN2", "lisinopril", "IN"), ("SCD2", "has_ingredient", "IN1", "metoprolol", "IN"), ("SBD1", "may_treat", "D1", "x", "DX")]
    edges = spark.createDataFrame([("RxNorm", "r", *x, k) for k, x in enumerate(e)], "vocabulary string, release string, subject_id string, predicate string, object_id string, object_label string, object_class string, edge_order int")
    return Terminology(c, names, edges)


ROWS = [("1", "TOPROL XL 50 MG", "oral"), ("2", "metoprolol", None), ("3", "Metoprolol  Succinate", None), ("4", "lisinopril 10 mg / metoprolol 50 mg oral tablet", None), ("5", "zzqq none", None), ("6", " ", None), ("7", "metoprolo", None), ("8", "oldiumqx", None)]


@pytest.fixture(scope="module")
def decisions(spark, terms):
    df = spark.createDataFrame(ROWS, "id string, drug string, route string")
    out = align.align(units.build_units(df, "drug", ["id"], ["route"], P), terms, P, release="r", run_id="t")
    return {r["record_id"]: r for r in out.collect()}, out


def test_worked_cases(decisions):
    d, _ = decisions
    one = d["1"]
    assert (one["decision"], one["relationship"], one["analysis_level"]["concept_id"], one["routing_status"]) == ("MAPPED", "TARGET_BROADER_THAN_SOURCE", "IN1", "AUTO_ACCEPT")
    assert [x["kind"] for x in one["losses"]] == ["strength", "dose_form", "salt_form", "brand_identity", "route"]
    assert (d["2"]["relationship"], d["2"]["routing_status"]) == ("EXACT", "AUTO_ACCEPT")
    assert [x["kind"] for x in d["3"]["losses"]] == ["salt_form"]
    assert (d["4"]["decision"], sorted(x["concept_id"] for x in d["4"]["selected"]), d["4"]["routing_status"]) == ("MULTI_CONCEPT_MAPPED", ["IN1", "IN2"], "AUTO_ACCEPT")
    assert (d["6"]["status"], d["6"]["decision"]) == ("skipped", None)
    assert d["7"]["selected"][0]["concept_id"] == "IN1"
    assert d["8"]["routing_status"] in ("HUMAN_REVIEW", "ABSTAIN") and not d["8"]["selected"]


def test_crosswalk_shape(decisions):
    _, out = decisions
    flat = {r["record_id"]: r for r in batch.to_crosswalk(out).collect()}
    assert len(flat) == 7 and flat["4"]["selected_ids"].count("|") == 1
    assert all(t == "string" for _, t in batch.to_crosswalk(out).dtypes)
    assert {r["code"] for r in audit.audit_artifacts(out.where("status = 'success'")).select(F.explode("codes").alias("code")).collect()} <= {"REVIEW_ROUTED_TO_ABSTAIN"}


def test_repartitioning_and_repeats_change_nothing(spark, terms, decisions):
    d, _ = decisions
    df = spark.createDataFrame(ROWS + ROWS, "id string, drug string, route string").repartition(5)
    out = align.align(units.build_units(df, "drug", ["id"], ["route"], P), terms, P).collect()
    assert len(out) == 16
    assert all((r["decision"], r["routing_status"], r["mapping_key"]) == (d[r["record_id"]]["decision"], d[r["record_id"]]["routing_status"], d[r["record_id"]]["mapping_key"]) for r in out)


def test_approximate_finds_what_all_pairs_find(spark, terms):
    from difflib import SequenceMatcher

    names = [r["name"] for r in terms.names.where("is_current").collect()]
    asked = ["metoprolo", "lisinoprill", "toprol 50"]
    units_ = spark.createDataFrame([(x, x) for x in asked], "unit_key string, value string")
    top = {r["unit_key"]: r["name"] for r in retrieve.approx_hits(units_, terms.names, P).where("hit_rank = 1").collect()}
    for x in asked[:2]:
        assert top[x].lower() == max(names, key=lambda n: SequenceMatcher(None, x, n.lower()).ratio()).lower()


def alike(a, b):
    """Whether a value's normal form and a name's are alike by the profile."""
    words = lambda x: {w for w in re.findall("[a-z0-9]+", x) if len(w) > 1}
    runs = lambda x: {f" {x} "[i : i + 3] for i in range(len(x))}
    both = len(runs(a) & runs(b))
    return (bool(words(a)) and len(words(a) & words(b)) >= P.approximate_overlap * len(words(a)) - 1e-9) or both >= P.approximate_runs * (len(runs(a)) + len(runs(b)) - both) - 1e-9


def test_approximate_and_spelling_equal_all_pairs_of_the_fixtures(spark):
    from difflib import SequenceMatcher

    from termweave.jobs import queries_align

    d = "/root/testdata/sf0.01"
    names = [(r["concept_id"], r["name"], " ".join(r["name"].split()).casefold()) for r in queries_align.terminology(spark, d).names.where("is_current").collect()]
    values = sorted(r["value"] for r in queries_align.values(spark, d).collect())
    known = {n for *_, n in names}
    asked = [v for v in values if " ".join(v.split()).casefold() not in known][:12] + ["metal", "zzqq"]
    units_ = spark.createDataFrame([(x, x) for x in asked], "unit_key string, value string")
    tokens = lambda x: {w for w in re.findall("[a-z0-9]+", x) if len(w) > 1}
    got, told = {}, {}
    for r in retrieve.approx_hits(units_, queries_align.terminology(spark, d).names, P).collect():
        got.setdefault(r["unit_key"], []).append((r["hit_rank"], r["concept_id"], r["name"], round(r["score"], 9)))
    for r in retrieve.suggestions(units_, queries_align.terminology(spark, d).names.where("is_current")).collect():
        told.setdefault(r["unit_key"], []).append((r["place"], r["distance"], r["suggestion"]))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for v in asked:
        a = " ".join(v.split()).casefold()
        like = {n: max(SequenceMatcher(None, a, n).ratio(), len(tokens(a) & tokens(n)) / max(1, len(tokens(a)))) for n in known}
        best = {}
        for concept, name, n in names:
            if alike(a, n):
                best[concept] = max(best.get(concept, (0.0, "")), (like[n], name))
        first = sorted(((-s, c, name) for c, (s, name) in best.items() if s > 0))[: P.maximum_candidates]
        assert sorted(got.get(v, [])) == [(i + 1, c, name, round(-100 * s, 9)) for i, (s, c, name) in enumerate(first)]
        near = sorted((e, n) for n in known if abs(len(a) - len(n)) * 3 <= len(a) and 0 < (e := edits(a, n)) and e * 3 <= len(a))[:3]
        assert sorted(told.get(v, [])) == [(i + 1, e, n) for i, (e, n) in enumerate(near)]


def test_release_pin(terms):
    assert retrieve.pin_release(terms.concepts, "r").count() == 6
    with pytest.raises(ValueError, match="no rows"):
        retrieve.pin_release(terms.concepts, "other")


def test_stream_in_one_or_three_files_and_restart(spark, terms, tmp_path):
    exact = lambda asked: retrieve.exact_hits(asked, terms.names)
    results = []
    for parts in (1, 3):
        root = str(tmp_path / f"s{parts}")
        df = spark.createDataFrame(ROWS, "id string, drug string, route string")
        df.repartition(parts).write.parquet(f"{root}/in")
        for _ in range(2):  # the second start finds nothing new
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
            streaming.align_stream(stream, terms, P, f"{root}/out", f"{root}/ck", "drug", ["id"], ["route"], exact).awaitTermination()
        results.append(sorted((r["record_id"], r["decision"] or "") for r in spark.read.parquet(f"{root}/out/decisions").collect()))
    assert results[0] == results[1] and len(results[0]) == 8
    with pytest.raises(ValueError, match="another profile"):
        streaming.guard_profile(spark, f"{root}/ck", Profile(version="9"))


def test_evaluation_counts(spark):
    gold = spark.createDataFrame([("a", "x", "c", ["1"], {}), ("b", "y", None, [], {}), ("c", "z", "", ["2"], {})], "case_id string, source_value string, category string, expected_ids array<string>, context map<string,string>")
    pred = spark.createDataFrame([("a", "x", ["1"], "AUTO_ACCEPT", {}, "k"), ("b", None, [], "ABSTAIN", {}, "k"), ("q", "z", [], "ABSTAIN", {}, "k")], "case_id string, source_value string, selected_ids array<string>, routing_status string, context map<string,string>, mapping_key string")
    pairs = evaluate.pair_cases(gold, pred)
    total = evaluate.evaluate(pairs).where("level = 1").head()
    assert (total["gold_cases"], total["missing"], total["correct"], total["accepted_correct"]) == (3, 1, 2, 1)
    assert not evaluate.report(pairs).head()["complete"]


def test_approximate_hits_are_those_of_all_pairs(spark):
    """Every eighth value without an exact hit, against all current names."""
    from termweave.functions import text
    from termweave.jobs import queries_align

    d = "/root/testdata/sf0.001"
    names = queries_align.terminology(spark, d).names.where("is_current")
    asked = queries_align.QUERIES["unmet_values"](spark, d).distinct().where("xxhash64(unit_key) % 8 = 0").withColumn("value", F.col("unit_key"))
    pairs = asked.crossJoin(names.select("concept_id", "name")).withColumn("score", 100 * text.lexical_similarity(F.col("value"), F.col("name")))
    want, best = {}, {}
    for r in pairs.collect():
        if alike(" ".join(r["value"].split()).casefold(), " ".join(r["name"].split()).casefold()):
            best[r["unit_key"], r["concept_id"]] = max(best.get((r["unit_key"], r["concept_id"]), 0), r["score"])
    for (unit, concept), score in best.items():
        want.setdefault(unit, []).append((-score, concept))
    got = {}
    for r in retrieve.approx_hits(asked, names, P).collect():
        got.setdefault(r["unit_key"], []).append((r["hit_rank"], -r["score"], r["concept_id"]))
    assert want and {k: [(s, c) for _, s, c in sorted(v)] for k, v in got.items()} == {k: [(pytest.approx(s), c) for s, c in sorted(v)[: P.maximum_candidates]] for k, v in want.items()}


def test_exact_claims_across_a_salt_are_rejected_either_way(spark):
    concept = "struct<concept_id:string,label:string,vocabulary:string,concept_class:string,status:string,relation:string>"
    rows = [(f"{a}{b}{r}", "MAPPED", r, (a, "x", "RxNorm", a, "active", "EXACT"), (b, "x", "RxNorm", b, "active", r)) for a in ("PIN", "IN") for b in ("PIN", "IN") for r in ("EXACT", "TARGET_BROADER_THAN_SOURCE")]
    df = spark.createDataFrame(rows, f"sau_id string, decision string, relationship string, source_level {concept}, analysis_level {concept}")
    df = df.withColumns({"selected": F.array("analysis_level"), "requested_review": F.lit(False), "candidates": F.array().cast("array<struct<candidate_id:string,edges:array<struct<predicate:string,object_id:string>>>>")})
    found = df.select("sau_id", validate.domain(P, False).alias("f")).where(F.exists("f", lambda x: x["code"] == "SALT_ACTIVE_MOIETY_CONFLATION"))
    assert sorted(r["sau_id"] for r in found.collect()) == ["INPINEXACT", "PININEXACT"]


def test_unmet_values_are_told_apart_on_stored_values(spark):
    """An anti join moves below a distinct: the rows that values are made of must not take part in it."""
    from termweave.jobs import queries_align

    d = "/root/testdata/sf0.001"
    got = queries_align.QUERIES["unmet_values"](spark, d)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "l_partkey" not in plan
    names = queries_align.terminology(spark, d).names.where("is_current")
    met = {r["unit_key"] for r in retrieve.exact_hits(queries_align.values(spark, d), names).collect()}
    every = {r["unit_key"] for r in queries_align.values(spark, d).collect()}
    assert {r["unit_key"] for r in got.collect()} == every - met and met
    odd = spark.createDataFrame([("a", None), ("b", " "), ("c", names.head()["name"].upper())], "unit_key string, value string")
    assert sorted(r["unit_key"] for r in retrieve.unmet(odd, names).collect()) == ["a", "b"]


def test_rows_of_one_file_are_dealt_out_before_the_work_on_them(spark):
    df = spark.createDataFrame(ROWS, "id string, drug string, route string").coalesce(1)
    out = units.build_units(df, "drug", ["id"], ["route"], P)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("mapping_key") < plan.index("RepartitionByExpression")
    assert sorted(r["record_id"] for r in out.collect()) == sorted(r[0] for r in ROWS)


def test_values_and_names_are_dealt_out_before_they_are_cut_in_pieces(spark):
    rows = spark.createDataFrame([("hot blt",), ("hot bolt",), ("cold",)], "own string").coalesce(1)
    met = retrieve._within(rows, rows.withColumnRenamed("own", "name"), 2)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    sides = plan.split("Join Inner")[1].split("\n")
    cut = [i for i, line in enumerate(sides) if "Generate explode" in line]
    dealt = [i for i, line in enumerate(sides) if "RepartitionByExpression" in line]
    assert len(dealt) == 2 and cut[0] < dealt[0] < cut[-1] < dealt[1]
    assert sorted(tuple(r) for r in met.where("own <> name").collect()) == [("hot blt", "hot bolt", 1), ("hot bolt", "hot blt", 1)]


def test_no_table_of_all_units_is_stored(spark, terms, decisions):
    """Rows may be many, cases are few: what is stored on the way goes with cases and names."""
    d, _ = decisions
    put, sizes = align.store(spark), {}

    def told(df, name):
        out = put(df, name)
        sizes[name] = out.count()
        return out

    df = spark.createDataFrame([(f"{i}-{k}", v, r) for k in range(40) for i, v, r in ROWS], "id string, drug string, route string")
    out = align.align(units.build_units(df, "drug", ["id"], ["route"], P), terms, P, put=told).collect()
    assert len(out) == 40 * len(ROWS) and max(sizes.values()) < 100, sizes
    assert all((r["decision"], r["routing_status"], r["mapping_key"]) == (d[i]["decision"], d[i]["routing_status"], d[i]["mapping_key"]) for r in out for i in [r["record_id"].split("-")[0]])


def test_the_first_rows_text_stands_for_its_normal_form(spark, terms):
    df = spark.createDataFrame([("3", "METOPROLOL", 7), ("1", "metoprolol", 9), ("2", "Metoprolol", 8), ("4", "lisinopril", 6)], "id string, drug string, n long")
    for number, first in ((None, "metoprolol"), ("n", "METOPROLOL")):
        asked = {}

        def hits(keys, asked=asked):
            asked |= {r["unit_key"]: r["value"] for r in keys.collect()}
            return retrieve.exact_hits(keys, terms.names)

        out = align.align(units.build_units(df, "drug", ["id"], [], P, number), terms, P, hits).collect()
        assert asked == {"metoprolol": first, "lisinopril": "lisinopril"} and {r["decision"] for r in out} == {"MAPPED"}


def test_a_streams_rows_are_written_without_what_their_cases_share(spark, terms, tmp_path):
    exact = lambda asked: retrieve.exact_hits(asked, terms.names)
    root = str(tmp_path)
    df = spark.createDataFrame([(f"{i}-{k}", v, r) for k in range(20) for i, v, r in ROWS], "id string, drug string, route string")
    df.repartition(2).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    streaming.align_stream(stream, terms, P, f"{root}/out", f"{root}/ck", "drug", ["id"], ["route"], exact).awaitTermination()
    rows, cases = spark.read.parquet(f"{root}/out/decisions"), spark.read.parquet(f"{root}/out/cases")
    assert "candidates" not in rows.columns and rows.count() == df.count()
    assert cases.count() == cases.select("batch", "case_key").distinct().count() <= 2 * 7
    want = align.align(units.build_units(df, "drug", ["id"], ["route"], P), terms, P, exact)
    got = streaming.stream_decisions(spark, f"{root}/out").drop("batch")
    assert sorted(got.columns) == sorted(want.columns)
    shown = lambda x: sorted(r[0] for r in x.select(F.to_json(F.struct(*sorted(want.columns)))).collect())
    assert shown(got) == shown(want)


def test_ties_beyond_the_best_are_not_sorted_again():
    """Names as good as the last of the best change them only by smaller concepts, or a greater name of theirs."""
    names, own = [f"hot bolt {i:03d} mg" for i in range(300)], "hot bolt mg"
    told = [[f"c{(7 * i) % 300:03d}", f"c{(7 * i + 1) % 300:03d}"] for i in range(300)]

    class Counted(str):
        sorts = 0

        def __lt__(self, other):
            Counted.sorts += 1
            return str.__lt__(self, other)

    best = {}
    for name, concepts in zip(names, told, strict=True):
        for c in concepts:
            best[c] = max(best.get(c, (0.0, "")), (1.0, name))
    want = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:10]
    got = retrieve._best(own, names, __import__("numpy").ones(300), lambda i: [Counted(c) for c in told[i]], 10, {})
    assert sorted(got.items()) == sorted(want) and Counted.sorts < 3000
