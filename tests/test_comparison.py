import json

import pytest
from pyspark.sql import functions as F

from regulith.operators import compare, licensing, workflow
from regulith.sources import licenses, projects, reports

from . import spec

NAMES = "jurisdiction string, text string, input_ord int"


def provisions(spark):
    rows = [("Alpha", "An online form, electronic filing, may be waived.", 0), ("Beta", "Shall appear in person; notarized within 30 days; a fee of $50 and $1,200.50 is required. Must must must shall shall " * 3, 1), ("", "x", 2), ("Gamma", "", 3), ("Beta2", "Plain.", 4), ("Alpha", "An online form may be used for a fee of $5 in 2 weeks.", 5)]
    return compare.provisions(spark.createDataFrame(rows, NAMES))


def test_ranking_differences_and_advice(spark):
    rows = provisions(spark)
    ranked = compare.rankings(rows).orderBy("rank").collect()
    texts = {r.jurisdiction: r.text for r in rows.collect()}
    assert set(texts) == {"Alpha", "Beta", "Beta2"} and texts["Alpha"].endswith("weeks.")
    assert [r.jurisdiction for r in ranked] == sorted(texts, key=lambda n: spec.score(texts[n])) == ["Alpha", "Beta2", "Beta"]
    assert all(r.score == pytest.approx(spec.score(texts[r.jurisdiction])) and r.notes == f"Based on {len(texts[r.jurisdiction].split())} words of regulation" for r in ranked)
    found = {(r.aspect, r.jurisdiction): r.detail for r in compare.differences(rows).collect()}
    assert found["Fees", "Beta"].startswith("$50, $1,200.50, $50") and found["Timeframes", "Alpha"] == "2 weeks" and found["Digital/Online Options", "Beta2"] == "Not mentioned"
    said = [r.recommendation for r in compare.recommendations(compare.rankings(rows)).orderBy("ord").collect()]
    assert len(said) == 3 and "from Alpha" in said[0] and "Beta has a high burden score of 10.0" in said[1]
    alone = compare.recommendations(compare.rankings(rows.where("jurisdiction = 'Alpha'"))).collect()
    assert [r.recommendation for r in alone] == [compare.CLOSING]
    report = reports.comparison_markdown("forms", rows)
    assert "1. **Alpha**" in report and "### Fees" in report and report.endswith(compare.CLOSING)


def test_decimals_are_rounded_as_in_python(spark):
    numbers = [7.25, 7.35, 8.05, 9.95, 7.15, 10.0, 7.0]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select(compare.one_decimal(F.col("x")).alias("s")).collect()
    assert [r.s for r in got][:1] == ["7.2"]
    lights = spark.range(1, 11).select(compare.burden_light(F.col("id")).alias("l"), compare.medal(F.col("id")).alias("m")).collect()
    assert [r.l for r in lights] == ["🟢"] * 3 + ["🟡"] * 3 + ["🔴"] * 4 and lights[3].m == "🔹"


def test_licenses(spark):
    rows = licenses.licenses(spark)
    best = {r.license_key: r.state for r in licensing.best_practice(rows).collect()}
    assert best == {"cosmetology": "Florida", "contractor": "Texas", "real_estate": "Florida"}
    costs = [r.total_initial_cost for r in licensing.with_totals(licensing.for_license(rows, "COSMETOLOGY")).orderBy("input_ord").collect()]
    assert costs == [225, 171, 138, 95, 140, 125]
    models = licensing.model_provisions(rows).where("license_key = 'cosmetology'").orderBy("rank").collect()
    assert [(r.state, r.burden_score) for r in models] == [("Florida", 4), ("Texas", 5), ("Arizona", 5)]
    compared = licensing.compare_states(rows, ["New York", "Texas", "Nowhere", "Texas"], "cosmetology")
    assert [r.state for r in compared.orderBy("rank").collect()] == ["New York", "Texas", "Texas"]
    assert licensing.for_license(rows, "Real Estate").count() == 0 and licensing.state_data(rows, "texas", "cosmetology").count() == 0
    shown = licensing.shown(compared).where("state = 'Texas'").first()
    assert shown.total_cost == "$171" and shown.in_person_required == "❌"
    wide = licensing.transposed(licensing.shown(licensing.compare_states(rows, ["Texas", "Florida"], "cosmetology"))).collect()
    assert wide[0].attribute == "training_hours" and wide[0].Texas == "1500"
    sampled = licensing.with_sample_statute(rows, licenses.sample_statutes(spark)).collect()
    assert [r.state for r in sampled] == ["California"]


def test_projects(spark):
    made = workflow.create(spark.createDataFrame([("one", "Texas", "permits", None), ("two", "Ohio", "fees", "d")], "name string, state string, topic string, description string")).cache()
    made.count()
    assert [len(r.id) for r in made.collect()] == [8, 8] and {r.stage for r in made.collect()} == {"created"}
    stored = spark.createDataFrame(made.collect(), made.schema)
    changed = workflow.save_scan(stored.where("name = 'one'"), F.struct(F.lit(3).alias("burdens_found")), F.lit("x" * 600))
    changed = workflow.add_note(changed, "seen")
    now = {r.name: r for r in workflow.upsert(stored, changed).collect()}
    assert now["one"].stage == "scanned" and len(now["one"].target_statute) == 500 and now["one"].notes[0].text == "seen" and now["two"].stage == "created"
    assert json.loads(now["one"].scan_results) == {"burdens_found": 3}
    assert workflow.delete(stored, [now["one"].id]).count() == 1
    texts = workflow.to_json(stored)
    again = workflow.from_json(texts).collect()
    assert sorted(r.name for r in again) == ["one", "two"] and not {r.id for r in again} & {r.id for r in now.values()}
    with pytest.raises(Exception, match="unknown fields: bogus"):
        workflow.from_json(spark.createDataFrame([('{"name": "x", "bogus": 1}',)], "json string")).collect()
    moved = workflow.advance_to(stored, "enacted").select(workflow.progress(F.col("stage")).alias("p")).first()
    assert moved.p == 100
    with pytest.raises(ValueError):
        workflow.advance_to(stored, "nowhere")


def test_whole_sources_are_profiled(spark):
    rows = [("A", "fee of $1 and $2 online", 3), ("A", "fees $3, $4 within 5 days", 1), ("A", "", 0), ("", "$9", 2), ("B", "shall " * 10, 4), (None, "x", 5)]
    got = {r.jurisdiction: r for r in compare.profiles(spark.createDataFrame(rows, NAMES)).collect()}
    assert set(got) == {"A", "B"} and got["A"].fees == "$3, $4, $1" and got["A"].timeframes == "5 days" and got["A"].digital == "Available" and got["A"].input_ord == 1
    assert got["A"].words == 12 and got["A"].score == pytest.approx(5 + 0.2 + 0.2 - 0.3) and got["B"].score == pytest.approx(6.0)


def test_project_store(spark, tmp_path):
    store = projects.ProjectStore(spark, f"{tmp_path}/projects")
    made = store.create(spark.createDataFrame([("one", "Texas", "permits", None), ("two", "Ohio", "fees", "d")], "name string, state string, topic string, description string"))
    ids = {r.name: r.id for r in made.collect()}
    assert {r.id: r.name for r in store.list().collect()} == {v: k for k, v in ids.items()}
    store.save(workflow.advance_to(store.get(ids["one"]), "drafted"))
    assert store.get(ids["one"]).first().stage == "drafted" and store.get("nothing").count() == 0
    store.delete(ids["two"], "nothing")
    again = projects.ProjectStore(spark, f"{tmp_path}/projects")
    assert [r.name for r in again.list().collect()] == ["one"]
    mine, yours = (spark.createDataFrame(again.get(ids["one"]).collect(), again.list().schema) for _ in range(2))  # both read the same state
    again.save(workflow.add_note(mine, "mine"))
    with pytest.raises(projects.Conflict):
        again.save(workflow.add_note(yours, "yours"))
    again.save(workflow.add_note(again.get(ids["one"]), "yours"))
    assert [n.text for n in again.get(ids["one"]).first().notes] == ["mine", "yours"]
    assert projects.ProjectStore(spark, f"{tmp_path}/none").list().count() == 0 and not (tmp_path / "none").exists()


def test_stages(spark):
    rows = [("created", "scan"), ("scanned", "scan"), ("created", "comparison"), ("scanned", "comparison"), ("drafted", "comparison")]
    got = spark.createDataFrame(rows, "s string, e string").select(workflow.advance(F.col("s"), F.col("e")).alias("n")).collect()
    assert [r.n for r in got] == ["scanned", "scanned", "analyzed", "analyzed", "drafted"]
    project = spark.createDataFrame([("p", "analyzed")], "id string, stage string")
    stages = workflow.stage_rows(project).orderBy("stage_ord").collect()
    assert [r.is_complete for r in stages] == [True, True] + [False] * 5 and stages[2].is_current
    steps = spark.createDataFrame([(s,) for s in workflow.STAGES], "s string").select(workflow.next_step(F.col("s")).alias("n"), workflow.icon(F.col("s")).alias("i"), workflow.progress(F.col("s")).alias("p")).collect()
    assert sum(r.n is not None for r in steps) == 4 and steps[3].p == 50 and len({r.i for r in steps}) == 7
