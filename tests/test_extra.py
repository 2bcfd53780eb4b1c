import json
import random

from regulith.functions.rules import STAGES
from regulith.operators import scan, workflow
from regulith.sources import reports
from regulith.streaming import rollup

LAW = "Section 1. Filing\nThe form shall be signed by the owner in writing and a filing fee of $50 is required. Violation is a felony.\nSection 2. Place\nThe owner shall appear in person before a notary public.\n"


def test_stages_go_forth_and_back_in_the_order_of_events(spark):
    rng = random.Random(2)
    kinds = ["scan", "comparison", "set", "note", None]
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.choice(kinds), rng.choice([*STAGES, "nowhere", None])) for i in range(4000)]
    events = spark.createDataFrame(rows, "k string, at long, e string, s string").repartition(9)
    got = {r.k: (r.events, r.outcomes) for r in workflow.composed(events, "k", ["at"], events.e, events.s).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        outcomes = {}
        for start in STAGES:
            stage = start
            for _, _, e, s in own:
                if e == "set" and s in STAGES:
                    stage = s
                elif e == "scan" and stage == "created":
                    stage = "scanned"
                elif e == "comparison" and stage in ("created", "scanned"):
                    stage = "analyzed"
            outcomes[start] = stage
        want[k] = (len(own), outcomes)
    assert got == want
    assert workflow.composed(events.where("at < 0"), "k", ["at"], events.e, events.s).count() == 0


def test_reports_of_any_size_are_the_driver_s(spark, tmp_path):
    rows = [(i, ["Ohio", "Iowa", None][i % 3], LAW * (i % 4)) for i in range(12)] + [(99, "Nothing here", "plain words")]
    docs = spark.createDataFrame(rows, "doc_id long, jurisdiction string, text string").repartition(5)
    lines = reports.scan_lines(docs, scan.scan(docs))
    reports.write_scan_results(lines, f"{tmp_path}/out")
    folders = {f.name.split("=", 1)[1]: f for f in (tmp_path / "out").iterdir() if f.is_dir()}
    assert set(folders) == {"Ohio", "Iowa", "__HIVE_DEFAULT_PARTITION__", "Nothing here"}
    for name in ("Ohio", "__HIVE_DEFAULT_PARTITION__", "Nothing here"):
        said = json.loads("".join(f.read_text() for f in sorted(folders[name].glob("part-*"))))
        own = docs.where(f"jurisdiction = '{name}'") if "HIVE" not in name else docs.where("jurisdiction is null")
        want = reports.scan_result(own, scan.scan(own), "" if "HIVE" in name else name)
        assert said == want and list(said["summary_stats"]["by_type"]) == list(want["summary_stats"]["by_type"])


def test_blobs_are_read_by_path(spark):
    blobs = ['{"a": {"b": 3, "c": [1, "x"]}, "n": null}', "no JSON", None]
    rows = spark.createDataFrame([(b,) for b in blobs], "scan_results string").selectExpr("scan_results", *(f"cast(null as string) as {c}" for c in workflow.RESULTS if c != "scan_results"))
    parsed = workflow.with_parsed_results(rows)
    got = parsed.select(workflow.result(parsed.scan_results, "$.a.b", "int"), workflow.result(parsed.scan_results, "$.a.c[1]", "string"), workflow.result(parsed.scan_results, "$.a", "int")).collect()
    assert [tuple(r) for r in got] == [(3, "x", None), (None, None, None), (None, None, None)]
    out = workflow.with_exported_results(parsed).collect()
    assert json.loads(out[0].scan_results) == json.loads(blobs[0]) and out[1].scan_results is None and out[2].scan_results is None


def test_a_stream_in_any_split_gives_the_batch_s_counts(spark, tmp_path):
    rows = [(i, f"s{i % 2}" if i % 5 else None, [LAW, "plain", None][i % 3]) for i in range(24)]
    schema = "doc_id long, source string, text string"
    given = tmp_path / "in"
    parts = [rows[:10], [*rows[5:17], *rows[5:9]], rows[:3], rows[17:]]  # some come again, in a batch and later
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(given))
        docs = spark.readStream.schema(schema).parquet(str(given))
        query = rollup.rollup_stream(docs, f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination(60)
        assert query.lastProgress.observedMetrics["engine"].documents_seen == len(part)
    got = {tuple(r) for r in rollup.rollup(spark, f"{tmp_path}/out").collect()}
    whole = spark.createDataFrame(rows, schema)
    counts = rollup.batch_counts(whole)
    assert {r for r in got if r[1] != "by_category"} == {tuple(r) for r in counts.collect()}
    named = scan.counts(scan.scan(whole).join(whole.selectExpr("doc_id", "coalesce(source, '') as source"), "doc_id"), "source").where("dimension <> 'by_severity'")
    assert {r for r in got if r[1] in ("by_type", "by_category")} == {(r.source, r.dimension, r.value, r.n) for r in named.collect()}


def test_sql_functions_are_the_columns(spark):
    from regulith.functions import sql, text

    names = sql.register(spark)
    texts = [LAW, "", "Plain. A waiver online costs $1,250.00 within 30 days! İstanbul’s naïve\x1ccafé", "it's \\ 'quoted'", None, "notarised", "Wet-Signature", "critical"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = {"words": text.word_count, "sentences": text.sentence_count, "syllables": text.syllable_count, "readability": text.readability, "document_type": text.document_type, "burden_score": text.burden_score, "fees": text.fees, "timeframes": text.timeframes, "digital": text.digital, "burden_type": text.mapped_type, "category": text.category, "severity_rank": text.severity_rank}
    got = spark.sql("SELECT " + ", ".join(f"legal_{n}(t) AS {n}" for n in pairs) + " FROM {rows}", rows=rows)
    assert got.collect() == rows.select(*(f(rows.t).alias(n) for n, f in pairs.items())).collect()
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "legal_report" in names
    report = spark.sql("SELECT r.* FROM {rows}, LATERAL legal_report(t) r WHERE t = ''", rows=rows).first()
    assert (report.words, report.rating, report.doc_type) == (0, rows.where("t = ''").select(text.rating(text.readability(rows.t))).first()[0], "unknown")
