"""How often queries go over the texts, and what is split twice."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regulith.functions import rx
from regulith.operators import external, scan, sections
from regulith.streaming import rollup


def generated(frame, name):
    """Where rows are made of an array of this name."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Generate" in line and name in line]


@pytest.mark.parametrize("name", ["engine_analysis"])
def test_rules_go_over_the_texts_once(spark, name):
    assert len(generated(entry.QUERIES[name](spark, "/root/testdata/sf0.001"), "__hits")) == 1


def test_only_documents_that_are_shown_are_split_again(spark):
    rows = [(i, f"t{i % 3}", f"Section {i} a\n" + "x" * (i % 7 * 700) + f"\nSection {i}.1 b") for i in range(400)] + [(5, "t2", "again"), (6, None, "y")]
    docs, asked = spark.createDataFrame(rows, "doc_id long, topic string, text string"), []
    sides = [docs.where(F.pmod("doc_id", F.lit(2)) == odd) for odd in (0, 1)]
    split = lambda frame: sections.split_sections(frame, "doc_id", "text", "topic")

    def again(frame):
        def of(shown):
            asked.append({r.doc_id for r in shown.collect()})
            return split(frame.join(shown.select("doc_id"), "doc_id", "left_semi"))

        return of

    plain = external.paired(*map(split, sides), ["topic"])
    few = external.paired(*map(split, sides), ["topic"], again=tuple(map(again, sides)))
    assert few.columns == plain.columns and sorted(few.collect()) == sorted(plain.collect()) and plain.count() == 3
    assert len(asked) == 2 and all(0 < len(ids) < 40 for ids in asked)


def test_a_batch_counts_its_rules_once(spark):
    docs = spark.createDataFrame([(1, "a", "Filing fee, in writing.")], "doc_id long, source string, text string")
    plan = rollup.batch_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "size(concat" in line]


def test_few_roots_begin_with_common_characters():
    wanted = sorted({x for r in scan.CATALOG for x in rx.needed_any(r.pattern)})
    found = rx.roots(wanted)
    assert set(found) == set(wanted) and all(root in x for x, root in found.items()) and len(set(found.values())) < 40
    assert sum(rx.COMMON.get(root[0], 1) for root in set(found.values())) < 900  # 1,675 when roots were chosen by number alone
