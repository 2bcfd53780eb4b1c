"""Reform projects as a keyed table and their workflow.

The store is a log of rows: a project's newest row (by updated_at, then version) is
what it is, and a deleted one has none. Blobs of results are JSON text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.rules import STAGES

NOTE = "array<struct<timestamp: string, text: string>>"
TEXTS = ("id", "name", "created_at", "updated_at", "state", "topic", "description", "target_statute", "target_regulation", "stage", "scan_results", "analysis_results", "comparison_results", "draft_results")
SCHEMA = ", ".join(f"{c} string" for c in TEXTS) + f", notes {NOTE}, tags array<string>"
#: What to do next, and the pictures of stages.
NEXT_STEP = {
    "created": "Use the Burden Scanner to analyze your target statute.",
    "scanned": "Use the Gap Analyzer to compare against regulations.",
    "analyzed": "Use the Cross-State Comparator to find best practices.",
    "drafted": "Review and refine your draft legislation.",
}
ICONS = {"created": "📁", "scanned": "🔍", "analyzed": "📊", "drafted": "📝", "reviewed": "✅", "introduced": "🏛️", "enacted": "⚖️"}


def _look_up(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def new_id() -> Column:
    return F.substring(F.uuid(), 1, 8)


def iso_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def create(rows: DataFrame) -> DataFrame:
    """New projects from name, state, topic and description."""
    empty = {c: F.lit("") for c in ("target_statute", "target_regulation")} | {c: F.lit(None).cast("string") for c in TEXTS if c.endswith("_results")}
    made = rows.select("name", "state", "topic", F.coalesce("description", F.lit("")).alias("description")).withColumns({"id": new_id(), "created_at": iso_now(), "updated_at": iso_now(), "stage": F.lit(STAGES[0]), "notes": F.array().cast(NOTE), "tags": F.array().cast("array<string>"), **empty})
    return made.select(*T.StructType.fromDDL(SCHEMA).names)


def upsert(stored: DataFrame, changes: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """The newest row of each key; a change wins over a stored row of the same time."""
    both = stored.withColumn("__v", F.lit(0)).unionByName(changes.withColumn("__v", F.lit(1)))
    whole = F.struct(*stored.columns)
    return both.groupBy(key).agg(F.max_by(whole, F.struct(order, "__v")).alias("r")).select("r.*")


def delete(stored: DataFrame, ids: list[str]) -> DataFrame:
    return stored.where(~F.col("id").isin(ids)) if ids else stored


def stage_index(stage: Column) -> Column:
    """0 to 6; null for another name."""
    return F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), stage), F.lit(0)) - 1


def progress(stage: Column) -> Column:
    return stage_index(stage) / (len(STAGES) - 1) * 100


def advance(stage: Column, event: Column) -> Column:
    """Stage after a saved "scan" (of a new project) or "comparison" (of a new or scanned one)."""
    return F.when((event == "scan") & (stage == "created"), "scanned").when((event == "comparison") & stage.isin("created", "scanned"), "analyzed").otherwise(stage)


def advance_to(projects: DataFrame, stage: str) -> DataFrame:
    """Any stage may follow any other."""
    if stage not in STAGES:
        raise ValueError(f"no stage {stage!r}")
    return projects.withColumns({"stage": F.lit(stage), "updated_at": iso_now()})


def next_step(stage: Column) -> Column:
    return _look_up(NEXT_STEP, stage)


def icon(stage: Column) -> Column:
    return F.coalesce(_look_up(ICONS, stage), F.lit("📋"))


def stage_rows(projects: DataFrame, key: str = "id") -> DataFrame:
    """(key, stage_ord, stage, is_current, is_complete) for every stage of every project."""
    each = projects.select(key, stage_index(F.col("stage")).alias("__now"), F.posexplode(F.array(*map(F.lit, STAGES))).alias("stage_ord", "stage"))
    return each.select(key, "stage_ord", "stage", (F.col("stage_ord") == F.col("__now")).alias("is_current"), (F.col("stage_ord") < F.col("__now")).alias("is_complete"))


def add_note(projects: DataFrame, note: Column | str) -> DataFrame:
    said = note if isinstance(note, Column) else F.lit(note)
    entry = F.struct(iso_now().alias("timestamp"), said.alias("text"))
    return projects.withColumns({"notes": F.array_append(F.coalesce("notes", F.array().cast(NOTE)), entry), "updated_at": iso_now()})


def save_scan(projects: DataFrame, totals: Column, text: Column) -> DataFrame:
    """Store a scan's result (a struct) as JSON and the beginning of its text, and move a new project on."""
    return projects.withColumns({"scan_results": F.to_json(totals), "target_statute": F.substring(text, 1, 500), "stage": advance(F.col("stage"), F.lit("scan")), "updated_at": iso_now()})


RESULTS = tuple(c for c in TEXTS if c.endswith("_results"))


def with_parsed_results(projects: DataFrame) -> DataFrame:
    """The blobs of results as VARIANT, parsed once and read by path (``result``); null for none, and for what isn't JSON."""
    return projects.withColumns({c: F.try_parse_json(c) for c in RESULTS})


def result(blob: Column, path: str, kind: str) -> Column:
    """What stands at a path ("$.summary_stats.by_type") of a parsed blob, as ``kind``; null where it isn't, or isn't one."""
    return F.try_variant_get(blob, path, kind)


def with_exported_results(projects: DataFrame) -> DataFrame:
    """Parsed blobs as JSON text again. Members come in the order of their names."""
    return projects.withColumns({c: F.to_json(c) for c in RESULTS})


def to_json(projects: DataFrame) -> DataFrame:
    """id, json"""
    return projects.select("id", F.to_json(F.struct(*projects.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def from_json(texts: DataFrame, json_col: str = "json") -> DataFrame:
    """Projects from their JSON, with new ids and times. A field that a project doesn't have is an error."""
    names = T.StructType.fromDDL(SCHEMA).names
    unknown = F.array_except(F.json_object_keys(json_col), F.array(*map(F.lit, names)))
    parsed = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", ")))).otherwise(F.from_json(json_col, SCHEMA))
    return texts.select(parsed.alias("p")).select("p.*").withColumns({"id": new_id(), "created_at": iso_now(), "updated_at": iso_now()})


def replayed(events: DataFrame, key: str, event: Column) -> DataFrame:
    """key, stage, scans, comparisons after all of a project's events.

    Stages only move on, so what counts is whether there was a comparison, or else a scan: sums, no replay.
    """
    kind = events.select(key, event.alias("__e"))
    per = kind.groupBy(key).agg(F.count_if(F.col("__e") == "scan").alias("scans"), F.count_if(F.col("__e") == "comparison").alias("comparisons"))
    return per.withColumn("stage", F.when(F.col("comparisons") > 0, "analyzed").when(F.col("scans") > 0, "scanned").otherwise("created"))


#: Each stage as the outcome of itself: what no event at all does.
NOTHING = tuple(range(len(STAGES)))


def _outcomes(event: str | None, to: str | None) -> tuple[int, ...]:
    """An event as a function: the stage after it, by each stage before it. What no rule knows changes nothing."""
    at = {s: i for i, s in enumerate(STAGES)}
    if event == "set" and to in at:
        return (at[to],) * len(STAGES)
    moved = {"scan": {"created": "scanned"}, "comparison": {"created": "analyzed", "scanned": "analyzed"}}.get(event, {})
    return tuple(at[moved.get(s, s)] for s in STAGES)


def composed(events: DataFrame, key: str, order: list[str], event: Column, to: Column) -> DataFrame:
    """key, events, outcomes (map from each stage to the one after all of the key's events, in order).

    ``event`` is "scan", "comparison" or "set" (to the stage ``to``, forth or back); others change nothing. Events
    are functions from stage to stage, and a run of events is their composition, which may be bracketed in any way.
    So rows are dealt by ranges of (key, order), each task composes what it has of a key as it reads it, and of a
    key's rows one for each task meets the others: a key with most of the events is spread like any other.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("k"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), event.alias("event"), to.alias("to"))
    by = ["k", *(f"o{i}" for i in range(len(order)))]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("k", "event", "to", F.spark_partition_id().alias("part"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, n, done = {}, None, 0, NOTHING  # held: (outcomes so far, event, stage) → outcomes, of which there are few
        for batch in batches:
            out = []
            for k, e, t, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (k, part) != at:
                    if at:
                        out.append((*at, n, list(done)))
                    at, n, done = (k, part), 0, NOTHING
                if (done, e, t) not in held:
                    step = _outcomes(e, t)
                    held[done, e, t] = tuple(step[x] for x in done)
                n, done = n + 1, held[done, e, t]
            yield run(out)
        yield run([(*at, n, list(done))] if at else [])

    def run(rows: list[tuple]) -> pa.RecordBatch:
        types = (schema[0], pa.int32(), pa.int64(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["k", "part", "n", "done"])

    schema = [to_arrow_type(events.schema[key].dataType)]
    parts = ranged.mapInArrow(runs, f"k {kind}, part int, n long, done array<int>")
    # of a key there is a row for each task that has some of its events
    listed = F.array_sort(F.collect_list(F.struct("part", "done")))
    whole = F.aggregate(listed, F.array(*map(F.lit, NOTHING)), lambda so_far, x: F.transform(so_far, lambda s: F.element_at(x["done"], s + 1)))
    names = F.array(*map(F.lit, STAGES))
    outcomes = F.map_from_arrays(names, F.transform("whole", lambda i: F.element_at(names, i + 1)))
    return parts.groupBy("k").agg(F.sum("n").alias("events"), whole.alias("whole")).select(F.col("k").alias(key), "events", outcomes.alias("outcomes"))


def after(stage: Column, outcomes: Column) -> Column:
    """The stage that a project in ``stage`` is in after events with these outcomes."""
    return F.coalesce(F.element_at(outcomes, stage), stage)


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key, found by partial sums rather than a window."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
