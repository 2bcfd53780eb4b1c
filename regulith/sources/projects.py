"""A store of reform projects: a log of rows in a folder, of which each project's newest counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import workflow

LOG = workflow.SCHEMA + ", deleted boolean, version long"


class Conflict(ValueError):
    """A project was saved by someone else after it was read."""


class ProjectStore:
    """Saving appends, and so does deleting: readers never meet half a change, and a lost executor costs a task.

    Each row has a version, one more than that of the row it comes from. What is read carries its version along, and saving
    it is a ``Conflict`` if the store has gone on since then, so that nobody's notes are lost unseen. (Two that save in the same
    moment may both pass; the later time counts then.) Opening a store writes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(LOG).parquet(self.path) if there else self.spark.createDataFrame([], LOG)

    def _newest(self) -> DataFrame:
        return workflow.newest(self._log(), "id", ["version", "updated_at"])

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def list(self) -> DataFrame:
        """All projects with their versions, by ``created_at`` and id."""
        return self._newest().where(~F.col("deleted")).drop("deleted").orderBy("created_at", "id")

    def get(self, project_id: str) -> DataFrame:
        """The project with this id; no row if there is none."""
        return self.list().where(F.col("id") == project_id)

    def save(self, projects: DataFrame) -> None:
        """Save new projects, and new states of old ones. Rows without a version are taken as they are."""
        columns = [f.name for f in self.spark.createDataFrame([], workflow.SCHEMA).schema]
        read = F.col("version") if "version" in projects.columns else F.lit(None).cast("long")
        stored = self._newest().select(F.col("id").alias("__id"), F.col("version").alias("__stored"))
        rows = projects.withColumn("__read", read).join(stored, F.col("id") == F.col("__id"), "left")
        late = [r["id"] for r in rows.where(F.col("__read") != F.coalesce("__stored", F.lit(0))).select("id").take(10)]
        if late:
            raise Conflict(f"saved by someone else meanwhile: {', '.join(late)}")
        version = F.coalesce("__stored", F.lit(0)) + 1
        self._append(rows.select(*columns, version.alias("version")).withColumns({"updated_at": workflow.iso_now(), "deleted": F.lit(False)}).select(*columns, "deleted", "version"))

    def delete(self, *ids: str) -> None:
        gone = self._newest().where(F.col("id").isin(*ids))
        self._append(gone.withColumns({"deleted": F.lit(True), "version": F.col("version") + 1}))

    def create(self, rows: DataFrame) -> DataFrame:
        """New projects from name, state, topic and description, as they are stored."""
        made = self.spark.createDataFrame(workflow.create(rows).collect(), workflow.SCHEMA)  # a person's projects; their ids are drawn once
        self.save(made)
        return made
