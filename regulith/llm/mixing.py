"""Mixing sources to target weights by systematic sampling.

Sources, in code point order and null last, weigh 5, 2, 1, 5, 2, 1 and so on.
They share ``share`` times all sizes by weight; a target stops at ``cap`` times
its source's size and what is over is shared again by weight, which is the one
level at which every source gets the smaller of its cap and level times weight.

Within a source each document expects target / source size copies. Documents
stand in an order by size; the expected copies are summed along it, one offset
for the source in [0, 1) is added, and a document is emitted once for each whole
number that its stretch of the sum crosses: the whole part of the expected
copies, or one more. As neighbours have like sizes, the words taken come near
the target whatever the sizes are.

No source's rows stand in one task for that sum: the order is by (band of the
size's two leading digits, two hexadecimal digits of MD5 of the id, size, id).
Bands and digits make cells, of which a source has a bounded number; cells are
counted, their counts summed up within the source, and each row needs its place
within its cell only. MD5 also gives the offset, so reruns agree.

Defined results: a null text has size 0 and null ids come first in their cell.
Rows that repeat an id are documents of their own. A null source is a source;
one without words has target 0. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, scratch, written

WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """source, source_size → also target. One row for each source, so the table is as small as the list of sources.

    With the sources by cap / weight, the level fits behind the first n of them if it lies
    between their ratios; n is the number whose cap is under the level their remainder would set.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weigh = F.element_at(F.array(*map(F.lit, weights)), kind + 1).cast("long")
    ranked = sources.withColumn("weight", weigh).withColumn("ceiling", cap * F.col("source_size"))
    rising = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum("ceiling").over(before), F.lit(0))
    level = (share * F.sum("source_size").over(Window.partitionBy()) - full) / F.sum("weight").over(onward)
    capped = F.col("ceiling") <= level * F.col("weight")
    stepped = ranked.withColumn("level", level).withColumn("capped", capped)
    found = F.min(F.when(~F.col("capped"), F.struct(F.col("ceiling") / F.col("weight"), F.col("level")))).over(Window.partitionBy())
    target = F.when(F.col("capped"), F.col("ceiling").cast("double")).otherwise(found["level"] * F.col("weight"))
    return stepped.withColumn("target", target).select("source", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", keep: tuple[str, ...] = (), **how) -> DataFrame:
    """Per row of ``docs``: doc_id, columns ``keep``, source, size, source_size, target and copies (0, 1 or more)."""
    folder = scratch(docs.sparkSession, "mix")
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    digits = F.col("size").cast("string")
    rows = written(
        base.withColumn("band", F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 2))).withColumn(
            "cell", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
        ),
        f"{folder}/rows",
    )
    cells = written(rows.groupBy("source", "band", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("cell_size")), f"{folder}/cells")
    aimed = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), **how)
    # sums before a band among its source's, of which each decade of size has 90, and before a cell among its band's 256
    before = lambda order, *by: F.sum("n").over(Window.partitionBy(*by).orderBy(order)) - F.col("n")
    bands = cells.groupBy("source", "band").agg(F.sum("n").alias("n")).select(F.col("source").alias("t"), F.col("band").alias("u"), before("band", "source").alias("above"))
    bands = bands.join(aimed, F.col("t").eqNullSafe(F.col("source"))).drop("source")
    cells = cells.select(F.col("source").alias("s"), F.col("band").alias("b"), F.col("cell").alias("c"), before("cell", "source", "band").alias("within"))
    cells = cells.join(bands, F.col("s").eqNullSafe(F.col("t")) & (F.col("b") == F.col("u"))).withColumn("before", F.col("above") + F.col("within")).drop("t", "u", "above", "within")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "band", "cell").orderBy("size", "doc_id")))
    at = placed.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")) & (F.col("cell") == F.col("c")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    hashed = F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).cast("binary"))
    offset = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    upto = (F.col("before") + F.col("place")).cast("double")
    copies = F.floor(each * upto + offset) - F.floor(each * (upto - 1.0) + offset)
    return at.select("doc_id", *keep, "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def report(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same for DuckDB, over a table ``documents``.
SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS cell FROM documents
), banded AS (
  SELECT *, lpad(length(size::VARCHAR)::VARCHAR, 2, '0') || substr(size::VARCHAR, 1, 2) AS band FROM rows
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM banded GROUP BY source
), weighed AS (
  SELECT *, 2 * source_size AS ceiling, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sources
), stepped AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(ceiling) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW a AS (ORDER BY ceiling / weight, source NULLS LAST)
), levels AS (
  SELECT level AS found FROM stepped WHERE NOT ceiling <= level * weight ORDER BY ceiling / weight LIMIT 1
), aimed AS (
  SELECT source, source_size, CASE WHEN ceiling <= level * weight THEN ceiling::DOUBLE ELSE (SELECT found FROM levels) * weight END AS target FROM stepped
), placed AS (
  SELECT b.*, a.source_size, a.target, row_number() OVER (PARTITION BY b.source ORDER BY b.band, b.cell, b.size, b.doc_id NULLS FIRST)::DOUBLE AS upto,
         CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS each,
         ('0x' || substr(md5('mix' || coalesce('=' || b.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM banded b JOIN aimed a ON b.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target, ((floor(each * upto + start) - floor(each * (upto - 1.0::DOUBLE) + start))::BIGINT * size)::BIGINT AS taken FROM placed
"""
