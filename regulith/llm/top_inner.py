"""Exact top-k search by inner product over vectors in order of length.

Components become floor(scale * x), so scores are whole numbers. Vectors are put in
order of descending length and cut into blocks of ``block`` rows. Queries meet the
blocks in waves, the first block alone, then two, four and so on; what they have
found bounds the next wave: by Cauchy-Schwarz a block is worth a query's while only if
its longest vector times the query's length reaches the query's k-th score so far, so
a query reaches a first stretch of the blocks, and only these pairs are made. Vectors
go to the groups of queries that reach their block.

Inside a block vectors are taken in runs of descending length. A rotation from a
singular value decomposition puts most of the length into the first components,
whose partial sum plus the product of the two residual lengths bounds the score.
Only pairs whose bound reaches the query's k-th score are scored, in whole numbers.

The rotation is fitted on a bounded sample (``sample`` rows, chosen by a hash): any
rotation gives the same results, a good one prunes more. All rows are searched. How far
a query reaches is read off a list with an entry for each sixteenth of a power of 2
among the lengths, whatever the number of blocks.

Defined results: rows with a null id, a null vector, or a null or non-finite
component take no part. Shorter vectors count as if filled up with zeros.
A score that leaves 64 bits is the nearest number that doesn't. Equal scores go to
the smaller id. Queries and candidates are rows: rows that repeat an id, and equal
rows, are queries and candidates of their own, and a query's own row alone isn't a
candidate of it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, scratch, share, written

RUN = 1024
LOW, HIGH = -(2**63), 2**63 - 1
#: What longer vectors count as where lengths bound scores: with it, too, they come first and are never left out.
LONGEST = 1.7e308


def _unit(scale: float) -> float:
    """What components are kept in parts of: ``scale``, if dividing by it is exact."""
    return scale if scale == 2.0 ** round(np.log2(scale)) else 1.0


def _quantise(vectors: pa.Array, scale: float, kind: str) -> pa.Array:
    """struct<packed: floor(scale * component) / unit as numbers of ``kind``, length>, null where a vector takes no part."""
    flat = vectors.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    absent = vectors.is_null().to_numpy(zero_copy_only=False)
    packed, lengths, unit = [], [], _unit(scale)
    for gone, n, end in zip(absent.tolist(), sizes.tolist(), np.cumsum(sizes).tolist()):
        x = values[end - n : end]
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(scale * x)
            own = whole / unit
        if unit == scale:  # a component whose product leaves the range of numbers is whole as it is
            own = np.where(np.isfinite(whole), own, x)
        if gone or not np.isfinite(own).all():
            packed.append(None)
            lengths.append(None)
            continue
        packed.append(own.astype(kind).tobytes())
        lengths.append(min(float(norms(whole[None, :])[0]), LONGEST))
    fields = [pa.field("packed", pa.binary()), pa.field("length", pa.float64())]
    return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(lengths, pa.float64())], fields=fields)


def quantised(vector: Column, scale: float = 64.0, kind: str = "<f8") -> Column:
    """Whole numbers, in parts of ``scale`` if that is a power of 2: so what comes of a 32-bit component fits ``<f4``, whatever its size."""
    return F.arrow_udf(lambda v: _quantise(v, scale, kind), "struct<packed: binary, length: double>")(vector)


def _matrix(packed: list[bytes], dim: int, kind: str = "<f8") -> np.ndarray:
    out = np.zeros((len(packed), dim))
    for row, data in zip(out, packed):
        own = np.frombuffer(data, kind)
        row[: len(own)] = own
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow on the way."""
    most = np.abs(x).max(1, initial=0)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x / np.where(most > 0, most, 1)[:, None]
        return np.nan_to_num(most * np.sqrt((scaled * scaled).sum(1)), nan=np.inf, posinf=np.inf)


def products(a: np.ndarray, b: np.ndarray, unit: float = 1.0) -> np.ndarray:
    """Exact inner products of whole numbers in parts of ``unit``, row by row, as 64-bit numbers (the nearest ones)."""
    with np.errstate(over="ignore"):
        u, v = a * unit, b * unit
        reach = float(np.abs(u).max(initial=0)) * float(np.abs(v).max(initial=0)) * a.shape[1]
    if reach < 2**53:
        return np.einsum("ij,ij->i", u, v).astype(np.int64)
    if reach < 2**62 and max(float(np.abs(x).max(initial=0)) for x in (u, v)) < 2**62:
        return np.einsum("ij,ij->i", u.astype(np.int64), v.astype(np.int64))
    whole = lambda x: int(x) * int(unit) if abs(x) >= 2**53 else int(x * unit)
    sums = (sum(whole(x) * whole(y) for x, y in zip(p, q) if x and y) for p, q in zip(a.tolist(), b.tolist()))
    return np.array([max(LOW, min(HIGH, s)) for s in sums], np.int64)


def fit_rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors, those of the largest singular values first."""
    dim = sample.shape[1]
    sample = sample[np.abs(sample).max(1, initial=0) < 1e100]  # squares of others may leave the range of numbers
    if not len(sample) or not dim:
        return np.eye(dim)
    values, vectors = np.linalg.eigh(sample.T.astype(float) @ sample.astype(float))
    return np.ascontiguousarray(vectors[:, ::-1])


def search(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, rotation: np.ndarray, floor: np.ndarray | None = None, run: int = RUN, unit: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query's place, vector's place, score) of each query's best k, and the number of pairs scored.

    Queries and vectors hold whole numbers in parts of ``unit``. Vectors of a query's own row are left out. ``floor``: a
    k-th score that each query has already, or minus infinity; lower scores are left out.
    """
    dim, exact = queries.shape[1], (queries, vectors)
    with np.errstate(over="ignore"):  # a component beyond the range of numbers is infinite in bounds, not in scores
        queries, vectors = queries * unit, vectors * unit
    least = np.full(len(queries), -np.inf) if floor is None else floor.astype(float).copy()
    length = norms(vectors)
    order = np.lexsort((ids, -length))
    vectors, ids, rows, length = vectors[order], ids[order], rows[order], length[order]
    exact = exact[0], exact[1][order]
    q_length = norms(queries)
    head = max(1, dim // 4) if dim else 0
    with np.errstate(over="ignore", invalid="ignore"):
        turned, q_turned = vectors @ rotation, queries @ rotation
    rest, q_rest = norms(turned[:, head:]), norms(q_turned[:, head:])
    found = np.empty((3, 0), np.int64)
    scored = 0
    for at in range(0, len(vectors), run):
        stop = min(at + run, len(vectors))
        # what can't be compared (a number that is none) is worth scoring
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-6 + 1e-9 * q_length * length[at]
            live = np.flatnonzero(~(q_length * length[at] + slack < least))
            if not len(live):
                break  # no later vector is longer
            bound = q_turned[live, :head] @ turned[at:stop, :head].T + q_rest[live, None] * rest[None, at:stop]
            worth = ~(bound + slack[live, None] < least[live, None])
        worth &= query_rows[live, None] != rows[None, at:stop]
        scored += int(worth.sum())
        with np.errstate(over="ignore", invalid="ignore"):
            reach = float(np.abs(queries[live]).max(initial=0)) * float(np.abs(vectors[at:stop]).max(initial=0)) * dim
        if worth.mean() > 0.05 and reach < 2**53:
            score = (queries[live] @ vectors[at:stop].T).astype(np.int64)
            if score.shape[1] > k:
                kept = np.where(worth, score, LOW)
                worth &= score >= np.partition(kept, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
            i, j = np.nonzero(worth & (score >= least[live, None]))
            new = np.stack([live[i], at + j, score[i, j]])
        else:
            i, j = np.nonzero(worth)
            score = products(exact[0][live[i]], exact[1][at + j], unit)
            reached = score >= least[live[i]]
            new = np.stack([live[i][reached], at + j[reached], score[reached]])
        if not new.shape[1]:
            continue
        found = np.concatenate([found, new], 1)
        found = found[:, np.lexsort((ids[found[1]], -found[2].astype(object) if (found[2] == LOW).any() else -found[2], found[0]))]
        first = np.searchsorted(found[0], found[0])
        place = np.arange(found.shape[1]) - first
        found = found[:, place < k]
        full = np.flatnonzero(place[place < k] == k - 1)
        least[found[0, full]] = np.maximum(least[found[0, full]], found[2, full])
    return found[0], order[found[1]], found[2], scored


def _meet(queries: pa.Table, block: pa.Table, dim: int, k: int, rotation: np.ndarray, kind: str, unit: float) -> pa.Table:
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not queries.num_rows or not block.num_rows:
        return schema.empty_table()
    floor = queries["least"].combine_chunks().cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
    own, ids = queries["q"].to_numpy(), block["vec_id"].to_numpy()
    i, j, score, _ = search(_matrix(queries["packed"].to_pylist(), dim, kind), own, _matrix(block["packed"].to_pylist(), dim, kind), ids, block["row"].to_numpy(), k, rotation, floor, unit=unit)
    return pa.table([own[i], ids[j], score], schema=schema)


def _in_blocks(base: DataFrame, n: int, block: int, folder: str) -> DataFrame:
    """row, vec_id, packed, length, block: blocks of ``block`` rows by descending length, whatever the number of partitions."""
    ordered = base.repartitionByRange(max(1, -(-n // block)), F.col("length").desc(), F.xxhash64("row")).sortWithinPartitions(F.col("length").desc(), "row")
    ordered = written(ordered.select("row", "vec_id", "packed", "length", F.monotonically_increasing_id().alias("at")), f"{folder}/ordered")
    part = F.shiftrightunsigned("at", 33)
    # a row for each partition: one for some ``block`` vectors
    before = ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("p")) - F.col("n")).select("p", "before")
    before = written(before, f"{folder}/before")
    placed = ordered.join(before, part == before.p).withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    blocks = written(placed.select("row", "vec_id", "packed", "length", F.floor(F.col("place") / block).cast("int").alias("block")), f"{folder}/blocks")
    drop(base.sparkSession, f"{folder}/ordered")
    return blocks


def _reach(blocks: DataFrame) -> list[tuple[float, int]]:
    """(length, number of blocks that hold longer vectors or begin with such), by descending length in steps of a sixteenth of a power of 2."""
    tops = blocks.groupBy("block").agg(F.max("length").alias("top"))
    step = F.when(F.col("top") > 0, F.floor(F.log2("top") * 16)).otherwise(-40_000)
    rows = tops.groupBy(step.alias("step")).agg(F.max("block").alias("last")).collect()
    out, far = [], 0
    for r in sorted(rows, key=lambda r: -r.step):
        far = max(far, r.last + 1)
        out.append((2.0 ** (r.step / 16) * (1 - 1e-9) if r.step > -40_000 else 0.0, far))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, block: int = 16_384, queries_a_task: int = 4_096, sample: int = 20_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best rows other than its own."""
    spark = vectors.sparkSession
    folder = scratch(spark, "top-k")
    unit = _unit(scale)
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" and unit == scale else "<f8"
    base = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), quantised(F.col(vector_col), scale, kind).alias("x"))
    base = base.where("x.packed is not null").select(F.monotonically_increasing_id().alias("row"), "vec_id", "asks", "x.packed", "x.length")
    base = written(base, f"{folder}/all")
    n, widest = base.agg(F.count("*"), F.max(F.length("packed"))).first()
    dim = (widest or 0) // np.dtype(kind).itemsize
    some = base.where(share(F.col("row"), "rotation") < min(1.0, sample / max(n, 1))).select("packed").collect()
    rotation = fit_rotation(_matrix([r.packed for r in some], dim, kind))  # in parts of the unit: a rotation is the same
    asked = written(base.where("asks").select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "packed", "length"), f"{folder}/queries")
    blocks = _in_blocks(base, n, block, folder)
    drop(spark, f"{folder}/all")
    meet = partial(_meet, dim=dim, k=k, rotation=rotation, kind=kind, unit=unit)
    reach, total = _reach(blocks), -(-n // block)
    best = written(spark.createDataFrame([], "q long, vec_id long, score long"), f"{folder}/best-0")
    at, width, wave = 0, 1, 0
    while at < total:
        stop, wave = min(total, at + width), wave + 1
        known = best.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("s")).select("q", F.when(F.col("n") >= k, F.col("s")).alias("least"))
        wait = asked.join(known, "q", "left")
        wanted = (F.col("least") - 1e-6) / F.col("length") * (1 - 1e-6)  # blocks below this length have nothing for the query
        longer = F.size(F.filter(F.array(*(F.lit(x) for x, _ in reach)), lambda x: x >= wanted))
        upto = F.coalesce(F.try_element_at(F.array(*(F.lit(far) for _, far in reach)), longer + 1), F.lit(total))
        upto = F.when(F.col("least").isNull() | (F.col("least") <= 0) | (F.col("length") == 0), F.lit(total)).otherwise(upto)
        live = written(wait.withColumn("upto", upto).where(F.col("upto") > at), f"{folder}/live-{wave}")
        groups = max(1, -(-live.count() // queries_a_task))
        pairs = live.withColumn("block", F.explode(F.sequence(F.lit(at), F.least("upto", F.lit(stop)) - 1))).withColumn("part", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))
        met = pairs.select(F.col("block").alias("b"), F.col("part").alias("to")).distinct()
        shipped = blocks.where((F.col("block") >= at) & (F.col("block") < stop)).join(met, F.col("block") == F.col("b")).select("row", "vec_id", "packed", F.col("block").alias("b"), "to")
        found = pairs.groupBy("block", "part").cogroup(shipped.groupBy("b", "to")).applyInArrow(lambda a, b: meet(a, b), "q long, vec_id long, score long")
        found = written(found, f"{folder}/found-{wave}")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        ranked = best.union(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        best = written(ranked, f"{folder}/best-{wave}")
        for name in (f"live-{wave}", f"found-{wave}", f"best-{wave - 1}"):
            drop(spark, f"{folder}/{name}")
        at, width = stop, width * 2
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")).cast("int")
    return best.join(asked.select("q", "query_id"), "q").select("query_id", rank.alias("rank"), "vec_id", "score")


#: The same for DuckDB, over a table ``embeddings``.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i]::HUGEINT * c.w[i]::HUGEINT)), 0) AS score
  FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.r <> c.r
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id,
         greatest(-9223372036854775808, least(9223372036854775807, score))::BIGINT AS score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
