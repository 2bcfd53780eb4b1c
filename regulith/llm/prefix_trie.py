"""The trie of the prefixes of conversations, by partition refinement.

All conversations start in one class, the root. In each round the classes of two or more
members are split by their members' next turn; a class of one member is retired, and its
further turns become a unary chain without another round. So there are as many rounds as the
longest shared prefix has turns, each over the members that are still shared, and each turn
is met once. Classes of one depth have no member in common, so a class is named by its depth
and its smallest member. Then subtrees are summed up, from the deepest level to the root.

A turn is told by SHA-256 of its role and text. Each level is written, so no plan grows
with the depth. Counts and sums are worked out where the rows lie before they are
shuffled, and what a class gives back to its members is joined by class and turn, so Spark
can split the rows of a class that most conversations are in.

The digest of the conversations that end at a node takes their ids in order and can't be
put together from parts. Ids are dealt by ranges, joined to pieces there, and only pieces
meet; they are hashed one after the other, so nothing holds a whole list.

Defined results: turns of one conversation stand in the order of their number (null first),
equal numbers by role, then text; repeated rows are turns of their own. A null role or text
is empty. Rows with a null conversation id take no part. An empty table has no node, not
even a root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, settled, written

#: Characters of a piece of joined ids.
PIECE = 1 << 16
NODE = "conv_id long, parent_conv_id long, n_convs long, chars long, n_turns long"
SUMMED = "conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def numbered(turns: DataFrame, folder: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), role, text: each conversation's turns in order.

    Rows are dealt by ranges of the order itself, so the turns of one conversation, however many, and equal
    rows too, stand in as many tasks as it takes; a row's number is its number in its range, and the rows
    of the conversation in the ranges before.
    """
    rows = settled(turns, f"{folder}/turns").where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ("turn", "role", "text", "row")
    ranged = written(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), f"{folder}/ranged")
    within = ranged.withColumn("within", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    return within.join(counts.select("conv_id", "part", before.alias("before")), ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("within")).alias("pos"), "role", "text")


def with_shared_starts(turns: DataFrame, folder: str, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt upon those at the head of their block: (conv_id, n_turns), (conv_id, pos, role, text).

    The first h turns of conversation c - c % ``block`` take the place of the first h of c; h is crc32 of c modulo ``most``.
    """
    rows = written(turns, f"{folder}/numbered")
    lengths = written(rows.groupBy("conv_id").agg(F.max("pos").alias("own")), f"{folder}/lengths")
    heads = lengths.select(F.col("conv_id").alias("head"), F.col("own").alias("head_turns"))
    convs = lengths.withColumns({"head": F.col("conv_id") - F.col("conv_id") % block, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    convs = convs.join(heads, "head", "left").withColumn("taken", F.least("h", F.coalesce("head_turns", F.lit(0))))
    convs = written(convs.select("conv_id", "head", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")), f"{folder}/convs")
    starts = rows.where(F.col("pos") < most).withColumnRenamed("conv_id", "head").join(convs.where(F.col("taken") > 0).select("conv_id", "head", "h"), "head").where(F.col("pos") <= F.col("h"))
    own = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") > F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ("conv_id", "pos", "role", "text")
    return convs.select("conv_id", "n_turns"), starts.select(*columns).unionByName(own.select(*columns))


def _told(role: Column, text: Column) -> Column:
    """A digest of both; the role's length parts them."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, conv_id, first, piece): neighbouring rows of a node as one text, PIECE characters or little more."""
    names, at, out, ids, size = ("depth", "conv_id", "first", "piece"), None, [], [], 0

    def close() -> None:
        if ids:
            out.append((*at, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for depth, node, member in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "member"))):
            if (depth, node) != at or size > PIECE:
                close()
                at, size = (depth, node), 0
            ids.append(member)
            size += 20
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], list(names))
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], list(names))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, conv_id, ends_sha256) from pieces in order."""
    at, state, out = None, None, []
    table = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["depth", "conv_id", "ends_sha256"])
    for batch in batches:
        for depth, node, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "piece"))):
            if (depth, node) != at:
                if at:
                    out.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield table()
            out.clear()
    if at:
        out.append((*at, state.hexdigest()))
        yield table()


def ends(members: DataFrame) -> DataFrame:
    """depth, conv_id, ends_sha256: SHA-256 of each node's members (column ``member``), ascending and joined by commas."""
    ranged = members.repartitionByRange("depth", "conv_id", "member").sortWithinPartitions("depth", "conv_id", "member")
    pieces = ranged.select("depth", "conv_id", "member").mapInArrow(_joined, "depth long, conv_id long, first long, piece string")
    return pieces.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first").mapInArrow(_hashed, "depth long, conv_id long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each different prefix of conversations.

    ``convs`` has conv_id and n_turns, a row for each; ``turns`` has conv_id, pos (from 1), role and text.
    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    spark = convs.sparkSession
    folder = scratch(spark, "trie")
    steps = written(turns.select("conv_id", "pos", _told(F.col("role"), F.col("text")).alias("told"), F.length("text").cast("long").alias("chars")), f"{folder}/steps")
    at = lambda kind, depth: f"{folder}/{kind}/depth={depth}"
    level = lambda kind, depth, schema: spark.read.schema(schema).parquet(at(kind, depth))
    member = "conv_id long, n_turns long, class long, n long"

    total = convs.agg(F.min("conv_id").alias("class"), F.count("*").alias("n")).first()
    if not total["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    members = convs.select("conv_id", "n_turns", F.lit(total["class"]).alias("class"), F.lit(total["n"]).alias("n"))
    written(members, at("members", 0))
    root = members.where(F.col("conv_id") == F.col("class")).select("conv_id", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("chars"), "n_turns")
    written(root, at("classes", 0))

    depth = 0
    while True:  # split
        shared = level("members", depth, member).where((F.col("n") > 1) & (F.col("n_turns") > depth))
        if not shared.take(1):
            break
        depth += 1
        moved = shared.select("conv_id", "n_turns", "class").join(steps.where(F.col("pos") == depth).drop("pos"), "conv_id")
        moved = written(moved, f"{folder}/moved/depth={depth}")
        split = moved.groupBy("class", "told").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("n_turns").alias("n_turns"))
        found = written(split.withColumnRenamed("class", "parent_conv_id"), at("classes", depth))
        named = found.select(F.col("parent_conv_id").alias("class"), "told", F.col("conv_id").alias("name"), F.col("n_convs").alias("n"))
        back = moved.select("conv_id", "n_turns", "class", "told").join(named, ["class", "told"])
        written(back.select("conv_id", "n_turns", F.col("name").alias("class"), "n"), at("members", depth))

    below = spark.createDataFrame([], SUMMED)
    for d in range(depth, -1, -1):  # fold back
        sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        nodes = level("classes", d, NODE).join(sums, "conv_id", "left")
        alone = F.col("n_convs") == 1  # its child, if any, starts a chain
        children = F.when(alone, (F.col("n_turns") > d).cast("long")).otherwise(F.coalesce("children", F.lit(0)))
        saved = (F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))
        summed = nodes.select("conv_id", "parent_conv_id", "n_convs", children.alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))
        below = written(summed, at("summed", d))

    every = spark.read.schema(f"{member}, depth long").parquet(f"{folder}/members")
    ended = ends(every.where(F.col("n_turns") == F.col("depth")).select("depth", F.col("class").alias("conv_id"), F.col("conv_id").alias("member")))
    none = F.sha2(F.lit("").cast("binary"), 256)
    classes = spark.read.schema(f"{SUMMED}, depth long").parquet(f"{folder}/summed").join(ended, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    retired = every.where((F.col("n") == 1) & (F.col("n_turns") > F.col("depth"))).select("conv_id", "n_turns", F.col("depth").alias("after"))
    chains = steps.select("conv_id", F.col("pos").cast("long").alias("depth")).join(retired, "conv_id").where(F.col("depth") > F.col("after"))
    last = F.col("depth") == F.col("n_turns")
    one = F.lit(1).cast("long")
    tails = chains.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return classes.select(*tails.columns).unionByName(tails)


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes with the role and text of their last turn; the root has neither."""
    return nodes.join(turns.select("conv_id", F.col("pos").alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


def rebuilt_trie(conversations: DataFrame, **how) -> DataFrame:
    """The trie of conversations rebuilt by ``with_shared_starts``."""
    folder = scratch(conversations.sparkSession, "conversations")
    return trie(*with_shared_starts(numbered(conversations, folder), folder, **how))


#: The same for DuckDB, over a table ``conversations``. CRC-32 is worked out digit by digit from its polynomial.
SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS b)
  )
), rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), lengths AS (SELECT conv_id, count(*) AS own FROM rows GROUP BY conv_id
), hashed AS (
  SELECT conv_id, own, conv_id - conv_id % 100 AS head,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 6 AS h
  FROM lengths, crc
), convs AS (
  SELECT a.conv_id, a.head, a.h, least(a.h, coalesce(b.own, 0)) AS taken, least(a.h, coalesce(b.own, 0)) + greatest(a.own - a.h, 0) AS n_turns
  FROM hashed a LEFT JOIN lengths b ON a.head = b.conv_id
), rebuilt AS (
  SELECT c.conv_id, r.pos, r.role, r.text FROM convs c JOIN rows r ON r.conv_id = c.head AND r.pos <= c.h
  UNION ALL
  SELECT c.conv_id, r.pos - c.h + c.taken, r.role, r.text FROM convs c JOIN rows r ON r.conv_id = c.conv_id AND r.pos > c.h
), chained AS (
  SELECT conv_id, pos AS depth, length(text) AS chars, sha256(string_agg(sha256(length(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS prefix FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), placed AS (
  SELECT conv_id, depth, chars, min(conv_id) OVER (PARTITION BY depth, prefix) AS node, count(*) OVER (PARTITION BY depth, prefix) AS n FROM chained
), nodes AS (
  SELECT p.depth, p.node, any_value(p.n) AS n_convs, any_value(p.chars) AS chars, any_value(up.node) AS parent,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE c.n_turns = p.depth), '')) AS ends_sha256
  FROM placed p JOIN convs c USING (conv_id) LEFT JOIN placed up ON up.conv_id = p.conv_id AND up.depth = p.depth - 1
  GROUP BY p.depth, p.node
), children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT up.depth, up.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.chars)::BIGINT AS saved_tokens
  FROM nodes x LEFT JOIN children k USING (depth, node) JOIN placed up ON up.conv_id = x.node AND up.depth <= x.depth
  GROUP BY up.depth, up.node
)
SELECT x.node::BIGINT AS conv_id, x.depth::BIGINT AS depth, x.parent::BIGINT AS parent_conv_id, x.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved_tokens, x.ends_sha256
FROM nodes x JOIN below b USING (depth, node) LEFT JOIN children k USING (depth, node)
"""
