"""A Merkle manifest of a dataset: every row a leaf, a tree of runs for each part, a tree over the parts' roots.

H is lower-case hex SHA-256 of its inputs, concatenated (digests as hex text). Within a part (here: a language) leaves
stand in order and every run of ``GROUP`` consecutive nodes, the last perhaps shorter, becomes one node of the next level,
while a level has more than one. The parts' roots, in order of the parts, are the leaves of the tree on top.

Ranks. Leaves are range-partitioned by part and order and numbered within their partitions; a table of (part,
partition) counts gives the rest, so no task numbers a whole part.

Nodes. ``LEVELS`` levels at a time are folded from ``GROUP ** LEVELS`` consecutive nodes in one row. The node table has
one row for every run: its coordinate (part, level, run) and the digests of its nodes, in order, as one binary value.

Proofs. Every leaf explodes the coordinates of the runs that hold its siblings, from its index and the group size, and
joins the node table; its own digest is cut out by its position. What was found is ordered by level, concatenated and
folded with the leaf. Runs with more than one in ``SHARE`` of the leaves below them (at most ``SHARE`` on a level)
would be hot keys: they are broadcast, the others joined by key.

Defined results. Null fields are '-'; null ids come first and are never tampered; equal ids are ordered by their
leaves. A part of one row is its own root and has no siblings in its tree; one part alone is the root. An empty table gives
an empty table. Columns other than those named are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.store import materialize, scratch

GROUP, LEVELS, SHARE = 8, 3, 256
#: The part that the tree over the parts has for its own; the others are '' or begin with '='.
TOP = "^"
#: Rows of the table of (part, partition) counts that are broadcast; beyond it they are joined by key.
MOST_BROADCAST = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
A_Z, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_digest(*fields: Column) -> Column:
    """H of the fields as length-prefixed UTF-8; null is '-'."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _counted(leaves: DataFrame) -> DataFrame:
    """part, slice, before (leaves of the part in earlier slices), first (its first number in the slice), size (of the part)."""
    here = leaves.groupBy("part", F.shiftright("number", 33).alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"))
    w = Window.partitionBy("part")
    return here.select("part", "slice", "first", (F.sum("n").over(w.orderBy("slice")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("size"))


def ranked(leaves: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(``leaves`` in order as a table with number, its counts by slice); ``leaves`` has part, not null."""
    spark = leaves.sparkSession
    dealt = leaves.repartitionByRange(_partitions(spark), "part", *order).sortWithinPartitions("part", *order)
    table = materialize(dealt.withColumn("number", F.monotonically_increasing_id()), name)
    return table, materialize(_counted(table), f"{name}-counts")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def indexed(leaves: DataFrame, counts: DataFrame, *more: str) -> DataFrame:
    """``leaves`` with index, size and the columns ``more`` of ``counts``."""
    at = counts.select("part", "slice", "first", "before", "size", *more)
    at = F.broadcast(at) if counts.count() <= MOST_BROADCAST else at
    sliced = leaves.withColumn("slice", F.shiftright("number", 33))
    return sliced.join(at, ["part", "slice"]).withColumn("index", F.col("before") + F.col("number") - F.col("first")).drop("slice", "first", "before")


def _runs(values: Column, made) -> Column:
    """``made`` of every run of GROUP consecutive values."""
    return F.transform(F.sequence(F.lit(0), _div(F.size(values) - 1, F.lit(GROUP)).cast("int")), lambda i: made(F.slice(values, i * GROUP + 1, GROUP)))


def _div(x: Column, by: Column) -> Column:
    return F.call_function("div", x, by)


def _concatenated(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def _sum(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0).cast("long"), lambda a, x: a + x)


def _folded(nodes: DataFrame) -> DataFrame:
    """part, rows, block, count0.., run0.., weight0.., root, above, weight: LEVELS levels of each block of GROUP ** LEVELS nodes.

    count is the number of nodes of the whole tree on a level; where it is one, that node is the root."""
    block = _div(F.col("index"), F.lit(GROUP**LEVELS)).alias("block")
    rows = nodes.groupBy("part", "rows", "count", block).agg(F.sort_array(F.collect_list(F.struct("index", "digest", "weight"))).alias("x"))
    rows = rows.select("part", "rows", "block", F.col("count").alias("count0"), F.col("x.digest").alias("d0"), F.col("x.weight").alias("w0"))
    for k in range(LEVELS):
        more = F.col(f"count{k}") > 1
        rows = rows.withColumns({
            f"run{k}": F.when(more, _runs(F.col(f"d{k}"), _concatenated)), f"w{k + 1}": F.when(more, _runs(F.col(f"w{k}"), _sum)),
            f"count{k + 1}": F.when(more, _div(F.col(f"count{k}") + (GROUP - 1), F.lit(GROUP))),
        })
        rows = rows.withColumn(f"d{k + 1}", F.transform(f"run{k}", lambda r: F.unhex(F.sha2(_text(r), 256))))
    root = F.coalesce(*(F.when(F.col(f"count{k}") == 1, F.col(f"d{k}")[0]) for k in range(LEVELS + 1)))
    top = [F.col(f"d{LEVELS}")[0].alias("above"), F.col(f"w{LEVELS}")[0].alias("weight"), F.col(f"count{LEVELS}").alias("count")]
    return rows.select("part", "rows", "block", root.alias("root"), *top, *(f"run{k}" for k in range(LEVELS)), *(F.col(f"w{k + 1}").alias(f"weight{k}") for k in range(LEVELS)))


def node_table(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(runs: part, level, run, nodes, weight; roots: part, size, root) of leaves (part, index, size, digest as binary, weight).

    ``nodes`` has the digests of a run, in order; ``weight`` is the number of rows below."""
    runs, roots, level = [], [], 0
    nodes = leaves.select("part", "index", F.col("size").alias("rows"), F.col("size").alias("count"), "digest", "weight")
    while True:
        rows = materialize(_folded(nodes), f"{name}-{level}")
        for k in range(LEVELS):
            listed = rows.select("part", "block", F.posexplode(F.arrays_zip(F.col(f"run{k}").alias("nodes"), F.col(f"weight{k}").alias("weight"))))
            runs.append(listed.select("part", F.lit(level + k).alias("level"), (F.col("block") * GROUP ** (LEVELS - 1 - k) + F.col("pos")).alias("run"), "col.nodes", "col.weight"))
        roots.append(rows.where("root is not null").select("part", F.col("rows").alias("size"), "root"))
        nodes = rows.where("count > 1").select("part", F.col("block").alias("index"), "rows", "count", F.col("above").alias("digest"), "weight")
        level += LEVELS
        if nodes.isEmpty():
            return materialize(functools.reduce(DataFrame.unionByName, runs), f"{name}-runs"), functools.reduce(DataFrame.unionByName, roots)


def coordinates(part: Column, index: Column, size: Column, first: int) -> Column:
    """The runs that hold a leaf's siblings, (step, part, level, run, at) from the lowest level to the root of its tree."""
    widths = F.filter(F.array(*(F.lit(GROUP**n) for n in range(21))), lambda w: w < size)

    def one(width: Column, level: Column) -> Column:
        node = _div(index, width)
        return F.struct((level + first).alias("step"), part.alias("part"), level.alias("level"), _div(node, F.lit(GROUP)).alias("run"), (node % GROUP).cast("int").alias("at"))

    return F.transform(widths, one)


def lookup(asked: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """number, step, at, nodes of ``asked`` (number, step, part, level, run, at)."""
    key = ["part", "level", "run"]
    hot = F.broadcast(nodes.where(F.col("weight") * SHARE > rows).drop("weight"))
    met = asked.join(hot, key, "left")
    cold = met.where("nodes is null").drop("nodes").join(nodes.where(F.col("weight") * SHARE <= rows).drop("weight"), key)
    return met.where("nodes is not null").unionByName(cold).select("number", "step", "at", "nodes")


def manifest(docs: DataFrame, *, part: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """``order``, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    The proof is checked with the leaf of the row as it is now: ``tampered`` gives columns that changed since the manifest."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        now = tampered or {}
        leaf = F.unhex(leaf_digest(*(F.col(c) for c in fields)))
        now_leaf = F.unhex(leaf_digest(*(now.get(c, F.col(c)) for c in fields)))
        parts = F.coalesce(F.concat(F.lit("="), F.col(part)), F.lit(""))
        leaves = docs.select(parts.alias("part"), F.col(order).alias("id"), leaf.alias("digest"), (now_leaf if now else F.lit(None).cast("binary")).alias("now"))
        leaves = leaves.withColumn("now", F.when(F.col("now") != F.col("digest"), F.col("now")))
        leaves, counts = ranked(leaves, ["id", "digest"], "manifest-leaves")
        runs, roots = node_table(indexed(leaves, counts).withColumn("weight", F.lit(1).cast("long")), "manifest-nodes")
        # the tree over the parts: its leaves are their roots, in their order
        over, over_counts = ranked(roots.select(F.lit(TOP).alias("part"), F.col("part").alias("name"), F.col("root").alias("digest"), F.col("size").alias("weight")), ["name"], "manifest-parts")
        over = indexed(over, over_counts)
        top_runs, top_roots = node_table(over, "manifest-top")
        first = top_roots.first()
        root = first["root"].hex() if first else None
        rows = roots.agg(F.sum("size")).first()[0] or 0
        above = over.select(F.col("name").alias("part"), F.col("index").alias("top_index"), F.col("size").alias("top_size"), F.col("digest").alias("subroot"))
        placed = indexed(leaves, materialize(counts.join(above, "part"), "manifest-places"), "top_index", "top_size", "subroot")
        where = F.concat(coordinates(F.col("part"), F.col("index"), F.col("size"), 0), coordinates(F.lit(TOP), F.col("top_index"), F.col("top_size"), 100))
        asked = placed.select("number", F.explode(where).alias("c")).select("number", "c.*")
        found = lookup(asked, runs.unionByName(top_runs), rows)
        own = placed.select("number", "id", "digest", "now", "subroot")
        step = F.when(F.col("step").isNotNull(), F.struct("step", "at", "nodes"))
        gathered = own.unionByName(found, allowMissingColumns=True).groupBy("number").agg(
            *(F.max(c).alias(c) for c in ("id", "digest", "now", "subroot")), F.sort_array(F.collect_list(step)).alias("steps")
        )
        made = materialize(gathered.select(F.col("id").alias(order), *_checked(root)), "manifest-proofs")
        keep(made)
    return made


def _checked(root: str | None) -> list[Column]:
    """The siblings on both sides of a leaf, concatenated, and what they fold to."""
    width = 64
    left = lambda x: F.substring(_text(x["nodes"]), F.lit(1), x["at"] * width)
    right = lambda x: F.substring(_text(x["nodes"]), x["at"] * width + (width + 1), F.lit(GROUP * width))
    leaf, whole = _text(F.col("digest")), F.lit(root).cast("string")
    proof = F.sha2(F.array_join(F.transform("steps", lambda x: F.concat(left(x), right(x))), ""), 256)
    folded = F.aggregate("steps", F.coalesce(_text(F.col("now")), leaf), lambda a, x: F.sha2(F.concat(left(x), a, right(x)), 256))
    return [leaf.alias("leaf"), _text(F.col("subroot")).alias("subroot"), whole.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"), (folded == whole).alias("verified")]


def lower_cased(doc_id: Column, text: Column) -> Column:
    """``text`` with A-Z lower-cased in the rows that the check tampers with: those where 3 divides the id's CRC-32."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, A_Z, LOWERED)).otherwise(text)
