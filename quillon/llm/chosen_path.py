"""N-gram Jaccard self-join of documents by chosen paths.

Every document is the set of its five-word shingles (hashed). In each of several runs a tree is grown: a node is
a path of shared tokens, and a set at a node descends to the tokens whose hash under that path is below
1 / (threshold * set size). Two sets of similarity at or above the threshold agree on at least one choice per
level on average, so they meet in some bucket of some run; the number of runs follows from the target recall.
Buckets with few sets are compared outright. A bucket that is too large is split two levels deeper; what is still
large there is a group of near copies. A large group is measured against its consensus, the set of the tokens that at
least half of its members have: members close enough to it are all linked with each other by the triangle inequality of
the symmetric difference, so their links are counted without looking at pairs. The rest of the group is compared in
blocks by exact set intersection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.llm.store import bounded_batches, materialize, pieces, row_keys, scratch
from quillon.llm.textarrays import mix, row_of, words

SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
BUCKET = 64
#: Sets and tokens of a block of a hot group.
BLOCK = 1024
BLOCK_TOKENS = 1 << 20
BROADCAST_IDS = 400_000

_TOKEN_BITS = np.uint64(48)
_TOKEN_MASK = np.uint64((1 << 48) - 1)
_CHILD = np.uint64(0xC2B2AE3D27D4EB4F)
_SKETCH = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def runs_for(recall: float, depth: int = 4) -> int:
    """Runs until a pair at the threshold meets at ``depth`` with probability ``recall``.

    The choices two such sets share per level are Poisson with a mean of at least one (the contained set is the
    worst case), which gives the chance of a common path by iterating s = 1 - exp(-s').
    """
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-s)
    return math.ceil(math.log(1 - recall) / math.log(1 - s))


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 48-bit shingle hashes of all rows, first of every row). Fewer than k words, but not none,
    are one shingle; no words give the empty set."""
    w, first = words(column)
    counts = np.diff(first)
    n = max(len(w) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    rows = row_of(first)
    inside = rows[:n] == rows[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
    h, at = mix(h[inside]), rows[:n][inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.full(len(short), 0x5BD1E995, np.uint64)
        for j in range(k - 1):
            there = counts[short] > j
            extra[there] = extra[there] * np.uint64(0x9E3779B97F4A7C15) + w[first[short[there]] + j]
        h, at = np.concatenate([h, mix(extra)]), np.concatenate([at, short])
    keys = np.unique((at.astype(np.uint64) << _TOKEN_BITS) | (h & _TOKEN_MASK))
    return keys & _TOKEN_MASK, np.searchsorted(keys, np.arange(len(counts) + 1, dtype=np.uint64) << _TOKEN_BITS)


def _children(paths: np.ndarray, tokens: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(index of the parent, child path) of every choice of ``tokens`` below ``paths``."""
    parents, kids = [], []
    for at in range(0, len(tokens), 65536):
        part = tokens[at : at + 65536]
        p, t = np.nonzero(paths[:, None] * part[None, :] < limit)
        parents.append(p)
        kids.append(mix(paths[p] + part[t] * _CHILD) | np.uint64(1))
    return np.concatenate(parents), np.concatenate(kids)


def _sketch(tokens: np.ndarray) -> int:
    """64 one-bit min-hashes."""
    low = np.full(64, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(tokens), 16384):
        np.minimum(low, (_SKETCH[:, None] * tokens[None, at : at + 16384]).min(axis=1), out=low)
    return int(np.packbits((mix(low) & np.uint64(1)).astype(np.uint8)).view(np.int64)[0])


_FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("sketch", pa.int64())]
    + [("p2", pa.list_(pa.int64())), ("p4", pa.list_(pa.int64())), ("p4_in", pa.list_(pa.int64()))]
)


def _digests(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((2, len(tokens) + 1), np.uint64)
    for k in range(2):
        np.cumsum(mix(tokens + np.uint64(0x1234567 * (k + 1))), out=total[k, 1:])
    both = total[:, first[1:]] - total[:, first[:-1]]
    return mix(both[0] + np.diff(first).astype(np.uint64)).view(np.int64), mix(both[1]).view(np.int64)


def _features(k: int, threshold: float, runs: int):
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)

    def of_set(tokens: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if len(tokens) < threshold / (1 - threshold) - 1e-9:  # a smaller set has no similar set but itself
            return 0, none, none, none
        limit = np.uint64(min(1 / (threshold * len(tokens)), 1 - 1e-9) * 2.0**64)
        shifted = tokens << np.uint64(16)
        _, one = _children(roots, shifted, limit)
        _, two = _children(one, shifted, limit)
        up, three = _children(two, shifted, limit)
        last, four = _children(three, shifted, limit)
        return _sketch(shifted), two.view(np.int64), four.view(np.int64), two[up[last]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                tokens, first = shingle_sets(part.column("text"), k)
                hi, lo = _digests(tokens, first)
                each = [of_set(tokens[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                lists = []
                for j in (1, 2, 3):
                    values = np.concatenate([x[j] for x in each])
                    ends = np.concatenate([[0], np.cumsum([len(x[j]) for x in each])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                columns = [part.column("doc_id").cast(pa.int64()), part.column("key").cast(pa.int64()), pa.array(hi), pa.array(lo), pa.array(np.diff(first).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in each], pa.int64()), *lists], schema=_FEATURES)

    return run


def _sets(k: int):
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                tokens, first = shingle_sets(part.column("text"), k)
                hi, lo = _digests(tokens, first)
                blobs = [tokens[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(blobs, pa.binary())], schema=schema)

    return run


def _bucket_pairs(threshold: float, bucket: int):
    """Candidate pairs within equal paths of a partition sorted by path; the size and sketch filters lose no more
    than one pair in a million at the threshold."""
    differing = 64 - math.floor(64 * (1 + threshold) / 2 - 5 * math.sqrt(64 * (1 - ((1 + threshold) / 2)) * (1 + threshold) / 2))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(path, node, n, sketch) -> Iterator[pa.RecordBatch]:
        found = []
        for d in range(1, bucket):
            if len(path) <= d or not (same := path[d:] == path[:-d]).any():
                break
            x, y = node[:-d][same], node[d:][same]
            m, o = n[:-d][same], n[d:][same]
            near = np.bitwise_count((sketch[:-d][same] ^ sketch[d:][same]).view(np.uint64)) <= differing
            near &= (np.minimum(m, o) >= threshold * np.maximum(m, o) - 1e-9) & (x != y)
            found.append(np.stack([np.minimum(x, y)[near], np.maximum(x, y)[near]]))
        if found:
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "node", "n", "sketch")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            cut = np.searchsorted(now[0], now[0][-1])  # the last path may go on in the next batch
            rest = [x[cut:] for x in now]
            yield from pairs(*(x[:cut] for x in now))
        if rest is not None:
            yield from pairs(*rest)

    return run


def _verify(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("tokens_a", "tokens_b")]
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = shared >= threshold * (len(x) + len(y) - shared) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], schema=schema)

    return run


def _block(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of one pair of blocks: per node the weight of its partners and a local root to join it to."""
        rows = rows.sort_values(["block", "node"], ignore_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
        n = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        token, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, (_, column) = owner[shared], np.unique(column[shared], return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, width, 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(sets), min(4096, width - at)), np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            common += part @ part.T
        link = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6
        np.fill_diagonal(link, False)
        block, weight = rows["block"].to_numpy(), rows["size"].to_numpy().astype(np.float64)
        if block[0] != block[-1]:
            link &= block[:, None] != block[None, :]
        elif rows["i"].iloc[0] != rows["j"].iloc[0]:
            link[:] = False  # the partner block is empty
        root = np.arange(len(sets))
        while True:
            least = np.minimum(root, np.where(link, root[None, :], len(sets)).min(axis=1))
            least = least[least]
            if (least == root).all():
                break
            root = least
        node = rows["node"].to_numpy()
        return pd.DataFrame({"node": node, "links": (link @ weight).astype(np.int64), "root": node[root]})

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, token, members that have it) of each batch."""
    for batch in batches:
        group = batch.column("g").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
        for g in np.unique(group):
            token, count = np.unique(np.concatenate([sets[i] for i in np.flatnonzero(group == g)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), g)), pa.array(token.view(np.int64)), pa.array(count)], ["g", "token", "n"])


def _is_core(threshold: float):
    """Whether a member's distance d to the consensus is at most kappa times its size: J(a, b) >= threshold says that
    the distance of a and b is at most kappa (|a| + |b|), and it never exceeds the sum of their distances to it."""
    kappa = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = np.zeros(batch.num_rows, bool)
            for i, (own, common) in enumerate(zip(batch.column("tokens").to_pylist(), batch.column("consensus").to_pylist(), strict=True)):
                own, common = np.frombuffer(own, np.uint64), np.array(common or [], np.int64).view(np.uint64)
                apart = len(own) + len(common) - 2 * len(np.intersect1d(own, common, assume_unique=True))
                core[i] = apart <= kappa * len(own) - 1e-6
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "node", "size", "tokens")), pa.array(core)], ["g", "node", "size", "tokens", "core"])

    return run


def _hot_links(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """node, links, root of the members of hot groups: rows of one node add up; root is a linked node of the group."""
    members = materialize(groups.join(sets, "node").select("g", "node", "size", "tokens"), "hot-members")
    weight = F.octet_length("tokens") / 8
    sizes = materialize(members.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.sum(weight).alias("weight")), "hot-sizes")
    few = sizes.count() <= BROADCAST_IDS
    bounded = F.broadcast if few else (lambda x: x)

    big = bounded(sizes.where(F.col("members") > BLOCK).select("g", "members"))
    inside = members.join(big, "g")
    common = inside.select("g", "tokens").mapInArrow(_tally, "g long, token long, n long").groupBy("g", "token").agg(F.sum("n").alias("n"))
    common = common.join(big, "g").where(2 * F.col("n") >= F.col("members")).groupBy("g").agg(F.collect_list("token").alias("consensus"))
    common = materialize(common, "consensus")  # at most twice the mean size of a member each
    held = common.agg(F.coalesce(F.sum(F.size("consensus")), F.lit(0))).first()[0]
    near = inside.join(F.broadcast(common) if held <= 4 * BROADCAST_IDS else common, "g", "left")
    kinds = "g long, node long, size long, tokens binary, core boolean"
    big_ones = near.select("g", "node", "size", "tokens", "consensus").mapInArrow(_is_core(threshold), kinds)
    small = members.join(bounded(sizes.where(F.col("members") <= BLOCK).select("g")), "g", "left_semi").withColumn("core", F.lit(False))
    told = materialize(big_ones.unionByName(small), "hot-told")

    cliques = told.where("core").groupBy("g").agg(F.sum("size").alias("total"), F.min("node").alias("root"))
    sure = told.where("core").join(bounded(cliques), "g").select("node", (F.col("total") - F.col("size")).alias("links"), "root")

    def blocks(kind: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(kind) / BLOCK, F.coalesce(F.sum(F.when(kind, weight)), F.lit(0.0)) / BLOCK_TOKENS)).cast("int")

    dealt = told.groupBy("g").agg(blocks(~F.col("core")).alias("rest"), blocks(F.col("core")).alias("cores"))
    dealt = told.join(bounded(dealt.where("rest > 0")), "g")
    spot = F.xxhash64("node")
    dealt = dealt.withColumn("block", F.when(F.col("core"), F.col("rest") + F.pmod(spot, F.greatest("cores", F.lit(1)))).otherwise(F.pmod(spot, F.col("rest"))).cast("int"))
    last = F.when(F.col("core"), F.col("rest")).otherwise(F.col("rest") + F.col("cores")) - 1
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("other"))
    dealt = dealt.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "size", "tokens")
    compared = dealt.groupBy("g", "i", "j").applyInPandas(_block(threshold), "node long, links long, root long")
    return materialize(sure.unionByName(compared), "hot-links")


def near_duplicate_classes(
    docs: DataFrame, *, k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, bucket: int = BUCKET
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, class_id, copies, n_links.

    class_id is the smallest doc_id of the connected group of similar documents, copies the rows with the same
    shingle set (this one included), n_links the other rows of similarity at or above ``threshold``: each other
    copy and each copy of every linked set. Null texts and texts without words are similar to nothing: their
    class_id is their doc_id, copies 1, n_links 0. A null doc_id is allowed; such a row stands for its class only
    where no row of it has an id. Repeated rows count as copies. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("key"), "text")
    with scratch(docs.sparkSession) as keep:
        features, known = _classes(docs, k, threshold, recall, bucket)
        keep(features)
        keep(known)
    out = features.select("doc_id", F.when(F.col("n") > 0, F.col("hi")).alias("hi"), F.when(F.col("n") > 0, F.col("lo")).alias("lo")).join(known, ["hi", "lo"], "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("copies"),
        (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )


def _classes(docs: DataFrame, k: int, threshold: float, recall: float, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(the features of every row of ``docs`` (doc_id, key, text), the classes of equal shingle sets: hi, lo, size,
    links, class_id, first). first is the class's first row by doc_id, a null one last, and key."""
    features = docs.mapInArrow(_features(k, threshold, runs_for(recall)), _ddl(_FEATURES))
    features = materialize(features, "shingle-features")
    rowed = features.select("*", F.monotonically_increasing_id().alias("row"))
    nodes = rowed.where("n > 0").groupBy("hi", "lo").agg(
        F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("size")
    )
    nodes = materialize(nodes, "shingle-classes")
    chosen = rowed.where("size(p2) > 0").join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    chosen = materialize(chosen.select(F.col("row").alias("node"), "n", "sketch", "p2", "p4", "p4_in"), "chosen-paths")

    def buckets(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(the candidate pairs of buckets with few sets, the rows of the others, their paths). Counts are combined before they move,
        so the rows of a crowded path never meet in one task."""
        crowded = materialize(rows.groupBy("path").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > bucket).select("path"), "crowded-paths")
        known = F.broadcast(crowded) if crowded.count() <= BROADCAST_IDS else crowded
        light = rows.join(known, "path", "left_anti").repartition("path").sortWithinPartitions("path")
        return light.select("path", "node", "n", "sketch").mapInArrow(_bucket_pairs(threshold, bucket), "a long, b long"), rows.join(known, "path", "left_semi"), known

    shallow, _, large = buckets(chosen.select("node", "n", "sketch", F.explode("p2").alias("path")))
    deeper = chosen.select("node", "n", "sketch", F.explode(F.arrays_zip("p4", "p4_in")).alias("x"))
    deeper = deeper.select("node", "n", "sketch", F.col("x.p4").alias("path"), F.col("x.p4_in").alias("parent"))
    deeper = materialize(deeper.join(large.withColumnRenamed("path", "parent"), "parent", "left_semi").drop("parent"), "deeper-paths")
    deep, hot, crowded = buckets(deeper)

    roots = hot.groupBy("path").agg(F.min("node").alias("b"))
    if crowded.count() <= BROADCAST_IDS:
        roots = F.broadcast(roots)
    groups = connected_components(hot.select(F.col("node").alias("a"), "path").join(roots, "path").select("a", "b"))
    groups = materialize(groups.select("node", F.col("component").alias("g")), "hot-groups")

    candidates = shallow.unionByName(deep).distinct()
    for end in ("a", "b"):
        candidates = candidates.join(groups.select(F.col("node").alias(end), F.col("g").alias(f"g_{end}")), end, "left")
    candidates = materialize(candidates.where("g_a is null or g_b is null or g_a <> g_b").select("a", "b"), "candidate-pairs")

    needed = candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).unionByName(groups.select("node")).distinct()
    needed = materialize(nodes.join(needed, "node"), "needed-sets")
    ids = needed.select(F.col("first.doc_id").alias("wanted")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = texts.mapInArrow(_sets(k), "hi long, lo long, tokens binary").join(needed, ["hi", "lo"]).dropDuplicates(["node"])
    sets = materialize(sets.select("node", "size", "tokens"), "sets")

    sided = candidates
    for end in ("a", "b"):
        sided = sided.join(sets.select(F.col("node").alias(end), F.col("tokens").alias(f"tokens_{end}")), end)
    links = materialize(sided.mapInArrow(_verify(threshold), "a long, b long"), "links")

    blocks = _hot_links(groups, sets, threshold)

    weight = nodes.select("node", "size")
    degree = links.select(F.col("a").alias("to"), F.col("b").alias("node")).unionByName(links.select(F.col("b").alias("to"), F.col("a").alias("node")))
    degree = degree.join(weight, "node").select(F.col("to").alias("node"), F.col("size").alias("links")).unionByName(blocks.select("node", "links"))
    degree = degree.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(links.unionByName(blocks.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")))
    known = nodes.join(parts, "node", "left").join(degree, "node", "left")
    known = materialize(known.select("hi", "lo", "size", "first", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    least = known.where("links > 0").groupBy("component").agg(F.min("first").alias("least"))
    known = known.join(least, "component", "left").select("hi", "lo", "size", "links", F.coalesce("least", "first").alias("first"))
    return features, materialize(known.withColumn("class_id", F.col("first.doc_id")), "near-classes")


def keep_one_per_class(
    docs: DataFrame, *, k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, bucket: int = BUCKET
) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest doc_id, one without an id only where no row of the
    class has one. Rows that share a doc_id but not the text are judged each; repeated rows become one. Rows without
    words are in no class."""
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        rows, unnamed = row_keys(docs)
        slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__key").alias("key"), "text")
        features, known = _classes(slim, k, threshold, recall, bucket)
        placed = features.where("n > 0").select("doc_id", "key", "hi", "lo").join(known.where("size > 1 or links > 0").select("hi", "lo", "first"), ["hi", "lo"])
        stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
        lost = materialize(placed.where(~stays).select(F.col("doc_id").alias("__dropped"), F.col("key").alias("__dropped_key")).distinct(), "near-copies")
        repeated = features.groupBy("doc_id", "key").count().where("count > 1").limit(1).count()
        keep(unnamed)
        keep(lost)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__dropped")) & (F.col("__key") == F.col("__dropped_key"))
    kept = rows.join(lost, same, "left_anti")
    return (kept.dropDuplicates(["doc_id", "__key"]) if repeated else kept).select(*docs.columns)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int64()): "array<long>", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)
