"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of blocks. A block holds some documents, their sorted distinct terms (word hashes) and each
term's ascending word positions, so a list can be intersected with another after shifting it by the distance of
the two terms in a phrase. It is split by document: a search needs no shuffle, the postings never move, and a term
that every document has only makes its list in each block longer. The test items travel to the blocks, in portions
of bounded size.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import bounded_batches, free_name, materialize, pieces, row_hash, scratch
from quillon.llm.textarrays import row_of, words

WINDOW = 13
BLOCK_BYTES = 2 << 20
#: Characters of test items that are sent to the executors at once: a portion's broadcast takes some ten bytes for each at
#: most (a word number and a vocabulary entry a word). Further portions are searched one after the other.
PORTION_CHARACTERS = 2 << 20
#: Windows of a portion that a block looks up at once.
WINDOWS_AT_ONCE = 1 << 14
BROADCAST_IDS = 400_000

_INDEX = "block string, doc_id array<long>, first binary, terms binary, starts binary, positions binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", BLOCK_BYTES):
            w, first = words(part.column("text"))
            order = np.argsort(w, kind="stable").astype(np.int32)
            ranked = w[order]
            starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(w) else np.zeros(0, np.int64)
            ids = pa.array([part.column("doc_id").cast(pa.int64()).to_pylist()], pa.list_(pa.int64()))
            blobs = [first.astype(np.int32), ranked[starts], np.append(starts, len(w)).astype(np.int32), order]
            columns = [pa.array([uuid.uuid4().hex]), ids, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "first", "terms", "starts", "positions"])


def build_index(docs: DataFrame) -> DataFrame:
    """Write the positional index of docs (doc_id, text; other columns are ignored) to the shared folder.

    Null and empty texts are documents without words; null ids and repeated rows are documents of their own.
    """
    bounded_batches(docs.sparkSession)
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_build, _INDEX), "postings")


class _Items:
    """Test items as vocabulary numbers: every window of ``WINDOW`` words, or the whole of a shorter item."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        w, first = words(pa.array(texts, pa.string()))
        self.ids = ids
        self.vocabulary, number = np.unique(w, return_inverse=True)
        self.number = number.astype(np.int32)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: item and first word of each
        item = row_of(first)
        counts = np.diff(first)
        for n in sorted({min(int(c), WINDOW) for c in counts if c}):
            if n == WINDOW:
                at = np.arange(max(len(w) - n + 1, 0))
                at = at[item[at] == item[at + n - 1]]
            else:
                at = first[:-1][counts == n]
            self.windows[n] = item[at], at
        self.words = [np.unique(number[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


    def occurrences(self, block: _Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words of the window, item, position in the block) of the windows' occurrences, some windows at a time."""
        for n, (item, at) in self.windows.items():
            for a in range(0, len(at), WINDOWS_AT_ONCE):
                part = at[a : a + WINDOWS_AT_ONCE]
                which, found = block.phrase(self.number[part[:, None] + np.arange(n)])
                yield n, item[a : a + WINDOWS_AT_ONCE][which], found


class _Block:
    def __init__(self, first: bytes, terms: bytes, starts: bytes, positions: bytes, vocabulary: np.ndarray):
        self.first = np.frombuffer(first, np.int32).astype(np.int64)
        self.total = int(self.first[-1])
        starts, places = np.frombuffer(starts, np.int32).astype(np.int64), np.frombuffer(positions, np.int32)
        terms = np.frombuffer(terms, np.uint64)
        at = np.searchsorted(terms, vocabulary)
        there = at < len(terms)
        there[there] = terms[at[there]] == vocabulary[there]
        #: The vocabulary's lists one after another: ascending keys of (word number, position).
        self.count = np.zeros(len(vocabulary), np.int64)
        self.count[there] = starts[at[there] + 1] - starts[at[there]]
        self.begin = np.concatenate([[0], np.cumsum(self.count)])
        source = np.repeat(np.where(there, starts[np.minimum(at, len(starts) - 1)], 0) - self.begin[:-1], self.count) + np.arange(self.begin[-1])
        self.position = places[source].astype(np.int64)
        self.key = np.repeat(np.arange(len(vocabulary)), self.count) * (self.total + 1) + self.position

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def lists(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``numbers``, position) for the whole list of each."""
        n = self.count[numbers]
        which = np.repeat(np.arange(len(numbers)), n)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.position[self.begin[numbers[which]] + inner]

    def phrase(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first position) of every occurrence of the phrases (rows of equally many word numbers).

        The rarest word's list, shifted to the phrase's start, is intersected with the next rarest and so on.
        """
        n = numbers.shape[1]
        live = np.flatnonzero((self.count[numbers] > 0).all(axis=1))
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(live):  # some phrases at a time, so that candidates stay few
            cost = np.cumsum(self.count[numbers[live]].min(axis=1))
            part, live = np.split(live, [max(1, int(np.searchsorted(cost, 2_000_000)))])
            order = np.argsort(self.count[numbers[part]], axis=1, kind="stable")
            which, at = self.lists(numbers[part, order[:, 0]])
            at = at - order[which, 0]
            fits = (at >= 0) & (at + n <= self.total)
            which, at = which[fits], at[fits]
            for k in range(1, n):
                place = order[which, k]
                key = numbers[part[which], place] * (self.total + 1) + at + place
                spot = np.searchsorted(self.key, key)
                same = spot < len(self.key)
                same[same] = self.key[spot[same]] == key[same]
                which, at = which[same], at[same]
            inside = self.document(at) == self.document(at + n - 1)
            found[0].append(part[which[inside]])
            found[1].append(at[inside])
        return np.concatenate(found[0]), np.concatenate(found[1])

    def near(self, numbers: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the first word that have each other word at most ``slop`` words away in the same document."""
        at = self.lists(numbers[:1])[1]
        for other in numbers[1:]:
            low = np.maximum(at - slop, self.first[self.document(at)])
            high = np.minimum(at + slop, self.first[self.document(at) + 1] - 1)
            spot = np.searchsorted(self.key, other * (self.total + 1) + low)
            good = spot < len(self.key)
            good[good] = self.key[spot[good]] <= other * (self.total + 1) + high[good]
            at = at[good]
        return at


def _portions(items: DataFrame, limit: int = PORTION_CHARACTERS) -> Iterator[tuple[list[str], list[str | None]]]:
    ids, texts, size = [], [], 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"] or "")
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _columns(batch: pa.RecordBatch, i: int, vocabulary: np.ndarray) -> _Block:
    return _Block(*(batch.column(c)[i].as_py() for c in ("first", "terms", "starts", "positions")), vocabulary)


def _covered(shared):
    schema = pa.schema([("block", pa.string()), ("nth", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.binary()), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                block = _columns(batch, i, items.vocabulary)
                edge = np.zeros(block.total + 1, np.int32)
                docs, whose = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for n, item, at in items.occurrences(block):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n, -1)
                    docs.append(block.document(at))
                    whose.append(item)
                hit = np.cumsum(edge[:-1]) > 0
                pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(whose)]), axis=1)
                count = len(block.first) - 1
                mine = [sorted({items.ids[k] for k in pairs[1][a:b]}) for a, b in zip(*(np.searchsorted(pairs[0], np.arange(count) + j) for j in (0, 1)), strict=True)]
                places = np.flatnonzero(hit)
                of = np.searchsorted(places, block.first)
                spans = [(places[a:b] - block.first[d]).astype(np.int32).tobytes() for d, (a, b) in enumerate(zip(of[:-1], of[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("block")[i].as_py()] * count), pa.array(np.arange(count, dtype=np.int32)), pa.array(batch.column("doc_id")[i].as_py(), pa.int64()),
                     pa.array(np.diff(block.first)), pa.array(spans, pa.binary()), pa.array(mine, pa.list_(pa.string()))], schema=schema)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [len(np.unique(np.frombuffer(b"".join(x), np.int32))) for x in batch.column("spans").to_pylist()]
        names = [[v for p in x for v in p] for x in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([sorted(set(x)) for x in names], pa.list_(pa.string()))],
            ["doc_id", "n_words", "n_hit", "item_ids"],
        )


def contamination(docs: DataFrame, items: DataFrame, *, index: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated.

    Words are runs of digits, ASCII letters (lower-cased) and everything beyond ASCII. A window is 13 consecutive words
    of an item, or the whole of a shorter item that has words. n_hit counts the document's words inside any occurrence
    of a window, item_ids the items (as sorted strings; a null id is the empty string) with an occurrence. Contaminated:
    n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words; empty items hit nothing; repeated rows
    are judged each; an empty table of items leaves every document clean. Columns beyond the named are ignored. A doc_id
    that is no number is an error. Words are compared by 64-bit hashes: two different words pass for one with a chance of
    2**-64, and a window is hit wrongly only if that befalls each word in which it differs.
    """
    sc = docs.sparkSession.sparkContext
    index = build_index(docs) if index is None else index
    kinds = "block string, nth int, doc_id long, n_words long, spans binary, items array<string>"
    portions = _portions(items)
    ahead = [x for x in (next(portions, ([], [])), next(portions, None)) if x is not None]
    if len(ahead) == 1:
        told = index.mapInArrow(_covered(sc.broadcast(_Items(*ahead[0]))), kinds)
        lists = told.select("doc_id", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
    else:  # each portion's hits are written before the next portion is read; a document's hits are put together
        parts = [index.mapInArrow(_covered(sc.broadcast(_Items([], []))), kinds)]
        for ids, texts in itertools.chain(ahead, portions):
            shared = sc.broadcast(_Items(ids, texts))
            parts.append(materialize(index.mapInArrow(_covered(shared), kinds).where("size(items) > 0"), "portion-hits"))
            shared.destroy()
        lists = reduce(DataFrame.unionByName, parts).groupBy("block", "nth").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")
        ).drop("block", "nth")
    out = lists.mapInArrow(_merge, "doc_id long, n_words long, n_hit long, item_ids array<string>")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``contamination`` calls contaminated; all columns stay.

    Every row is judged by its own text, whatever other rows have its doc_id and whether it has one: rows are told apart
    by a 64-bit hash of doc_id and text. Repeated rows share their fate, null and empty texts stay, empty tables give
    what they can."""
    lost_name = free_name(docs, "lost")
    row = row_hash("doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        judged = contamination(docs.select(row.alias("doc_id"), "text"), items)
        lost = materialize(judged.where("contaminated").select(F.col("doc_id").alias(lost_name)).distinct(), "contaminated")
        keep(lost)
    if lost.count() <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    return docs.join(lost, row == F.col(lost_name), "left_anti")


def phrase_matches(index: DataFrame, items: DataFrame) -> DataFrame:
    """Every occurrence of every window: doc_id, item_id, position (in words from the document's start), n_words."""
    sc = index.sparkSession.sparkContext
    found = None

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    block, ids = _columns(batch, i, items.vocabulary), batch.column("doc_id")[i].as_py()
                    for n, item, at in items.occurrences(block):
                        doc = block.document(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[d] for d in doc], pa.int64()), pa.array([items.ids[k] for k in item], pa.string()), pa.array(at - block.first[doc]), pa.array(np.full(len(at), n, np.int32))],
                            ["doc_id", "item_id", "position", "n_words"],
                        )

        return run

    for ids, texts in _portions(items):
        part = index.mapInArrow(search(sc.broadcast(_Items(ids, texts))), "doc_id long, item_id string, position long, n_words int")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else index.sparkSession.createDataFrame([], "doc_id long, item_id string, position long, n_words int")


def term_frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences in the whole index of each term of ``vocabulary``; one sum per block and term travels."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total += _columns(batch, i, shared.value).count
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for row in index.select("first", "terms", "starts", "positions").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    return out


def proximity_matches(index: DataFrame, items: DataFrame, *, terms: int = 4, slop: int = 20) -> DataFrame:
    """Occurrences of an item's rarest term (by the index's frequencies, ties by hash) that have each of its next
    rarest ``terms`` - 1 distinct terms at most ``slop`` words away: doc_id, item_id, position. Items with fewer
    distinct words use all of them."""
    sc = index.sparkSession.sparkContext
    found = None

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, rarest = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    block, ids = _columns(batch, i, items.vocabulary), batch.column("doc_id")[i].as_py()
                    rows = []
                    for name, numbers in zip(items.ids, rarest, strict=True):
                        if len(numbers) and (block.count[numbers] > 0).all():
                            at = block.near(numbers, slop)
                            doc = block.document(at)
                            rows += zip((ids[d] for d in doc), [name] * len(at), (at - block.first[doc]).tolist(), strict=True)
                    columns = list(zip(*rows, strict=True)) or [[], [], []]
                    kinds = (pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "position"])

        return run

    for ids, texts in _portions(items):
        made = _Items(ids, texts)
        df = term_frequencies(index, made.vocabulary)
        rarest = [w[np.argsort(df[w], kind="stable")][:terms] for w in made.words]
        part = index.mapInArrow(search(sc.broadcast((made, rarest))), "doc_id long, item_id string, position long")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else index.sparkSession.createDataFrame([], "doc_id long, item_id string, position long")
