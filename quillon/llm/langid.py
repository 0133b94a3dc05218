"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added up in log space: the likelihood of the text's letter trigrams, the language that the
markup declares, the suffix of the address, and a prior of the host. How far a declaration or suffix can be trusted
and what a host usually holds are counted over all rows, by grouped aggregation over the languages that the texts
alone suggest; a host's counts are smoothed by its domain's, and these by the whole table's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillon.llm.html_paths import main_text
from quillon.llm.store import bounded_batches, free_name, materialize, pieces, row_hash, scratch
from quillon.llm.textarrays import LOWER, utf8
from quillon.llm.url_filter import host_of

#: The trigram model is fitted on up to this many distinct labelled texts, shared evenly among the languages (each gets
#: LEAST_A_LANGUAGE at least, and all its texts where it has fewer), chosen by a hash of the text; all other counts cover
#: every row.
SAMPLE_ROWS = 4000
LEAST_A_LANGUAGE = 200
#: A model tells this many labels apart, those of the most distinct texts (ties by name); all further labels are one
#: class, RARE. There are fewer languages with a code of two letters, so only dirty columns come so far.
MAX_LANGUAGES = 256
RARE = "other"
#: Buckets of trigrams are 2 ** GRAM_BITS, or fewer where there are so many languages that the model would have more
#: than MODEL_CELLS cells (above 64 languages); the number of rows plays no part.
GRAM_BITS = 16
MODEL_CELLS = 1 << 22
#: A text weighs like at most this many independent trigrams, so that long texts don't silence all other evidence.
TEXT_WEIGHT = 40.0
SMOOTHING = 20.0
LEAST_POSTERIOR = 0.5
BROADCAST_ROWS = 200_000
BROADCAST_CELLS = 2_000_000

_LETTER = np.zeros(256, np.bool_)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


@dataclass(frozen=True)
class TrigramModel:
    languages: list[str]
    log_p: np.ndarray  # languages x buckets

    @property
    def bits(self) -> int:
        return self.log_p.shape[1].bit_length() - 1


def trigrams(column: pa.Array, bits: int = GRAM_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every letter trigram, first of every row). A run of other bytes counts as one blank, as do the ends,
    so that a text has trigrams if and only if it has letters."""
    column = pc.binary_join_element_wise(" ", pc.fill_null(column.cast(pa.string()), ""), " ", "")
    raw, offsets = utf8(column)
    raw = LOWER[raw]
    raw = np.where(_LETTER[raw], raw, np.uint8(32))
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    keep[offsets[:-1]] = True  # a row's own first blank, whatever the row before ends with
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    raw = raw[keep].astype(np.uint32)
    gram = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:] if len(raw) > 2 else np.zeros(0, np.uint32)
    bucket = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)
    inside = np.zeros(len(bucket), bool)
    # a row of n bytes has n - 2 trigrams
    edge = np.zeros(len(bucket) + 1, np.int32)
    n = np.maximum(np.diff(ends) - 2, 0)
    np.add.at(edge, np.minimum(ends[:-1], len(bucket)), (n > 0).astype(np.int32))
    np.add.at(edge, np.minimum(ends[:-1] + n, len(bucket)), -(n > 0).astype(np.int32))
    inside = np.cumsum(edge[:-1]) > 0
    return bucket[inside], np.concatenate([[0], np.cumsum(n)])


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                bucket, first = trigrams(part.column("text"), bits)
                spoken = part.column("language").to_pylist()
                for language in set(spoken):
                    rows = np.array([x == language for x in spoken])
                    n = np.bincount(bucket[np.repeat(rows, np.diff(first))], minlength=1 << bits)
                    seen = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen])], ["language", "bucket", "n"])

    return run


def hash_bound(quota: int, texts: int) -> int:
    """Texts whose 63-bit hash is below this are in the sample: all of them where there are few, else about ``quota``
    at any number of texts."""
    return (1 << 63) - 1 if texts <= 1.1 * quota else max(1, (quota << 63) // texts)


def _classes(labelled: DataFrame, most: int) -> tuple[DataFrame, list[Row]]:
    """(``labelled`` with the labels beyond the ``most`` that have most texts renamed to RARE, the classes with their
    numbers of distinct texts). At most ``most`` + 2 rows come to the driver, however many labels there are."""
    hashed = labelled.select("language", F.xxhash64("text").alias("h"))
    counted = hashed.groupBy("language").agg(F.approx_count_distinct("h", 0.02).alias("texts"))
    found = counted.orderBy(F.desc("texts"), "language").limit(most + 1).collect()
    if len(found) <= most:
        return labelled, found
    names = [r["language"] for r in found[:most]]
    labelled = labelled.withColumn("language", F.when(F.col("language").isin(names), F.col("language")).otherwise(RARE))
    rest = labelled.where(F.col("language") == RARE).agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")).first()["texts"]
    return labelled, [*(r for r in found[:most] if r["language"] != RARE), Row(language=RARE, texts=rest)]


def train(labelled: DataFrame, *, sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> TrigramModel:
    """Fit the trigram model on a sample of labelled (text, language) for each language; rows without either are not
    used. Up to ``max_languages`` labels every one is in the model, whatever its share, unless none of its texts has
    letters; of more labels those with the fewest texts share the class RARE. Equal texts of a language count once.
    Without any labelled text there is one language, und; labels whose sample comes out empty raise an error."""
    bounded_batches(labelled.sparkSession)
    labelled, found = _classes(labelled.select("text", "language").where("text is not null and language is not null"), max_languages)
    quota = max(LEAST_A_LANGUAGE, sample_rows // max(len(found), 1))
    bits = min(GRAM_BITS, max(1, MODEL_CELLS // max(len(found), 1)).bit_length() - 1)
    bound = {r["language"]: hash_bound(quota, r["texts"]) for r in found}
    if not bound:
        return TrigramModel(["und"], np.full((1, 1 << bits), -np.log(1 << bits), np.float32))
    shares = F.broadcast(labelled.sparkSession.createDataFrame(list(bound.items()), "language string, bound long"))
    sample = labelled.join(shares, "language").where(F.shiftrightunsigned(F.xxhash64("text"), 1) < F.col("bound"))
    sample = sample.select("text", "language").distinct()
    counts = sample.mapInArrow(_count(bits), "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty and not sample.limit(1).count():
        raise RuntimeError(f"no text was drawn from {sum(r['texts'] for r in found)} labelled ones")
    languages = sorted(counts["language"].unique()) or ["und"]
    table = np.full((len(languages), 1 << bits), 0.1)
    row = {language: i for i, language in enumerate(languages)}
    np.add.at(table, (counts["language"].map(row).to_numpy(np.int64), counts["bucket"].to_numpy(np.int64)), counts["n"].to_numpy())
    return TrigramModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def score_texts(rows: DataFrame, model: TrigramModel, *, is_html: bool = False) -> DataFrame:
    """Replaces ``text`` by n_grams and likelihood (mean log likelihood of a trigram, per language of the model).
    With ``is_html`` the text is a page, whose article is scored."""
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p, bits = shared.value.log_p, shared.value.bits
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text")
                if is_html:
                    texts = pa.array([main_text(x) for x in texts.to_pylist()], pa.string())
                bucket, first = trigrams(texts, bits)
                n = np.diff(first)
                means = np.zeros((len(n), len(log_p)))
                for i, table in enumerate(log_p):
                    total = np.concatenate([[0.0], np.cumsum(table[bucket], dtype=np.float64)])[first]
                    means[:, i] = np.diff(total) / np.maximum(n, 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(log_p)), pa.array(means.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(n), lists], [*kept, "n_grams", "likelihood"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{kinds}, n_grams long, likelihood array<double>")


def _counted(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key, {key}_seen (how many rows with it the texts give to each language), {key}_total. Counted in long form, so a hot
    value has at most ``n`` rows per task before the last grouping."""
    long = rows.where(F.col(key).isNotNull()).groupBy(key, "said").agg(F.count(F.lit(1)).alias("n"))
    found = long.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("said", "n")))).alias("found"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(F.col("found"), i), F.lit(0).cast("long")))
    return found.select(key, dense.alias(f"{key}_seen")).withColumn(f"{key}_total", F.aggregate(f"{key}_seen", F.lit(0).cast("long"), lambda a, x: a + x))


def fuse(scored: DataFrame, languages: list[str]) -> DataFrame:
    """Adds text_language, language, posterior and kept to scored rows (n_grams, likelihood, declared, host).

    Without letters a text has no likelihood, its row is not counted, and language is that of the other evidence but
    kept is false; kept is also false where the best posterior is below one half. A null host is no evidence, a null
    declaration is the declaration that there is none. Of languages with the same evidence the first by name wins.
    Repeated rows are counted each; an empty table gives an empty result.
    """
    n = len(languages)
    names = F.lit(languages)
    weight = F.least(F.col("n_grams"), F.lit(TEXT_WEIGHT))
    best = F.array_position("likelihood", F.array_max("likelihood")).cast("int") - 1
    labels = F.split(F.col("host"), r"\.")
    rows = scored.withColumns(
        {
            "said": F.when(F.col("n_grams") > 0, best),
            "declared": F.lower(F.regexp_extract(F.coalesce(F.col("declared"), F.lit("")), "^[A-Za-z]+", 0)),
            "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
            "suffix": F.when(F.size(labels) > 1, F.element_at(labels, -1)),
        }
    )
    rows = materialize(rows, "language-evidence")
    whole = {r["said"]: r["n"] for r in rows.where("said is not null").groupBy("said").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    total = sum(whole.values())
    prior = F.lit([(whole.get(i, 0) + 1) / (total + n) for i in range(n)])
    out = rows
    for key in ("host", "domain", "suffix", "declared"):
        counts = materialize(_counted(rows, key, n), f"languages-by-{key}")
        # a value takes a number a language; a longer list is joined by a shuffle, which can split a hot value
        if counts.count() * n <= BROADCAST_CELLS:
            counts = F.broadcast(counts)
        out = out.join(counts, key, "left")

    def seen(key: str, base: Column, share: Callable[[Column, Column, Column], Column]) -> Column:
        """``share`` of (a language's count under the row's value of ``key``, its entry in ``base``, all counts under the value)."""
        none = F.array_repeat(F.lit(0).cast("long"), n)
        whole = F.coalesce(F.col(f"{key}_total"), F.lit(0))
        return F.zip_with(F.coalesce(F.col(f"{key}_seen"), none), base, lambda x, b: share(x, b, whole))

    def smooth(x: Column, b: Column, whole: Column) -> Column:
        return (x + SMOOTHING * b) / (whole + SMOOTHING)

    # what a value says beyond the prior: P(value | language) / P(value), smoothed toward one
    evidence = F.zip_with("likelihood", seen("host", seen("domain", prior, smooth), smooth), lambda x, p: weight * x + F.log(p))
    for key in ("declared", "suffix"):
        evidence = F.zip_with(evidence, seen(key, prior, lambda x, b, whole: F.log(smooth(x, b, whole) / b)), lambda x, y: x + y)
    out = out.withColumn("evidence", evidence).withColumn("top", F.array_max("evidence"))
    mass = F.aggregate("evidence", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    out = out.withColumn("posterior", 1 / mass).withColumn("language", F.get(names, F.array_position("evidence", F.col("top")).cast("int") - 1))
    made = [c for c in scored.columns if c not in ("n_grams", "likelihood", "declared", "host")]
    kept = (F.col("n_grams") > 0) & (F.col("posterior") >= LEAST_POSTERIOR)
    return out.select(*made, F.get(names, F.col("said")).alias("text_language"), "language", F.round("posterior", 6).alias("posterior"), kept.alias("kept"))


def _identified(docs: DataFrame, sample_rows: int, model: TrigramModel | None = None) -> DataFrame:
    rows = docs.select("doc_id", row_hash("doc_id", "text", "lang", "source").alias("row"), "text", F.col("lang").alias("declared"), F.lower("source").alias("host"))
    model = model or train(docs.select("text", F.col("lang").alias("language")), sample_rows=sample_rows)
    return fuse(score_texts(rows, model), model.languages)


def identify_documents(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, model: TrigramModel | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source; other columns are ignored): doc_id, text_language,
    language, posterior, kept. The declared language is ``lang``, the host is ``source``. Without a ``model`` one is
    trained on the declared languages.

    Null and empty texts, and texts without letters, are not kept; a null lang or source is no evidence. Repeated rows
    are judged alike. An empty table gives an empty result.
    """
    return _identified(docs, sample_rows, model).drop("row")


def identify_pages(pages: DataFrame, labelled: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """As ``identify_documents`` for pages (page_id, url, html): the article's text, the lang attribute of the html
    element, the address's host and suffix. ``labelled`` (text, language) fits the trigram model. Null html is a page
    without letters; a null url is no evidence; repeated rows are judged alike; an empty table gives an empty result."""
    declared = F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    host = host_of(F.col("url"))
    rows = pages.select("page_id", F.col("html").alias("text"), declared.alias("declared"), F.when(host != "", host).alias("host"))
    model = train(labelled, sample_rows=sample_rows)
    return fuse(score_texts(rows, model, is_html=True), model.languages)


def keep_identified(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that ``identify_documents`` rejects; all columns stay. A row is judged by its own text, lang
    and source, whatever other rows have its doc_id; rows are told apart by a 64-bit hash of these four."""
    lost_name = free_name(docs, "lost")
    with scratch(docs.sparkSession) as keep:
        lost = materialize(_identified(docs, sample_rows).where("not kept").select(F.col("row").alias(lost_name)).distinct(), "rejected-rows")
        keep(lost)
    if lost.count() <= BROADCAST_ROWS:
        lost = F.broadcast(lost)
    return docs.join(lost, row_hash("doc_id", "text", "lang", "source") == F.col(lost_name), "left_anti")
