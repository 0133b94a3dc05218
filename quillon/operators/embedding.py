"""A detector on a learned embedding of chunks beside their features.

An action is one of ``WORDS`` words: its kind, street and bucket of amount. How often one word follows another within a
hand, counted over all actions, is factorised into a vector per word as the one that comes before and one as the one that
comes after; their product sums up to how much more often the pair occurs than chance. A hand is the mean of its actions'
vectors, a chunk the mean and spread of its hands. Only the counts, at most ``WORDS`` squared, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.labels import hash_split
from quillon.functions.scalars import AMOUNT_EDGES, STREETS, amount_bucket
from quillon.operators import metrics as M
from quillon.operators import models as D
from quillon.operators.features import ACTION_TYPES, feature_matrix
from quillon.operators.sequences import in_hand

BUCKETS = len(AMOUNT_EDGES) + 2
WORDS = (len(ACTION_TYPES) + 1) * (len(STREETS) + 1) * BUCKETS
DIMENSIONS = 8


def action_words(actions: DataFrame) -> DataFrame:
    """hand_id, ord, word, before (the word of the action before it in its hand, null for the first). Unknown kinds and
    streets, and missing ones, are one of their own; a missing amount counts as none."""
    place = lambda names, c: F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.lower(F.trim(c))), F.lit(0)).cast("int")
    bucket = amount_bucket(F.coalesce(F.col("amount_bb").cast("double"), F.lit(0.0))).cast("int")
    word = (place(ACTION_TYPES, "action_type") * (len(STREETS) + 1) + place(STREETS, "street")) * BUCKETS + bucket
    return actions.select("hand_id", "ord", word.alias("word")).withColumn("before", F.lag("word").over(in_hand()))


def word_pairs(words: DataFrame) -> DataFrame:
    """before, word, n: how often a word directly follows another."""
    return words.where("before is not null").groupBy("before", "word").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class WordVectors:
    before: list[list[float]]
    after: list[list[float]]

    @property
    def names(self) -> list[str]:
        """The columns of ``chunk_embedding``."""
        d = len(self.after[0])
        return [f"{part}_{i}_{s}" for s in ("mean", "spread") for part in ("word", "pair") for i in range(d)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate(zip(self.before, self.after, strict=True))], "word int, as_before array<double>, as_after array<double>")

    @staticmethod
    def of(table: DataFrame) -> WordVectors:
        """The vectors that ``table`` wrote; it has ``WORDS`` rows."""
        rows = table.orderBy("word").collect()
        return WordVectors([r["as_before"] for r in rows], [r["as_after"] for r in rows])


def fit_words(pairs: DataFrame, *, dimensions: int = DIMENSIONS) -> WordVectors:
    """Factorise the positive pointwise mutual information of ``pairs`` (before, word, n) by its largest singular values.
    Words without pairs, and dimensions beyond the matrix's rank, are zero; the sign of a dimension is that which makes
    its largest entry positive. Without pairs all vectors are zero."""
    counts = np.zeros((WORDS, WORDS))
    for r in pairs.collect():  # WORDS squared at most
        counts[r["before"], r["word"]] += r["n"]
    expected = np.outer(counts.sum(axis=1), counts.sum(axis=0)) / max(counts.sum(), 1.0)
    told = counts > 0
    information = np.zeros_like(counts)
    information[told] = np.maximum(np.log(counts[told] / expected[told]), 0.0)
    left, size, right = np.linalg.svd(information)
    left, right, size = left[:, :dimensions], right[:dimensions].T, size[:dimensions]
    size[size < 1e-9 * max(size[0], 1.0)] = 0.0
    sign = np.where(left[np.abs(left).argmax(axis=0), np.arange(dimensions)] < 0, -1.0, 1.0)
    scale = sign * np.sqrt(size)
    return WordVectors((left * scale).tolist(), (right * scale).tolist())


def chunk_embedding(chunks: DataFrame, hands: DataFrame, words: DataFrame, vectors: WordVectors) -> DataFrame:
    """chunk_id of ``chunks`` and the columns ``vectors.names``: the mean over a hand's actions of each word's vector and of
    its product with the word before (zero for a hand's first action), then their mean and population spread over the
    chunk's hands that have actions. A chunk without such hands is all zeros. ``hands``: chunk_id, hand_id; ``words`` of
    ``action_words``. The vectors are broadcast, ``WORDS`` rows at most. Words are dealt by hand, as numbers, before the
    means of a hand begin: these are longer than all its words."""
    d = len(vectors.after[0])
    table = vectors.table(words.sparkSession)
    a = words.select("hand_id", "word", "before").repartition("hand_id")
    a = a.join(F.broadcast(table.select("word", "as_after")), "word")
    a = a.join(F.broadcast(table.select(F.col("word").alias("before"), "as_before")), "before", "left")
    parts = {f"word_{i}": F.get("as_after", F.lit(i)) for i in range(d)}
    parts |= {f"pair_{i}": F.coalesce(F.get("as_before", F.lit(i)) * F.get("as_after", F.lit(i)), F.lit(0.0)) for i in range(d)}
    per_hand = a.groupBy("hand_id").agg(*(F.avg(c).alias(n) for n, c in parts.items()))
    told = per_hand.join(hands.select("chunk_id", "hand_id"), "hand_id").groupBy("chunk_id")
    told = told.agg(*(F.avg(n).alias(f"{n}_mean") for n in parts), *(F.stddev_pop(n).alias(f"{n}_spread") for n in parts))
    return chunks.select("chunk_id").join(told, "chunk_id", "left").select("chunk_id", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in vectors.names))


@dataclass(frozen=True)
class EmbeddedDetector:
    """Word vectors, and the head with the names of its inputs (embedding first, then features) and its calibrator."""

    vectors: WordVectors
    served: D.Served
    threshold: float | None = None

    def inputs(self, chunks: DataFrame, hands: DataFrame, words: DataFrame, features: DataFrame) -> DataFrame:
        """chunk_id and every input of the head; features that ``features`` lacks, or that are null or not finite, are 0."""
        names = self.served.names[len(self.vectors.names) :]
        told = feature_columns(features, names)
        return chunk_embedding(chunks, hands, words, self.vectors).join(told, "chunk_id", "left").na.fill(0.0, names)

    def predict(self, chunks: DataFrame, hands: DataFrame, actions: DataFrame | None, features: DataFrame, *, words: DataFrame | None = None) -> DataFrame:
        """chunk_id, raw, score (calibrated, six decimals) and flagged of every row of ``chunks``, in one plan. Flagged is a
        score at or above ``threshold``; without one a score above one half, since the calibrator's cut itself passes. A
        chunk without hands is scored by its features and a zero embedding. ``words``: those of the actions, where they are
        known already."""
        rows = self.inputs(chunks, hands, action_words(actions) if words is None else words, features)
        out = D.predict_chunks(self.served, rows)
        raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw")))
        return out.select("chunk_id", F.round(raw, 6).alias("raw"), "score", M.decide(boundary=self.threshold).alias("flagged"))

    def predict_one(self, chunk_id: object, hands: DataFrame, actions: DataFrame, features: DataFrame) -> float:
        """The score of one chunk, one half if neither a hand nor a feature row has it. Only its own rows are read."""
        mine = hands.where(F.col("chunk_id") == chunk_id)
        described = features.where(F.col("chunk_id") == chunk_id)
        chunks = mine.select("chunk_id").unionByName(described.select("chunk_id")).distinct()
        # the chunk's hands select its actions, wherever they lie
        got = self.predict(chunks, mine, actions.join(mine.select("hand_id"), "hand_id", "left_semi"), described).first()
        return got["score"] if got else 0.5


def feature_columns(features: DataFrame, names: list[str]) -> DataFrame:
    """chunk_id and ``names``, zero where a value is missing or not finite."""
    return feature_matrix(features, features.select("chunk_id", F.lit(None).cast("int").alias("label")).limit(0), names)[0].drop("y")


def fit_embedded(
    hands: DataFrame, actions: DataFrame | None, features: DataFrame, labels: DataFrame, names: list[str], *, words: DataFrame | None = None,
    dimensions: int = DIMENSIONS, stacked: bool = False, held_out: float = 0.3, seed: int = 44,
) -> EmbeddedDetector:
    """Fit vectors on all actions, the head on the labelled chunks (``labels``: chunk_id, y), the calibrator on scores of chunks
    that the head has not seen: with ``stacked`` the out-of-fold ones of an ensemble, else those of a share that is held out.
    ``words``: those of the actions, where they are known already."""
    words = action_words(actions) if words is None else words
    vectors = fit_words(word_pairs(words), dimensions=dimensions)
    inputs = [*vectors.names, *names]
    blank = EmbeddedDetector(vectors, D.Served(inputs, {}))
    rows = blank.inputs(labels, hands, words, features).join(labels.select("chunk_id", "y"), "chunk_id")
    rows = hash_split(rows, "chunk_id", held_out, seed).persist()  # a learner reads its rows many times over
    try:
        if stacked:
            base, meta, oof = D.stack(rows.drop("split"), inputs, "chunk_id", seed=seed)
            seen = D.score(meta, oof)
        else:
            base, meta = {"trees": D.train(rows.where("split = 'train'"), inputs, seed=seed)}, None
            seen = D.score(base["trees"], rows.where("split = 'validation'"))
        return EmbeddedDetector(vectors, D.Served(inputs, base, meta, D.fit_calibrator(seen.select("score", "y"))))
    finally:
        rows.unpersist()


def save_embedded(detector: EmbeddedDetector, spark: SparkSession, path: str, metrics: dict[str, float], version: int, **gate: float) -> bool:
    """Save the vectors, then promote the head into the same version if its metrics pass the gate of ``models.promote``; a
    version counts only when its head is there."""
    detector.vectors.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/v={version:012d}/words")
    return D.promote(detector.served, path, metrics, version, **gate)


def load_embedded(spark: SparkSession, path: str, *, threshold: float | None = None) -> EmbeddedDetector | None:
    """The newest promoted version, None if there is none."""
    served, folder = D.load_served(spark, path), D.newest_version(spark, path)
    return EmbeddedDetector(WordVectors.of(spark.read.parquet(f"{folder}/words")), served, threshold) if served else None
