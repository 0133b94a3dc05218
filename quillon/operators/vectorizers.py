"""Estimators around the feature operators, for pipelines: fitted once, applied alike when training and serving."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.features import value_vocabulary


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to standardise", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "fitted population deviations", TypeConverters.toListFloat)


class PopulationScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Population z-scores; a spread below 1e-6 counts as 1."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        names = self.getOrDefault(self.inputCols)
        r = dataset.agg(*(F.avg(c) for c in names), *(F.stddev_pop(c) for c in names)).first()
        means = [float(x or 0.0) for x in r[: len(names)]]
        spreads = [1.0 if x is None or x < 1e-6 else float(x) for x in r[len(names) :]]
        return PopulationScalerModel()._set(inputCols=names, means=means, spreads=spreads)


class PopulationScalerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        triples = zip(*(self.getOrDefault(p) for p in (self.inputCols, self.means, self.spreads)), strict=True)
        return dataset.withColumns({c: (F.col(c) - m) / s for c, m, s in triples})


class _Vocabulary(Params):
    inputCol = Param(Params._dummy(), "inputCol", "column to encode", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of ids", TypeConverters.toString)
    orderCol = Param(Params._dummy(), "orderCol", "column that tells which value came first", TypeConverters.toString)
    least = Param(Params._dummy(), "least", "least count of a value", TypeConverters.toInt)
    values = Param(Params._dummy(), "values", "values in order of their ids from 2", TypeConverters.toListString)


class ValueIndexer(Estimator, _Vocabulary, DefaultParamsReadable, DefaultParamsWritable):
    """Categories as ids from 2 in order of first appearance; padding is 0, unknown 1. For columns of few values."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, orderCol: str | None = None, least: int = 1):
        super().__init__()
        self._setDefault(least=1)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ValueIndexerModel:
        c = self.getOrDefault(self.inputCol)
        rows = dataset.select(c, F.col(self.getOrDefault(self.orderCol)).alias("at"))
        found = value_vocabulary(rows, c, self.getOrDefault(self.least)).orderBy("id").limit(100_001).collect()
        if len(found) > 100_000:
            raise ValueError(f"{c} has more than 100000 values; join a vocabulary table instead")
        return ValueIndexerModel()._set(inputCol=c, outputCol=self.getOrDefault(self.outputCol), values=[str(r["value"]) for r in found])


class ValueIndexerModel(Model, _Vocabulary, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        place = F.array_position(F.array(*map(F.lit, self.getOrDefault(self.values))).cast("array<string>"), F.col(self.getOrDefault(self.inputCol)).cast("string"))
        return dataset.withColumn(self.getOrDefault(self.outputCol), F.when(F.coalesce(place, F.lit(0)) > 0, place + 1).otherwise(1).cast("long"))
