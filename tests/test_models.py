import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from quillon.operators import models as D
from quillon.operators import vectorizers as V
from quillon.sources import synthetic


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(300).select("id", (F.col("id") * 7919 % 300 / 300.0).alias("a"), (F.col("id") * 104729 % 300 / 300.0).alias("b"))
    return df.withColumn("y", (F.col("a") + 0.3 * F.col("b") > 0.7).cast("int")).persist()


def test_stack_beats_chance_and_promotes(spark, rows, tmp_path):
    from quillon.operators.metrics import ranking

    base, meta, oof = D.stack(rows, ["a", "b"], "id", k=2)
    assert oof.count() == rows.count() and oof.select("id").distinct().count() == rows.count()
    assert ranking(D.score_stack(base, meta, rows, "id"), []).first()["auc"] > 0.95
    path = f"file://{tmp_path}/models"
    assert D.load_latest(spark, path) is None
    assert not D.promote(base["linear"], path, {"reward": 0.5, "fpr": 0.0}, 1) and not D.promote(base["linear"], path, {"reward": 0.9, "fpr": 0.06}, 1)
    assert D.promote(base["linear"], path, {"reward": 0.9, "fpr": 0.01}, 2)
    assert isinstance(D.load_latest(spark, path), PipelineModel)
    importance = D.importances(base["trees"], ["a", "b"])
    assert sum(importance.values()) == pytest.approx(1) and D.top_features(importance, 1) == ["a"]


def test_vectorizers_fit_once_and_apply_alike(spark, rows, tmp_path):
    m = V.PopulationScaler(inputCols=["a"]).fit(rows)
    m.write().overwrite().save(f"file://{tmp_path}/s")
    again = V.PopulationScalerModel.load(f"file://{tmp_path}/s")
    r = again.transform(rows).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert r[0] == pytest.approx(0, abs=1e-9) and r[1] == pytest.approx(1)
    words = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None)], "at int, w string")
    got = V.ValueIndexer(inputCol="w", outputCol="i", orderCol="at").fit(words).transform(words.unionByName(spark.createDataFrame([(5, "z")], words.schema)))
    assert [r["i"] for r in got.orderBy("at").collect()] == [2, 3, 2, 1, 1]


def test_table_function(spark):
    synthetic.register_udtf(spark)
    n = spark.sql("SELECT h.* FROM range(3) r, LATERAL synthetic_hand(r.id, 'loose', 4, 7) h").count()
    assert n == sum(len(synthetic.hand(i, "loose", 4, 7)) for i in range(3))
