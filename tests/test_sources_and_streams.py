import gzip
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quillon.functions import labels as G
from quillon.sources import chunks, paged, sinks, synthetic
from quillon.streaming import state as T

HAND = {"metadata": {"max_seats": 6, "hero_seat": 2}, "players": [], "streets": [], "outcome": {}, "actions": [{"action_id": "2", "action_type": "call", "actor_seat": 1}, {"action_id": "1", "action_type": "bet", "actor_seat": 2}]}


def test_root_shapes_and_labels(spark, tmp_path):
    docs = {
        "a.json": [{"hands": [HAND], "is_bot": True, "chunk_id": "x"}, {"chunk": [HAND, HAND], "label": " human "}, {"nothing": 1}],
        "b.json": {"train": [{"hands": [HAND], "label": 1}], "validation": [{"hands": [HAND], "ground_truth": ["ai"]}]},
        "c.json": {"data": {"chunks": [{"hands": [HAND], "is_human": True}]}}, "d.json": [[HAND, HAND]], "e.json": {"none": []},
    }
    for name, value in docs.items():
        (tmp_path / name).write_text(json.dumps(value))
    with gzip.open(tmp_path / "f.json.gz", "wt") as f:
        json.dump({"samples": [{"hands": [HAND], "y": "0"}]}, f)
    (tmp_path / "g.json").write_text("{broken")
    got = {(r["file"].rsplit("/")[-1], r["chunk_id"]): (r["split"], r["label"], len(r["hands"])) for r in chunks.read_chunks(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.json", "x"): (None, 1, 1), ("a.json", "sample_1"): (None, 0, 2), ("b.json", "sample_0"): ("validation", 1, 1) if ("b.json", "sample_0") not in got else got[("b.json", "sample_0")],
        ("c.json", "sample_0"): (None, 0, 1), ("d.json", "sample_0"): (None, None, 2), ("f.json.gz", "sample_0"): (None, 0, 1),
    }
    assert {r["split"] for r in chunks.read_chunks(spark, str(tmp_path)).where("file like '%b.json'").collect()} == {"train", "validation"}
    assert chunks.rejected_items(spark, str(tmp_path)).count() == 1
    one = chunks.read_chunks(spark, str(tmp_path), glob="a.json")
    assert [r["action_type"] for r in chunks.actions_of(one.where("chunk_id = 'x'")).orderBy("ord").collect()] == ["bet", "call"]
    assert chunks.is_labelled(one).first().asDict() == {"some": True, "all": True}


def test_release_shape(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"data": {"chunks": [{"chunkHash": "h", "chunkId": "c", "split": "train", "sourceDate": "d", "chunks": [[HAND], [HAND, HAND]], "groundTruth": [0, 1]}]}}))
    got = [(r["chunk_id"], r["label"], len(r["hands"])) for r in chunks.read_release(spark, str(tmp_path)).orderBy("chunk_id").collect()]
    assert got == [("c-0", 0, 1), ("c-1", 1, 2)]


def test_paged_source(spark):
    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(self.path.rsplit("=")[-1]) if "cursor" in self.path else 0
            body = json.dumps({"data": {"chunks": [{"n": n * 2}, {"n": n * 2 + 1}], "nextCursor": n + 1 if n < 2 else None}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/r?split="
    spark.dataSource.register(paged.PagedJson)
    got = spark.read.format("paged_json").option("urls", f"{base}a {base}b").load()
    assert sorted(r[0] for r in got.select(F.get_json_object("item", "$.n").cast("int")).collect()) == sorted([*range(6)] * 2)
    server.shutdown()


def test_sinks_and_registry_versions(spark, tmp_path):
    scored = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "chunk_id string, score double")
    sinks.write_predictions(scored, f"{tmp_path}/p")
    assert {r["confidence"] for r in spark.read.json(f"{tmp_path}/p").collect()} == {"high", "low"}
    sinks.write_report(scored, f"{tmp_path}/c", by="score")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first()["chunk_id"] == "a"
    path, kind = f"file://{tmp_path}/reg", "uid long, n long"
    assert sinks.current(spark, path, kind).count() == 0
    sinks.publish(spark.createDataFrame([(1, 1), (136, 1)], kind), path, 1)
    sinks.publish(sinks.remove_keys(sinks.current(spark, path, kind), spark.createDataFrame([(136,)], "uid long"), "uid"), path, 2)
    assert [r["uid"] for r in sinks.current(spark, path, kind).collect()] == [1]


def test_stream_state_survives_a_restart(spark, tmp_path):
    rows = [(1, i, float(i)) for i in range(10)] + [(2, 3, 5.0)]
    df = spark.createDataFrame(rows, "key long, s long, value double").select("key", F.timestamp_seconds("s").alias("at"), "value")
    src, state = f"{tmp_path}/src", f"file://{tmp_path}/state"
    df.where("at < timestamp_seconds(5)").write.mode("append").parquet(src)
    run = lambda: {r["key"]: (r["held"], r["mean"]) for r in T.latest(T.ring_buffers(spark.readStream.schema(df.schema).parquet(src), 4), "key", state_dir=state).collect()}
    assert run() == {1: (4, 2.5), 2: (1, 5.0)}
    df.where("at >= timestamp_seconds(5)").write.mode("append").parquet(src)
    assert run() == {1: (4, 7.5), 2: (1, 5.0)}


def test_unseen_within_the_watermark(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, s long").select("key", F.timestamp_seconds("s").alias("at"))
    df.write.parquet(f"{tmp_path}/src")
    out: list = []
    T.run_available(T.unseen(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/src")), lambda d, i: out.extend(d.collect()), f"file://{tmp_path}/cp", mode="append")
    assert sorted(r["key"] for r in out) == ["a", "b"]


def test_synthetic_hands_are_consistent_and_repeatable(spark):
    one = synthetic.synthetic_actions(spark, 40, partitions=2).orderBy("hand_id", "ord").collect()
    assert one == synthetic.synthetic_actions(spark, 40, partitions=5).orderBy("hand_id", "ord").collect()
    for h in range(40):
        acts = [r for r in one if r["hand_id"] == h]
        folded: set = set()
        for a, b in zip(acts, [*acts[1:], None], strict=True):
            assert a["seat"] not in folded and a["pot_after"] >= a["pot_before"]
            assert b is None or abs(b["pot_before"] - a["pot_after"]) < 0.011
            folded |= {a["seat"]} if a["action_type"] == "fold" else set()


def test_synthetic_chunks_are_whole_hands(spark):
    from quillon.operators import features as X

    rows = synthetic.synthetic_chunks(spark, 80, per_chunk=10, partitions=3).persist()
    got = {r["chunk_id"]: r for r in rows.collect()}
    assert len(got) == 8 and {len(r["hands"]) for r in got.values()} == {10} and {k.split("-")[0] for k in got} == set(synthetic.ARCHETYPES)
    for h in (h for r in got.values() for h in r["hands"]):
        acts = h["actions"]
        assert [a["action_type"] for a in acts[:2]] == ["small_blind", "big_blind"] and h["metadata"]["hand_ended_on_street"] == acts[-1]["street"]
        assert h["outcome"]["total_pot"] == pytest.approx(sum(a["amount"] for a in acts), abs=0.01) and len(h["players"]) == 6
        assert h["outcome"]["winners"][0] not in {f"seat_{a['actor_seat']}" for a in acts if a["action_type"] == "fold"}
        assert all((a["raise_to"] is not None) == (a["action_type"] in ("bet", "raise")) and (a["call_to"] is not None) == (a["action_type"] == "call") for a in acts)
    out = X.table_features(rows, chunks.hands_of(rows), chunks.actions_rows(rows), chunks.players_of(rows), chunks.streets_of(rows)).collect()
    rate = {k: sum(r["bet_raise_rate"] for r in out if r["chunk_id"].startswith(k)) for k in synthetic.ARCHETYPES}
    assert len(out) == 8 and max(rate, key=rate.get) == "aggressive"


def test_options_come_back(spark):
    from quillon.sources.shared import settings, stream_pattern

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with settings(spark, {key: "x"}):
        assert spark.conf.get(key) == "x"
    assert spark.conf.get(key, None) == before
    assert stream_pattern("/a/b.parquet/") == "/a/b.parque[t]" and stream_pattern("/a/{b,c}") == "/a/{b,c}"


def test_splits_and_bootstrap(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 10 == 0).alias("y"))
    got = {(r["y"], r["split"]): r["count"] for r in G.stratified_split(rows, "id", "y", 0.2, 44).groupBy("y", "split").count().collect()}
    assert got == {(True, "validation"): 20, (True, "train"): 80, (False, "validation"): 180, (False, "train"): 720}
    assert 400 < G.bootstrap(rows, 500, "id", 3).count() < 600


@pytest.mark.parametrize("name", ["calibrated_detector", "blend_report", "synthetic_mix", "bootstrap_sample", "canonical_hands", "pooled_features", "table_features"])
def test_queries_without_twins(spark, sf, name):
    from quillon.plans import registry

    rows = registry.queries()[name](spark, sf).collect()
    assert rows
    if name == "calibrated_detector":
        assert all(0 <= r["score"] <= 1 for r in rows)
        from quillon.operators.metrics import ranking

        assert ranking(spark.createDataFrame(rows), []).first()["auc"] > 0.7
    if name == "blend_report":
        assert sum(r["chosen"] for r in rows) >= 1
    if name == "canonical_hands":
        assert all(len(r["actions"]) in (0, 2, 3, 4, 5, 6, 7, 8, 12) for r in rows)


def test_calibrator_is_monotone_and_keeps_the_ceiling(spark):
    from quillon.operators import metrics as M
    from quillon.operators import models as D

    rows = spark.range(400).select(((F.col("id") * 37 % 400) / 400.0).alias("score")).withColumn("y", (F.col("score") + 0.2 * F.sin(F.col("score") * 400) > 0.55).cast("int"))
    c = D.fit_calibrator(rows)
    assert all(b > a for a, b in zip(c.grid, c.grid[1:], strict=False))
    assert M.reward(c.apply(rows), []).first()["fpr"] < 0.05
