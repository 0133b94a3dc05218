"""The polled feed, append buffers, audit lanes, snapshots and corrected epochs."""

import hashlib
import http.server
import json
import random
import statistics
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from quillon.operators import rollups as R
from quillon.sources import feed, sinks
from quillon.streaming import buffers as U
from quillon.streaming import state as T


class Feed:
    """A feed of two lists that grows by hand and notes what was acknowledged."""

    def __init__(self):
        outer, self.items, self.acks, self.ok, self.fail_reads = self, {"a": [], "b": []}, [], True, 0

        class Handler(http.server.BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def answer(self, value, code=200):
                self.send_response(code)
                self.end_headers()
                self.wfile.write(json.dumps(value).encode())

            def do_GET(self):
                where = urllib.parse.urlparse(self.path)
                if where.path == "/health":
                    done = outer.acks[-1] if outer.acks else {}
                    latest = {outer.url(k): len(v) for k, v in outer.items.items()}
                    return self.answer({"success": True, "data": {"ok": outer.ok, "available": sum(n - done.get(u, 0) for u, n in latest.items()), "latest": latest}})
                if outer.fail_reads:
                    outer.fail_reads -= 1
                    return self.answer({}, 503)
                q = dict(urllib.parse.parse_qsl(where.query))
                at = int(q["after"])
                return self.answer({"items": outer.items[where.path[1:]][at : at + int(q["limit"])]})

            def do_POST(self):
                outer.acks.append(json.loads(self.rfile.read(int(self.headers["content-length"])))["latest"])
                self.answer({})

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def url(self, k):
        return f"http://127.0.0.1:{self.server.server_port}/{k}"

    def options(self, **more):
        return {"urls": f"{self.url('a')} {self.url('b')}", "health": self.url("health"), "ack": self.url("ack"), "least": "3", "page": "4", "perTask": "6", "tries": "2", "pause": "0.01"} | more


def test_a_feed_is_polled_gated_resumed_and_acknowledged(spark, tmp_path):
    f, got, broken = Feed(), {}, [True]

    def sink(rows, batch):
        got[batch] = sorted((r["url"][-1], r["number"], json.loads(r["item"])["n"]) for r in rows.collect())
        if broken[0]:
            raise ValueError("the sink is down")

    cycle = lambda: feed.poll(spark, f.options(), sink, f"file://{tmp_path}/cp", cycles=1)[0]
    f.items["a"] = [{"n": i} for i in range(2)]
    assert cycle() == "not ready" and not got  # two items are under the least
    f.items["a"] = [{"n": i} for i in range(15)]
    f.ok = False
    assert cycle() == "not ready" and not got
    f.ok = True
    assert cycle().startswith("failed") and not f.acks
    first = got[0]
    f.items["b"] = [{"n": i} for i in range(5)]  # comes later, so it is not in the batch that failed
    f.fail_reads = 1
    broken[0] = False
    assert cycle() == "ok" and got[0] == first == [("a", i + 1, i) for i in range(15)]
    assert 1 in got or cycle() == "ok"  # what had come meanwhile
    assert got[1] == [("b", i + 1, i) for i in range(5)]
    assert f.acks[-1] == {f.url("a"): 15, f.url("b"): 5}
    assert cycle() in ("empty", "not ready") and len(got) == 2
    f.items["a"] += [{"n": 99}] * 3
    pauses = []
    assert feed.poll(spark, f.options(), sink, f"file://{tmp_path}/cp", cycles=2, every=7, pause=pauses.append)[0] == "ok" and pauses == [7]
    assert got[2] == [("a", i, 99) for i in (16, 17, 18)] and f.acks[-1][f.url("a")] == 18
    f.server.shutdown()


ANSWER = "key long, at timestamp, nth long, scores array<double>, labels array<int>, coverage double, latency double"


def answers(rng, cycles, keys):
    rows = []
    for c in cycles:
        for k in keys:
            n = rng.randint(0, 3)
            rows.append((k, c // 2, c * 100 + k, [rng.random() for _ in range(n)], [rng.randint(0, 1) for _ in range(n + rng.randint(0, 1))], rng.choice([0.0, 0.5, 1.0]), rng.choice([None, rng.random()])))
    return rows


def brute_buffers(rows, window):
    out = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        p = [x for r in mine for x in zip(r[3], r[4], strict=False)]
        late = [r[6] for r in mine if r[6] is not None][-window:]
        out[k] = (len(p[-window:]), len(p), [s for s, _ in p[-window:]], [y for _, y in p[-window:]], statistics.fmean([r[5] for r in mine][-window:]), statistics.fmean(late) if late else None)
    return out


def write(spark, rows, path):
    df = spark.createDataFrame([(r[0], None, *r[2:], r[1]) for r in rows], ANSWER + ", s long")
    df.withColumn("at", F.timestamp_seconds("s")).drop("s").repartition(3).write.mode("append").parquet(path)


def test_append_buffers_over_batches_restart_and_restore(spark, tmp_path):
    rng = random.Random(7)
    rows = answers(rng, range(60), [1, 2, 3])
    src = f"{tmp_path}/src"
    read = lambda: spark.readStream.schema(ANSWER).parquet(src)
    told = lambda df: {r["key"]: (r["sample_count"], r["total"], r["scores"], r["labels"], pytest.approx(r["coverage_rate"]), r["latency_mean"] and pytest.approx(r["latency_mean"])) for r in df.collect()}
    run = lambda state, **more: told(T.latest(U.append_buffers(read(), 10, slack=2, **more), "key", state_dir=f"file://{tmp_path}/{state}"))
    cuts = [0, 2, 20, 40]
    for a, b in zip(cuts, cuts[1:], strict=False):
        write(spark, [r for r in rows if a <= r[2] // 100 < b], src)
        assert run("whole") == brute_buffers([r for r in rows if r[2] // 100 < b], 10)
    saved = U.saved_buffers(spark, f"file://{tmp_path}/whole/checkpoint")
    assert saved.groupBy("key", "list").count().agg(F.max("count")).first()[0] <= 20
    sinks.publish(saved, f"file://{tmp_path}/state", 3)
    src = f"{tmp_path}/rest"
    write(spark, [r for r in rows if r[2] // 100 >= 40], src)
    kept = sinks.current(spark, f"file://{tmp_path}/state", saved.schema.simpleString()[7:-1].replace(":", " "))
    assert run("other", initial=kept) == brute_buffers(rows, 10)


def test_a_key_of_many_rows_is_held_in_few(spark, tmp_path):
    n = 200_000
    rows = spark.range(n, numPartitions=8).select(F.lit(1).cast("long").alias("key"), F.timestamp_seconds("id").alias("at"), F.col("id").alias("nth"), F.array(F.col("id") / 1e6).alias("scores"), F.array(F.lit(0)).alias("labels"), F.lit(1.0).alias("coverage"), F.lit(None).cast("double").alias("latency"))
    rows.write.parquet(f"{tmp_path}/src")
    out = T.latest(U.append_buffers(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/src"), 5), "key", state_dir=f"file://{tmp_path}/s").first()
    assert (out["sample_count"], out["total"], out["scores"]) == (5, n, [i / 1e6 for i in range(n - 5, n)])
    assert U.saved_buffers(spark, f"file://{tmp_path}/s/checkpoint").count() == 10


def test_averages_go_on_from_a_snapshot(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, i, rng.random()) for i in range(40) for k in (1, 2) if (k, i) != (2, 30)] + [(3, 35, 0.5)]
    df = spark.createDataFrame(rows, "key long, s long, value double").select("key", F.timestamp_seconds("s").alias("at"), "value", "s")
    for name, cond in (("whole", "s >= 0"), ("early", "s < 20"), ("late", "s >= 20")):
        df.where(cond).drop("s").write.parquet(f"{tmp_path}/{name}")
    schema = df.drop("s").schema
    run = lambda name, **more: {r["key"]: r["ema"] for r in T.latest(T.moving_averages(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}"), 0.1, **more), "key", state_dir=f"file://{tmp_path}/of-{name}").collect()}
    whole = run("whole")
    run("early")
    again = run("late", initial=T.saved_averages(spark, f"file://{tmp_path}/of-early/checkpoint"))
    assert again == {k: pytest.approx(v) for k, v in whole.items()}


def test_statuses_of_audits(spark):
    cases = [
        (None, None, None, None, None, "local_only"), ("none", "shadow", True, None, True, "local_only"), ("OTHER", "shadow", True, None, True, "provider_unsupported"), ("main", "Disabled ", True, None, True, "provider_disabled"),
        ("main", "shadow", False, None, True, "provider_unconfigured"), ("main", "shadow", None, None, None, "provider_unconfigured"), ("main", "shadow", True, " x" * 200, True, "provider_failed"), ("main", "shadow", True, None, True, "verified"), (" Main", "", True, None, None, "provider_completed"),
    ]
    df = spark.createDataFrame(cases, "p string, m string, c boolean, e string, v boolean, want string")
    status, reason = R.audit_status(*(F.col(c) for c in "pmcev"), supported="main")
    got = df.select("want", status.alias("status"), reason.alias("reason")).collect()
    assert [r["status"] for r in got] == [r["want"] for r in got]
    assert {r["reason"] for r in got if r["status"] == "provider_unsupported"} == {"unsupported provider: other"} and all(len(r["reason"]) == 303 for r in got if r["status"] == "provider_failed")


def brute_lane(reports, recent):
    """(nth, previous, chain, recent, verified, failed) of one key's (nth, status, digest, proof)."""
    out, chain = [], ""
    for i, (nth, status, digest, _) in enumerate(reports):
        chain = hashlib.sha256((chain + digest).encode()).hexdigest()
        last = reports[max(0, i + 1 - recent) : i + 1]
        out.append((nth, reports[i - 1][1] if i else None, chain, len(last), sum(x[3] for x in last), sum(x[1].startswith("provider_") and x[1] != "provider_completed" for x in last)))
    return out


def test_audit_lanes_over_batches_and_from_an_older_form(spark, tmp_path):
    rng = random.Random(9)
    kinds = [U.LOCAL, U.UNSUPPORTED, U.DISABLED, U.UNCONFIGURED, U.VERIFIED, U.COMPLETED, U.FAILED]
    reports = [(i, s := rng.choice(kinds), f"d{i}", s == U.VERIFIED) for i in range(30)]
    schema = "key string, created_at timestamp, nth long, status string, status_reason string, input_hash string, proof_verified boolean"

    def put(rows, path):
        df = spark.createDataFrame([("v", None, n, s, "", d, p, n // 2) for n, s, d, p in rows], schema + ", s long")
        df.withColumn("created_at", F.timestamp_seconds("s")).drop("s").repartition(2).write.mode("append").parquet(path)

    out: list = []
    keep = lambda df, _: out.extend((r["nth"], r["previous_status"], r["chain"], r["recent_reports"], r["verified_reports"], r["failed_reports"]) for r in df.collect())
    run = lambda src, state, **more: T.run_available(U.audit_lane(spark.readStream.schema(schema).parquet(src), recent=6, **more), keep, f"file://{tmp_path}/{state}", mode="append")
    for a, b in ((0, 3), (3, 20)):
        put(reports[a:b], f"{tmp_path}/src")
        run(f"{tmp_path}/src", "cp")
    want = brute_lane(reports, 6)
    assert sorted(out) == want[:20]
    # the state as a table, with what an older form had besides, and without what it lacked
    saved = U.saved_reports(spark, f"file://{tmp_path}/cp")
    assert sorted(r["nth"] for r in saved.collect()) == list(range(14, 20)) and saved.where("chain is not null").count() == 1
    older = saved.drop("status_reason").withColumn("evidence", F.lit("secret")).withColumn("nth", F.col("nth").cast("int"))
    moved = U.migrated_reports(older.unionByName(older.limit(1).withColumn("key", F.lit(None).cast("string"))))
    assert "evidence" not in moved.columns and moved.count() == 6
    out.clear()
    put(reports[20:], f"{tmp_path}/rest")
    run(f"{tmp_path}/rest", "cp2", initial=moved)
    assert sorted(out) == want[20:]


def test_late_rows_correct_their_epoch(spark, tmp_path):
    day = 86400
    first, late = [(0, 1.0), (5 * day, 2.0), (40 * day, 3.0)], [(1, 10.0), (5 * day + 1, 20.0)]
    src, schema = f"{tmp_path}/src", "at timestamp, value double"
    put = lambda rows: spark.createDataFrame(rows, "s long, value double").select(F.timestamp_seconds("s").alias("at"), "value").write.mode("append").parquet(src)
    run = lambda: {r["start"].timestamp(): (r["n"], r["total"]) for r in T.latest(U.corrected_epochs(spark.readStream.schema(schema).parquet(src), anchor="1970-01-02 00:00:00"), "start", state_dir=f"file://{tmp_path}/s").collect()}
    put(first)
    before = run()
    put(late)
    after = run()
    assert {k: n for k, (n, _) in before.items()} == {0.0: 1, 4.0 * day: 1, 40.0 * day: 1}
    assert after == {0.0: (2, 11.0), 4.0 * day: (2, 22.0), 40.0 * day: (1, 3.0)}
