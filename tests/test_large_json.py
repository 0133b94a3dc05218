"""Documents read piece by piece against the reader of whole documents."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.sources import chunks as C
from quillon.sources import large_json as L


def value(rng, depth=3):
    kind = rng.randint(0, 6 if depth else 3)
    if kind == 0:
        return rng.choice(["", 'a"b', "}{][", "\\", 'x\\"}', "é日\U0001f600", "line\nbreak,", ":,", "}" * 5])
    if kind < 4:
        return rng.choice([None, True, 1.5, -3, 12345678901234])
    return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))] if kind == 4 else {rng.choice(["a", "b}", 'c"', "hands"]): value(rng, depth - 1) for _ in range(rng.randint(0, 3))}


def items_of(text, cut):
    """What the parser gives of a text cut at the places of ``cut``."""
    p, out = L.ItemParser(), []
    for a, b in zip([0, *cut], [*cut, len(text)], strict=True):
        out += list(p.feed(text[a:b]))
    return out


def test_the_parser_takes_any_pieces():
    rng = random.Random(1)
    for _ in range(300):
        top = [value(rng) for _ in range(rng.randint(0, 5))]
        doc = rng.choice([top, {"x": 1, "train": top, "m": {"k}": "[", "deep": {"list": [1, [2], {"a": [3]}]}}, "validation": []}])
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        cut = sorted(rng.sample(range(len(text)), min(len(text), rng.randint(0, 12))))
        got = [(p, n, json.loads(t)) for p, n, t in items_of(text, cut) if n >= 0]
        want = [("", n, v) for n, v in enumerate(top)] if isinstance(doc, list) else [("train", n, v) for n, v in enumerate(top)] + [("m.deep.list", n, v) for n, v in enumerate(doc["m"]["deep"]["list"])]
        assert got == want
        assert [p for p, n, _ in items_of(text, cut) if n == -1] == ([""] if isinstance(doc, list) else ["train", "m.deep.list", "validation"])


@pytest.mark.parametrize("split", [400, 1 << 27])
def test_large_items_are_those_of_whole_documents(spark, tmp_path, split):
    rng = random.Random(3)
    items = lambda n: [{"id": i, "note": value(rng), "hands": [value(rng) for _ in range(2)]} for i in range(n)]
    docs = {"a.json": items(40), "b.json": {"data": {"chunks": items(5)}, "meta": {"tags": [1, 2]}}, "c.json.gz": {"splits": {"validation": items(3), "train": items(4)}, "samples": items(2)}, "d.json": {"samples": [], "data": items(2)}, "e.json": [], "f.json": {"x": 1}, "g.json": [1, "two", None, [3]]}
    for name, doc in docs.items():
        raw = json.dumps(doc, indent=rng.choice([None, 1])).encode()
        (tmp_path / name).write_bytes(gzip.compress(raw) if name.endswith("gz") else raw)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        told = lambda df: sorted((r["file"], str(r["split"]), r["nth"], r["t"]) for r in df.select("file", "split", "nth", F.to_json("item").alias("t")).collect())
        got, want = told(C.read_large_items(spark, str(tmp_path))), told(C.read_items(spark, str(tmp_path)))
        assert got == want and len(got) == 40 + 5 + 7 + 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_large_gzip_passes_in_pieces(spark, tmp_path):
    """One line of 60 MB: the batches that the parser hands on stay small, whatever the document's size."""
    hand = {"metadata": {"game_type": "x" * 200}, "players": [], "streets": [], "actions": [{"action_id": "1", "amount": 1.5}], "outcome": {}}
    one = json.dumps({"chunk_id": "c", "label": 1, "hands": [hand] * 10})
    n = 20_000
    with gzip.open(tmp_path / "x.json.gz", "wt", compresslevel=1) as f:
        f.write('{"labeled_chunks": [')
        for i in range(n):
            f.write(("," if i else "") + one)
        f.write("]}")
    made = L.read_arrays(spark, str(tmp_path)).where("nth >= 0")
    assert made.agg(F.count("*"), F.max("nth"), F.max(F.length("text"))).first()[:] == (n, n - 1, len(one))
    assert C.read_chunks(spark, str(tmp_path), large=True).limit(5).where("size(hands) = 10 and label = 1").count() == 5


def test_a_cut_document_gives_what_came_before(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1}, {"b": {"c": 2}}, {"d": [1, {"e"')
    assert [r["text"] for r in L.read_arrays(spark, str(tmp_path)).where("nth >= 0").orderBy("nth").collect()] == ['{"a": 1}', '{"b": {"c": 2}}']
