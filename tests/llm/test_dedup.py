"""Near duplicates, line duplicates and exact duplicates against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import chosen_path as CP
from quillon.llm import exact_stream as ES
from quillon.llm import line_join as LJ
from quillon.llm.components import connected_components
from quillon.llm.textarrays import utf8, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOC = "doc_id long, text string"


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_near(rows, threshold=0.8):
    """{doc_id: (class, links)} by comparing shingle sets."""
    sets = {}
    for i, t in rows:
        w = tokens(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    pairs, links = [], Counter()
    for i, s in sets.items():
        for j, shared in Counter(k for g in s for k in where[g] if k != i).items():
            if shared >= threshold * (len(s) + len(sets[j]) - shared) - 1e-9:
                links[i] += 1
                pairs.append((i, j))
    of = roots(pairs, sets)
    return {i: (of[i], links[i]) for i in sets}


def near_rows(spark, rows, **options):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in CP.near_duplicate_classes(spark.createDataFrame(rows, DOC), **options).collect()}


def test_words_of_an_array():
    texts = ["Hello wörld abc", "abc", "", None, "abc hello-World", "x", "xx", "É ß"]
    h, first = words(pa.array(texts))
    assert np.diff(first).tolist() == [len(tokens(t)) for t in texts]
    named = {}
    for w, x in zip([w for t in texts for w in tokens(t)], h.tolist(), strict=True):
        assert named.setdefault(w, x) == x
    assert len(set(named.values())) == len(named)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in CP.near_duplicate_classes(docs).collect()}
    assert got == brute_near([tuple(r) for r in docs.collect()])


def test_planted_copies_with_small_buckets(spark):
    """Deep levels, the crowded path and its blocks: with buckets of 3 a group of 40 near copies needs them all."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(200)] = f"n{i}x{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))) for i in range(60)]
    rows += [(200 + i, rows[50][1]) for i in range(5)]
    assert near_rows(spark, rows, bucket=3, recall=0.9999) == brute_near(rows)


@pytest.mark.parametrize("most", [3, 25])
def test_large_hot_groups_with_and_without_pairs(spark, monkeypatch, most):
    """Blocks of 8 sets: members near the consensus are linked without pairs, the others are compared in blocks."""
    monkeypatch.setattr(CP, "BLOCK", 8)
    rng = random.Random(most)
    rows = []
    for group in range(2):
        base = [f"g{group}w{rng.randrange(3000)}" for _ in range(200)]
        for i in range(60):
            w = list(base)
            for _ in range(rng.randint(1, most)):
                w[rng.randrange(len(w))] = f"n{i}x{rng.random()}"
            if i % 9 == 0:
                w += [f"t{i}x{k}" for k in range(rng.randint(1, 40))]
            rows.append((group * 100 + i, " ".join(w)))
    rows += [(300 + i, rows[5][1]) for i in range(4)]
    assert near_rows(spark, rows, bucket=3, recall=0.99999) == brute_near(rows)


def thue_morse(n):
    """Two words that every polynomial hash modulo a power of two takes for equal from 1,024 letters on."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_fool_polynomial_hashes(spark):
    a, b = thue_morse(2048)
    h, _ = words(pa.array([a, b, a[:1024], b[:1024], a[:300], b[:300]]))
    assert len(set(h.tolist())) == 6
    text = "one two three four {} five six seven eight nine ten eleven twelve"
    rows = [(1, text.format(a)), (2, text.format(b)), (3, text.format(a)), (4, a), (5, b)]
    assert near_rows(spark, rows) == brute_near(rows) == {1: (1, 1), 2: (2, 0), 3: (1, 1), 4: (4, 0), 5: (5, 0)}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One TWO"), (5, "... !!"), (6, "a " * 50_000), (6, "a " * 50_000), (None, "one two"), (7, "ü ü ü ü ü ü")]
    got = sorted(((r["doc_id"], r["class_id"], r["copies"], r["n_links"]) for r in CP.near_duplicate_classes(spark.createDataFrame(rows, DOC)).collect()), key=str)
    want = [(1, 1, 1, 0), (2, 2, 1, 0), (3, 3, 3, 2), (4, 3, 3, 2), (5, 5, 1, 0), (6, 6, 2, 1), (6, 6, 2, 1), (None, 3, 3, 2), (7, 7, 1, 0)]
    assert got == sorted(want, key=str)
    assert CP.near_duplicate_classes(spark.createDataFrame([], DOC)).count() == 0


def test_one_of_each_class_stays_with_all_columns(spark):
    rows = [(3, "a b c d e f g", "x", 1), (1, "a b c d e f g", "y", 2), (2, "other text here", None, 3), (1, "a b c d e f g", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, row long")
    kept = CP.keep_one_per_class(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_runs_for_a_recall():
    assert CP.runs_for(0.999) == 19 and CP.runs_for(0.9) < 9


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 1), (9, 8), (7, 7), (2, 9), (None, 1)] + [(i, 20) for i in range(21, 60)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots(real, {x for p in real for x in p})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, a, alphabet, most):
    b = list(a)
    for _ in range(rng.randint(0, most)):
        k, i = rng.randint(0, 2), rng.randint(0, len(b))
        if k == 0:
            b.insert(i, rng.choice(alphabet))
        elif i < len(b):
            b[i : i + 1] = [] if k == 1 else [rng.choice(alphabet)]
    return bytes(b)


def test_banded_distance():
    rng = random.Random(2)
    a = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    b = [edited(rng, x, b"abc", 4) for x in a]
    assert LJ.within(a, b).tolist() == [min(3, distance(x, y)) for x, y in zip(a, b, strict=True)]


def test_lookups_find_every_pair():
    rng = random.Random(3)
    a = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(20, 40))) for _ in range(300)]
    lines = list(dict.fromkeys(x for x in a + [edited(rng, x, b"abcd", 2) for x in a] if len(x) >= 20))
    key, line, own = LJ.lookups(*utf8(pa.array([x.decode() for x in lines])))
    at = defaultdict(lambda: (set(), set()))
    for k, i, o in zip(key.tolist(), line.tolist(), own.tolist(), strict=True):
        at[k][0 if o else 1].add(i)
    met = {(min(x, y), max(x, y)) for own_lines, others in at.values() for x in own_lines for y in own_lines | others if x != y}
    for i in range(len(lines)):
        for j in range(i + 1, len(lines)):
            if abs(len(lines[i]) - len(lines[j])) <= 2 and distance(lines[i], lines[j]) <= 2:
                assert (i, j) in met


def brute_lines(rows):
    seen = [(t, i, k) for i, x in rows for k, t in enumerate((x or "").split("\n")) if len(t.encode()) >= LJ.LEAST]
    lines = list(dict.fromkeys(t for t, _, _ in seen))
    raw = [x.encode() for x in lines]
    pairs = []
    for i in range(len(raw)):
        js = [j for j in range(i + 1, len(raw)) if abs(len(raw[i]) - len(raw[j])) <= 2]
        pairs += [(i, j) for j, d in zip(js, LJ.within([raw[i]] * len(js), [raw[j] for j in js]), strict=True) if d <= 2]
    of = roots(pairs, range(len(lines)))
    number = {t: n for n, t in enumerate(lines)}
    first: dict = {}
    for t, i, k in seen:
        c = of[number[t]]
        first[c] = min(first.get(c, (i, k)), (i, k))
    out = defaultdict(set)
    for t, i, k in seen:
        if first[of[number[t]]] != (i, k):
            out[i].add(k)
    return out


def test_line_report_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute_lines([tuple(r) for r in docs.collect()])
    got = {r["doc_id"]: set(r["dropped"]) for r in LJ.line_dedup_report(docs).collect()}
    assert got == {i: want.get(i, set()) for i in got} and sum(map(len, got.values())) > 100


def test_crowded_keys_that_one_line_reaches(spark, monkeypatch):
    """Near copies of one line, copies of these, and strangers with the same beginning: pivot and blocks."""
    monkeypatch.setattr(LJ, "BLOCK", 50)
    rng = random.Random(6)
    head = "the same beginning of every line of them "
    rows = [(i, head + edited(rng, b"0000000000", b"123456789", 2).decode()) for i in range(120)]
    rows += [(200 + i, head + edited(rng, b"0123456789", b"abcdefgh", 5).decode()) for i in range(120)]
    want = brute_lines(rows)
    got = {r["doc_id"]: set(r["dropped"]) for r in LJ.line_dedup_report(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {i: want.get(i, set()) for i in got}


@pytest.mark.parametrize("look", [1, 1 << 40])
def test_crowded_keys(spark, monkeypatch, look):
    """Two hundred variants of one line share a segment: the crowded path, in several blocks, whether the look before
    the shuffle finds the key or not."""
    monkeypatch.setattr(LJ, "BLOCK", 50)
    monkeypatch.setattr(LJ, "LOOK", look)
    rng = random.Random(4)
    rows = [(i, "the same beginning of every line " + f"{i:03d}" + rng.choice("xy")) for i in range(200)] + [(900, "quite another line of text")]
    want = brute_lines(rows)
    got = {r["doc_id"]: set(r["dropped"]) for r in LJ.line_dedup_report(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {i: want.get(i, set()) for i in got}


def test_line_dedup_of_odd_rows(spark):
    long = "a line of more than twenty bytes"
    rows = [(1, f"{long}\nshort\n{long}"), (2, f"{long}!\nnew line that nobody else has"), (3, long), (4, None), (5, ""), (None, long), (6, "short\n\nshort"), (7, "z" * 70_000)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC + ", n_chars long")
    got = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in LJ.line_dedup_report(docs).collect()}
    assert got == {1: (3, [2]), 2: (2, [0]), 3: (1, [0]), 4: (0, []), 5: (1, []), None: (1, [0]), 6: (3, []), 7: (1, [])}
    out = LJ.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert left[1] == (f"{long}\nshort", len(long) + 6) and left[2][0] == "new line that nobody else has"
    assert set(left) == {1, 2, 4, 5, 6, 7} and left[4][0] is None
    assert LJ.line_dedup_report(docs.limit(0)).count() == 0


def test_rows_with_one_id_or_none_lose_no_unique_line(spark):
    a, u = "a line of more than twenty bytes", "unique line number {} of twenty bytes {}"
    texts = [(1, f"{a}\nx"), (None, f"{a}\ny"), (None, f"{u.format(1, 'pqr' * 5)}\nz"), (7, f"{a}\nv"), (7, f"{u.format(2, 'stu' * 5)}\nw"), (None, f"q\n{u.format(3, 'mno' * 5)}")]
    left = sorted(r["text"] for r in LJ.drop_repeated_lines(spark.createDataFrame(texts, DOC), least=1).collect())
    assert left == sorted(["y", f"{u.format(1, 'pqr' * 5)}\nz", "v", f"{u.format(2, 'stu' * 5)}\nw", f"q\n{u.format(3, 'mno' * 5)}", f"{a}\nx"])


def test_rows_with_one_id_or_none_lose_no_text(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "p q r s t u v"
    rows = [(1, a), (7, a), (7, b), (None, c), (None, c), (None, a), (None, "x y z"), (9, None), (None, None)]
    kept = CP.keep_one_per_class(spark.createDataFrame(rows, DOC))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (7, b), (None, c), (None, "x y z"), (9, None), (None, None)], key=str)


def exact(spark, path, **options):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in ES.exact_duplicates(spark, path, **options).collect()}


def test_exact_duplicates_of_odd_rows(spark, tmp_path):
    rows = [(1, "a", 0), (2, "a", 1), (3, None, 2), (4, "", 3), (5, "A", 4), (None, "a", 5), (6, "x" * 2_000_000, 6)]
    spark.createDataFrame(rows, DOC + ", keep_id long").coalesce(1).write.parquet(f"{tmp_path}/d")
    got = exact(spark, f"file://{tmp_path}/d")
    assert got == {1: (2, 3, False), 2: (2, 3, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), None: (2, 3, False), 6: (6, 1, True)}
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/e")
    assert exact(spark, f"file://{tmp_path}/e") == {}


def test_the_byte_check_tells_colliding_texts_apart(spark, tmp_path):
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "efg"), (5, "cd"), (6, "cd")]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/d")
    got = exact(spark, f"file://{tmp_path}/d", digest=lambda t: F.length(t).cast("string"))
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (6, 3, False), 5: (6, 3, False), 6: (6, 3, True), 4: (4, 1, True)}


def test_state_goes_on_when_files_are_added(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], DOC).write.parquet(f"{tmp_path}/d")
    path, state = f"file://{tmp_path}/d", f"file://{tmp_path}/s"
    assert exact(spark, path, state_dir=state, bytes_per_batch=1)[1] == (1, 1, True)
    spark.createDataFrame([(9, "a")], DOC).write.mode("append").parquet(f"{tmp_path}/d")
    got = exact(spark, path, state_dir=state, bytes_per_batch=1)
    assert got[1] == (9, 2, False) and got[9] == (9, 2, True) and got[2] == (2, 1, True)


def test_a_pattern_names_the_files_and_options_come_back(spark, tmp_path):
    for name, rows in (("a", [(1, "x")]), ("b", [(2, "x")]), ("c", [(3, "x")])):
        spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/{name}")
    before = {k: spark.conf.get(k, None) for k in ES.STATE_STORE}
    assert exact(spark, f"file://{tmp_path}/{{a,b}}") == {1: (2, 2, False), 2: (2, 2, True)}
    assert {k: spark.conf.get(k, None) for k in ES.STATE_STORE} == before


@pytest.mark.parametrize("name", ["op3_chosen_path_join", "op5_streaming_exact_dedup"])
def test_against_sql(spark, sf, name):
    from compare import assert_same

    from quillon.llm import queries

    assert_same(spark, sf, queries.queries()[name], queries.oracle_sql()[name])
