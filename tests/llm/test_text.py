"""Decontamination, language, pieces, token files, the pipeline."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from pyspark.sql import functions as F
from test_dedup import brute_near, tokens

from quillon.llm import decontam as D
from quillon.llm import langid as L
from quillon.llm import queries
from quillon.llm import token_scan as T
from quillon.llm import unigram as U

DOC = "doc_id long, text string"
ITEM = "item_id long, text string"


def test_contamination_against_sql(spark, sf):
    assert_same(spark, sf, queries.queries()["op7_positional_index"], queries.oracle_sql()["op7_positional_index"])


def brute_hits(docs, items):
    windows = {}
    for i, t in items:
        w = tokens(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = tokens(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if who := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= who
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("portion", [1 << 20, 40])
def test_contamination_of_odd_rows(spark, monkeypatch, portion):
    """Also with the items in many portions, whose hits overlap."""
    real = D._portions
    monkeypatch.setattr(D, "_portions", lambda items: real(items, portion))
    rng = random.Random(5)
    w = [f"v{rng.randint(0, 30)}" for _ in range(400)]
    items = [(1, " ".join(w[10:40])), (2, " ".join(w[20:50])), (3, "Short ITEM"), (4, None), (5, ""), (None, "no id here"), (1, " ".join(w[100:113])), (7, "a a a a a a a a a a a a a a a")]
    docs = [(1, " ".join(w)), (2, "x short, item; y"), (3, None), (4, ""), (5, "no id here"), (5, "no id here"), (None, " ".join(w[25:45])), (8, "a " * 40), (9, "z " * 30_000 + " ".join(w[100:113]))]
    got = D.contamination(spark.createDataFrame([(*d, 1) for d in docs], DOC + ", n_hit int"), spark.createDataFrame(items, ITEM)).drop("item_ids").collect()
    assert sorted(map(tuple, got), key=str) == brute_hits(docs, items)


def test_words_that_fool_polynomial_hashes_are_no_hits(spark):
    from test_dedup import thue_morse

    a, b = thue_morse(4096)
    docs, items = [(1, f"x {a} y"), (2, f"x {b} y"), (3, b)], [(1, a), (2, f"{b} y")]
    got = D.contamination(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).drop("item_ids").collect()
    assert sorted(map(tuple, got), key=str) == brute_hits(docs, items)


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOC), spark.createDataFrame([(1, "a b")], ITEM)
    assert [tuple(r)[:4] for r in D.contamination(docs, items.limit(0)).collect()] == [(1, 2, 0, 0)]
    assert D.contamination(docs.limit(0), items).count() == 0


def test_phrase_and_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "six five one x x x x x x x x x x four"), (3, "four x three")], DOC)
    items = spark.createDataFrame([(1, "three four"), (2, "one four six")], ITEM)
    index = D.build_index(docs)
    assert {(r["doc_id"], r["item_id"], r["position"]) for r in D.phrase_matches(index, items).collect()} == {(1, "1", 2)}
    near = {(r["doc_id"], r["item_id"]) for r in D.proximity_matches(index, items, slop=6).collect()}
    assert near == {(1, "1"), (1, "2"), (3, "1")}


def test_clean_documents_stay(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, text, "a"), (2, "other " + text[:100], "b"), (None, text, "c"), (3, None, "d")], DOC + ", n_words string")
    items = spark.createDataFrame([(1, text)], ITEM)
    kept = D.keep_clean(docs, items)
    assert kept.columns == docs.columns and {r["n_words"] for r in kept.collect()} == {"d"}
    few = D.keep_clean(docs, spark.createDataFrame([(1, " ".join(text.split()[:13]))], ITEM))
    assert {r["n_words"] for r in few.collect()} == {"a", "c", "d"}  # 13 of 300 words are under a twentieth


def test_a_clean_row_stays_whatever_shares_its_id(spark):
    """(7, contaminated), (7, clean), (8, clean), null ids alike; columns that are named as the operators name theirs."""
    item = " ".join(f"w{i}" for i in range(40))
    rows = [(7, item), (7, "a clean text"), (8, "another clean text"), (None, item), (None, "a clean text"), (7, None), (7, item)]
    docs = spark.createDataFrame([(*r, n, 1, 1, 1) for n, r in enumerate(rows)], DOC + ", n long, lost int, __lost int, row int")
    kept = D.keep_clean(docs, spark.createDataFrame([(1, item)], ITEM))
    assert kept.columns == docs.columns and {r["n"] for r in kept.collect()} == {1, 2, 4, 5}


def test_a_row_is_identified_by_all_its_evidence(spark):
    """Rows that differ in language or source alone are judged apart; rows without letters go, whatever their id."""
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    rows = [(i, " ".join(word("abcde" if i % 2 else "vwxyz") for _ in range(20)), "xx" if i % 2 else "yy", "s") for i in range(40)]
    rows += [(3, "123 456", "xx", "s"), (3, rows[3][1], "xx", None), (None, "", None, None), (None, rows[5][1], None, "s"), (3, rows[3][1], "xx", "s")]
    docs = spark.createDataFrame([(*r, n, 1, 1) for n, r in enumerate(rows)], DOC + ", lang string, source string, n long, lost int, __hash int")
    kept = L.keep_identified(docs)
    judged = L.identify_documents(docs.withColumn("doc_id", F.col("n")))
    assert kept.columns == docs.columns and {r["n"] for r in kept.collect()} == {r["doc_id"] for r in judged.where("kept").collect()} and 40 not in {r["n"] for r in kept.collect()}


def test_language_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = L.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("language = lang").count() >= 0.97 * docs.count()
    held_out = queries.queries()["language_of_pages"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.regexp_extract("html", 'lang="(..)', 1).alias("lang")), "page_id")
    assert held_out.where("language = lang").count() >= 0.95 * held_out.count()


def test_language_of_odd_rows(spark, sf):
    known = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(-1, None, "en", "a"), (-2, "", None, None), (-3, "123 !!", "en", "a"), (-4, "A.", None, None), (-5, "the and of the", "fr", "b.example.com")], known.schema)
    docs = known.unionByName(odd).withColumn("host", F.lit("clash"))
    got = {r["doc_id"]: r for r in L.identify_documents(docs).collect()}
    assert [got[i]["kept"] for i in (-1, -2, -3, -4)] == [False, False, False, True]
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == known.count() + 2
    assert L.identify_documents(docs.limit(0)).count() == 0


def brute_language(rows, labelled):
    """{key: (text_language, language, posterior, kept)} in plain Python: rows (key, text, declared, host)."""
    import math
    from collections import Counter

    def grams(text):
        out, last = [32], True
        for c in (text or "").encode().lower():
            letter = 0x61 <= c <= 0x7A or c >= 0x80
            if letter or not last:
                out.append(c if letter else 32)
            last = not letter
        if not last:
            out.append(32)
        return [((out[i] << 16 | out[i + 1] << 8 | out[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(len(out) - 2)]

    counts = {}
    for text, language in {x for x in labelled if x[0] is not None and x[1] is not None}:
        counts.setdefault(language, Counter()).update(grams(text))
    names = sorted(k for k, v in counts.items() if v)
    total = {k: sum(counts[k].values()) + 0.1 * 65536 for k in names}
    seen = []
    for key, text, declared, host in rows:
        g = grams(text)
        mean = [sum(math.log((counts[k][x] + 0.1) / total[k]) for x in g) / max(len(g), 1) for k in names]
        said = mean.index(max(mean)) if g else None
        letters = ""
        for c in declared or "":
            if not (c.isascii() and c.isalpha()):
                break
            letters += c.lower()
        labels = host.split(".") if host is not None else None
        values = (host, ".".join(labels[-2:]) if labels else None, labels[-1] if labels and len(labels) > 1 else None, letters)
        seen.append((key, len(g), mean, said, values))
    whole = Counter(s[3] for s in seen if s[3] is not None)
    prior = [(whole[i] + 1) / (sum(whole.values()) + len(names)) for i in range(len(names))]
    by = [Counter((s[4][j], s[3]) for s in seen if s[3] is not None and s[4][j] is not None) for j in range(4)]

    def smoothed(j, value, base):
        n = [by[j][value, i] for i in range(len(names))]
        return [(n[i] + 20 * base[i]) / (sum(n) + 20) for i in range(len(names))]

    out = {}
    for key, n, mean, said, (host, domain, suffix, declared) in seen:
        of_host = smoothed(0, host, smoothed(1, domain, prior))
        lift = [[math.log(x / p) for x, p in zip(smoothed(j, v, prior), prior, strict=True)] for j, v in ((3, declared), (2, suffix))]
        total_ = [min(n, 40) * mean[i] + math.log(of_host[i]) + lift[0][i] + lift[1][i] for i in range(len(names))]
        posterior = 1 / sum(math.exp(x - max(total_)) for x in total_)
        out[key] = (None if said is None else names[said], names[total_.index(max(total_))], posterior, n > 0 and posterior >= 0.5)
    return out


def same_languages(got, want):
    assert set(got) == set(want)
    for key, (text, language, posterior, kept) in want.items():
        r = got[key]
        assert r["posterior"] == pytest.approx(posterior, abs=2e-4), key
        if posterior > 0.501:
            assert (r["text_language"], r["language"], r["kept"]) == (text, language, kept), key


def test_languages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "en", "a.b.c"), (-2, "12", None, None), (-3, "A.", "fr-CA", "x.org"), (-4, "und der", "", "SRC1")], docs.schema))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"].lower() if r["source"] is not None else None) for r in docs.collect()]
    want = brute_language(rows, [(t, d) for _, t, d, _ in rows])
    same_languages({r["doc_id"]: r for r in queries.queries()["op8_language_evidence"](spark, sf).collect()}, brute_language(rows[:-4], [(t, d) for _, t, d, _ in rows[:-4]]))
    same_languages({r["doc_id"]: r for r in L.identify_documents(docs).collect()}, want)


def test_page_languages_against_brute_force(spark, sf):
    import re

    from quillon.llm.html_paths import main_text

    def host(url):
        m = re.search(r"://([^/?#]*)", url or "")
        return m[1].lower() or None if m else None

    labelled = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    rows = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        m = re.search(r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", r["html"] or "")
        rows.append((r["page_id"], main_text(r["html"]), m[1] if m else "", host(r["url"])))
    same_languages({r["page_id"]: r for r in queries.queries()["language_of_pages"](spark, sf).collect()}, brute_language(rows, labelled))


def test_held_out_accuracy_by_text_alone(spark):
    """The model is fitted on one half of the rows; the other half is judged without its declaration and source."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").where("lang is not null")
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    model = L.train(docs.where(half == 0).select("text", F.col("lang").alias("language")))
    bare = docs.where(half == 1).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    got = L.identify_documents(bare, model=model).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id")
    right, n = got.agg(F.avg((F.col("text_language") == F.col("true")).cast("int")), F.count(F.lit(1))).first()
    print(f"held-out accuracy {right:.4f} of {n}")
    assert n > 300 and right >= 0.95


def test_the_sample_is_never_empty(spark, monkeypatch):
    quota, texts = 200, 10**16
    assert L.hash_bound(quota, texts) > 0 and abs(L.hash_bound(quota, texts) / 2**63 * texts / quota - 1) < 1e-2
    assert L.hash_bound(200, 210) == 2**63 - 1 and L.hash_bound(1, 10**30) == 1
    monkeypatch.setattr(L, "LEAST_A_LANGUAGE", 1)
    labelled = spark.range(3_000_000).select(F.concat(F.lit("w"), F.hex("id")).alias("text"), F.lit("xx").alias("language"))
    monkeypatch.setattr(L, "hash_bound", lambda quota, texts: (2 << 63) // texts)
    assert L.train(labelled, sample_rows=2).languages == ["xx"]
    monkeypatch.setattr(L, "hash_bound", lambda quota, texts: 0)
    with pytest.raises(RuntimeError):
        L.train(labelled, sample_rows=2)


def test_many_languages_take_fewer_buckets(spark):
    labelled = spark.createDataFrame([(f"text {chr(97 + i % 26)}{chr(97 + i // 26)}x", f"l{i:03d}") for i in range(200)], "text string, language string")
    model = L.train(labelled)
    assert len(model.languages) == 200 and model.log_p.size <= L.MODEL_CELLS


def test_trigrams_of_rows():
    texts = ["", None, "a", "ab", "12", "abc def", "é"]
    bucket, first = L.trigrams(pa.array(texts))
    assert np.diff(first).tolist() == [0, 0, 1, 2, 0, 7, 2] and len(bucket) == first[-1]


def test_evidence_decides_where_the_text_is_short(spark):
    rows = [(i, 30, [-5.0, -7.0] if i % 2 == 0 else [-7.0, -5.0], "xx" if i % 2 == 0 else "yy", f"h{i % 2}.example.{'aa' if i % 2 == 0 else 'bb'}") for i in range(200)]
    rows += [(1000, 1, [-6.0, -6.05], "yy", "h1.example.bb"), (1001, 1, [-6.0, -6.05], None, None), (1002, 0, [0.0, 0.0], "xx", "h0.example.aa")]
    df = spark.createDataFrame(rows, "k long, n_grams long, likelihood array<double>, declared string, host string")
    got = {r["k"]: r for r in L.fuse(df, ["xx", "yy"]).collect()}
    assert got[1000]["text_language"] == "xx" and got[1000]["language"] == "yy" and got[1000]["posterior"] > 0.9
    assert got[1001]["language"] == "xx" and got[1002]["kept"] is False and got[1002]["language"] == "xx"


# ---------------------------------------------------------------- pieces
@pytest.fixture(scope="module")
def small_vocabulary():
    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    rng = random.Random(6)
    pieces = {"▁", "a", "b", "é", "▁a", "ab", "ba", "aba", "▁ab", "bab", "▁▁", "éa"}
    return U.vocabulary([*entries, *((p, -rng.uniform(1, 6), 1) for p in sorted(pieces))], True), sorted(pieces), {p: s for p, s, k in []}


def brute_best(v, names, text):
    """The best score over all segmentations, by recursion over characters."""
    score = {p.replace("▁", " "): v.score[258 + i] for i, p in enumerate(names)}
    best = [0.0] + [-1e18] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 4) + 1):
            part = text[i:j]
            s = score.get(part, v.fallback if j == i + 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_viterbi_against_brute_force(small_vocabulary):
    v, names, _ = small_vocabulary
    rng = random.Random(7)
    texts = ["".join(rng.choice("aabbé ☃▁\n") for _ in range(rng.randint(1, 150))) for _ in range(300)]
    ids, first, data, offsets = U.encode_batch(v, pa.array(texts))
    back, ends = U.decode_batch(v, ids, first)
    assert np.array_equal(back, data) and np.array_equal(ends, offsets)
    for i, t in enumerate(texts):
        mine, k, total = ids[first[i] : first[i + 1]].tolist(), 0, 0.0
        while k < len(mine):
            if mine[k] >= 258:
                total, k = total + v.score[mine[k]], k + 1
            else:  # a character as bytes
                lead = mine[k] - 2
                total, k = total + v.fallback, k + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
        assert total == pytest.approx(brute_best(v, names, " " + t))


def test_double_array_holds_every_key():
    rng = random.Random(8)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randint(1, 6))): i for i in range(3000) for _ in [0]}
    trie = U.Trie.of(keys)
    for key, value in keys.items():
        state = 0
        for b in key:
            nxt = trie.base[state] + b
            assert trie.check[nxt] == state
            state = nxt
        assert trie.value[state] == value


def test_encoding_round_trip_of_odd_rows(spark, sf):
    texts = [None, "", " ", "  two  blanks ", "▁marker▁", "日本語 ☃ \n\t é\r\n", "x" * 100_000, "a" * 300 + " " * 300, "plain words here"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "same", "c"), (None, "same", "c")], DOC + ", n_tokens string")
    got = {r["doc_id"]: r for r in U.round_trip(df).collect()}
    assert all(r["exact"] for r in got.values()) and got[0]["n_tokens"] == got[1]["n_tokens"] == 0 and got[2]["n_tokens"] > 0
    assert all(r["text_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest() for i, r in got.items() if i is not None)
    back = U.decode(U.encode(df)).select("doc_id", "text", "n_tokens").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in [*enumerate(texts), (None, "same"), (None, "same")])
    assert U.round_trip(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert U.round_trip(docs).where("not exact").count() == 0


# ---------------------------------------------------------------- token files
def test_token_counts_against_the_tokenizer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    with open(T.VOCABULARY, "rb") as f:
        encoding = T._encoding(f.read())
    want = {r["doc_id"]: len(encoding.encode_ordinary(r["text"] or "")) for r in docs.collect()}
    got = T.count_tokens(docs, file_tokens=20_000, block_bytes=1554).collect()  # documents reach over many blocks
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len({r["file"] for r in got}) > 3


def test_token_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "abc def", 1), (2, "", 1), (3, "word " * 30_000, 1), (3, "abc def", 1)], DOC + ", start int")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in T.count_tokens(df, block_bytes=2000).collect()), key=str)
    with open(T.VOCABULARY, "rb") as f:
        encoding = T._encoding(f.read())
    assert got == sorted(((i, len(encoding.encode_ordinary(t or ""))) for i, t in ((1, None), (None, "abc def"), (2, ""), (3, "word " * 30_000), (3, "abc def"))), key=str)
    assert T.count_tokens(df.limit(0)).count() == 0


@pytest.mark.parametrize("first", [b"", b"\xef\xbb\xbf", b"\n", b"\n\n\n"])
@pytest.mark.parametrize("split", ["64m", "1k"])
def test_flat_files_in_byte_ranges(spark, tmp_path, first, split):
    """Files of any content, cut into ranges of a kilobyte; separators off a token's boundary don't count."""
    rng = np.random.default_rng(len(first))
    (tmp_path / "f").mkdir()
    want = set()
    for k in range(3):
        ids = rng.integers(0, 50256, 20_000).astype("<u2")
        ids[rng.random(20_000) < 0.01] = T.SEPARATOR
        ids[rng.random(20_000) < 0.02] = 0xC450 >> 8 | 0x5000  # the separator's bytes, one place off
        ids[rng.random(20_000) < 0.02] = 0x0A0A
        raw = first + ids.tobytes()
        raw = raw[: len(raw) // 2 * 2] + (np.array([T.SEPARATOR], "<u2").tobytes() if k else b"\n")
        (tmp_path / "f" / f"part-{k}").write_bytes(raw)
        flat = np.frombuffer(raw[: len(raw) // 2 * 2], "<u2")
        ends = np.flatnonzero(flat == T.SEPARATOR)
        starts = np.concatenate([[0], ends[:-1] + 1])
        want |= {(len(raw), i, int(a), int(b - a)) for i, (a, b) in enumerate(zip(starts, ends, strict=True))}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        ranges = T.read_ranges(spark, f"file://{tmp_path}/f")
        blocks = T.scan_blocks(ranges, block_bytes=700)
        sizes = ranges.select("file", "size").distinct()
        rows = T.stitch(blocks).join(sizes, "file").select("size", "document", "start", "n_tokens").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, rows)) == sorted(want)


def test_stitching_by_hand(spark):
    rows = [(0, 24, 0, 0, 8, [2]), (0, 24, 0, 1, 8, []), (0, 24, 9, 0, 8, [0, 2, 3, 6]), (1, 2, 0, 0, 3, [0]), (2, 9, 0, 0, 3, [1]), (2, 9, 0, 1, 7, [1, 2])]
    got = T.stitch(spark.createDataFrame(rows, "file long, size long, start long, block long, n long, places array<long>")).orderBy("file", "document").collect()
    assert [(r["file"], r["document"], r["start"], r["n_tokens"]) for r in got] == [(0, 0, 0, 1), (0, 1, 2, 6), (0, 2, 9, 0), (0, 3, 10, 1), (1, 0, 0, 0), (2, 0, 0, 2)]


# ---------------------------------------------------------------- pipeline
def test_every_stage_on_its_own_input(spark, sf):
    import corpus_pipeline as P

    from quillon.llm.store import materialize

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        seen[name] = docs
        docs = materialize(stage(spark, docs, sf), "test-stage")
        if name != "tokens":
            assert docs.columns == columns
    near = [(r["doc_id"], r["text"]) for r in seen["near duplicates"].select("doc_id", "text").collect()]
    kept = {i for i, (c, _) in brute_near(near).items() if i == c}
    assert kept == {r["doc_id"] for r in seen["decontamination"].select("doc_id").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    judged = brute_hits([tuple(r) for r in seen["decontamination"].select("doc_id", "text").collect()], items)
    assert {r[0] for r in judged if not r[5]} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert docs.where("not exact").count() == 0
    assert seen["lines"].count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_of_odd_rows(spark, sf):
    import corpus_pipeline as P

    kinds = "doc_id long, text string, lang string, source string, n_chars long, extra string, __of int"
    rows = [(1, None, None, None, None, "e", 1), (None, "some words here that stand alone", "en", "s", 1, None, 1), (2, "", "en", "s", 0, "e", 1), (3, "some words here that stand alone", "en", "s", 3, "e", 1), (3, "w " * 50_000, "en", None, 1, "e", 1)]
    docs = spark.createDataFrame(rows, kinds).drop("__of")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        docs = stage(spark, docs, sf)
    # null and empty texts have no language; of the two rows with one text that with an id stays
    assert [r["doc_id"] for r in docs.collect()] == [3, 3]


def test_pipeline_loses_no_clean_unique_text(spark, sf):
    """Shared and null ids: whatever the stages drop is a copy, contaminated or without a language."""
    import corpus_pipeline as P

    real = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) between 300 and 3000").limit(40).collect()
    bench = " ".join(r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(2).collect())
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else k, r["text"], r["lang"], r["source"], len(r["text"])) for k, r in enumerate(real)]
    rows += [(7, bench, "en", "src0", len(bench)), (None, bench, "en", "src1", len(bench)), (7, rows[0][1], rows[0][2], rows[0][3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = docs
    for _, stage in P.STAGES[:-1]:
        left = stage(spark, left, sf)
    texts = [r["text"] for r in left.collect()]
    near = brute_near([(k, r[1]) for k, r in enumerate(rows)])
    hits = {k: h for (k, *_, h) in brute_hits([(k, r[1]) for k, r in enumerate(rows)], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])}
    lines = lambda t: {x for x in t.split("\n") if x.strip()}
    for k, r in enumerate(rows):
        alone = near[k][1] == 0 and not hits[k]
        if alone:
            others = set().union(*(lines(x[1]) for j, x in enumerate(rows) if j != k))
            assert any(lines(t) >= lines(r[1]) - others for t in texts), k
    assert not any(bench[:200] in t for t in texts)


def test_languages_beyond_the_limit_are_one_class(spark):
    """5,000 labels, most of them on one row: the plan does not grow with them, the frequent ones stay apart."""
    words = {"de": "der hund und die katze schlafen", "en": "the dog and the cat are asleep"}
    rows = [(i, f"{words[k]} {i}", k, f"{k}{i % 3}.org") for k in words for i in range(100)]
    rows += [(1000 + i, f"zzq xxv {i} qqz", f"dirt{i:04d}", "dump.net") for i in range(4998)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = L.train(docs.select("text", F.col("lang").alias("language")), max_languages=2)
    assert model.languages == ["de", "en", L.RARE]
    got = {r["doc_id"]: r["language"] for r in L.identify_documents(docs.where("doc_id >= 1000"), model=model).collect()}
    assert len(got) == 4998 and set(got.values()) == {L.RARE}
    got = L.identify_documents(docs.where("doc_id < 1000"), model=model).groupBy("language").count().collect()
    assert {r["language"]: r["count"] for r in got} == {"de": 100, "en": 100}


def test_many_languages_keep_the_plan_small(spark):
    """60 labels: each a class of its own with words of its own."""
    rows = [(i, " ".join(f"{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{x}" for x in ("ga", "ru", "mo")) + f" {j}", f"l{i:02d}", f"host{i % 7}.org") for i in range(60) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = L.identify_documents(docs).collect()
    assert len(got) == 120 and all(r["language"] == f"l{r['doc_id']:02d}" for r in got)
    plan = L.fuse(L.score_texts(docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host")), L.train(docs.select("text", F.col("lang").alias("language")))), [f"l{i:02d}" for i in range(60)])
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 40_000
