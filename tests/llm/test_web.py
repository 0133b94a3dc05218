"""WARC bundles, url rules, main text."""

import hashlib

import pytest
import zstandard
from compare import assert_same
from pyspark.sql import functions as F

from quillon.llm import html_paths as H
from quillon.llm import queries
from quillon.llm import url_filter as U
from quillon.llm import warc as W

PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize("name", ["op1_warc_bundles", "op2_url_cascade", "op6_tag_path_text"])
def test_against_sql(spark, sf, name):
    assert_same(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


def test_archives_of_odd_rows(spark, tmp_path):
    rows = [(1, "http://a", "x" * 200), (2, None, "x" * 200), (3, None, None), (4, "u\r\n: ü", "é" * 60), (None, "q", "é" * 60), (5, "z", "short"), (6, "z", "short"), (7, "big", "y\r\n\r\nWARC/1.1" * 60_000), (1, "http://a", "x" * 200)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGE + ", payload_digest string")
    path = f"file://{tmp_path}/w"
    got = [tuple(r) for r in W.archive_round_trip(df, path).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    want = [(1, 200, "response", None)] * 2 + [(2, 200, "revisit", 1), (3, 0, "response", None), (4, 120, "response", None), (None, 120, "revisit", 4), (5, 5, "response", None), (6, 5, "response", None),
            (7, 13 * 60_000, "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    records = W.read_archives(spark, path)
    assert {r["page_id"]: r["url"] for r in records.collect()}[4] == "u\r\n: ü"
    full = records.where("record_type = 'response'").select("payload_digest", F.sha2("payload", 256).alias("d"))
    assert full.where("payload_digest <> d").count() == 0
    assert W.archive_round_trip(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_random_access_and_any_tool(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * 3000) for i in range(60)]
    path = f"file://{tmp_path}/w"
    W.write_archives(spark.createDataFrame(rows, PAGE).coalesce(1), path)
    index = W.read_index(spark, path)
    assert index.count() == 60 and index.agg(F.max("frame")).first()[0] >= 3
    wanted = index.where("frame = 2")
    found = {r["record_id"]: bytes(r["record"]) for r in W.read_records(spark, path, wanted).collect()}
    assert len(found) == wanted.count() > 0
    for record in found.values():
        head, block, _ = W.parse_record(record)
        assert hashlib.sha256(block).hexdigest() == head["WARC-Payload-Digest"].removeprefix("sha256:")
    file = next(f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-"))
    data = file.read_bytes()
    assert data.endswith(W.SEEKABLE_MAGIC) and sum(n for _, n, _ in W.seek_table(data)) < len(data)
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 60


def independent_parse(data):
    """(headers, block) of each record of an uncompressed WARC file, by the letter of WARC/1.1."""
    at, out = 0, []
    while at < len(data):
        assert data.startswith(b"WARC/1.1\r\n", at)
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, v = line.decode().split(":", 1)
            assert k not in head
            head[k] = v.strip()
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        assert data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size
        out.append((head, block))
    return out


def test_records_by_an_independent_parser(spark, tmp_path):
    import re
    from urllib.parse import urlsplit

    rows = [(1, "http://a/x y", "p" * 200), (2, "http://b/", "p" * 200), (3, None, "p" * 200), (4, "http://ü/%41", "q" * 150), (4, "http://ü/%41", "q" * 150), (5, "http://c", "q" * 150)]
    rows += [(6, "http://d", "s"), (6, "http://d", "s"), (None, "", None), (None, "", None)]
    W.write_archives(spark.createDataFrame(rows, PAGE).repartition(3), f"file://{tmp_path}/w")
    records = []
    for file in (tmp_path / "w").iterdir():
        if file.name.startswith("part-"):
            records += independent_parse(zstandard.ZstdDecompressor().stream_reader(file.read_bytes(), read_across_frames=True).read())
    assert len(records) == len(rows) == len({h["WARC-Record-ID"] for h, _ in records})
    by_id = {h["WARC-Record-ID"]: (h, b) for h, b in records}
    for head, block in records:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", head["WARC-Record-ID"])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", head["WARC-Date"])
        assert re.fullmatch(r"[\x21-\x7e]+", head["WARC-Target-URI"]) and urlsplit(head["WARC-Target-URI"]).scheme
        if head["WARC-Type"] == "revisit":
            assert block == b"" and head["WARC-Refers-To-Date"] == head["WARC-Date"] and head["WARC-Profile"].endswith("identical-payload-digest")
        else:
            assert hashlib.sha256(block).hexdigest() == head["WARC-Payload-Digest"].removeprefix("sha256:")
    revisits = {h.get("WARC-Page-Id"): h for h, _ in records if h["WARC-Type"] == "revisit"}
    assert set(revisits) == {"2", "3", "5"}
    for page in ("2", "3"):
        response, block = by_id[revisits[page]["WARC-Refers-To"]]
        assert response["WARC-Page-Id"] == "1" and block == b"p" * 200
        assert revisits[page]["WARC-Refers-To-Target-URI"] == response["WARC-Target-URI"] == "http://a/x%20y"
    assert "WARC-Refers-To" not in revisits["5"] and revisits["5"]["WARC-Refers-To-Target-URI"] == "http://%C3%BC/%41"
    read = W.read_archives(spark, f"file://{tmp_path}/w").select("page_id", "url", "record_id")
    assert sorted(((r[0], r[1]) for r in read.collect()), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)


def test_cascade_levels_part_keys_and_large_lists_are_joined(spark):
    rows = [(i, f"http://{h}/en/{i}", "x", "y") for i, h in enumerate(["bad.org", "a.bad.org", "good.org", "www.example.com", "example.com", "x.net", "." * 300_000 + "bad.org", "bad.org" + "." * 300_000, "y" * 200_000])]
    df = spark.createDataFrame(rows, "page_id int, url string, held string, first string")
    listed = spark.createDataFrame([("bad.org",), (None,), ("q.com",), ("bad.org",)], "host string")
    some = U.judge_urls(df, queries.RULES, listed)
    joined = U.judge_urls(df, queries.RULES, listed, max_bits=1)
    assert some.columns == joined.columns == [*df.columns, "host", "path", "rule", "verdict"]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in some.collect()}
    assert got == {r["page_id"]: (r["rule"], r["verdict"]) for r in joined.collect()}
    want = [(None, "block"), (None, "block"), (None, "allow"), ("www.example.com/en/", "allow"), ("example.com/en/", "block"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow")]
    assert [got[i] for i in range(len(rows))] == want


def test_cascade_is_exact_with_few_bits(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("substring(key, 2) % 7 = 0")
    cascade = U.Cascade(listed, universe, bits_per_key=3)
    assert len(cascade.levels) > 2
    wrong = universe.select("key", cascade.holds(F.col("key")).alias("h")).where("h <> (substring(key, 2) % 7 = 0)")
    assert wrong.count() == 0
    assert universe.where(U.Cascade(listed.limit(0), universe).holds(F.col("key"))).count() == 0


def test_urls_of_odd_rows(spark):
    rows = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/", "http://example.com", "x://net/es/1", "ftp://spam-farm.example.org?/en/", "http://a.spam-farm.example.org/", "http://com/", "http://notcom/", "http://x.net/fr/://y"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)], "page_id int, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(df, queries.RULES, queries.LISTED_HOSTS).collect()}
    assert [got[i][:2] for i in range(4)] == [("", "")] * 4 and all(got[i][2:] == (None, "allow") for i in range(4))
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5][2:] == ("example.com/en/", "block") and got[6] == ("example.com", "", None, "allow")
    assert got[7][2:] == ("net/es/", "block") and got[8] == ("spam-farm.example.org", "", None, "block") and got[9][3] == "block"
    assert got[10][2:] == ("com/", "allow") and got[11][2] is None and got[12][2:] == ("net/fr/", "block")
    assert U.judge_urls(df.limit(0), queries.RULES, queries.LISTED_HOSTS).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<", "<"), ("plain &amp; text", "plain & text"),
        ("<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>One,  two.<br>Three &lt;b&gt;.<p><b>Four<p>Five.</article><footer>F</footer>", "Head\n\nOne, two. Three <b>.\n\nFour\n\nFive."),
        ("<body><div class=ad>Buy, now. Cheap.</div><article><p>Text <a href='x>y'>link</a>, more.</p><aside>Note.</aside><form><p>Mail?</p></form></article><div id='comments'><p>First, indeed.</p></div>", "Text link, more."),
        ("<body><div><p>A long paragraph, with commas, and words that go on.</p><p>Another long one, as long, and as good as the first.</p></div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul>",
         "A long paragraph, with commas, and words that go on.\n\nAnother long one, as long, and as good as the first."),
        ("<article><p>Cut &amp; off &am", "Cut & off &am"), ("<article><p>Cut<scr", "Cut"), ("<article><script>var a='<p>no</p>';</script><p>yes", "yes"),
        ("<article><p>a<!-- <p>no</p> -->b</p><style>p{}</style></article>", "ab"), ("<nav><p>menu, only.</p></nav>", ""),
        ("<article><table><tr><td>x<td>y</table><pre>a\n  b</pre></article>", "x\n\ny\n\na b"),
    ],
)
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_long_and_deep_pages():
    assert H.main_text("<article>" + "<p>Word, word.</p>" * 20_000).count("\n\n") == 19_999
    assert H.main_text("<div>" * 3000 + "deep") == "deep"
    assert H.main_text("<" * 50_000).startswith("<<<")
    assert H.main_text('<a x="' * 5000) == ""


@pytest.mark.parametrize(
    "page",
    [
        "<div>a, b. " * 50_000, "<div class=ad>c. " * 50_000, "<b>x" * 50_000 + "</i>" * 50_000, "<b>" + "<div>y, " * 25_000 + "</b>" * 25_000,
        "<ul><li>z" * 25_000 + "<li>w" * 25_000, "<p><span>q" * 50_000, "<main><div class=nav>v, " * 20_000,
    ],
)
def test_nesting_costs_no_square(page):
    import time

    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 3


PROSE = "A sentence of some length, with commas, and with a point. Another one, as long, follows it."
CLOUD = "".join(f"<span><a href=/{i}>tag{i}</a></span>" for i in range(30))
PLAIN = f"<body><div><div>{CLOUD}</div><div><h2>The title of it</h2><p>{PROSE}</p><p>{PROSE}</p><p>Yes.</p><div><span>{CLOUD}</span></div></div><div>{CLOUD}</div></div>"


def test_ratios_choose_nodes_where_no_article_is_named(monkeypatch):
    """Neither classes nor article elements: only the ratios tell the text from the links around and inside it."""
    want = f"The title of it\n\n{PROSE}\n\n{PROSE}\n\nYes."
    assert H.main_text(PLAIN) == want
    monkeypatch.setattr(H, "_fused", lambda nodes: {n.path: 1.0 for _, n, _ in nodes})
    assert H.main_text(PLAIN) != want


@pytest.mark.parametrize("holder", ["article", "main", "div"])
@pytest.mark.parametrize("head", ["div class='post-header'", "div class='entry-header'", "header"])
def test_the_article_keeps_its_own_title(holder, head):
    page = f"<body><div class=header><a href=/>Site</a></div><{holder}><{head}><h1>The title of the article</h1></{head.split()[0]}><p>{PROSE}</p><p>{PROSE}</p></{holder}>"
    got = H.main_text(page)
    assert got.endswith(f"{PROSE}\n\n{PROSE}") and "Site" not in got
    assert holder == "div" or got.startswith("The title of the article")


def test_pages_table(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = H.extract_pages(pages.withColumn("text", F.lit("clash"))).collect()
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == len(source)
    for r in rows:
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r["page_id"]], re.S)
        inner = re.sub(r"<[a-zA-Z/][^<>]*\Z", "", m[1]) if m else ""
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    assert H.extract_pages(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "u", "<p>x.")], PAGE)
    assert sorted((r["text"], r["n_chars"]) for r in H.extract_pages(odd).collect()) == [("", 0), ("x.", 2)]


def test_cascade_stays_in_a_large_universe(spark):
    """At 16 bits a key, more of the universe passes the first level wrongly than the second may hold."""
    listed = spark.createDataFrame([(f"bad{i}.org",) for i in range(7)], "key string")
    universe = spark.range(0, 300_000, 1, 4).select(F.concat(F.lit("host"), "id", F.lit(".net")).alias("key")).unionAll(listed)
    most = 4096
    assert 300_000 * U.false_rate(16) * 16 > most
    cascade = U.Cascade(listed, universe, max_bits=most)
    assert cascade.fits and all(64 * level.words <= most + 64 for level in cascade.levels)
    assert sorted(r["key"] for r in universe.where(cascade.holds(F.col("key"))).collect()) == [f"bad{i}.org" for i in range(7)]


def test_bits_of_a_level_grow_with_the_universe():
    assert U.bits_for(7, 100_000, 16, U.MAX_BITS) == 16
    for others in (10**9, 10**12, 10**14):
        bits = U.bits_for(7, others, 16, U.MAX_BITS)
        assert 7 * bits <= U.MAX_BITS and others * U.false_rate(bits) * 16 <= U.MAX_BITS
    assert U.bits_for(10**6, 10**12, 16, U.MAX_BITS) == 16
