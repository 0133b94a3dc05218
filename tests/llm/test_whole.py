"""Cases that a bound, a shared key or a sample once left out."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_dedup import DOC, brute_lines

from quillon.llm import chosen_path as CP
from quillon.llm import html_paths as H
from quillon.llm import langid as L
from quillon.llm import line_join as LJ
from quillon.llm import queries


def brute_repeats(rows):
    """{doc_id: numbers of the lines that repeat an earlier one exactly}, blank lines aside, at any length."""
    seen, out = set(), defaultdict(set)
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            if line.strip():
                if line in seen:
                    out[i].add(k)
                seen.add(line)
    return out


def test_short_lines_repeat_exactly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    near, equal = brute_lines(rows), brute_repeats(rows)
    got = {r["doc_id"]: set(r["dropped"]) for r in queries.queries()["op10_line_edit_join"](spark, sf).collect()}
    assert got == {i: near.get(i, set()) | equal.get(i, set()) for i in got}
    assert any(equal[i] - near.get(i, set()) for i in equal)


def test_short_lines_of_odd_rows(spark):
    rows = [(1, "Les.\n\n  \nLes."), (2, "Les\n \n\nLes."), (3, "é\n日本"), (4, "日本\né!")]
    docs = spark.createDataFrame(rows, DOC)
    got = {r["doc_id"]: r["dropped"] for r in LJ.line_dedup_report(docs, least=1).collect()}
    assert got == {1: [3], 2: [3], 3: [], 4: [0]}
    left = {r["doc_id"]: r["text"] for r in LJ.drop_repeated_lines(docs, least=1).collect()}
    assert left == {1: "Les.\n\n  ", 2: "Les\n \n", 3: "é\n日本", 4: "é!"}


def test_rows_that_share_an_id_or_have_none_are_documents_of_their_own(spark):
    same, own = "a line of more than twenty bytes", "words that no other document has: "
    rows = [(1, same), (None, f"{same}\n{own}x y z"), (None, f"{own}quite different\n{own}some more of them"), (None, f"{own}quite different"), (5, f"{own}the first of two\n{same}"), (5, f"{own}another text here\n{own}which is longer")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], DOC + ", n long")
    left = {r["n"]: r["text"] for r in LJ.drop_repeated_lines(docs).collect()}
    assert {n: left[n] for n in (0, 4, 5)} == {0: same, 4: f"{own}the first of two", 5: rows[5][1]}
    assert left[1] == f"{own}x y z"
    # of the two null-id rows with one line at one number, the later one loses it
    assert sorted((left.get(2, ""), left.get(3, ""))) in (["", rows[2][1]], sorted((f"{own}some more of them", rows[3][1])))
    report = LJ.line_dedup_report(docs.drop("n")).collect()
    assert len(report) == 6 and sorted(r["n_dropped"] for r in report) == [0, 0, 0, 1, 1, 1]


def test_one_row_of_each_class_by_row(spark):
    base, other = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, base), (2, base), (2, other), (3, "one two three four five six"), (3, "six five four three two one"), (None, other), (None, "x y z x y z w"), (None, "x y z x y z w"), (4, None), (None, ""), (3, "six five four three two one")]
    kept = CP.keep_one_per_class(spark.createDataFrame(rows, DOC))
    want = [(1, base), (2, other), (3, rows[3][1]), (3, rows[4][1]), (None, rows[6][1]), (4, None), (None, "")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_a_rare_language_and_a_repeated_text_are_in_the_model(spark):
    rng = random.Random(5)

    def text(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(12))

    often = [(text("abcdefg"), "xx") for _ in range(6000)] + [(text("abcdefg"), "yy")] * 4000
    rare = [(text("opqrstu"), "zz") for _ in range(3)]
    labelled = spark.createDataFrame(often + rare, "text string, language string")
    model = L.train(labelled, sample_rows=300)
    assert model.languages == ["xx", "yy", "zz"]
    once = L.train(labelled.distinct(), sample_rows=300)
    assert (model.log_p == once.log_p).all()
    docs = labelled.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.col("language").alias("lang"), F.lit("s").alias("source"))
    got = L.identify_documents(docs, sample_rows=300).join(docs, "doc_id").where("lang = 'zz'").collect()
    assert [r["text_language"] for r in got] == ["zz"] * 3


LONG = "A long paragraph, with commas, and words. It goes on, and on."


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class='layout no-sidebar'", "div class='sticky-header wrapper'", "form", "div role=form", "header"])
@pytest.mark.parametrize("holder", ["article", "main", "div"])
def test_a_mark_around_the_article_does_not_drop_it(wrapper, holder):
    inner = f"<{holder}><h1>Head</h1><p>{LONG}</p><p>{LONG} Two.</p><p><a href=1>Only a link</a></p><div class=share>Share, now.</div></{holder}>"
    page = f"<body><{wrapper}>{inner}<div class=sidebar><p>Aside, yes.</p></div></{wrapper.split()[0]}><div id=comments><p>First, indeed.</p></div>"
    text = H.main_text(page).split("\n\n")
    assert text[-3:] == [LONG, LONG + " Two.", "Only a link"] and "Aside, yes." not in text and "Share, now." not in text


def test_marks_beside_the_article_still_drop():
    comments = f"<div id=comments><article><p>Nice, one.</p></article><article><p>{LONG}</p></article></div>"
    assert H.main_text(f"<article><p>{LONG}</p></article>{comments}") == LONG
    assert H.main_text(f"<div class=post><p>{LONG * 5}</p></div>{comments}") == LONG * 5
    assert H.main_text("<div class=ad>" * 1000 + "".join(f"<p>{LONG}</p></div>" for _ in range(1000))).count(LONG) > 0
