"""Source divergence audit: which sources of a language differ from one another, and by which terms.

Plain relational. The texts' terms are exploded and counted by (language, source, term), once; every later step reads
that table; the groups come from the two short columns alone. A language keeps the terms that at least ``LEAST`` of its
documents have. Groups (language, source) cross the kept terms of their language, so that zeros count; the dense table
joins itself on language and term, the terms are summed for every two sources, and windows rank. All arithmetic is on
whole numbers.

Hot languages: no key is a language alone. Where groups are few they are broadcast, and a term carries its groups' counts;
else they meet the terms by (language, salt). Every term of a language has as many dense rows as the language has groups, so the self-join's keys are
even however often a term occurs. The ranks of terms are taken of each salt's best first.

Defined results. Null text, language and source are ''. A group without terms has zeros for all kept terms. Repeated
rows count as they stand; rows with equal or null doc_ids are documents of their own. A language without kept terms gives 0 for
its pairs; a source alone in its language has no pairs. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.store import materialize, scratch

TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
A_Z, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, SCALE, MOST_TERMS = 3, 1_000_000_000, 200
#: Groups that are broadcast; beyond it they are spread over salts.
MOST_BROADCAST, SALTS = 10_000, 64


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it).

    A document gives a row for each of its terms' occurrences and, behind these, one more for each distinct term; a
    partial aggregate stands before the only shuffle. Cutting at what lies between the terms finds the same terms as
    matching them, in a quarter of the time. Of a text that is ASCII alone, A-Z is all that lowering changes, and quicker."""
    text = F.coalesce("text", F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, A_Z, LOWERED))
    words = F.split(lowered, TERMS.replace("^", ""))
    cut = docs.select(*_group(), words.alias("words"))
    rows = cut.select("lang", "source", F.size("words").alias("size"), F.posexplode(F.concat("words", F.array_distinct("words"))).alias("pos", "term")).where("term <> ''")
    again = F.col("pos") >= F.col("size")
    return rows.groupBy("lang", "source", "term").agg(F.sum((~again).cast("long")).alias("n"), F.sum(again.cast("long")).alias("docs"))


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + size)), in three steps of a thousand that no count of ours overflows."""
    whole, out, left = total + size, F.lit(0).cast("long"), count + 1
    for _ in range(3):
        out = out * 1000 + F.call_function("div", left * 1000, whole)
        left = (left * 1000) % whole
    return 1 + out


def excess(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def dense_shares(terms: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, gid, term, n, p, q: every group's and the language's share of every kept term; groups: lang, gid, source), of
    the counts of terms and all groups (lang, source)."""
    had = F.collect_list(F.struct("source", "n")).alias("had")
    vocabulary = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), had).where(F.col("docs") >= LEAST).drop("docs")
    vocabulary = materialize(vocabulary, "divergence-terms")
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("lang_n").alias("lang_total"))
    totals = vocabulary.select("lang", F.inline("had")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "size", "lang_total"])
    groups = materialize(groups.withColumn("gid", F.monotonically_increasing_id()), "divergence-groups")
    if groups.count() <= MOST_BROADCAST:
        # a term brings the counts of the groups that have it; the language's other groups are added with none
        every = F.broadcast(groups.groupBy("lang").agg(F.collect_list("source").alias("every")))
        none = F.transform(F.array_except("every", F.col("had")["source"]), lambda x: F.struct(x.alias("source"), F.lit(0).cast("long").alias("n")))
        counted = vocabulary.join(every, "lang").select("lang", "term", "lang_n", F.inline(F.concat("had", none)))
        dense = counted.join(F.broadcast(groups), ["lang", "source"])
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        crossed = vocabulary.drop("had").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
        dense = crossed.join(terms.select("lang", "source", "term", "n"), ["lang", "term", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p, q = share(F.col("n"), F.col("total"), F.col("size")), share(F.col("lang_n"), F.col("lang_total"), F.col("size"))
    return materialize(dense.select("lang", "term", "gid", "n", p.alias("p"), q.alias("q")), "divergence-dense"), groups


def pair_values(dense: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value."""
    a = dense.select("lang", "term", F.col("gid").alias("a"), "p")
    b = dense.select("lang", "term", F.col("gid").alias("b"), F.col("p").alias("other"))
    sums = a.join(b, ["lang", "term"]).where("a <> b").groupBy("a", "b").agg(F.sum(excess(F.col("p"), F.col("other"))).alias("value"))
    left, right = groups.select("lang", F.col("gid").alias("a"), "source"), groups.select("lang", F.col("gid").alias("b"), F.col("source").alias("item"))
    return left.join(right, "lang").where("a <> b").join(sums, ["a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def term_values(dense: DataFrame, groups: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, item (a term that the group has more of than its language), value: the ``most`` first of each group.

    Whatever is among a group's first is among the first of its salt: a group of many terms is ranked in parts."""
    over = dense.where("n > 0 and p > q").select("gid", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"), F.pmod(F.xxhash64("term"), F.lit(SALTS)).alias("salt"))
    w = Window.partitionBy("gid", "salt").orderBy(F.desc("value"), "item")
    best = over.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth", "salt")
    return best.join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", "item", "value")


def divergence(docs: DataFrame, *, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source): all pairs and the first terms of every group."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        counts = materialize(term_counts(docs), "divergence-counts")
        dense, groups = dense_shares(counts, docs.select(*_group()).distinct())
        parts = [x.withColumn("part", F.lit(name)) for x, name in ((pair_values(dense, groups), "pair"), (term_values(dense, groups, most), "term"))]
        w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        ranked = parts[0].unionByName(parts[1]).withColumn("rank", F.row_number().over(w))
        made = materialize(ranked.where((F.col("part") == "pair") | (F.col("rank") <= most)).select("lang", "source", "part", "item", "value", "rank"), "divergence")
        keep(made)
    return made
