"""Queries of the scalar functions, over columns of the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import bindings as B
from quillon.functions import labels as G
from quillon.functions import scalars as S
from quillon.plans.catalog import query


@query("""
SELECT p_partkey, coalesce(TRY_CAST(x AS DOUBLE), 0) AS as_double, CASE WHEN regexp_full_match(trim(x), '-?[0-9]+') THEN x::INT ELSE -1 END AS strict_int,
  coalesce(trunc(TRY_CAST(x AS DOUBLE))::INT, -1) AS loose_int, coalesce(TRY_CAST(translate(m, '$,€£', '') AS DOUBLE), 0) AS money
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_retailprice::VARCHAR WHEN 2 THEN p_name ELSE ' ' || p_size || ' ' END AS x,
        CASE p_size % 3 WHEN 0 THEN '$1,' || lpad((p_size * 7 % 1000)::VARCHAR, 3, '0') WHEN 1 THEN '€' || p_size ELSE 'n/a' END AS m FROM part)""")
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = B.table(spark, sf_dir, "part"), F.col("p_size")
    x = F.when(size % 4 == 0, size.cast("string")).when(size % 4 == 1, F.col("p_retailprice").cast("string")).when(size % 4 == 2, F.col("p_name")).otherwise(F.concat(F.lit(" "), size.cast("string"), F.lit(" ")))
    m = F.when(size % 3 == 0, F.concat(F.lit("$1,"), F.lpad((size * 7 % 1000).cast("string"), 3, "0"))).when(size % 3 == 1, F.concat(F.lit("€"), size.cast("string"))).otherwise("n/a")
    return p.select("p_partkey", x.alias("x"), m.alias("m")).select(
        "p_partkey", S.to_double("x").alias("as_double"), S.to_int_strict("x", -1).alias("strict_int"), S.to_int_loose("x", -1).alias("loose_int"), S.money("m").alias("money")
    )


@query("""
SELECT p_partkey, coalesce(nullif(translate(lower(trim(p_type)), '- /', '___'), ''), 'unknown') AS kind, CASE WHEN length(p_name) > 12 THEN left(p_name, 12) || '...' ELSE p_name END AS short,
  lower(trim(p_brand)) NOT IN ('', 'null', 'none', 'nan') AS present, p_size % 7 AS seat, p_size % 2 = 0 AS truth
FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seat = F.when(F.col("p_size") % 7 == 0, "x").otherwise(F.concat(F.lit("seat_"), (F.col("p_size") % 7).cast("string")))
    yes = F.when(F.col("p_size") % 2 == 0, " Yes ").otherwise("0")
    return B.table(spark, sf_dir, "part").select(
        "p_partkey", S.norm_text("p_type").alias("kind"), S.shorten("p_name", 12).alias("short"), S.is_present("p_brand").alias("present"), S.seat_of_uid(seat).alias("seat"), S.truth(yes).alias("truth")
    )


@query("""
SELECT o_orderkey, round(coalesce(o_totalprice / nullif(o_custkey % 10, 0), 0) + 1e-9, 6) AS ratio, round(CASE WHEN o_custkey % 10 > 0 THEN greatest(0, least(o_orderkey % 50 / (o_custkey % 10)::DOUBLE, 10)) / 10 ELSE 0 END + 1e-9, 6) AS capped,
  round(least(ln(1 + o_orderkey % 300) / ln(201.0::DOUBLE), 1) + 1e-9, 6) AS logged, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE round(o_totalprice, 2) END AS finite,
  round_even((o_orderkey % 9) / 2.0::DOUBLE, 0)::INT AS half_even, round(o_totalprice, 1) AS one_place FROM orders""")
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = B.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey") % 10
    odd = F.when(k % 22 == 0, float("nan")).when(k % 11 == 0, float("inf")).otherwise(F.round("o_totalprice", 2))
    return o.select(
        "o_orderkey", S.tidy(S.ratio("o_totalprice", c)).alias("ratio"), S.tidy(S.capped_ratio(k % 50, c)).alias("capped"), S.tidy(S.scaled_log((k % 300).cast("double"))).alias("logged"),
        S.finite(odd).alias("finite"), F.rint((k % 9) / 2).cast("int").alias("half_even"), F.round("o_totalprice", 1).alias("one_place"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity <= 1 THEN 1 WHEN l_quantity <= 2 THEN 2 WHEN l_quantity <= 5 THEN 3 WHEN l_quantity <= 10 THEN 4 WHEN l_quantity <= 25 THEN 5 WHEN l_quantity <= 50 THEN 6 WHEN l_quantity <= 100 THEN 7 ELSE 8 END AS bucket,
  CASE WHEN l_quantity <= 0 THEN 'z' WHEN l_quantity <= 1 THEN 'xs' WHEN l_quantity <= 2 THEN 's' WHEN l_quantity <= 4 THEN 'm' WHEN l_quantity <= 8 THEN 'l' WHEN l_quantity <= 20 THEN 'xl' ELSE 'xxl' END AS label FROM lineitem""")
def amount_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.amount_bucket("l_quantity").alias("bucket"), S.amount_label("l_quantity").alias("label"))


@query("""
SELECT c_nationkey, round(CASE WHEN count(*) < 2 OR avg(v) <= 1e-9 THEN 0 ELSE least(stddev_pop(v) / avg(v), 3) / 3 END + 1e-9, 6) AS cv, round(quantile_cont(v, 0.25) + 1e-9, 6) AS q25, round(quantile_cont(v, 0.9) + 1e-9, 6) AS q90
FROM (SELECT c_nationkey, abs(c_acctbal) AS v FROM customer) GROUP BY c_nationkey""")
def spread_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "customer").select("c_nationkey", F.abs("c_acctbal").alias("v"))
    g = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.9))).alias("q"))
    cv = F.when((F.col("n") < 2) | (F.col("m") <= 1e-9), 0.0).otherwise(F.least(F.col("s") / F.col("m"), F.lit(3.0)) / 3)
    return g.select("c_nationkey", S.tidy(cv).alias("cv"), S.tidy(F.get("q", F.lit(0))).alias("q25"), S.tidy(F.get("q", F.lit(1))).alias("q90"))


@query("""
SELECT page_id, rtrim(regexp_replace(regexp_replace(trim(url), '/+$', ''), '\\.git$', '')) AS repo, regexp_full_match(substr(sha256(url), 1, (page_id % 12)::INT), '[0-9a-f]{7,40}') AS is_commit FROM pages""")
def repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.expr("left(sha2(cast(url as binary), 256), cast(page_id % 12 as int))")
    return B.table(spark, sf_dir, "pages").select("page_id", S.repo_url("url").alias("repo"), S.is_commit(some).alias("is_commit"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE date_trunc('second', ts) END AS t FROM events")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text and epoch seconds; anything else is null."""
    e, i = B.table(spark, sf_dir, "events"), F.col("event_id") % 4
    whole = F.date_trunc("second", F.col("ts").cast("timestamp"))
    text = F.when(i == 0, F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss")).when(i == 1, F.unix_timestamp(whole).cast("string")).when(i == 2, F.date_format(whole, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return e.select("event_id", S.parse_time(text).cast("timestamp_ntz").alias("t"))


@query("""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NOT NULL AS has_k, event_type IN ('click', 'purchase') AS allowed FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of semi-structured text, the test that required keys are there, and a membership filter."""
    e = B.table(spark, sf_dir, "events")
    has = F.size(F.array_except(F.array(F.lit("k")), F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>")))) == 0
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), has.alias("has_k"), F.col("event_type").isin("click", "purchase").alias("allowed"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE NULL END::INT AS label, coalesce(CASE event_id % 2 WHEN 0 THEN event_id::VARCHAR END, 'sample_' || event_id) AS sample_id FROM events""")
def extracted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels under several names and spellings; ids by the first field that has one."""
    e, i = B.table(spark, sf_dir, "events"), F.col("event_id") % 6
    item = e.select(
        "event_id", F.when(i == 0, True).alias("is_bot"), F.when(i == 1, True).alias("is_human"), F.when(i == 2, " AI ").when(i == 3, "human").when(i == 4, "1.0").when(i == 5, "maybe").alias("label"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("chunk_id"),
    )
    return item.select("event_id", G.label_of(is_bot="is_bot", is_human="is_human", labels=["label"]).alias("label"), G.first_id(["chunk_id"], F.concat(F.lit("sample_"), F.col("event_id").cast("string"))).alias("sample_id"))


@query("""
SELECT n_nationkey AS "key", n_name AS "nation/name", r_name AS "nation/region/name", length(r_name)::INT AS "nation/region/size_count" FROM nation JOIN region ON n_regionkey = r_regionkey""")
def flattened_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested metrics as flat columns with slashed names; lists become counts."""
    n, r = B.table(spark, sf_dir, "nation"), B.table(spark, sf_dir, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    letters = F.split(F.col("r_name"), "")
    nested = j.select(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name"), F.filter(letters, lambda x: x != "").alias("size")).alias("region")).alias("nation"))
    return G.flatten(nested)


@query("SELECT n_nationkey, 'tight' AS name, n_nationkey % 5 + 1.0::DOUBLE AS weight FROM nation UNION ALL SELECT n_nationkey, 'loose', 2.0 FROM nation")
def weighted_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name:weight,...`` as rows."""
    spec = F.concat(F.lit("tight:"), (F.col("n_nationkey") % 5 + 1).cast("string"), F.lit(", loose:2"))
    return B.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(G.parse_spec(spec)).alias("x")).select("n_nationkey", "x.name", "x.weight")


@query("""
WITH h AS (SELECT c_custkey, c_acctbal < 0 AS b, sha256(c_custkey || ':44') AS k FROM customer)
SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY k) <= round_even(0.2 * count(*) OVER (PARTITION BY b), 0) THEN 'validation' ELSE 'train' END AS split FROM h""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by seeded hash order within each class."""
    c = B.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("b"))
    return G.stratified_split(c, "c_custkey", "b", 0.2, 44).select("c_custkey", "split")
