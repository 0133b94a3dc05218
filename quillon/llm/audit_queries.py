"""Queries over whole documents for quality rules, the Merkle manifest and the source audit, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import divergence, merkle, quality_rules

#: At most so many of a stratum's good texts may be rejected, and the chance that any stratum's promise fails.
FALSE_REJECTION, ERROR = 0.05, 0.05


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its statistics and whether it stays, by rules whose cutoffs are certified for its language."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    made = quality_rules.judge(_table(spark, sf_dir, "documents"), labels, false_rejection=FALSE_REJECTION, error=ERROR)
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, checked against a copy in which a third of the texts are lower-cased."""
    lowered = {"text": merkle.lower_cased(F.col("doc_id"), F.col("text"))}
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered=lowered)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, and the terms it has more of than the language."""
    return divergence.divergence(_table(spark, sf_dir, "documents"))


_LEVELS = ",\n".join(
    f"       {' + '.join(f'(1000 * {r.part} > {c} * {r.whole})::INT' for c in r.cutoffs)} AS l{i}" for i, r in enumerate(quality_rules.RULES)
)
_N = len(quality_rules.RULES)
_STEPS = ", ".join(f"s{i}" for i in range(_N))
_HIT = " OR ".join(f"l{i} + s{i} > {len(r.cutoffs)}" for i, r in enumerate(quality_rules.RULES))
_SETTINGS = ", ".join(f"range({len(r.cutoffs) + 1}) t{i}(s{i})" for i, r in enumerate(quality_rules.RULES))

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
s AS (SELECT r, doc_id, stratum, t, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (r)),
x AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
{_LEVELS} FROM s),
told AS (SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
texts AS (SELECT stratum, t, {', '.join(f'l{i}' for i in range(_N))}, max(good) AS good FROM x JOIN told USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
sizes AS (SELECT stratum, sum(good)::BIGINT AS n FROM texts GROUP BY stratum HAVING sum(good) * ln(1 - {FALSE_REJECTION}) <= ln({ERROR})),
counts AS (SELECT stratum, {_STEPS}, sum(good)::BIGINT AS k, sum(1 - good)::BIGINT AS b FROM texts, {_SETTINGS} WHERE {_HIT} GROUP BY ALL),
tried AS (SELECT *, CASE WHEN k > n * {FALSE_REJECTION} THEN 1 ELSE
            list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({FALSE_REJECTION}) + (n - j) * ln(1 - {FALSE_REJECTION})))) END AS tail
          FROM counts JOIN sizes USING (stratum)),
best AS (SELECT stratum, {_STEPS} FROM tried WHERE tail <= {ERROR} / ((SELECT count(*) FROM sizes) * {len(quality_rules.settings())}) AND b > k
         QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY b - k DESC, {' + '.join(f's{i}' for i in range(_N))}, {_STEPS}) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({_HIT}, FALSE) AS kept
FROM x LEFT JOIN best USING (stratum)
"""


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f} END" for f in fields) + ")"


def _tree(name: str, part: str, levels: int) -> str:
    """Levels of trees of eight above ``name``0 (part, i, n, h), with the digests left and right of every node in its run."""
    out = []
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT {part}, i // 8 AS i, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > 1 GROUP BY {part}, i // 8, n)")
        side = "coalesce(string_agg(h, '') OVER (PARTITION BY {p}, i // 8 ORDER BY i ROWS BETWEEN {r}), '')"
        l, r = (side.format(p=part, r=x) for x in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        out.append(f"{name}p{k} AS (SELECT {part}, i, {l} AS l, {r} AS r FROM {name}{k} WHERE n > 1)")
    return ",\n".join(out)


def _climb(steps: list[tuple[str, str, str]]) -> str:
    """The fold of a leaf along the nodes it stands in."""
    out = []
    for k, (table, on, at) in enumerate(steps):
        out.append(f"f{k + 1} AS (SELECT f{k}.* REPLACE (CASE WHEN x.l IS NULL THEN fold ELSE sha256(x.l || fold || x.r) END AS fold, proof || coalesce(x.l || x.r, '') AS proof) FROM f{k} LEFT JOIN {table} x ON {on} AND x.i = {at})")
    return ",\n".join(out)


#: Trees of up to 8**6 rows a language and 8**3 languages.
_DEEP, _WIDE = 6, 3
OP12_SQL = rf"""
WITH c AS (SELECT *, row_number() OVER () AS r, list_transform(range(0, 8 * strlen(doc_id::VARCHAR)), lambda j: CASE WHEN j % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (j // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) AS bits FROM documents),
d AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bits), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) % 3 = 0 AS hit,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM c),
e AS (SELECT r, doc_id, coalesce('=' || lang, '') AS part, {_leaf("text")} AS leaf, CASE WHEN hit THEN {_leaf("lower_text")} ELSE {_leaf("text")} END AS now FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY part) AS n FROM e),
t0 AS (SELECT part, i, n, leaf AS h FROM o),
{_tree("t", "part", _DEEP)},
u AS ({" UNION ALL ".join(f"SELECT part, h FROM t{k} WHERE n = 1" for k in range(_DEEP + 1))}),
v0 AS (SELECT 0 AS top, row_number() OVER (ORDER BY part) - 1 AS i, count(*) OVER () AS n, h, part FROM u),
{_tree("v", "top", _WIDE)},
root AS ({" UNION ALL ".join(f"SELECT h FROM v{k} WHERE n = 1" for k in range(_WIDE + 1))}),
f0 AS (SELECT o.r, o.doc_id, o.part, o.leaf, o.i, v0.i AS ti, v0.h AS subroot, o.now AS fold, '' AS proof FROM o JOIN v0 ON v0.part = o.part),
{_climb([(f"tp{k}", f"x.part = f{k}.part", f"f{k}.i // {8**k}") for k in range(_DEEP)] + [(f"vp{k}", "x.top = 0", f"f{_DEEP + k}.ti // {8**k}") for k in range(_WIDE)])}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM f{_DEEP + _WIDE}, root
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS size, sum(n) AS total FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
z AS (SELECT g.lang, g.source, v.term, v.n AS lang_n, coalesce(k.n, 0) AS n, size, total, sum(coalesce(k.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
      FROM g JOIN v ON v.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = v.term),
p AS (SELECT lang, source, term, n, (1 + 1000000000 * (n + 1)::HUGEINT // (own + size)::HUGEINT)::HUGEINT AS p, (1 + 1000000000 * (lang_n + 1)::HUGEINT // (total + size)::HUGEINT)::HUGEINT AS q FROM z),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x
QUALIFY part = 'pair' OR rank <= 200
"""


def queries():
    return {f.__name__: f for f in (op11_risk_controlled_rules, op12_merkle_manifest, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op11_risk_controlled_rules": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_source_divergence": OP13_SQL}
