"""URL rules answered by a cascade of Bloom filters, in DataFrame expressions only.

A cascade answers set membership exactly for a closed universe of keys: the first filter encodes the listed keys,
the second the universe's false positives of the first, the third the listed keys that the second passes, and so
on until nothing passes wrongly. The universe here is every key of the corpus (host suffix plus path prefix), so
judging a url needs neither a join nor the list itself, only a few words of bits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.store import materialize, scratch

BITS_PER_KEY = 16
HASHES = 6
#: A filter of more bits than this (2 MB) is not sent to every task: larger lists are answered by an exact join.
MAX_BITS = 1 << 24
#: A level is made sparser until no more keys than it holds, or this many, are expected to pass it wrongly.
FEW_FALSE = 4096
#: Each level holds about a hundredth of the keys of the level two before it; so many are never needed.
MAX_LEVELS = 40


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int], longest_host: int | None = None) -> Column:
    """Every host suffix (at a dot) with every path prefix of the given lengths, longest key first. Suffixes longer than
    ``longest_host``, where it is given, are left out before they are made: no listed host is as long."""
    if longest_host is not None:
        # the last characters of the host and one more, which tells whether the first label there is whole
        tail = F.when(F.length(host) > longest_host + 1, F.right(host, F.lit(longest_host + 1))).otherwise(F.concat(F.lit("."), host))
        at = F.locate(".", tail)
        host = F.when(host == "", host).when(at > 0, F.substring(tail, at + 1, F.length(tail))).otherwise(F.lit(""))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    none = F.array().cast("array<string>")

    def with_prefix(n: int) -> Column:
        return F.when(F.length(path) >= n, F.transform(suffixes, lambda s: F.concat(s, F.substring(path, 1, n)))).otherwise(none)

    each = [with_prefix(n) for n in lengths]
    ranked = F.transform(F.flatten(F.array(*each)), lambda k: F.struct((-F.length(k)).alias("rank"), k.alias("key")))
    return F.when(host == "", none).otherwise(F.transform(F.array_sort(ranked), lambda x: x["key"]))


def false_rate(bits_per_key: float) -> float:
    """The share of other keys that a filter passes: a word of 64 bits holds a Poisson number of keys."""
    mean = 64 / bits_per_key
    held = [math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(200)]
    return sum(p * (1 - (63 / 64) ** (HASHES * k)) ** HASHES for k, p in enumerate(held))


def bits_for(n: int, others: int, least: int, max_bits: int) -> int:
    """Bits a key of a level with ``n`` keys that ``others`` are asked of: ``least``, doubled while more of them than
    ``n``, or than a small level holds, would pass wrongly and the level still has no more than ``max_bits``."""
    few = max(n, min(FEW_FALSE, max_bits // least // 2))
    bits = least
    while others * false_rate(bits) > few and 2 * n * bits <= max_bits:
        bits *= 2
    return bits


class _Filter:
    """A blocked Bloom filter: one hash names a word, a second one up to HASHES of its 64 bits. The hashes of every
    level start from the level's own number, so that keys that agree at one level part at the next."""

    def __init__(self, keys: DataFrame, n: int, level: int, bits_per_key: int):
        self.words = max(1, math.ceil(n * bits_per_key / 64))
        self.level = level
        filled = keys.groupBy(self._word(F.col("key")).alias("word")).agg(F.bit_or(self._mask(F.col("key"))).alias("bits"))
        filled = materialize(filled, "bloom-words").collect()  # at most MAX_BITS / 64 rows
        bits = [0] * self.words
        for row in filled:
            bits[row["word"]] = row["bits"]
        self.bits = F.from_json(F.lit("[" + ",".join(map(str, bits)) + "]"), "array<bigint>")

    def _hash(self, key: Column, i: int) -> Column:
        return F.xxhash64(F.lit(2 * self.level + i), key)

    def _word(self, key: Column) -> Column:
        return F.pmod(self._hash(key, 0), F.lit(self.words)).cast("int")

    def _mask(self, key: Column) -> Column:
        places = self._hash(key, 1)
        out = F.lit(0).cast("long")
        for i in range(HASHES):
            place = F.shiftrightunsigned(places, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
        return out

    def holds(self, key: Column) -> Column:
        mask = self._mask(key)
        return F.element_at(self.bits, self._word(key) + 1).bitwiseAND(mask) == mask


class Cascade:
    """Exact membership of ``listed`` (column key) for every key of ``universe`` (column key; each key once).

    A level's bits a key grow with the logarithm of the keys that are asked of it, so a short list stays a cascade of
    few and small levels in any universe. ``fits`` is false where a level takes more than ``max_bits`` even at
    ``bits_per_key``: the caller then joins. An input whose levels do
    not come to an end (64 bits of hash shared by two keys at MAX_LEVELS levels) raises an error.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS):
        inside, outside, others = listed, universe.join(listed, "key", "left_anti"), universe.count()
        self.levels: list[_Filter] = []
        self.fits = True
        while n := inside.count():
            if n * bits_per_key > max_bits:
                self.fits = False
                return
            if len(self.levels) == MAX_LEVELS:
                raise RuntimeError(f"{n} keys still pass wrongly after {MAX_LEVELS} levels")
            self.levels.append(_Filter(inside, n, len(self.levels), bits_for(n, others, bits_per_key, max_bits)))
            wrong = materialize(outside.where(self.levels[-1].holds(F.col("key"))), "bloom-false")
            inside, outside, others = wrong, inside, n

    def holds(self, key: Column) -> Column:
        """Level 1 passes, and not level 2, unless level 3, and so on."""
        if not self.levels:
            return F.lit(False)
        out = self.levels[-1].holds(key)
        for level in reversed(self.levels[:-1]):
            out = level.holds(key) & ~out
        return out


def judge_urls(
    urls: DataFrame, rules: list[Rule], listed_hosts: list[str] | DataFrame, *, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS
) -> DataFrame:
    """``urls`` (column url, others stay) with host, path, rule and verdict.

    The longest rule that fits a url gives its verdict; without one, a url whose host or a parent of it is listed
    is blocked and every other allowed. ``listed_hosts`` is a list or a table with a column host of any size; a list that
    needs more than ``max_bits`` is answered by an exact join over the distinct keys instead of the cascade.
    Null urls and urls without ``://`` have empty host and path and are allowed. Of long hosts only the suffixes that
    are no longer than the longest listed one are looked at. Repeated rows are judged alike; an empty table gives an
    empty result. Columns of the input named as the four new ones are replaced; any other name may occur.
    """
    spark: SparkSession = urls.sparkSession
    lengths = sorted({len(r.path) for r in rules})
    urls = urls.drop("host", "path", "rule", "verdict")
    parted = urls.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if isinstance(listed_hosts, DataFrame):
        hosts = listed_hosts.select("host").where("host is not null")
    else:
        hosts = spark.range(1).select(F.explode(F.array(*map(F.lit, listed_hosts)).cast("array<string>")).alias("host"))
    longest = max([len(r.host) for r in rules] + [hosts.agg(F.coalesce(F.max(F.length("host")), F.lit(0))).first()[0]])

    # keys of rules are marked R, of listed hosts H; no host holds a blank
    def keys(host: Column, path: Column) -> Column:
        of_rules = F.transform(candidate_keys(host, path, lengths, longest), lambda k: F.concat(F.lit("R "), k))
        return F.concat(of_rules, F.transform(candidate_keys(host, F.lit(""), [0], longest), lambda k: F.concat(F.lit("H "), k)))

    def of_rules(verdict: str) -> DataFrame:
        mine = [f"R {r.key}" for r in rules if r.verdict == verdict]
        return spark.range(1).select(F.explode(F.array(*map(F.lit, mine)).cast("array<string>")).alias("key"))

    places = parted.select("host", F.expr(f"left(path, {max(lengths, default=0)})").alias("path")).distinct()
    with scratch(spark) as keep:  # the filters' bits are in the expressions; the tables behind them can go
        universe = materialize(places.select(F.explode(keys(F.col("host"), F.col("path"))).alias("key")).distinct(), "url-keys")
        block_list = materialize(of_rules("block").unionByName(hosts.select(F.concat(F.lit("H "), "host").alias("key"))).distinct(), "blocked-keys")
        blocked = Cascade(block_list, universe, bits_per_key, max_bits)
        allowed = Cascade(of_rules("allow").distinct(), universe, bits_per_key, max_bits)
        told = None
        if not (blocked.fits and allowed.fits):
            hits = [universe.join(block_list, "key", "left_semi").withColumn("verdict", F.lit("block")), universe.join(of_rules("allow"), "key", "left_semi").withColumn("verdict", F.lit("allow"))]
            told = materialize(hits[0].unionByName(hits[1]), "listed-keys")
            keep(told)
    if told is not None:
        return _joined(parted, keys, told)
    held = F.filter(
        F.transform(
            keys(F.col("host"), F.col("path")),
            lambda k: F.struct(k.alias("key"), F.when(blocked.holds(k), "block").when(allowed.holds(k), "allow").alias("verdict")),
        ),
        lambda x: x["verdict"].isNotNull(),
    )
    return _judged(parted, F.get(held, F.lit(0)))


def _judged(parted: DataFrame, first: Column) -> DataFrame:
    """``parted`` with rule and verdict of its winning entry (key, verdict)."""
    taken = "first"
    while taken in parted.columns:
        taken += "_"
    is_rule = F.col(taken)["key"].startswith("R ")
    return parted.select("*", first.alias(taken)).select(
        *(F.col(f"`{c}`") for c in parted.columns),
        F.when(is_rule, F.substring(F.col(taken)["key"], 3, 1 << 20)).alias("rule"),
        F.coalesce(F.col(taken)["verdict"], F.lit("allow")).alias("verdict"),
    )


def _joined(parted: DataFrame, keys, told: DataFrame) -> DataFrame:
    """The same verdicts by joins: every distinct place with the first of its keys that is listed."""
    places = parted.select(F.col("host").alias("h"), F.col("path").alias("p")).distinct()
    each = places.select("h", "p", F.posexplode(keys(F.col("h"), F.col("p"))).alias("at", "key")).join(told, "key")
    best = each.groupBy("h", "p").agg(F.min(F.struct("at", "key", "verdict")).alias("best"))
    best = best.select(*(F.col(c).alias(f"__{c}") for c in best.columns))
    joined = parted.join(best, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    return _judged(joined.select(*(F.col(f"`{c}`") for c in parted.columns), "__best"), F.col("__best")).drop("__best")
