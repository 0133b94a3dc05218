"""Scalar column functions: tolerant casts, text and money normalisation, buckets, logistic helpers, hashes.

All stay inside whole-stage code generation; none needs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- casts
def to_double(x: ColumnOrName, default: float = 0.0) -> Column:
    """The value as a double, or ``default`` where it is null or no number."""
    return F.coalesce(_c(x).try_cast("double"), F.lit(default))


def to_int_strict(x: ColumnOrName, default: int = 0) -> Column:
    """Strings with a fraction are no integers here."""
    return F.coalesce(_c(x).try_cast("int"), F.lit(default))


def to_int_loose(x: ColumnOrName, default: int = 0) -> Column:
    """As ``to_int_strict``, then once more by way of a double, cut toward zero."""
    number = _c(x).try_cast("double")
    return F.coalesce(_c(x).try_cast("int"), F.when(~F.isnan(number), number.try_cast("int")), F.lit(default))


def finite(x: ColumnOrName, default: float = 0.0) -> Column:
    """Null, NaN and infinities become ``default``."""
    value = _c(x)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")) | value.isNull(), F.lit(default)).otherwise(value)


def money(x: ColumnOrName, default: float = 0.0) -> Column:
    """A number behind currency signs and thousands separators."""
    return finite(F.trim(F.translate(_c(x), ",$€£", "")).try_cast("double"), default)


def truth(x: ColumnOrName) -> Column:
    """Whether a text says yes."""
    return F.coalesce(F.lower(F.trim(_c(x))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def is_present(x: ColumnOrName) -> Column:
    """Neither null nor a word for nothing."""
    return F.coalesce(~F.lower(F.trim(_c(x))).isin("", "null", "none", "nan"), F.lit(False))


def norm_text(x: ColumnOrName, default: str = "unknown") -> Column:
    """Trimmed lower case with underscores for blanks, dashes and slashes."""
    return F.coalesce(F.nullif(F.translate(F.lower(F.trim(_c(x))), "- /", "___"), F.lit("")), F.lit(default))


def shorten(x: ColumnOrName, limit: int = 800) -> Column:
    return F.when(F.length(_c(x)) > limit, F.concat(F.left(_c(x), F.lit(limit)), F.lit("..."))).otherwise(_c(x))


def seat_of_uid(x: ColumnOrName) -> Column:
    """N of ``seat_N``, else 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(_c(x), F.lit("")), r"^seat_(\d+)$", 1).try_cast("int"), F.lit(0))


def repo_url(x: ColumnOrName) -> Column:
    """One spelling for a repository's address: https, no .git, no closing slash."""
    url = F.regexp_replace(F.trim(_c(x)), r"^git@([^:]+):", "https://$1/")
    return F.regexp_replace(F.regexp_replace(url, r"/+$", ""), r"\.git$", "")


def is_commit(x: ColumnOrName) -> Column:
    return F.coalesce(F.lower(F.trim(_c(x))).rlike("^[0-9a-f]{7,40}$"), F.lit(False))


def parse_time(x: ColumnOrName) -> Column:
    """ISO text or epoch seconds; null where it is neither."""
    return F.coalesce(F.timestamp_seconds(_c(x).try_cast("double")), F.try_to_timestamp(_c(x)))


# ---------------------------------------------------------------- arithmetic
def ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def clamp(x: ColumnOrName, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def capped_ratio(a: ColumnOrName, b: ColumnOrName, cap: float = 10.0) -> Column:
    return F.when(_c(b) > 0, clamp(ratio(a, b), 0.0, cap) / cap).otherwise(0.0)


def scaled_log(x: ColumnOrName, cap: float = 200.0) -> Column:
    return F.least(F.log1p(F.greatest(_c(x), F.lit(0.0))) / F.log1p(F.lit(float(cap))), F.lit(1.0))


def sigmoid(x: ColumnOrName) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -60.0, 60.0)))


def logit(p: ColumnOrName, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def remap(score: ColumnOrName, cut: ColumnOrName) -> Column:
    """Monotone piecewise-linear map of [0, 1] that sends ``cut`` to one half."""
    s, c = clamp(score), clamp(cut, 1e-6, 1 - 1e-6)
    return clamp(F.when(s < c, s / c * 0.5).otherwise(0.5 + (s - c) / (1 - c) * 0.5))


def grid_interpolate(x: ColumnOrName, grid_values: Column, steps: int = 255) -> Column:
    """Linear interpolation on an even grid over [0, 1]: two array reads, no range join."""
    at = clamp(x) * steps
    low = F.least(F.floor(at), F.lit(steps - 1)).cast("int")
    below, above = F.get(grid_values, low), F.get(grid_values, low + 1)
    return below + (above - below) * (at - low)


def entropy(counts: Column, *, scale: float | None = None) -> Column:
    """Entropy of an array of counts, by the log of ``scale`` or else of the number of symbols; 0 for one symbol."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    h = F.aggregate(counts, F.lit(0.0), lambda a, c: a - c / total * F.log(c / total + 1e-12))
    if scale is None:
        return F.when(F.size(counts) > 1, h / F.log(F.size(counts).cast("double"))).otherwise(0.0)
    return F.when(F.size(counts) > 0, F.least(h / F.log(F.lit(float(scale))), F.lit(1.0))).otherwise(0.0)


def symbol_counts(symbols: Column) -> Column:
    """How often each distinct entry of an array stands in it."""
    return F.transform(F.array_distinct(symbols), lambda s: F.size(F.filter(symbols, lambda x: x == s)).cast("double"))


# ---------------------------------------------------------------- buckets
#: Upper edges in big blinds.
AMOUNT_EDGES = (1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0)
AMOUNT_LABELS = ((0.0, "z"), (1.0, "xs"), (2.0, "s"), (4.0, "m"), (8.0, "l"), (20.0, "xl"))
VISIBLE_BUCKETS = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 36.0, 56.0, 84.0, 126.0)
#: Kinds of action and streets.
DIRECT_TYPES = ("small_blind", "big_blind", "ante", "check", "call", "bet", "raise", "fold")
STREETS = ("preflop", "flop", "turn", "river", "showdown")


def amount_bucket(bb: ColumnOrName) -> Column:
    """0 for nothing, then the number of the first edge that is not below the amount."""
    x = _c(bb)
    out = F.when(x <= 0, 0)
    for i, edge in enumerate(AMOUNT_EDGES, 1):
        out = out.when(x <= edge, i)
    return out.otherwise(len(AMOUNT_EDGES) + 1)


def amount_label(bb: ColumnOrName) -> Column:
    x = F.greatest(_c(bb), F.lit(0.0))
    out = None
    for edge, label in AMOUNT_LABELS:
        out = F.when(x <= edge, label) if out is None else out.when(x <= edge, label)
    return out.otherwise("xxl")


def nearest_bucket(bb: ColumnOrName) -> Column:
    """The visible bucket nearest to a positive amount; the lower one half-way between two."""
    middles = F.array(*(F.lit((a + b) / 2) for a, b in zip(VISIBLE_BUCKETS, VISIBLE_BUCKETS[1:], strict=False)))
    return F.element_at(F.array(*map(F.lit, VISIBLE_BUCKETS)), F.size(F.filter(middles, lambda m: m < _c(bb))) + 1)


def amount_id(bb: ColumnOrName) -> Column:
    """1 for nothing, else the number of the nearest of nought and the visible buckets, counted from 1; of two at one
    distance the lower."""
    edges = (0.0, *VISIBLE_BUCKETS)
    middles = F.array(*(F.lit((a + b) / 2) for a, b in zip(edges, edges[1:], strict=False)))
    x = _c(bb)
    return F.when(x > 0, F.size(F.filter(middles, lambda m: m < x)) + 1).otherwise(1)


def pot_flow(before_bb: ColumnOrName, after_bb: ColumnOrName) -> Column:
    """By how many big blinds the pot grew: 1 not at all, 2 up to one, 3 up to four, 4 more."""
    gain = F.greatest(_c(after_bb) - _c(before_bb), F.lit(0.0))
    return F.when(gain <= 1e-6, 1).when(gain <= 1.0, 2).when(gain <= 4.0, 3).otherwise(4)


def size_code(amount: ColumnOrName, pot: ColumnOrName, bb: ColumnOrName) -> Column:
    """Bet size against the pot: 0, s, m, p, o; against the big blind where there is no pot."""
    a, p, b = (to_double(x) for x in (amount, pot, bb))
    share = a / F.when(p > 0, p)
    by_blind = F.when(b <= 0, "0").when(b < 2, "s").when(b < 5, "m").when(b < 10, "p").otherwise("o")
    by_pot = F.when(share < 0.4, "s").when(share < 0.75, "m").when(share <= 1.15, "p").otherwise("o")
    return F.when(a <= 0, "0").when(p <= 0, by_blind).otherwise(by_pot)


def actor_role(seat: ColumnOrName, button: ColumnOrName, seats: ColumnOrName) -> Column:
    """The actor's place counted from the button: 1 unknown, 2 button, 3 small blind, 4 big blind, and of the seats after
    these the 5 early, 6 middle and 7 late third."""
    count = _c(seats)
    known = (_c(seat) > 0) & (_c(button) > 0) & (count > 1)
    offset = F.pmod(_c(seat) - _c(button), F.greatest(count, F.lit(1)))
    third = (offset - 3) / F.greatest(count - 3, F.lit(1))
    rest = F.when(count <= 3, 6).when(third < 1 / 3, 5).when(third < 2 / 3, 6).otherwise(7)
    return F.when(~F.coalesce(known, F.lit(False)), 1).when(offset == 0, 2).when(offset == 1, 3).when(offset == 2, 4).otherwise(rest)


def street_rank(street: ColumnOrName) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, STREETS)), _c(street)), F.lit(0).cast("long")).cast("int") - 1


def direct_type(x: ColumnOrName) -> Column:
    """A known kind of action, or the first of raise, bet, call, check, fold that the text holds; else empty."""
    t = F.lower(F.trim(F.coalesce(_c(x), F.lit(""))))
    out = F.when(t.isin(*DIRECT_TYPES), t)
    for word in ("raise", "bet", "call", "check"):
        out = out.when(t.contains(word), word)
    return out.when(t.contains("fold") | (t == "muck"), "fold").otherwise("")


def resolved_type(x: ColumnOrName, amount: ColumnOrName, raise_to: ColumnOrName, call_to: ColumnOrName, before: ColumnOrName, after: ColumnOrName) -> Column:
    """``direct_type``, or what the money says."""
    a, r, c, b, n = map(_c, (amount, raise_to, call_to, before, after))
    inferred = (
        F.when(r > 0, "raise").when(c > 0, "call").when((a > 0) & (n > b), "bet").when(a > 0, "call").when(n <= b, "check").otherwise("call")
    )
    return F.coalesce(F.nullif(direct_type(x), F.lit("")), inferred)


def seat_or_zero(x: ColumnOrName, seats: ColumnOrName | int) -> Column:
    most = F.lit(seats) if isinstance(seats, int) else _c(seats)
    number = _c(x).try_cast("int")
    return F.when(number.between(F.lit(1), most), number).otherwise(0)


# ---------------------------------------------------------------- hashes and units
def digest_byte(text: Column, i: int) -> Column:
    """Byte ``i`` (from 0) of the SHA-256 of a text."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 2 * i + 1, 2), 16, 10).cast("int")


def seeded(*parts: ColumnOrName) -> Column:
    return F.concat_ws("|", *(F.coalesce(_c(p).cast("string"), F.lit("")) if not isinstance(p, str) else F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))


def noise(seed: Column) -> Column:
    """A value in [-1, 1] that the seed determines."""
    return digest_byte(seed, 1) / F.lit(255.0) * 2 - 1


def window_size(seed: Column, low: int = 5, high: int = 8) -> Column:
    return low + F.pmod(digest_byte(seed, 0), F.lit(high - low + 1))


def in_blinds(x: ColumnOrName, bb: ColumnOrName, upper: float) -> Column:
    """Money in big blinds, bounded, two decimals; 0 without a big blind."""
    return F.when(_c(bb) > 0, F.bround(clamp(to_double(x) / F.when(_c(bb) > 0, _c(bb)), 0.0, upper), 2)).otherwise(0.0)


def from_blinds(x: ColumnOrName, bb: float = 0.02) -> Column:
    return F.bround(F.greatest(_c(x), F.lit(0.0)) * bb, 4)


def coarse(bb: ColumnOrName, near: ColumnOrName, shift: ColumnOrName) -> Column:
    """An amount's bucket ``near``, moved by ``shift`` in [-1, 1] times a reach that grows with it. Each argument is
    used several times, so pass columns rather than long expressions."""
    near, shift = _c(near), _c(shift)
    reach = F.when(near <= 1.5, 0.08).when(near <= 8.0, 0.22).otherwise(F.greatest(F.lit(0.35), near * 0.05))
    return F.when(_c(bb) <= 0, 0.0).otherwise(F.bround(clamp(near + shift * reach, 0.0, VISIBLE_BUCKETS[-1]), 2))


def confidence(p: ColumnOrName) -> Column:
    d = F.abs(_c(p) - 0.5)
    return F.when(d >= 0.35, "high").when(d >= 0.15, "medium").otherwise("low")


def tidy(x: ColumnOrName) -> Column:
    """Six decimals, half-way cases pushed up so that engines agree on them."""
    return F.round(_c(x).cast("double") + 1e-9, 6)
