"""Canonical JSON text as Python writes it (sorted keys, no blanks, ASCII only), in column functions.

Digests of such texts agree with those that Python programs made. Doubles from 1e-12 to 9.2e18 in size have Python's
shortest text; of those beyond, about one in ten thousand differs in its last digit, where two decimals of one length
read back as the same double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shortest(x: Column) -> Column:
    """Text d.ddde+xx of a positive double: the first of 15, 16 or 17 digits that reads back as it."""
    text = F.regexp_replace(x.cast("string"), "E", "e")
    for p in (16, 15, 14):
        text = _if_same(F.format_string(f"%.{p}e", x), x, text)
    return text


def _if_same(tried: Column, x: Column, other: Column) -> Column:
    """``tried`` as text where it reads as ``x``, else ``other``."""
    return _let(tried, lambda t: F.when(t.cast("double") == x, t.cast("string")).otherwise(other))


def _exact(x: Column) -> Column:
    """The same of a whole number from 2 ** 53 to 9.2e18, as all its digits: rounded from the exact ones, not from a text that
    was rounded before."""
    whole = x.cast("long")
    text = whole.cast("string")
    for p in (17, 16, 15):
        unit = F.pow(F.lit(10.0), F.greatest(F.length(whole.cast("string")) - p, F.lit(0))).cast("long")
        value = _let(unit, lambda u: F.call_function("div", whole + F.call_function("div", u, F.lit(2)), u) * u)
        text = _if_same(value, x, text)
    return text


def _pieces(x: Column) -> Column:
    """(digits without trailing zeros, decimal exponent of the first digit) of the shortest text of a positive double."""

    def cut(text: Column) -> Column:
        digits = F.rtrim(F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit("")), F.lit("0"))
        exponent = F.when(F.contains(text, F.lit("e")), F.substring_index(text, "e", -1).cast("int")).otherwise(F.length(text) - 1)
        return F.struct(digits.alias("digits"), exponent.alias("exponent"))

    return _let(F.when((x >= 2.0**53) & (x < 9.2e18), _exact(x)).otherwise(_shortest(x)), cut)


def float_text(x: Column) -> Column:
    """A double as Python's repr has it; NaN and the infinities as its json module has them.

    Two decimals of at most 15 digits never read as one double, so a plain text of the engine's that is so short, without
    zeros behind it, is the shortest already. Only the others are searched for."""
    short = lambda t: (F.length(t) <= 16) & ~F.contains(t, F.lit("E")) & (F.endswith(t, F.lit(".0")) | ~F.endswith(t, F.lit("0")))
    return _let(x.cast("string"), lambda t: F.when(short(t), t).otherwise(_searched(x)))


def _searched(x: Column) -> Column:
    """``float_text`` of any double."""
    zeros = lambda k: F.repeat(F.lit("0"), F.greatest(k, F.lit(0)).cast("int"))

    def told(piece: Column) -> Column:
        digits, exponent = piece["digits"], piece["exponent"]
        n = F.length(digits)
        fixed = (
            F.when(exponent < 0, F.concat(F.lit("0."), zeros(-exponent - 1), digits))
            .when(exponent >= n - 1, F.concat(digits, zeros(exponent - n + 1), F.lit(".0")))
            .otherwise(F.concat(F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2, F.lit(20))))
        )
        mantissa = F.when(n > 1, F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2), F.lit(20)))).otherwise(digits)
        power = F.abs(exponent).cast("string")
        power = F.when(F.abs(exponent) < 10, F.concat(F.lit("0"), power)).otherwise(power)
        science = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), power)
        return F.when((exponent >= -4) & (exponent < 16), fixed).otherwise(science)

    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    text = F.when(x == 0, "0.0").otherwise(_let(_pieces(F.abs(x)), told))
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, text))


def string_text(s: Column) -> Column:
    """A text in quotes; all but printable ASCII is escaped, beyond the basic plane as two halves."""
    plain = lambda r: F.replace(F.replace(r, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def escaped(r: Column) -> Column:
        out = F.regexp_replace(F.lower(F.hex(F.encode(r, "UTF-16BE"))), "(.{4})", r"\\u$1")
        for code, short in (("0008", "b"), ("0009", "t"), ("000a", "n"), ("000c", "f"), ("000d", "r")):
            out = F.replace(out, F.lit(f"\\u{code}"), F.lit(f"\\{short}"))
        return out

    runs = F.transform(F.regexp_extract_all(s, F.lit("[ -~]+|[^ -~]+"), F.lit(0)), lambda r: F.when(r.rlike("^[ -~]"), plain(r)).otherwise(escaped(r)))
    return F.concat(F.lit('"'), F.when(s.rlike(r"^[ -~]*\z"), plain(s)).otherwise(F.array_join(runs, "")), F.lit('"'))


def json_text(c: Column, kind: T.DataType, *, optional: frozenset[str] = frozenset()) -> Column:
    """The text of a value of any nested kind. Null is written as null, but fields named in ``optional`` are left out where
    they are null. Keys are sorted by their characters; dates, times and binary values must be cast to texts before."""

    def told(x: Column, k: T.DataType) -> Column:
        if isinstance(k, T.StructType):
            fields = sorted(k.fields, key=lambda f: f.name)
            pairs = [F.concat(string_text(F.lit(f.name)), F.lit(":"), whole(x[f.name], f.dataType)) for f in fields]
            kept = [F.when(x[f.name].isNotNull(), p) if f.name in optional else p for f, p in zip(fields, pairs, strict=True)]
            return F.concat(F.lit("{"), F.array_join(F.array(*kept), ",") if kept else F.lit(""), F.lit("}"))
        if isinstance(k, T.ArrayType):
            return F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: whole(e, k.elementType)), ","), F.lit("]"))
        if isinstance(k, T.MapType):
            entries = F.array_sort(F.map_entries(x))
            return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(string_text(e["key"].cast("string")), F.lit(":"), whole(e["value"], k.valueType))), ","), F.lit("}"))
        if isinstance(k, (T.DoubleType, T.FloatType)):
            return float_text(x.cast("double"))
        if isinstance(k, (T.StringType,)):
            return string_text(x)
        if isinstance(k, (T.BooleanType, T.IntegralType)):
            return x.cast("string")
        if isinstance(k, T.NullType):
            return F.lit("null")
        raise TypeError(f"{k.simpleString()} has no JSON form; cast it to string")

    def whole(x: Column, k: T.DataType) -> Column:
        return F.when(x.isNull(), "null").otherwise(told(x, k))

    return whole(c, kind)
