"""Numbers and texts as the answered calls read and show them, as columns.

Those calls take values of a scripting language: numbers may be written with underscores
and in any decimal digits, white space is whatever that language strips, and messages quote
what was received in its own notation.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space, beyond the six of ASCII's own.
_WIDE_SPACES = r"\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACES = rf"[\t-\r {_WIDE_SPACES}]"
_ASCII_SPACES = r"[\t-\r ]"

_DIGITS = "[0-9](?:_?[0-9])*"
_NUMBER = rf"\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
_NOT_FINITE = r"\A[+-]?(?:nan|inf|infinity)\z"

#: Characters that are not shown as they are: other, and separators but the plain space.
_HIDDEN = r"\A[\p{C}\p{Z}&&[^ ]]\z"


@cache
def _decimal_digits() -> tuple[str, str]:
    """Every decimal digit outside ASCII, and the ASCII digits of the same values."""
    wide = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(wide), "".join(str(unicodedata.decimal(c)) for c in wide)


def stripped(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(text, rf"\A{_SPACES}+|{_SPACES}+\z", "")


def _plain(text: Column) -> Column:
    """Text with digits and white space in ASCII, and without the latter at its ends."""
    wide, narrow = _decimal_digits()
    spaced = F.regexp_replace(text, rf"[{_WIDE_SPACES[8:]}]", " ")
    ascii_ = F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(spaced, wide, narrow)).otherwise(text)
    return F.regexp_replace(ascii_, rf"\A{_ASCII_SPACES}+|{_ASCII_SPACES}+\z", "")


def number(text: Column) -> tuple[Column, Column]:
    """The value of a text as a double, null unless it is written in digits, and whether it
    is a number at all: "nan" and "inf" are."""
    plain = _plain(text)
    written = plain.rlike(_NUMBER)
    value = F.when(written, F.regexp_replace(plain, "_", "").try_cast("double"))
    is_number = F.coalesce(written | F.lower(plain).rlike(_NOT_FINITE), F.lit(False))
    return value, is_number


def _whole_digits(value: Column) -> Column:
    """The exact value of a whole double below 1e37 as a decimal, without its sign."""
    size, block = F.abs(value), 2.0**62
    high = F.floor(size / block)
    low = F.floor(size - high.cast("double") * block)
    return high.cast("decimal(38,0)") * F.lit(2**62).cast("decimal(19,0)") + low.cast("decimal(19,0)")


def shown_number(value: Column) -> Column:
    """A double in its shortest form: ``91.0``, ``1e-05``, ``nan``.

    Of several shortest forms it is the nearest one up to 1e37; beyond, and for some numbers
    with more than 15 digits, the last digit may differ."""
    most = 17
    # what the lambdas need travels inside the array: they refer to nothing outside
    given = F.arrays_zip(
        F.sequence(F.lit(1), F.lit(most)).alias("p"),
        F.array_repeat(value, most).alias("v"),
        F.array_repeat(_whole_digits(value).cast("string"), most).alias("w"),
    )

    def rounded(s: Column) -> Column:
        """The value with ``p`` digits, in scientific notation."""
        p, v, whole = s["p"], s["v"], s["w"]
        head = F.substring(whole, F.lit(1), p).cast("decimal(38,0)")
        up = F.when(F.substring(whole, p + 1, F.lit(1)) >= "5", 1).otherwise(0)
        digits = (head + up).cast("string")
        exact = F.concat(
            F.when(v < 0, "-").otherwise(""), F.substring(digits, 1, 1), F.lit("."),
            F.substring(digits, 2, 40), F.lit("e"),
            (F.length(whole) - 1 + F.length(digits) - p).cast("string"),
        )
        pattern = F.concat(F.lit("%."), (p - 1).cast("string"), F.lit("e"))
        text = F.when(F.abs(v).between(2.0**53, 1e37), exact)
        return F.struct(
            text.otherwise(F.call_function("format_string", pattern, v)).alias("t"), v.alias("v")
        )

    # the fewest digits that give the number back
    tried = F.filter(F.transform(given, rounded), lambda s: s["t"].try_cast("double") == s["v"])
    short = F.get(tried, F.lit(0))["t"]

    def laid_out(parts: Column) -> Column:
        digits, at = parts["digits"], parts["at"]
        size = F.length(digits)
        zeros = lambda n: F.repeat(F.lit("0"), n)
        plain = (
            F.when(at >= size - 1, F.concat(digits, zeros(at - size + 1), F.lit(".0")))
            .when(at >= 0, F.concat(F.substring(digits, F.lit(1), at + 1), F.lit("."), F.substring(digits, at + 2, size)))
            .otherwise(F.concat(F.lit("0."), zeros(-at - 1), digits))
        )
        rest = F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise("")
        power = F.abs(at).cast("string")
        scientific = F.concat(
            F.substring(digits, 1, 1), rest, F.when(at < 0, "e-").otherwise("e+"),
            F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power),
        )
        return F.concat(parts["sign"], F.when(at.between(-4, 15), plain).otherwise(scientific))

    def split(text: Column) -> Column:
        return F.struct(
            F.when(F.startswith(text, F.lit("-")), "-").otherwise("").alias("sign"),
            F.regexp_replace(F.substring_index(text, "e", 1), "[-.]", "").alias("digits"),
            F.substring_index(text, "e", -1).cast("int").alias("at"),
        )

    # arrays of one element, so that a value used several times is computed once
    made = F.get(F.transform(F.transform(F.array(short), split), laid_out), F.lit(0))
    return (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .otherwise(made)
    )


def shown_whole(value: Column) -> Column:
    """A double cut to a whole number, all digits shown.

    From 1e37 on it is shown like any double."""
    cut = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    size, block = F.abs(value), 2.0**62
    signed = F.concat(F.when(value < 0, "-").otherwise(""), _whole_digits(value).cast("string"))
    return F.when(size < block, cut.cast("string")).when(size < 1e37, signed).otherwise(shown_number(value))


def shown_text(text: Column) -> Column:
    """A text in quotes, with what cannot be seen escaped."""
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    quote = F.when(single & ~double, '"').otherwise("'")

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        digits = lambda n: F.lpad(F.lower(F.hex(code)), n, "0")
        hidden = (
            F.when(code < 0x100, F.concat(F.lit("\\x"), digits(2)))
            .when(code < 0x10000, F.concat(F.lit("\\u"), digits(4)))
            .otherwise(F.concat(F.lit("\\U"), digits(8)))
        )
        return (
            F.when(c == "\\", "\\\\")
            .when(c == "\n", "\\n")
            .when(c == "\r", "\\r")
            .when(c == "\t", "\\t")
            .when(c.rlike(_HIDDEN), hidden)
            .otherwise(c)
        )

    shown = F.array_join(F.transform(F.split(text, ""), escaped), "")
    quoted = F.when(single & double, F.replace(shown, F.lit("'"), F.lit("\\'"))).otherwise(shown)
    return F.concat(quote, quoted, quote)
