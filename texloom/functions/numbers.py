"""Numbers as text, with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Number words and ordinals.
UNITS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen").split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = ("zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth").split()
#: Roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))

NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_number(col: Column) -> Column:
    """A double, or null where the text isn't a number."""
    text = col.cast("string")
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def _pick(words: list[str] | tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*(F.lit(w) for w in words)), index.cast("int"))


def comma(x: Column) -> Column:
    """Thousands separated, decimals as they are."""
    whole = F.format_number(F.floor(F.abs(x)), 0)
    text = x.cast("decimal(38,10)").cast("string")
    decimals = F.regexp_replace(F.regexp_extract(text, r"\.(\d*)$", 1), "0+$", "")
    return F.concat(F.when(x < 0, "-").otherwise(""), whole, F.when(decimals != "", F.concat(F.lit("."), decimals)).otherwise(""))


def plain(x: Column) -> Column:
    """Integral doubles without a decimal part."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def in_words(x: Column) -> Column:
    """Words below 100, digits above."""
    a = F.abs(x)
    tens = F.concat(_pick(TENS, F.floor(a / 10) - 2), F.when(a % 10 == 0, "").otherwise(F.concat(F.lit("-"), _pick(UNITS, a % 10))))
    words = F.when(a < 20, _pick(UNITS, a)).otherwise(tens)
    return F.when((a >= 100) | (a != F.floor(a)), comma(x)).when(x < 0, F.concat(F.lit("minus "), words)).otherwise(words)


def roman(x: Column) -> Column:
    """Numerals for 1 to 3999, digit by digit."""
    n = F.floor(x)
    digits = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    parts = [
        _pick(["", "M", "MM", "MMM"], F.floor(n / 1000)),
        _pick(digits("C", "D", "M"), F.floor(n / 100) % 10),
        _pick(digits("X", "L", "C"), F.floor(n / 10) % 10),
        _pick(digits("I", "V", "X"), n % 10),
    ]
    return F.when((n >= 1) & (n <= 3999), F.concat(*parts)).otherwise(plain(x))


def ordinal(x: Column, letters: bool = False) -> Column:
    end = F.when((x % 100).between(11, 13), "th").when(x % 10 == 1, "st").when(x % 10 == 2, "nd").when(x % 10 == 3, "rd").otherwise("th")
    digits = F.concat(plain(x), end)
    return F.when(x.between(0, 20), _pick(ORDINALS, x)).otherwise(digits) if letters else digits


def times(x: Column, letters: bool = False) -> Column:
    number = in_words(x) if letters else plain(x)
    return F.when(x == 1, "once").when(x == 2, "twice").otherwise(F.concat(number, F.lit(" times")))


def rounded(x: Column, digits: int, *, int_as_double: bool = False, commas: bool = True) -> Column:
    """Half away from zero, with fixed decimals; whole numbers without them unless asked for."""
    d = F.round(x.cast("decimal(38,12)"), digits)
    text = F.format_number(d, digits) if commas else F.format_string(f"%.{digits}f", d)
    if int_as_double or digits == 0:
        return F.when(x.isNull() | F.isnan(x), "NA").otherwise(text)
    whole = F.format_number(x, 0) if commas else F.format_string("%.0f", x)
    return F.when(x.isNull() | F.isnan(x), "NA").when(x == F.floor(x), whole).otherwise(text)


def significant(x: Column, digits: int, least: int = 1, *, int_as_double: bool = False, commas: bool = True) -> Column:
    """The first digits of a number, cut off, not rounded; with at least ``least`` decimals."""
    a = F.abs(x)
    whole = F.floor(a)
    n_whole = F.when(whole == 0, 0).otherwise(F.length(whole.cast("string")))
    # the shortest digits that stand for the number, as decimals
    digits_of = F.when(a < 1e-20, F.format_string("%.340f", a.cast("double"))).otherwise(F.format_string("%.40f", a.cast("double")))
    decimals = F.substring_index(digits_of, ".", -1)
    zeros = F.when(whole == 0, F.length(F.regexp_extract(decimals, "^0*", 0))).otherwise(0)
    keep = F.greatest(F.lit(least), digits - n_whole + zeros)
    head = F.concat(F.when(x < 0, "-").otherwise(""), F.format_number(whole, 0) if commas else whole.cast("string"))
    full = F.concat(head, F.when(keep > 0, F.concat(F.lit("."), F.substring(decimals, F.lit(1), keep))).otherwise(""))
    out = full if int_as_double else F.when(a == whole, head).otherwise(full)
    return F.when(x.isNull() | F.isnan(x), "NA").otherwise(out)


def duration(x: Column) -> Column:
    """Seconds as a human duration."""
    hours, rest = F.floor(x / 3600), F.floor(x % 3600)
    plural = F.when(hours > 1, "s").otherwise("")
    return (
        F.when(x.isNull(), "(difftime: NA)")
        .when(x > 3600, F.concat(comma(hours.cast("double")), F.lit(" hour"), plural, F.format_string(" %02d min", F.floor(rest / 60))))
        .when(x > 60, F.concat(comma(F.floor(x / 60).cast("double")), F.format_string(" min %02d sec", F.floor(x % 60))))
        .when(x > 0.9, F.concat(F.when(x >= 10, plain(F.round(x, 1))).otherwise(F.format_string("%.1f", x)), F.lit("s")))
        .when(x > 1e-3, F.concat(F.when(x * 1000 >= 10, F.format_string("%.0f", x * 1000)).otherwise(F.format_string("%.1f", x * 1000)), F.lit("ms")))
        .otherwise("<1 ms")
    )


def duration_full(x: Column) -> Column:
    s = F.floor(x)
    return F.concat(F.when(s > 0, F.concat(F.lpad(s.cast("string"), 3, " "), F.lit("s"))).otherwise("    "), F.lit(" "), F.lpad(F.format_string("%.1f", (x - s) * 1000), 5, " "), F.lit("ms"))
