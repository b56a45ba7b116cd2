"""Column expressions for numbers and text, with SQL null as the only missing value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A signed decimal number without exponent; the first one in a text counts.
NUMBER = r"-?[0-9]+(?:[.][0-9]+)?"
#: White space as Unicode has it, the no-break space among it.
SPACES = r"[\s  - 　]+"


def rounded(value: Column, places: int = 2) -> Column:
    """Half to even on the scaled double; adding zero turns a negative zero into zero."""
    scale = float(10**places)
    return F.rint(value * scale) / scale + F.lit(0.0)


def fixed_text(value: Column, places: int = 2) -> Column:
    """The value's exact binary number as text with so many decimals, ties to even: 0.125 is 0.12, and 2.675, which is a
    little less than it looks, is 2.67. Right below 2**52 / 10**places; beyond it as Java's formatter has it.

    The value is split into two halves whose products with the scale are exact, so that the distance to the nearest whole
    number is too.
    """
    scale = float(10**places)

    def exact(v: Column) -> Column:
        folded = v * 134217729.0  # 2**27 + 1
        return bound(folded - (folded - v), lambda high: bound(F.rint(v * scale), lambda near: nearest(near, high * scale - near, (v - high) * scale)))

    def nearest(near: Column, much: Column, little: Column) -> Column:
        over, under = (much - 0.5) + little, (much + 0.5) + little  # exact where they are close to zero
        odd = F.pmod(near, F.lit(2.0)) == 1
        step = F.when((over > 0) | ((over == 0) & odd), 1.0).when((under < 0) | ((under == 0) & odd), -1.0).otherwise(0.0)
        return F.abs(near + step).cast("long")

    def shown(whole: Column) -> Column:
        parts = [whole.cast("string")]
        if places:
            parts = [F.call_function("div", whole, F.lit(10**places)).cast("string"), F.lit("."), F.lpad((whole % 10**places).cast("string"), places, "0")]
        return F.concat(*parts)

    minus = F.when(F.startswith(value.cast("string"), F.lit("-")), "-").otherwise("")
    text = F.concat(minus, bound(exact(value), shown))
    return F.when(F.abs(value) * scale < 2.0**52, text).otherwise(F.when(value.isNotNull(), F.format_string(f"%.{places}f", value)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def not_nan(value: Column) -> Column:
    """Null for NaN: Spark orders NaN above every number, so that it would pass a positive gate."""
    return F.nanvl(value, F.lit(None).cast("double"))


def growth_pct(current: Column, previous: Column) -> Column:
    """(current / previous - 1) * 100; null where the previous value is zero or missing."""
    return (current / F.nullif(previous, F.lit(0.0)) - 1.0) * 100.0


def parse_number(text: Column) -> Column:
    """The first number in a text without thousands commas, percent and rupee signs."""
    plain = F.translate(text, ",%₹", "")
    return F.nullif(F.regexp_extract(plain, NUMBER, 0), F.lit("")).try_cast("double")


def clean_label(text: Column) -> Column:
    """Without plus signs, and with single spaces."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("+"), F.lit("")), SPACES, " "))


def starts_with_any(label: Column, targets: tuple[str, ...]) -> Column:
    """Whether a label starts with one of the targets, whatever the case."""
    low = F.lower(label)
    hit = F.lit(False)
    for target in targets:
        hit = hit | F.startswith(low, F.lit(target.lower()))
    return hit


def text_bool(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "1", "yes"), F.lit(False))


def to_double(value: Column) -> Column:
    """Null where the text is no number."""
    return not_nan(value.try_cast("double"))


def percent_like(columns: list[str]) -> list[str]:
    """The export columns that hold percentages, by their names."""
    return [c for c in columns if "Return" in c or "ret" in c or c.endswith("%")]


def percent_encode(text: Column) -> Column:
    """Percent encoding with no safe marks: Spark's form encoding differs in three."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")
