"""Strict and lenient parsing of text cells into typed columns. Unreadable input gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,2)"
PRECISE = "decimal(28,6)"


# --- Fixed values: characters that count as blank at either end of a cell ------------------------
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def text_or_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def number_to_text(c: Column) -> Column:
    """Text of a numeric cell; whole floats lose their decimals."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def _date(day: Column, month: Column, year: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")


def _parts(c: Column, pattern: str, day: int, month: int, year: int) -> Column:
    pieces = [F.regexp_extract(c, pattern, i) for i in (day, month, year)]
    return F.when(c.rlike(pattern), _date(*pieces))


def _two_digit_year(c: Column, sep: str) -> Column:
    pattern = rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{2}})$"
    short = F.regexp_extract(c, pattern, 3)
    year = F.concat(F.when(short >= "69", "19").otherwise("20"), short)
    return F.when(c.rlike(pattern), _date(F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2), year))


def _four_digit_year(c: Column, sep: str) -> Column:
    return _parts(c, rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}})$", 1, 2, 3)


def _year_first(c: Column) -> Column:
    return _parts(c, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 3, 2, 1)


def date_strict(c: Column) -> Column:
    text = strip(c)
    return F.coalesce(_four_digit_year(text, "/"), _year_first(text))


def date_lenient(c: Column) -> Column:
    text = strip(c)
    return F.coalesce(
        *[_four_digit_year(text, sep) for sep in ("/", "-", r"\.")],
        _year_first(text),
        *[_two_digit_year(text, sep) for sep in ("/", "-", r"\.")],
    )


def time_strict(c: Column) -> Column:
    """Seconds of the day."""
    pattern = r"^([01]?\d|2[0-3]):([0-5]?\d)(?::([0-5]?\d))?$"
    text = strip(c)
    hours, minutes, seconds = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    total = hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60 + F.coalesce(
        F.nullif(seconds, F.lit("")).try_cast("int"), F.lit(0)
    )
    return F.when(text.rlike(pattern), total)


def amount_strict(c: Column, kind: str = PRECISE) -> Column:
    text = F.replace(strip(c), F.lit(" "), F.lit(""))
    italian = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(F.contains(text, F.lit(",")), italian).otherwise(text).try_cast(kind)


def amount_lenient(c: Column, kind: str = MONEY) -> Column:
    """Zero for blanks, dashes and anything unreadable."""
    text = strip(F.translate(strip(c), "€$", ""))
    last_comma = F.length(F.substring_index(text, ",", -1))
    last_dot = F.length(F.substring_index(text, ".", -1))
    has_comma, has_dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
    comma_decimal = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    dot_decimal = F.replace(text, F.lit(","), F.lit(""))
    plain = (
        F.when(has_comma & has_dot, F.when(last_comma < last_dot, comma_decimal).otherwise(dot_decimal))
        .when(has_comma, F.replace(text, F.lit(","), F.lit(".")))
        .otherwise(text)
    )
    return F.coalesce(plain.try_cast(kind), F.lit(0).cast(kind))


def amount_text(c: Column, kind: str = MONEY) -> Column:
    """Amount written in running text; NULL when no number is left after cleaning."""
    text = F.replace(F.replace(F.replace(strip(c), F.lit("€"), F.lit("")), F.lit("EUR"), F.lit("")), F.lit(" "), F.lit(""))
    decimal_comma = F.replace(text, F.lit(","), F.lit("."))
    grouped = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = (
        F.when(text.rlike(r"^-?\d{1,3}(\.\d{3})+,\d{1,2}$"), grouped)
        .when(F.contains(text, F.lit(",")) & ~F.contains(text, F.lit(".")), decimal_comma)
        .otherwise(text)
    )
    return F.regexp_replace(plain, r"[^0-9.\-]", "").try_cast(kind)
