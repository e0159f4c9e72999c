"""Column expressions that read figures, dates and names out of document text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from tallywright.constants import BANK_ALIASES, MONTHS, MONTH_PREFIXES, UNKNOWN_BANK
from tallywright.functions.parsing import amount_text, date_lenient, strip

#: White space between thousands: that of ASCII and the blanks of other scripts, non-breaking ones included.
BLANKS = r"\s\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
AMOUNT_PATTERN = rf"-?\d{{1,3}}(?:[.{BLANKS}]\d{{3}})+,\d{{2}}|-?\d{{1,3}}(?:[.{BLANKS}]\d{{3}})*,\d{{2}}|-?\d+[.,]\d{{2}}"
GROUPED_AMOUNT_PATTERN = r"\d{1,3}(?:\.\d{3})+,\d{2}"
DATE_PATTERN = r"\b(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})\b"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def _fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters whose compatibility decomposition leaves one ASCII character, and the longer ones."""
    source, target, longer = [], [], []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        kept = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(kept) == 1:
            source.append(chr(code))
            target.append(kept)
        elif kept:
            longer.append((chr(code), kept))
    return "".join(source), "".join(target), longer


FOLD_FROM, FOLD_TO, FOLD_LONGER = _fold_table()


@F.pandas_udf(StringType())  # a type, not its name: modules are imported before there is a session
def _composed(paths: pd.Series) -> pd.Series:
    """Canonical composition (NFC), which no built-in function has; names are short, and a batch of them crosses at once."""
    return paths.map(lambda p: p if p is None else unicodedata.normalize("NFC", p))


def fold_text(c: Column) -> Column:
    """Lower-case ASCII text for keyword matching; accents dropped, other characters removed."""
    longer = F.str_to_map(F.lit("\n".join(f"{old}\t{new}" for old, new in FOLD_LONGER)), F.lit("\n"), F.lit("\t"))
    present = F.filter(F.array_distinct(_matches(c, r"[^\x00-\x7F]")), lambda char: longer[char].isNotNull())
    expanded = F.aggregate(present, c, lambda text, char: F.replace(text, char, longer[char]))
    folded = F.regexp_replace(F.translate(expanded, FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]", "")
    return F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c))


def lines_of(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def _matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def _first_match(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def find_amounts(c: Column) -> Column:
    parsed = F.transform(_matches(c, AMOUNT_PATTERN), lambda x: amount_text(x))
    return F.filter(parsed, lambda x: F.abs(x) >= 0.01)


def find_dates(c: Column) -> Column:
    return _matches(c, DATE_PATTERN, 1)


def _largest(amounts: Column) -> Column:
    start = F.lit(None).cast("decimal(18,2)")
    return F.aggregate(
        amounts, start, lambda best, x: F.when(best.isNull() | (F.abs(x) > F.abs(best)), x).otherwise(best)
    )


def tax_payment_amount(c: Column) -> Column:
    grouped = F.filter(F.transform(_matches(c, GROUPED_AMOUNT_PATTERN), lambda x: amount_text(x)), lambda x: x >= 1)
    labelled = F.filter(lines_of(c), lambda line: line.rlike(r"(?i)importo|versare|totale|erario|saldo"))
    on_labelled = F.flatten(F.transform(labelled, lambda line: find_amounts(line)))
    return F.coalesce(
        _last(grouped), _largest(on_labelled), F.array_max(F.filter(find_amounts(c), lambda x: x >= 10))
    )


def statement_balance(c: Column) -> Column:
    named = F.filter(
        F.transform(lines_of(c), lambda line: F.lower(line)),
        lambda line: line.rlike("saldo|disponibilit|new balance|closing")
        & ~line.rlike("saldo iniziale|previous|precedente"),
    )
    last_amounts = F.transform(named, lambda line: _last(find_amounts(line)))
    return _last(F.filter(last_amounts, lambda x: F.abs(x) >= 1))


def protocol_number(c: Column) -> Column:
    return _first_match(c, r"\b(\d{15,20})\b")


def payment_date(c: Column) -> Column:
    compact = F.regexp_replace(c, r"(?U)[\s.:]", "")
    at = F.locate("DATADELVERSAMENTO", F.upper(compact))
    start = F.greatest(F.lit(1), at - 48)
    near = F.when(at > 0, F.substr(compact, start, at + 48 - start))
    digits = r"(0[1-9]|[12]\d|3[01])(0[1-9]|1[0-2])(20\d{2})"
    hit = _last(_matches(near, digits))
    marked = F.concat_ws("/", F.substr(hit, F.lit(1), F.lit(2)), F.substr(hit, F.lit(3), F.lit(2)), F.substr(hit, F.lit(5), F.lit(4)))
    dated = F.filter(lines_of(c), lambda line: line.rlike(DATE_PATTERN))
    paying = F.filter(dated, lambda line: line.rlike(r"(?i)vers|delega|quietanza|pagat|protocol"))
    return F.coalesce(
        F.when(hit.isNotNull(), marked),
        _last(find_dates(F.get(paying, F.lit(0)))),
        _last(find_dates(_last(dated))),
    )


def statement_account(name: Column, text: Column, width: int | None = None) -> Column:
    in_name = _first_match(name, r"(?i)cc[_\s-]*(\d+)")
    account_pattern = r"(?i)conto\s*corrente\s*n\.?\s*([\d /]+)"
    in_text = F.regexp_replace(F.regexp_extract(text, account_pattern, 1), r"\s+", "")
    in_text = in_text if width is None else F.left(in_text, F.lit(width))
    iban = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), r"(?i)IT\d{2}[A-Z]\d{10,}", 0)
    account = (
        F.when(in_name.isNotNull(), in_name)
        .when(name.rlike("(?i)usd"), F.lit("USD"))
        .when(text.rlike(account_pattern), in_text)
        .otherwise(F.right(iban, F.lit(12)))
    )
    return F.nullif(account, F.lit(""))


def _quarter_of(period: Column) -> Column:
    text = F.lower(period)
    return (
        F.when(text.rlike(r"(?U)\biii\b|\b3[°ºo]\b|\bterzo trim"), 3)
        .when(text.rlike(r"(?U)\bii\b|\b2[°ºo]\b|\bsecondo trim"), 2)
        .when(text.rlike(r"(?U)\biv\b|\b4[°ºo]\b|\bquarto trim"), 4)
        .when(text.rlike(r"(?U)\bi\b\s*trim|\b1[°ºo]\b|\bprimo trim"), 1)
    )


def period_year(period: Column, default_year: int | None = None) -> Column:
    return F.coalesce(_first_match(period, r"(20\d{2})").cast("int"), F.lit(default_year).cast("int"))


def _months_span(period: Column, pick) -> Column:
    """First or last quarter month, else first or last month named in full."""
    text = F.lower(period)
    named = F.array_compact(
        F.array(*[F.when(F.contains(text, F.lit(name)), F.lit(i)) for i, name in enumerate(MONTHS, 1)])
    )
    quarter = _quarter_of(period)
    bounds = {"first": quarter * 3 - 2, "last": quarter * 3}
    chosen = {"first": F.array_min(named), "last": F.array_max(named)}
    return F.when(quarter.isNotNull(), bounds[pick]).when(F.size(named) >= 2, chosen[pick]).cast("int")


def first_month(period: Column) -> Column:
    return _months_span(period, "first")


def last_month(period: Column) -> Column:
    return _months_span(period, "last")


def period_months(period: Column, default_year: int | None = None) -> Column:
    """Array of (year, month); NULL when the label names no period."""
    first, last, year = first_month(period), last_month(period), period_year(period, default_year)
    return F.when(
        first.isNotNull(),
        F.transform(F.sequence(first, last), lambda m: F.struct(year.alias("year"), m.alias("month"))),
    )


def period_quarter(period: Column) -> Column:
    return F.floor((first_month(period) - 1) / 3).cast("int") + 1


def quarter_in_name(name: Column) -> Column:
    text = F.lower(name)
    chain = None
    for number, roman in ((4, "iv"), (3, "iii"), (2, "ii"), (1, "i")):
        hit = text.rlike(rf"(?:^|[_\s.-]){number}\s*tr|\b{roman}\s*tr|{number}[°ºo]")
        chain = F.when(hit, number) if chain is None else chain.when(hit, number)
    return chain


SIX_DIGITS = r"\b(\d{2})(\d{2})(\d{2})\b"


def _six_digit_parts(name: Column) -> tuple[Column, Column, Column]:
    return tuple(_first_match(name, SIX_DIGITS, i).cast("int") for i in (1, 2, 3))


def month_in_name(name: Column) -> Column:
    prefix = _first_match(F.lower(name), "(" + "|".join(MONTH_PREFIXES) + r")[\s._-]?\d{2}")
    day, month, _ = _six_digit_parts(name)
    from_prefix = F.array_position(F.array(*[F.lit(p) for p in MONTH_PREFIXES]), prefix).cast("int")
    return F.coalesce(from_prefix, F.when(month.between(1, 12) & day.between(1, 31), month))


def date_in_name(name: Column) -> Column:
    day, month, year = _six_digit_parts(name)
    return F.when(
        month.between(1, 12) & day.between(1, 31),
        F.try_to_date(F.concat_ws("-", year + 2000, month, day), "yyyy-M-d"),
    )


def _first_alias(c: Column, value) -> Column:
    chain = None
    for alias, label in BANK_ALIASES:
        hit, out = F.contains(c, F.lit(alias)), F.lit(value(alias, label))
        chain = F.when(hit, out) if chain is None else chain.when(hit, out)
    return chain


def bank_alias_key(name: Column, text: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", name, text))
    pick = lambda alias, label: alias
    return F.coalesce(_first_alias(F.lower(name), pick), _first_alias(blob, pick))


def bank_alias(name: Column, text: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", name, text))
    pick = lambda alias, label: label
    return F.coalesce(_first_alias(F.lower(name), pick), _first_alias(blob, pick), F.lit(UNKNOWN_BANK))


def bank_key(name: Column) -> Column:
    text = F.lower(name)
    account = _first_match(text, r"cc[_\s-]*(\d+)")
    fallback = (
        F.when(F.contains(text, F.lit("usd")), "usd")
        .when(text.rlike("ecomm|e comm|e-comm"), "ecom")
        .otherwise("cc")
    )
    alias = _first_alias(text, lambda alias, label: alias)
    return F.coalesce(F.concat(alias, F.lit(":"), F.coalesce(account, fallback)), text)


def last_print_page(c: Column, limit: int | None = None) -> Column:
    pages = F.filter(F.split(c, "\f"), lambda page: strip(page) != "")
    from_mark = F.regexp_extract(c, r"(?is)^(?:.*\n)?([^\n]*pagina\s+\d+.*)$", 1)
    page = (
        F.when(F.contains(c, F.lit("\f")), F.coalesce(_last(pages), c))
        .when(c.rlike(r"(?i)pagina\s+\d+"), from_mark)
        .otherwise(c)
    )
    return page if limit is None else F.right(page, F.lit(limit))


LEDGER_NOISE = r"(?i)Saldi preced|Progr\.e saldo|Pagina|Elaborazione"
LEDGER_TAIL_NOISE = r"(?i)FINE STAMPA|Saldi preced|Progr\.e saldo|Pagina\s+\d+|Elaborazione"
WORD = r"[A-Za-zÀ-ÿ]{4,}"


def _squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def ledger_page(c: Column) -> Column:
    return _last(_matches(c, r"(?i)Pagina\s+(\d+)", 1)).try_cast("int")


def ledger_date(c: Column) -> Column:
    closing = _matches(c, r"(?i)Progr\.e saldo al\s+(\d{1,2}/\d{1,2}/\d{2,4})", 1)
    return F.coalesce(_last(closing), _last(find_dates(c)))


def _narrative_line(line: Column) -> Column:
    for pattern in (r"\d{1,2}/\d{1,2}/\d{2,4}", r"[\d.]+,\d{2}", r"\b\d+\b", r"\s+"):
        line = F.regexp_replace(line, pattern, " ")
    return F.regexp_replace(line, r"^[ -]+|[ -]+$", "")


def ledger_description(c: Column, width: int | None = None) -> Column:
    sub_account = _squeeze(
        F.regexp_extract(c, r"(?im)Sottoconto\s+\S+\s+(.+?)(?:\s{2,}Elaborazione|\s*$)", 1)
    )
    before = F.regexp_extract(c, r"(?is)^(.*)Progr\.e saldo al\s+\d{1,2}/\d{1,2}/\d{2,4}", 1)
    has_closing = c.rlike(r"(?i)Progr\.e saldo al\s+\d{1,2}/\d{1,2}/\d{2,4}")
    cut = F.when(has_closing, before).otherwise(c)
    last_dated = F.regexp_extract(cut, r"(?ms)\A.*(^\s*\d{1,2}/\d{1,2}/\d{2,4}\b.*)\z", 1)
    bits = F.filter(
        F.transform(lines_of(last_dated), lambda s: _narrative_line(s)), lambda s: s.rlike(WORD) & ~s.rlike(LEDGER_NOISE)
    )
    narrative = F.array_join(bits, " ")
    joined = F.concat_ws(" — ", F.nullif(sub_account, F.lit("")), F.nullif(narrative, F.lit("")))
    tail = F.filter(
        F.transform(lines_of(c), lambda s: strip(s)),
        lambda s: (F.length(s) >= 4) & ~s.startswith("-") & ~s.rlike(LEDGER_TAIL_NOISE) & s.rlike(WORD),
    )
    described = F.coalesce(F.nullif(joined, F.lit("")), _squeeze(_last(tail)), F.lit(""))
    return described if width is None else F.left(described, F.lit(width))


def ledger_closing(c: Column) -> Column:
    return F.struct(
        ledger_page(c).alias("page"), ledger_date(c).alias("closing_date"), ledger_description(c).alias("description")
    )


def normalise_path(c: Column) -> Column:
    """Canonically composed characters, forward slashes, no ``.`` or ``..`` segment, never above the root."""
    parts = F.split(strip(F.replace(F.coalesce(_composed(c), F.lit("")), F.lit("\\"), F.lit("/"))), "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
    )
    return F.array_join(kept, "/")


def document_key(engagement: Column, path: Column) -> Column:
    return F.left(F.sha1(F.concat(engagement, F.lit(":"), normalise_path(path))), F.lit(12))


def read_date(c: Column) -> Column:
    """Date of a token found in text, whatever its separators."""
    return date_lenient(F.left(F.replace(c, F.lit("."), F.lit("/")), F.lit(10)))
