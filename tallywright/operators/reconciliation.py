"""Bank reconciliation, trial-balance variation, tax and fund slots, books, minutes, provenance.

``documents``: engagement_id, load_order, item_id, name, rel_path, text, period (+ excerpt, skip,
method, confidence where a function says so).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallywright.constants import BANK_ALIASES, MONTHS, UNKNOWN_BANK
from tallywright.functions import text as T
from tallywright.functions.ordered import first_n, number_bucket, number_rows
from tallywright.functions.parsing import amount_text, strip
from tallywright.operators.classification import minutes_date

RECORD_LINES = 7
RECORD_BUCKET = 1_000_000
#: Lines whose record starts are walked in one cell.
RECORD_BLOCK = 4096
ENGAGEMENT = "engagement_id"


def _record_starts(lines: DataFrame, block: int = RECORD_BLOCK) -> DataFrame:
    """Every possible record start with its six following lines, and ``overlaps`` where it lies inside a record kept before.

    Non-blank lines are numbered per source; a bucket of lines also holds the six lines after it, so a record that
    crosses a border is still seen whole.
    """
    filled = lines.select("source_id", "line_number", strip(F.col("value")).alias("value")).filter("value <> ''")
    bucketed = filled.withColumn("_b", number_bucket("line_number"))
    numbered = number_rows(bucketed, ["source_id"], ["_b"], ["line_number"], "n").drop("_b")
    home = F.floor(F.col("n") / RECORD_BUCKET)
    near = F.sequence(F.floor((F.col("n") - RECORD_LINES + 1) / RECORD_BUCKET), home)
    spread = numbered.withColumn("_home", home).withColumn("_part", F.explode(near))
    part = W.partitionBy("source_id", "_part").orderBy("n")
    seen = spread.withColumns({f"l{i}": F.lead("value", i).over(part) for i in range(1, RECORD_LINES)})
    starts = F.col("value").rlike(r"(?i)^(BU|SA)\d{2}$") & F.col("l2").rlike("^[A-Z]{3}$") & F.col("l6").isNotNull()
    found = seen.filter(F.coalesce(starts, F.lit(False)) & (F.col("_part") == F.col("_home")))
    kept = kept_starts(found.select("source_id", "n"), block).withColumn("_kept", F.lit(True))
    return found.join(kept, ["source_id", "n"], "left").withColumn("overlaps", F.col("_kept").isNull())


def _walk(numbers: Column, free: Column) -> Column:
    """Of rising numbers those kept, each at least a record after the one kept before, and the next free number."""
    begin = F.struct(free.alias("free"), F.array().cast("array<bigint>").alias("kept"))
    take = lambda s, n: F.struct((n + RECORD_LINES).alias("free"), F.array_append(s["kept"], n).alias("kept"))
    return F.aggregate(numbers, begin, lambda s, n: F.when(n >= s["free"], take(s, n)).otherwise(s))


def _pass(units: Column, state: Column, first: Column) -> Column:
    """States in which units (place, after: state by state) are entered one after another; the state that is left in the end.

    The first place that can be entered in ``state`` is ``first``. A unit that doesn't follow the one before at once is entered in state 0.
    """
    begin = F.struct(first.alias("next"), state.alias("state"), F.array().cast("array<struct<place:bigint,entered:int>>").alias("seen"))

    def step(s: Column, unit: Column) -> Column:
        entered = F.when(unit["place"] == s["next"], s["state"]).otherwise(F.lit(0))
        seen = F.array_append(s["seen"], F.struct(unit["place"].alias("place"), entered.alias("entered")))
        return F.struct((unit["place"] + 1).alias("next"), F.get(unit["after"], entered).alias("state"), seen.alias("seen"))

    return F.aggregate(units, begin, step)


def kept_starts(starts: DataFrame, block: int = RECORD_BLOCK, blocks: int = 256) -> DataFrame:
    """(source_id, n) of the starts that count: taken in order, each at least seven lines after the last one that counted.

    What a block of lines does to those after it is a function of seven states, the lines still taken by a record
    when the block begins. Blocks are folded from every state at once, runs of blocks from their blocks' functions, and a
    source from its runs; then the states go back down, and each block is walked from the one it is entered in. A cell
    holds one block's starts, one run's blocks or one source's runs (one for every ``block * blocks`` lines).
    """
    states = F.sequence(F.lit(0), F.lit(RECORD_LINES - 1))
    place = F.floor(F.col("n") / block).cast("bigint")
    walked = starts.groupBy("source_id", place.alias("place")).agg(F.sort_array(F.collect_list(F.col("n").cast("bigint"))).alias("numbers"))
    begin = F.col("place") * block
    leaves = F.transform(states, lambda k: F.greatest(_walk(F.col("numbers"), begin + k)["free"] - begin - block, F.lit(0)).cast("int"))
    walked = walked.withColumns({"after": leaves, "run": F.floor(F.col("place") / blocks).cast("bigint")})
    units = F.sort_array(F.collect_list(F.struct("place", "after"))).alias("units")
    runs = walked.groupBy("source_id", "run").agg(units)
    first = F.col("run") * blocks

    def left(k: Column) -> Column:
        s = _pass(F.col("units"), k, first)
        return F.when(s["next"] == first + blocks, s["state"]).otherwise(F.lit(0))

    sources = runs.select("source_id", F.col("run").alias("place"), F.transform(states, left).alias("after")).groupBy("source_id").agg(units)
    entered = sources.select("source_id", F.explode(_pass(F.col("units"), F.lit(0), F.lit(-1).cast("bigint"))["seen"]).alias("s"))
    entered = entered.select("source_id", F.col("s.place").alias("run"), F.col("s.entered").alias("state"))
    inside = runs.join(entered, ["source_id", "run"]).select("source_id", F.explode(_pass(F.col("units"), F.col("state"), first)["seen"]).alias("s"))
    inside = inside.select("source_id", "s.place", "s.entered")
    return walked.join(inside, ["source_id", "place"]).select("source_id", F.explode(_walk(F.col("numbers"), begin + F.col("entered"))["kept"]).alias("n"))


def balance_records(lines: DataFrame) -> DataFrame:
    """Seven-line balance records of a dump; a record with neither amount is dropped."""
    records = _record_starts(lines).filter("NOT overlaps").select(
        "source_id",
        "line_number",
        F.col("l1").alias("bank"),
        F.col("l2").alias("currency"),
        F.col("l3").alias("record_date"),
        amount_text(F.col("l4")).alias("received"),
        amount_text(F.col("l5")).alias("booked"),
        amount_text(F.col("l6")).alias("difference"),
    )
    return records.filter("received IS NOT NULL OR booked IS NOT NULL")


def overlapping_records(lines: DataFrame) -> DataFrame:
    """Record starts that lie inside another record: a malformed dump to look at."""
    return _record_starts(lines).filter("overlaps").select("source_id", "line_number", "value")


# --- Fixed values: month tokens in statement names and points ------------------------------------
END_TOKENS = {3: "mar|marzo", 4: "apr|aprile", 5: "mag|maggio|may", 6: "giu|giugno|jun", 9: "set|settembre", 12: "dic|dicembre"}


def statement_points(name: Column, month: Column) -> Column:
    """Preference of a statement's name for the last month of the period."""
    n = F.lower(name)
    two = F.lpad(month.cast("string"), 2, "0")
    day = F.concat(
        F.lit(r"30[\s._-]?0?"), month, F.lit("|"), two, F.lit(r"[\s._-]30|"), two, F.lit(r"[\s._-]31")
    )
    named = F.regexp_like(n, day)
    for number, tokens in END_TOKENS.items():
        named = named | ((month == number) & n.rlike(tokens))
    early = n.rlike("aprile|maggio|apr-|may-|apr26|mag26") & (month == 6)
    return (
        F.when(named, 12).otherwise(0)
        + F.when(n.rlike(r"01[\s._-]jul|01[\s._-]lug|luglio|july"), -20).otherwise(0)
        + F.when(early, -8).otherwise(0)
        + F.when(F.contains(n, F.lit("scalar")), -4).otherwise(0)
        + F.when(n.rlike("ecommerce|e commerce|e-commerce"), 1).otherwise(0)
    )


def pick_statements(documents: DataFrame, rows: int | None = None) -> DataFrame:
    """One statement per bank and account, best name first, numbered in ``row_no``; only the first ``rows`` where given.

    The best per key is an aggregate, so the numbering sees one row per bank account of an engagement.
    """
    month = F.coalesce(T.last_month(F.col("period")), F.lit(6))
    scored = documents.filter(F.col("item_id") == "F.1").withColumns(
        {"points": statement_points(F.col("name"), month), "bank_key": T.bank_key(F.col("name"))}
    ).filter("points >= 0")
    rank = F.struct((-F.col("points")).alias("a"), F.col("load_order").alias("b"))
    best = scored.groupBy(ENGAGEMENT, "bank_key").agg(F.min(rank)["b"].alias("load_order"))  # texts join later
    own = scored.join(best, [ENGAGEMENT, "bank_key", "load_order"])
    if rows is not None:
        return first_n(own, [ENGAGEMENT], [F.desc("points"), F.col("load_order")], rows, "row_no")
    cut = own.select(ENGAGEMENT, "load_order", (-F.col("points")).alias("_worse"), number_bucket("load_order").alias("_range"))
    numbers = number_rows(cut, [ENGAGEMENT], ["_worse", "_range"], ["load_order"], "row_no").drop("_worse", "_range")
    return own.join(numbers, [ENGAGEMENT, "load_order"])


def _ranked(df: DataFrame, keys: list[str], order: list[Column], most: int | None, name: str) -> DataFrame:
    if most is not None:
        return first_n(df, keys, order, most, name)
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def _statement_rows(statements: DataFrame) -> DataFrame:
    name, text = F.col("name"), F.coalesce("text", F.lit(""))
    blob = F.lower(F.concat_ws(" ", name, text))
    return statements.select(
        ENGAGEMENT, "load_order", "name",
        T.bank_alias(name, text).alias("bank"),
        T.bank_alias_key(name, text).alias("alias"),
        F.when(F.contains(blob, F.lit("usd")), "USD").otherwise("cc").alias("currency"),
        T.statement_account(name, text).alias("account"),
        T.statement_balance(text).alias("statement_balance"),
    )


def _first_hits(rows: DataFrame, words: list[str], text: Column, value: str, keys: list[str]) -> DataFrame:
    """Per key and word the first row whose text contains the word; only real hits are unrolled."""
    hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))
    return (
        rows.filter(F.col(value).isNotNull())
        .select(*keys, "load_order", value, F.explode(hits).alias("word"))
        .groupBy(*keys, "word")
        .agg(F.min_by(value, "load_order").alias(value))
    )


def reconcile_banks(statements: DataFrame, records: DataFrame) -> DataFrame:
    """Statement balance beside the first booked balance of the same bank and currency class.

    ``records``: engagement_id, load_order, bank, currency, booked. Bank names are resolved to the
    aliases they contain first, so the two sides meet in an equi-join.
    """
    aliases = list(dict.fromkeys(alias for alias, _ in BANK_ALIASES))
    classed = records.withColumn("_usd", F.coalesce(F.col("currency") == "USD", F.lit(False)))
    booked = _first_hits(classed, aliases, F.col("bank"), "booked", [ENGAGEMENT, "_usd"])
    rows = _statement_rows(statements).withColumn("_usd", F.col("currency") == "USD")
    return rows.join(
        booked.withColumnRenamed("word", "alias"), [ENGAGEMENT, "_usd", "alias"], "left"
    ).drop("_usd", "alias")


def ledger_fallback(reconciled: DataFrame, accounts: DataFrame) -> DataFrame:
    """Fill a missing booked balance from the first ledger account named like the bank.

    ``accounts``: engagement_id, load_order, name, amount.
    """
    labels = [label for _, label in BANK_ALIASES] + [UNKNOWN_BANK]
    words = list(dict.fromkeys(label.split()[0].lower() for label in labels))
    named = _first_hits(accounts, words, F.col("name"), "amount", [ENGAGEMENT])
    word = F.lower(F.substring_index("bank", " ", 1))
    joined = reconciled.withColumn("word", word).join(named, [ENGAGEMENT, "word"], "left").drop("word")
    source = F.when(F.col("booked").isNotNull(), "dump").when(F.col("amount").isNotNull(), "ledger")
    return joined.withColumn("booked_source", source).withColumn("booked", F.coalesce("booked", "amount")).drop("amount")


def bank_check(rows: DataFrame) -> DataFrame:
    """Booked minus statement; a warning from half a cent on."""
    delta = F.col("booked") - F.col("statement_balance")
    off = F.abs(delta) >= F.lit("0.005").cast("decimal(4,3)")
    text = F.concat("bank", F.lit(": check bancario ≠ 0 (Δ "), delta.cast("decimal(18,2)"), F.lit(")"))
    return rows.withColumns({"delta": delta, "warning": F.when(off, text)})


def bank_totals(rows: DataFrame) -> DataFrame:
    """Column totals per engagement and over all of them (engagement NULL)."""
    columns = [c for c in ("booked", "statement_balance", "pending", "delta") if c in rows.columns]
    return rows.rollup(ENGAGEMENT).agg(
        F.count(F.lit(1)).alias("bank_rows"), *[F.sum(c).alias(f"total_{c}") for c in columns]
    )


def balance_variation(accounts: DataFrame) -> DataFrame:
    """Amount minus prior and the relative change, blank when prior is zero or either is missing."""
    change = F.try_divide(F.col("amount"), F.col("prior")) - 1
    return accounts.withColumns(
        {"variation": F.col("amount") - F.col("prior"), "variation_share": change.cast("decimal(18,6)")}
    )


def tax_payment_slots(documents: DataFrame, slots: int | None = None) -> DataFrame:
    """Tax receipts in the months of the period (the first ``slots`` where given), with date, amount and protocol per month.

    A receipt takes the first month that its name, a month word or a date names; otherwise its own
    place in load order while that is a month of the period. Later receipts overwrite field by field.
    Stamp-duty receipts count only where there is nothing else.
    """
    receipts = documents.filter(F.col("item_id") == "E.1")
    stamp = F.contains(F.lower("name"), F.lit("bollo"))
    others = receipts.groupBy(ENGAGEMENT).agg(F.bool_or(~stamp).alias("_others"))
    used = receipts.join(others, ENGAGEMENT).filter(~stamp | ~F.col("_others")).drop("_others")
    orders = used.select(ENGAGEMENT, "load_order")
    if slots is None:
        early = number_rows(orders.withColumn("_range", number_bucket("load_order")), [ENGAGEMENT], ["_range"], ["load_order"], "_place").drop("_range")
    else:
        early = first_n(orders, [ENGAGEMENT], [F.col("load_order")], slots, "_place")
    placed = used.join(early, [ENGAGEMENT, "load_order"], "left")

    name, text = F.col("name"), F.coalesce("text", F.lit(""))
    blob = F.lower(F.concat_ws(" ", name, text))
    words = F.array(*[F.lit(m) for m in MONTHS])
    placed = placed.withColumns(
        {
            "_months": T.period_months(F.col("period")) if slots is None else F.slice(T.period_months(F.col("period")), 1, slots),
            "_name_month": T.month_in_name(name),
            "_date_months": F.transform(T.find_dates(text), lambda d: F.month(T.read_date(d))),
            "_blob": blob,
        }
    )
    fits = F.transform(
        "_months",
        lambda m: F.coalesce(F.col("_name_month") == m["month"], F.lit(False))
        | F.contains(F.col("_blob"), F.element_at(words, m["month"]))
        | F.coalesce(F.array_contains("_date_months", m["month"]), F.lit(False)),
    )
    matched = F.nullif(F.array_position(fits, True), F.lit(0).cast("bigint"))
    slot = F.coalesce(matched, F.when(F.col("_place") <= F.size("_months"), F.col("_place").cast("bigint")))
    paid = T.read_date(T.payment_date(text))
    filled = placed.withColumn("slot", slot).filter("slot IS NOT NULL").select(
        ENGAGEMENT, "slot", "load_order", "name", F.get("_months", F.col("slot").cast("int") - 1).alias("m"),
        F.coalesce(paid, T.date_in_name(name)).alias("paid_on"),
        T.tax_payment_amount(text).alias("amount"),
        T.protocol_number(text).alias("protocol"),
    )
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("load_order"))).alias(c)
    return filled.groupBy(ENGAGEMENT, "slot", F.col("m.year").alias("year"), F.col("m.month").alias("month")).agg(
        F.count(F.lit(1)).alias("receipts"), latest("paid_on"), latest("amount"), latest("protocol")
    )


def fund_quarter_slots(documents: DataFrame) -> DataFrame:
    """Quarter marks of pension-fund receipts, the periodic and the annual VAT documents.

    The quarter is looked for in the name, the excerpt and the whole text. One row per fund receipt; VAT rows name their first document.
    """
    quarter = T.period_quarter(F.col("period"))
    blob = F.lower(F.concat_ws(" ", "name", *[c for c in ("excerpt", "text") if c in documents.columns]))
    stem = F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), "(?i)pdf$", "")
    funds = documents.filter(F.col("item_id") == "E.2").select(
        ENGAGEMENT, "load_order", stem.alias("row_label"),
        F.coalesce(T.quarter_in_name(blob), quarter).alias("quarter"),
    )
    vat = documents.filter(F.col("item_id").isin("E.3", "E.4")).groupBy(ENGAGEMENT, "item_id").agg(
        F.min("load_order").alias("load_order"), F.min_by(quarter, "load_order").alias("quarter")
    )
    label = F.when(F.col("item_id") == "E.3", "LIPE").otherwise("IVA annuale")
    rows = funds.unionByName(vat.select(ENGAGEMENT, "load_order", label.alias("row_label"), "quarter"))
    marks = [F.when(F.col("quarter") == q, "✓").alias(f"q{q}") for q in (1, 2, 3, 4)]
    return rows.select(ENGAGEMENT, "load_order", "row_label", *marks)


PAGE_NUMBER = r"(?i)pag(?:ina|\.)?\s*(\d+)"


def _page_in(name: Column, text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.concat_ws(" ", name, text), PAGE_NUMBER, 1), F.lit("")).try_cast("int")


def _first_document(documents: DataFrame, order: Column) -> DataFrame:
    rest = [c for c in documents.columns if c not in (ENGAGEMENT, "item_id")]
    first = F.min_by(F.struct(*rest), order).alias("d")
    return documents.groupBy(ENGAGEMENT, "item_id").agg(first, F.count(F.lit(1)).alias("files")).select(
        ENGAGEMENT, "item_id", "files", "d.*"
    )


def books_update(documents: DataFrame, width: int | None = None) -> DataFrame:
    """Per statutory book: file names (cut to ``width`` characters where given), and last page, date and description, or the number of files."""
    books = documents.filter(F.col("item_id").isin("D.1", "B.4", "D.3", "G.1"))
    item = F.col("item_id")
    preferred = (
        F.when(item == "B.4", F.when(F.contains(F.lower("name"), F.lit("mastrini")), 0).otherwise(1))
        .when(item == "D.1", F.when(F.contains(F.lower("rel_path"), F.lit("libri fiscali")), 0).otherwise(1))
        .otherwise(0)
    )
    by_name = F.when(item.isin("B.4", "D.1"), F.col("name")).otherwise("")
    first = _first_document(books, F.struct(preferred.alias("a"), by_name.alias("b"), F.col("load_order").alias("c")))
    # Every name adds at least three characters, so a third of the width is all that can be shown.
    order = F.struct(preferred.alias("a"), by_name.alias("b"), F.col("load_order").alias("c"))
    names = books.groupBy(ENGAGEMENT, "item_id", "name").agg(F.min(order).alias("o"))
    top = _ranked(names, [ENGAGEMENT, "item_id"], [F.col("o")], None if width is None else width // 3 + 1, "rank_no")
    listed = top.groupBy(ENGAGEMENT, "item_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank_no", "name"))), lambda x: x["name"]), ", ").alias("names")
    )
    page_text = T.last_print_page(F.coalesce("text", F.lit("")))
    read = item.isin("B.4", "D.1")
    rows = first.join(listed, [ENGAGEMENT, "item_id"])
    page = F.coalesce(T.ledger_page(page_text), _page_in(F.col("name"), page_text))
    note = F.when(read, "ultima pagina (chiusura stampa)").otherwise(F.concat("files", F.lit(" file in cartella")))
    return rows.select(
        ENGAGEMENT, "item_id", (F.col("names") if width is None else F.left("names", F.lit(width))).alias("names"),
        F.when(read, T.read_date(T.ledger_date(page_text))).alias("last_date"),
        F.when(read, page).alias("last_page"),
        F.when(read, F.nullif(T.ledger_description(page_text), F.lit(""))).alias("description"),
        note.alias("note"),
    )


def minutes_register(documents: DataFrame) -> DataFrame:
    """Per kind of minutes the first file with its meeting date and page; the audit board falls back
    to assembly minutes that name it."""
    kinds = documents.filter(F.col("item_id").isin("C.1", "C.2", "C.4"))
    board = documents.filter(F.col("item_id") == "C.3")
    named = documents.filter((F.col("item_id") == "C.1") & F.contains(F.lower("name"), F.lit("collegio")))
    spare = named.join(board.select(ENGAGEMENT).distinct(), ENGAGEMENT, "left_anti").withColumn("item_id", F.lit("C.3"))
    first = _first_document(kinds.unionByName(board).unionByName(spare), F.struct("load_order"))
    text = F.coalesce("text", F.lit(""))
    read = F.col("item_id") != "C.3"
    return first.select(
        ENGAGEMENT, "item_id", "name",
        F.when(read, T.read_date(minutes_date(F.col("name"), text))).alias("meeting_date"),
        F.when(read, _page_in(F.col("name"), text)).alias("page"),
    )


def provenance(rows: DataFrame, fields: dict[str, str], keys: list[str], excerpt_width: int | None = None) -> DataFrame:
    """One lineage row per filled output value.

    ``fields`` maps value columns to checklist items; ``rows`` carries source_path, source_name,
    method, confidence, excerpt (cut to ``excerpt_width`` where given) and human.
    """
    excerpt = F.col("excerpt") if excerpt_width is None else F.left("excerpt", F.lit(excerpt_width))
    values = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.lit(item).alias("item_id"), F.col(name).cast("string").alias("value"))
            for name, item in fields.items()
        ]
    )
    lineage = ["source_path", "source_name", "method", "confidence", "excerpt", "human"]
    long = rows.select(*keys, *lineage, F.explode(values).alias("v")).filter("v.value IS NOT NULL")
    return long.select(
        *keys, "v.field", "v.item_id", "v.value", "source_path", "source_name", "method", "confidence",
        excerpt.alias("excerpt"), "human",
    )
