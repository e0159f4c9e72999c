"""Delimited journals and trial balances: cells, header names and column detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallywright.constants import HEADER_CANDIDATES, TRIAL_BALANCE_ALIASES
from tallywright.functions.ordered import BUCKET_ROWS, first_n, neighbours, number_bucket
from tallywright.functions.parsing import amount_text, strip, text_or_null
from tallywright.functions.tables import broadcast_if_small

SEPARATORS = ";|\t,"
#: A record of more lines is taken for an unclosed quote and stops the job instead of filling a task.
RECORD_LINES = 10_000
#: Parts in which the records of a file meet a row about the file.
SLICES = 256
INSIDE = '(?:[^"]++|"")*+'


def _field(sep: str) -> str:
    """A whole cell: quoted (with whatever follows the closing quote), plain, or empty."""
    mark = f"\\Q{sep}\\E"
    return f'(?:"{INSIDE}"[^{mark}]*+|[^"{mark}][^{mark}]*+|)'


def _quote_lines(lines: DataFrame, sep: str) -> DataFrame:
    """Lines with a quote, with what they make of the state they are read in: does the next line begin inside quotes?"""
    mark, field = f"\\Q{sep}\\E", _field(sep)
    from_outside = F.rlike("value", F.lit(f'^(?:{field}{mark})*+"{INSIDE}$'))
    from_inside = F.rlike("value", F.lit(f'^{INSIDE}$|^{INSIDE}"[^{mark}]*+{mark}(?:{field}{mark})*+"{INSIDE}$'))
    quoted = lines.filter(F.contains("value", F.lit('"')))
    return quoted.select("source_id", "line_number", from_outside.alias("_out"), from_inside.alias("_in"))


def quoted_spans(lines: DataFrame, sep: str = ";", width: int = BUCKET_ROWS) -> DataFrame:
    """(source_id, start, stop) of every record of several lines: a quoted cell holds their line breaks.

    Each line with a quote maps the state before it (outside or inside quotes) to the state after it: to a fixed one,
    to the same or to the other. The state before a line is the last fixed one, turned by the changes since. It is
    found inside buckets of lines, and across buckets from one row each, so a file is never one task. A quote that is
    never closed runs to the end of its file; ``stop`` is NULL there.
    """
    fixed = F.when(F.col("_out") == F.col("_in"), F.col("_out").cast("int"))
    turns = (F.col("_out") & ~F.col("_in")).cast("int")
    rows = _quote_lines(lines, sep).withColumns({"_b": number_bucket("line_number", width), "_fixed": fixed, "_turns": turns})
    inside = W.partitionBy("source_id", "_b").orderBy("line_number")
    through, before = inside.rowsBetween(W.unboundedPreceding, W.currentRow), inside.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_sum", F.sum("_turns").over(through))
    known = F.when(F.col("_fixed").isNotNull(), F.pmod(F.col("_fixed") + F.col("_sum"), F.lit(2)))  # the state is this, turned by the sum so far
    rows = rows.withColumn("_known", known)
    rows = rows.withColumns({"_base": F.last("_known", True).over(before), "_so_far": F.coalesce(F.sum("_turns").over(before), F.lit(0)),
                             "_final": F.lead("line_number").over(inside).isNull()})
    ends = rows.filter("_final").select("source_id", "_b", F.coalesce("_known", "_base").alias("_last"), "_sum")
    order = W.partitionBy("source_id").orderBy("_b")
    ends = ends.withColumn("_whole", F.sum("_sum").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = ends.withColumn("_fix", F.when(F.col("_last").isNotNull(), F.pmod(F.col("_last") + F.col("_sum") + F.col("_whole"), F.lit(2))))
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    carried = F.pmod(F.coalesce(F.last("_fix", True).over(earlier), F.lit(0)) + F.coalesce(F.sum("_sum").over(earlier), F.lit(0)), F.lit(2))
    state = ends.select("source_id", "_b", carried.alias("_carried"))
    rows = rows.join(state, ["source_id", "_b"])
    came = F.pmod(F.coalesce("_base", "_carried") + F.col("_so_far"), F.lit(2)) == 1
    rows = rows.withColumn("_came", came).withColumn("_leaves", F.when(F.col("_came"), F.col("_in")).otherwise(F.col("_out")))
    borders = rows.filter(F.col("_came") != F.col("_leaves")).select("source_id", "_b", "line_number", F.col("_leaves").alias("opens"))
    closed = neighbours(borders, ["source_id"], ["_b"], ["line_number"], ["opens"], F.col("opens")).select(
        "source_id", F.col("line_number").alias("start"), F.col("next_line_number").alias("stop"))
    open_ends = borders.groupBy("source_id").agg(F.max(F.when(F.col("opens"), F.col("line_number"))).alias("start"), F.max("line_number").alias("_last"))
    unclosed = open_ends.filter(F.col("start") == F.col("_last")).select("source_id", "start", F.lit(None).cast("bigint").alias("stop"))
    return closed.unionByName(unclosed)


def delimited_records(lines: DataFrame, sep: str = ";", width: int = BUCKET_ROWS, most_lines: int = RECORD_LINES) -> DataFrame:
    """(source_id, line_number, value) of every record: a line, or the lines that a quoted cell joins, with their line breaks.

    ``line_number`` is that of the record's first line. Only the lines of such records are moved. A record of more
    than ``most_lines`` lines, such as the rest of a long file after a quote that nobody closed, stops the job with a message.
    """
    spans = quoted_spans(lines, sep, width)
    ends = lines.join(broadcast_if_small(spans.filter("stop IS NULL").select("source_id")), "source_id", "left_semi").groupBy("source_id").agg(F.max("line_number").alias("_end"))
    stop = F.coalesce("stop", "_end")
    message = F.concat(F.lit("quote of line "), "start", F.lit(" of "), F.col("source_id").cast("string"), F.lit(f" is not closed within {most_lines} lines"))
    held = F.when(stop - F.col("start") < most_lines, F.sequence("start", stop)).otherwise(F.raise_error(message).cast("array<bigint>"))
    members = spans.join(ends, "source_id", "left").select("source_id", "start", F.explode(held).alias("line_number"))
    single = lines.select("source_id", "line_number", "value").join(members, ["source_id", "line_number"], "left_anti")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "value"))), lambda x: x["value"]), "\n")
    several = lines.join(members, ["source_id", "line_number"]).groupBy("source_id", "start").agg(joined.alias("value"))
    return single.unionByName(several.withColumnRenamed("start", "line_number"))


def delimited_cells(records: DataFrame, width: int, sep: str = ";") -> DataFrame:
    """Cells of every record as an array of at least ``width``, without a byte-order mark; an empty cell is NULL.

    Cells beyond ``width`` follow, so a ragged line shows more cells than its header. A quote opens a quoted cell only
    at the cell's begin; two in it are one; what follows the closing quote belongs to the cell.
    """
    clean = F.concat(F.lit(sep), F.regexp_replace("value", "^\uFEFF", ""))
    mark = f"\\Q{sep}\\E"
    found = F.regexp_extract_all(clean, F.lit(f'{mark}("{INSIDE}"[^{mark}]*+|"{INSIDE}$|[^"{mark}][^{mark}]*+|)'), F.lit(1))

    def plain(cell: Column) -> Column:
        body = F.regexp_extract(cell, f'(?s)^"({INSIDE})"?(.*)$', 1)
        rest = F.regexp_extract(cell, f'(?s)^"({INSIDE})"?(.*)$', 2)
        return F.nullif(F.when(F.startswith(cell, F.lit('"')), F.concat(F.replace(body, F.lit('""'), F.lit('"')), rest)).otherwise(cell), F.lit(""))

    filled = F.concat(F.transform(found, plain), F.array_repeat(F.lit(None).cast("string"), F.greatest(F.lit(width) - F.size(found), F.lit(0))))
    return records.select("source_id", "line_number", filled.alias("cells"))


def _after_rows(lines: DataFrame, rows: int, sep: str) -> DataFrame:
    """Records after the first ``rows`` of each source.

    Only the first ``rows`` records of several lines can lie among the first ``rows`` records, so the others aren't looked at to find these.
    Records meet their source's bound in ``SLICES`` parts, so that a file is never one task.
    """
    records = delimited_records(lines, sep)
    if rows == 0:
        return records
    early = first_n(quoted_spans(lines, sep), ["source_id"], [F.col("start")], rows).select(F.col("source_id").alias("_source"), "start", "stop")
    later = (F.col("line_number") > F.col("start")) & (F.col("stop").isNull() | (F.col("line_number") <= F.col("stop")))
    begins = lines.select("source_id", "line_number").join(early, (F.col("source_id") == F.col("_source")) & later, "left_anti")
    top = first_n(begins, ["source_id"], [F.col("line_number")], rows)
    bound = top.groupBy("source_id").agg(F.max("line_number").alias("_bound"))
    spread = bound.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)).cast("array<bigint>")))
    sliced = records.withColumn("_slice", F.pmod("line_number", F.lit(SLICES)).cast("bigint")).join(spread, ["source_id", "_slice"])
    return sliced.filter(F.col("line_number") > F.col("_bound")).drop("_bound", "_slice")


def delimited_journal_scan(
    lines: DataFrame, width: int, header_row: int = 0, skip_rows: int = 0, sep: str = ";"
) -> DataFrame:
    """Records after the header row and the rows to skip; rows without any filled cell are dropped."""
    body = _after_rows(lines, header_row + 1 + skip_rows, sep)
    filled = F.exists("cells", lambda cell: strip(F.coalesce(cell, F.lit(""))) != "")
    return delimited_cells(body, width, sep).filter(filled)


def header_cells(lines: DataFrame, width: int, header_row: int = 0, sep: str = ";") -> DataFrame:
    """One row per header cell: (source_id, position, header), positions from 1."""
    top = first_n(delimited_records(lines, sep), ["source_id"], [F.col("line_number")], header_row + 1)
    found = delimited_cells(top.filter(F.col("rank_no") == header_row + 1), width, sep)
    return found.select("source_id", F.posexplode("cells").alias("_p", "header")).select(
        "source_id", (F.col("_p") + 1).alias("position"), "header"
    )


def separators(lines: DataFrame, rows: int = 20, choices: str = SEPARATORS) -> DataFrame:
    """(source_id, separator): the one that cuts the first non-blank lines into the same number of cells, more than one.

    Of several such the one of most cells wins, then the first of ``choices``; a file in which none does so has a comma.
    """
    top = first_n(lines.filter(strip(F.col("value")) != ""), ["source_id"], [F.col("line_number")], rows)
    counts = []
    for place, sep in enumerate(choices):
        mark = f"\\Q{sep}\\E"
        cells = F.regexp_count(F.concat(F.lit(sep), "value"), F.lit(f'{mark}(?:"{INSIDE}"[^{mark}]*+|"{INSIDE}$|[^"{mark}][^{mark}]*+|)'))
        counts.append(F.struct(F.lit(sep).alias("separator"), F.lit(place).alias("place"), cells.alias("cells")))
    each = top.select("source_id", F.explode(F.array(*counts)).alias("c")).groupBy("source_id", "c.separator", "c.place").agg(
        F.min("c.cells").alias("least"), F.max("c.cells").alias("most"))
    fit = F.when((F.col("least") == F.col("most")) & (F.col("least") > 1), F.col("least"))
    best = each.groupBy("source_id").agg(F.min_by("separator", F.when(fit.isNotNull(), F.struct(-fit, F.col("place")))).alias("separator"))
    return best.select("source_id", F.coalesce("separator", F.lit(",")).alias("separator"))


def header_autodetect(headers: DataFrame, candidates: dict[str, list[str]] | None = None) -> DataFrame:
    """Column of each logical field: the first candidate that contains or is contained in a header.

    An empty header is contained in every candidate, so it matches the first one.
    """
    wanted = HEADER_CANDIDATES if candidates is None else candidates
    header = F.lower(strip(F.coalesce("header", F.lit(""))))
    ranks = []
    for field, names in wanted.items():
        rank = None
        for order, name in enumerate(names):
            text = F.lit(name.lower().strip())
            fits = F.contains(header, text) | F.contains(text, header)
            rank = F.when(fits, order) if rank is None else rank.when(fits, order)
        ranks.append(F.struct(F.lit(field).alias("field"), rank.cast("int").alias("candidate")))
    matches = headers.select("source_id", "position", F.explode(F.array(*ranks)).alias("m")).filter("m.candidate IS NOT NULL")
    best = F.min(F.struct("m.candidate", "position"))
    return matches.groupBy("source_id", F.col("m.field").alias("field")).agg(best["position"].alias("position"))


def unique_headers(headers: DataFrame) -> DataFrame:
    """Repeated names get `` [2]``, `` [3]``; a blank header n becomes ``Colonna n``."""
    base = F.coalesce(text_or_null(F.col("header")), F.concat(F.lit("Colonna "), F.col("position")))
    named = headers.withColumn("_base", base)
    repeat = F.row_number().over(W.partitionBy("source_id", "_base").orderBy("position"))
    unique = F.when(repeat == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(" ["), repeat, F.lit("]")))
    return named.withColumn("unique_header", unique).drop("_base")


def read_trial_balance(lines: DataFrame, width: int = 64) -> DataFrame:
    """Trial balances of all files among ``lines`` (as ``read_lines`` gives them), each with its own separator and header row.

    Header names are matched by alias in each file; rows follow as in ``trial_balance_scan``, with their ``source_id``.
    """
    kinds = separators(lines)
    parts = []
    for sep in SEPARATORS:
        own = lines.join(broadcast_if_small(kinds.filter(F.col("separator") == sep).select("source_id")), "source_id", "left_semi")
        names = F.lower(strip(F.coalesce("header", F.lit(""))))
        known = {f: F.array_position(F.array(*[F.lit(a) for a in aliases]), names) for f, aliases in TRIAL_BALANCE_ALIASES.items()}
        heads = header_cells(own, width, 0, sep).select("source_id", "position", *[c.alias(f) for f, c in known.items()])
        places = heads.groupBy("source_id").agg(*[
            F.sort_array(F.collect_list(F.when(F.col(f) > 0, F.struct(F.col(f).alias("a"), -F.col("position"))))).alias(f) for f in known])
        cells = delimited_cells(_after_rows(own, 1, sep), width, sep).join(broadcast_if_small(places), "source_id")
        cell = {f: F.filter(F.transform(f, lambda x: F.element_at("cells", (-x["col2"]).cast("int"))), lambda c: c.isNotNull()) for f in known}
        parts.append(cells.select("source_id", *[F.get(c, F.lit(0)).alias(f) for f, c in cell.items()]))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return _balance_rows(rows, "source_id")


def _balance_rows(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *keys, strip(F.col("account")).alias("account"), strip(F.coalesce("name", F.lit(""))).alias("name"),
        amount_text(F.col("amount")).alias("amount"), amount_text(F.col("prior")).alias("prior"),
    ).filter(F.col("account").isNotNull())


def trial_balance_scan(raw: DataFrame) -> DataFrame:
    """Account, name, amount and prior amount by header alias; rows without account are dropped."""
    by_name = {name.lower().strip(): name for name in raw.columns}

    def pick(field: str):
        known = [F.col(f"`{by_name[a]}`").cast("string") for a in TRIAL_BALANCE_ALIASES[field] if a in by_name]
        filled = [F.when(c != "", c) for c in known]
        return F.coalesce(*filled) if filled else F.lit(None).cast("string")

    return _balance_rows(raw.select(*[pick(f).alias(f) for f in ("account", "name", "amount", "prior")]))
