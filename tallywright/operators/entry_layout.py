"""Entries with their totals and lines with their entry's header: two tables that all entry tests read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window as W, functions as F

from tallywright.functions.tables import StoredTable
from tallywright.operators.entries import ENTRY_KEY, _derived_totals, entry_totals

HEADER = ["registration_date", "load_order", "amount"]


class EntryJournal:
    """The journal as entry tests read it; each table is made when it is first asked for, so a test pays only for those it reads.

    ``rows``: the lines as they were given. ``entries``: one row per entry with totals. ``lines``: one row per line with ``position``,
    ``first_line`` and the entry's date, load order and amount, so that tests of accounts need no join with entries. Lines without an
    entry keep NULL there. ``first_lines``: the lines that are the first of their entry, made without moving the others.
    """

    def __init__(self, entries: DataFrame, lines: DataFrame, stage: bool = False, sources: tuple[StoredTable, ...] = ()):
        self.headers, self._given, self._stage = entries, lines, stage
        self.tables: list[StoredTable] = []
        self._sources = sources

    def _made(self, df: DataFrame, name: str) -> DataFrame:
        if not self._stage:
            return df
        self.tables.append(StoredTable(df, name))
        return self.tables[-1].read()

    @cached_property
    def rows(self) -> DataFrame:
        return self._given if self._sources else self._made(self._given, "journal-rows")

    @cached_property
    def _totalled(self) -> DataFrame:
        return self._made(_with_heads(self.headers, self.rows), "journal-entries")

    @cached_property
    def entries(self) -> DataFrame:
        return self._totalled.drop("_first")

    @cached_property
    def lines(self) -> DataFrame:
        return self._made(_with_header(self.rows, self._totalled), "journal-lines")

    @cached_property
    def first_lines(self) -> DataFrame:
        return self._made(_first_lines(self.rows, self._totalled), "journal-first-lines")

    def release(self) -> None:
        """Remove the tables of a staged journal; results that still read them must have been taken before."""
        for table in [*self.tables, *self._sources]:
            table.release()


def _with_heads(entries: DataFrame, lines: DataFrame) -> DataFrame:
    heads = lines.groupBy(*ENTRY_KEY).agg(
        F.sum("debit").alias("total_debit"), F.sum("credit").alias("total_credit"), F.count(F.lit(1)).alias("line_count"),
        F.min("position").alias("_first"),
    )
    zero = F.lit(0)
    kind = {c: heads.schema[c].dataType for c in ("total_debit", "total_credit")}
    joined = entries.join(heads, ENTRY_KEY, "left")
    return _derived_totals(joined.withColumns(
        {c: F.coalesce(c, zero.cast(t)) for c, t in kind.items()} | {"line_count": F.coalesce("line_count", zero)}))


def _with_header(lines: DataFrame, totalled: DataFrame) -> DataFrame:
    header = totalled.select(*ENTRY_KEY, *HEADER, "_first")
    return lines.join(header, ENTRY_KEY, "left").withColumn("first_line", F.col("position") == F.col("_first")).drop("_first")


def _first_lines(lines: DataFrame, totalled: DataFrame) -> DataFrame:
    """The rows of ``_with_header`` whose ``first_line`` is true. Every map task keeps only the first lines it sees of an entry."""
    place = F.rank().over(W.partitionBy(*ENTRY_KEY).orderBy("position"))
    first = lines.filter("position IS NOT NULL").withColumn("_place", place).filter("_place = 1").drop("_place")
    return first.join(totalled.select(*ENTRY_KEY, *HEADER), ENTRY_KEY).withColumn("first_line", F.lit(True))


def totals_of_lines(journal: EntryJournal) -> DataFrame:
    """Totals per entry that has lines, as those of laid-out lines, which an entry given several times has as often."""
    totals = entry_totals(journal.rows).select(*ENTRY_KEY, "total_debit", "total_credit", "line_count")
    several = journal.headers.groupBy(*ENTRY_KEY).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    joined = totals.join(several, ENTRY_KEY, "left")
    times = F.coalesce("_times", F.lit(1))
    sums = {c: (F.col(c) * times).cast(totals.schema[c].dataType) for c in ("total_debit", "total_credit", "line_count")}
    return _derived_totals(joined.withColumns(sums).drop("_times"))


def lay_out(entries: DataFrame, lines: DataFrame) -> EntryJournal:
    """The journal as entry tests read it, as plans over ``entries`` and ``lines``.

    ``lines`` need ``position``, unique within an entry: the first line of an entry is the one of lowest position.
    """
    return EntryJournal(entries, lines)


def stage_journal(entries: DataFrame, lines: DataFrame, sources: tuple[StoredTable, ...] = ()) -> EntryJournal:
    """The journal for a run of many tests: each of its tables is written to the shared folder when a test first reads it.

    Each test then scans the columns it needs of one or two tables. The joins that make them are plain ones on
    (engagement, entry), so that adaptive execution can split an entry with very many lines; for the same reason the
    tables are not bucketed by entry: with the header on every line hardly a test joins them again.

    ``sources`` are stored tables that ``lines`` only scan: then the lines aren't written again, and ``release`` removes the sources too.
    """
    return EntryJournal(entries, lines, True, sources)


def entries_of_sheets(assembled: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and lines of assembled sheets under the keys of entry tests.

    ``sources``: source_id, engagement_id, source_order (whole number, rising in the order in which files were loaded). An
    entry is named by its source and the position of its first line; ``load_order`` follows source_order and position
    (positions under 10**12). Lines without an account belong to no entry, as in the sheet's own totals.
    """
    keyed = assembled.join(sources.select("source_id", "engagement_id", "source_order"), "source_id")
    start = F.col("entry_start").cast("bigint")
    keyed = keyed.withColumns({
        "entry_id": F.concat_ws(":", F.col("source_id").cast("string"), start.cast("string")),
        "load_order": F.col("source_order").cast("bigint") * F.lit(10**12) + start,
    })
    entries = keyed.filter(F.col("position") == F.col("entry_start")).select(
        *ENTRY_KEY, "entry_number", "registration_date", "description", "load_order")
    lines = keyed.filter(F.trim(F.coalesce("account", F.lit(""))) != "").select(
        *ENTRY_KEY, "entry_number", "position", "account", "debit", "credit")
    return entries, lines
