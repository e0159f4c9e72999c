from __future__ import annotations

import hashlib

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywright.functions.ordered import neighbours, number_rows
from tallywright.functions.tables import constant_table
from tallywright.operators import anomalies as A, entries as E, reporting as P, sampling as S
from tallywright.operators.entry_layout import entries_of_sheets, lay_out, stage_journal, totals_of_lines
from tallywright.plans import entry_queries as Q

SF = "/root/testdata/sf0.001"


def entries(spark, *rows):
    full = [("E", str(n), n, d, text, order) for order, (n, d, text) in enumerate(rows)]
    return constant_table(spark, "engagement_id string, entry_id string, entry_number bigint, registration_date date, description string, load_order bigint", full)


def lines(spark, *rows):
    full = [("E", str(n), n, place, a, Decimal(d), Decimal(c)) for place, (n, a, d, c) in enumerate(rows)]
    return constant_table(spark, "engagement_id string, entry_id string, entry_number bigint, position int, account string, debit decimal(18,2), credit decimal(18,2)", full)


MONDAY = date(2026, 1, 5)


def test_validations(spark):
    e = entries(spark, (1, MONDAY, "ok"), (2, MONDAY, " "), (3, date(2026, 1, 4), "x"), (9, date(2026, 1, 10), "y"))
    ln = lines(spark, (1, "A", 10, 0), (1, "B", 0, 10), (2, "A", 5, 0), (2, "Z", 0, 4), (3, "A", 1, 1))
    v = {r.entry_number: (r.checks_failed, r.is_valid, r.checks_passed) for r in E.validate_entries(E.with_totals(e, ln), ln, constant_table(spark, "account string", [("A",), ("B",)])).collect()}
    assert v[1][:2] == ([], True) and v[2][0] == ["bilanciamento", "codici_conto", "completezza"] and v[9][0] == ["completezza"]
    assert "sequenza_date" not in v[3][2] and "sequenza_date" in v[1][2]
    assert [r.entry_number for r in E.date_regression(e).collect()] == [3]
    gap = E.entry_number_gaps(e, listed=10).first()
    assert "missing_numbers" not in E.entry_number_gaps(e).first().details
    assert gap.entry_number == 9 and gap.details["missing_numbers"] == "4,5,6,7,8"
    assert {r.entry_number: r.details["day_name"] for r in E.weekend_entries(e).collect()} == {3: "Domenica", 9: "Sabato"}
    assert E.unknown_accounts(ln, None).count() == 0


def test_duplicates_name_the_first_entry(spark):
    e = entries(spark, *[(n, MONDAY, "x") for n in (7, 3, 5)], (4, date(2026, 1, 6), "x"))
    ln = lines(spark, *[(n, "A", 10, 0) for n in (7, 3, 5, 4)])
    assert {(r.entry_number, r.details["original_number"]) for r in E.duplicate_entries(lay_out(e, ln).lines).collect()} == {(3, "7"), (5, "7")}


def test_first_account_is_that_of_the_first_line(spark):
    """The smallest account of both entries is A, but only 1 and 3 begin with the same one."""
    e = entries(spark, *[(n, MONDAY, "x") for n in (1, 2, 3)])
    ln = lines(spark, (1, "Z", 10, 0), (1, "A", 0, 10), (2, "A", 10, 0), (2, "Z", 0, 10), (3, "Z", 0, 10), (3, "A", 10, 0))
    found = E.duplicate_entries(lay_out(e, ln).lines).collect()
    assert [(r.entry_number, r.details["signature"]) for r in found] == [(3, "2026-01-05|Z|10.00")]


def test_reversals_follow_line_order(spark):
    """Within one entry the lines stand as credit, debit, debit: only the first two are neighbours on opposite sides."""
    e = entries(spark, (1, MONDAY, "x"))
    ln = lines(spark, (1, "A", 0, 10), (1, "A", 10, 0), (1, "A", 10, 0))
    assert A.quick_reversals(lay_out(e, ln).lines).count() == 1
    ln = lines(spark, (1, "A", 10, 0), (1, "A", 0, 10), (1, "A", 10, 0))
    assert A.quick_reversals(lay_out(e, ln).lines).count() == 2


def test_lay_out_keeps_entries_without_lines_and_lines_without_entry(spark):
    journal = stage_journal(entries(spark, (1, MONDAY, "x"), (2, MONDAY, "y")), lines(spark, (1, "B", 5, 0), (1, "A", 0, 5), (9, "C", 1, 0)))
    assert {r.entry_number: (r.line_count, str(r.amount), r.balanced) for r in journal.entries.collect()} == {1: (2, "5.00", True), 2: (0, "0.00", True)}
    assert {(r.entry_number, r.account): (r.load_order, r.first_line) for r in journal.lines.collect()} == {(1, "B"): (0, True), (1, "A"): (0, False), (9, "C"): (None, None)}
    journal.release()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(journal.tables[1].path).count()


def test_sheets_become_entries_and_lines(spark):
    """From lines of two files to findings, with the files' own order of entries and lines."""
    rows = [("f2", 1, 7, "B", "2026-01-05", "x", 10, 0), ("f2", 2, None, "A", "2026-01-05", "", 0, 10), ("f2", 3, 8, "B", "2026-01-02", "y", 10, 0),
            ("f2", 4, None, "A", "2026-01-02", "", 0, 9), ("f1", 1, 7, "B", "2026-01-05", "z", 0, 10), ("f1", 2, 7, " ", "2026-01-05", "z", 3, 0)]
    cells = spark.createDataFrame(rows, "source_id string, position bigint, entry_number bigint, account string, d string, description string, debit int, credit int")
    cells = cells.select("source_id", "position", "entry_number", "account", F.col("d").cast("date").alias("registration_date"), "description",
                         F.col("debit").cast("decimal(18,2)").alias("debit"), F.col("credit").cast("decimal(18,2)").alias("credit"))
    sources = spark.createDataFrame([("f1", "E", 2), ("f2", "E", 1)], "source_id string, engagement_id string, source_order int")
    journal = lay_out(*entries_of_sheets(E.assemble_entries(cells), sources))
    got = [(r.entry_id, r.entry_number, r.line_count) for r in journal.entries.orderBy("load_order").collect()]
    assert got == [("f2:1", 7, 2), ("f2:3", 8, 2), ("f1:1", 7, 1)]
    found = A.all_anomalies(journal, journal.entries)
    kinds = sorted((r.anomaly_type, r.entry_id) for r in found.collect())
    assert kinds == [("duplicate", "f1:1"), ("other", "f1:1"), ("unbalanced", "f1:1"), ("unbalanced", "f2:3")]
    assert [(r.entry_id) for r in E.date_regression(journal.entries).collect()] == ["f2:3"]


def test_busy_accounts_give_the_same_reversals(spark):
    movements = Q.cut_movements(spark, SF)
    plain = sorted(r.description for r in A.quick_reversals(movements).collect())
    split = sorted(r.description for r in A.quick_reversals(movements, busy_rows=5).collect())
    assert plain and plain == split


def test_reversal_needs_three_movements(spark):
    """Totals come from the lines at hand now, so the third movement is an entry of its own: as a second line of entry 2 it would change that entry's amount."""
    e = entries(spark, (1, MONDAY, "x"), (2, MONDAY, "x"), (3, MONDAY, "x"))
    two = lines(spark, (1, "A", 10, 0), (2, "A", 0, 10))
    three = lines(spark, (1, "A", 10, 0), (2, "A", 0, 10), (3, "A", 7, 0))
    assert A.quick_reversals(lay_out(e, two).lines).count() == 0
    assert [r.entry_number for r in A.quick_reversals(lay_out(e, three).lines).collect()] == [2]
    doubled = lines(spark, (1, "A", 10, 0), (2, "A", 0, 10), (2, "A", 0, 10))  # amounts 10 and 20
    assert A.quick_reversals(lay_out(e, doubled).lines).count() == 0


def test_sample_is_repeatable_and_disjoint(spark):
    totalled = Q.totalled(spark, SF).cache()
    draw = lambda df, n, seed: sorted(r.entry_id for r in S.sample_random(df, n, seed).collect())
    assert draw(totalled, 30, 1) == draw(totalled.repartition(11), 30, 1) != draw(totalled, 30, 2)
    per = {r.engagement_id: r["count"] for r in S.sample_random(totalled, 1200, 1).groupBy("engagement_id").count().collect()}
    total = {r.engagement_id: r["count"] for r in totalled.groupBy("engagement_id").count().collect()}
    assert per == {k: min(1200, n) for k, n in total.items()}
    sample = S.combined_sample(totalled, Q.staged(spark, SF).lines, Decimal(300000), ["a7"], random_count=5)
    assert sample.count() == sample.select("entry_id").distinct().count()
    assert sample.filter("sample_reason = 'random'").groupBy("engagement_id").count().select(F.max("count")).first()[0] == 5
    totalled.unpersist()


@pytest.mark.parametrize("n", [0, 1, 40, 999, 1000, 1001, 5000])
def test_samples_of_any_size_are_the_first_by_digest(spark, n):
    rows = spark.range(3000).select(F.concat(F.lit("E"), F.col("id") % 2).alias("engagement_id"), F.col("id").cast("string").alias("entry_id"))
    got = sorted((r.engagement_id, r.entry_id) for r in S.sample_random(rows, n, 7).collect())
    order = lambda e: hashlib.md5(f"7:{e}".encode()).hexdigest()
    want = [(f"E{k}", e) for k in (0, 1) for e in sorted((str(i) for i in range(k, 3000, 2)), key=order)[:n]]
    assert got == sorted(want)


def test_first_digits_need_fifty_amounts(spark):
    def digits(n):
        e = entries(spark, *[(i, MONDAY, "x") for i in range(n)])
        return E.with_totals(e, lines(spark, *[(i, "A", 100 + i, 0) for i in range(n)]))

    assert A.benford_first_digit(digits(49)).count() == 0
    row = A.benford_first_digit(digits(60)).first()
    assert "cifra '1' devia del 69.9%" in row.description and row.severity == "warning"


def test_status(spark):
    rows = [("A", 0, 0, 0, 0), ("B", 5, 1, 1, 0), ("C", 5, 0, 0, 2), ("D", 5, 0, 0, 0)]
    counts = constant_table(spark, "engagement_id string, entries_validated bigint, entries_with_issues bigint, critical_anomalies bigint, warning_anomalies bigint", rows)
    assert {r.engagement_id: r.status for r in P.run_status(counts).collect()} == {"A": "wip", "B": "wip", "C": "✓", "D": "✓"}


def test_neighbours_and_numbers_do_not_depend_on_bucket_width(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 1000).alias("n"), (F.col("id") % 3).alias("v"))
    own = {k: sorted((r.n, r.v) for r in rows.collect() if r.k == k) for k in (0, 1)}
    pairs = [(k, *x, *y) for k, v in own.items() for x, y in zip(v, v[1:])]
    for width in (3, 50, 10_000):
        levelled = rows.withColumns({"far": F.col("n") - F.col("n") % (width * 10), "near": F.col("n") - F.col("n") % width})
        for hit, want in ((None, pairs), (F.col("v") != F.col("next_v"), [p for p in pairs if p[2] != p[4]]),
                          (F.col("next_n") - F.col("n") > 2, [p for p in pairs if p[3] - p[1] > 2]), (F.lit(None).cast("boolean"), [])):
            found = neighbours(levelled, ["k"], ["far", "near"], ["n"], ["v"], hit).select("k", "n", "v", "next_n", "next_v")
            assert sorted(map(tuple, found.collect())) == want
        numbered = number_rows(levelled, ["k"], ["near"], ["n"], "place")
        assert [r.n for r in numbered.orderBy("k", "place").collect()] == [n for k in (0, 1) for n, _ in own[k]]


def test_missing_and_present_numbers_fill_the_range(spark):
    from tallywright.operators.numbering import sequence_missing
    from tallywright.plans.views import journal

    rows = journal(spark, SF).filter("engagement_id = 'E1' AND length(document_number) < 9")
    missing = {int(r.expected_number) for r in sequence_missing(rows).collect()}
    present = {int(r.document_number) for r in rows.filter("document_number RLIKE '^[0-9]+$'").collect()}
    assert not missing & present and missing | present == set(range(min(present), max(present) + 1))


def test_staged_tables_are_made_when_first_read(spark):
    """A test that reads only entries pays for no laid-out lines; each table is written once."""
    journal = stage_journal(entries(spark, (1, MONDAY, "x")), lines(spark, (1, "A", 5, 0)))
    assert journal.tables == []
    assert E.unbalanced_entries(journal.entries).count() == 1
    assert [t.name for t in journal.tables] == ["journal-rows", "journal-entries"]
    assert journal.lines.count() == journal.lines.count() == 1 and len(journal.tables) == 3
    journal.release()


def test_first_lines_and_totals_are_those_of_laid_out_lines(spark):
    """Repeated entries, repeated first lines, lines without position, entry or key count as in laid-out lines."""
    e = entries(spark, (1, MONDAY, "x"), (2, MONDAY, "y"), (3, MONDAY, "z")).unionByName(entries(spark, (1, MONDAY, "x")))
    ln = constant_table(spark, "engagement_id string, entry_id string, entry_number bigint, position int, account string, debit decimal(18,2), credit decimal(18,2)", [
        ("E", "1", 1, 5, "A", Decimal(7), Decimal(0)), ("E", "1", 1, 5, "B", Decimal(3), Decimal(0)), ("E", "1", 1, 6, "C", Decimal(0), Decimal(2)),
        ("E", "2", 2, None, "D", Decimal(1), Decimal(0)), ("E", "2", 2, 1, "E", Decimal(9), Decimal(0)), ("E", "9", 9, 1, "F", Decimal(4), Decimal(0)),
        (None, None, None, 1, "G", None, Decimal(6))])
    journal = lay_out(e, ln)
    kept = journal.first_lines.columns
    plain = lambda df: sorted(map(repr, df.select(*kept).collect()))
    assert plain(journal.first_lines) == plain(journal.lines.filter("first_line")) and journal.first_lines.count() == 5
    assert totals_of_lines(journal).schema == E.entry_totals(journal.lines).schema
    assert sorted(map(repr, totals_of_lines(journal).collect())) == sorted(map(repr, E.entry_totals(journal.lines).collect()))
    chart = constant_table(spark, "account string", [("E",)])
    named = lambda df: sorted((r.entry_id, r.details["account_code"]) for r in df.filter("anomaly_type = 'missing_account'").collect())
    sampled = journal.entries.filter("entry_number < 3")
    old = E.unknown_accounts(journal.lines.join(sampled.select(*E.ENTRY_KEY), E.ENTRY_KEY, "left_semi"), chart)
    assert named(A.all_anomalies(journal, sampled, chart, False, False)) == named(old) and len(named(old)) == 7
