from __future__ import annotations

import csv
import hashlib
import io
import random
import unicodedata
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywright.functions import parsing as P, text as T
from tallywright.functions.tables import constant_table
from tallywright.operators import entries as E
from tallywright.sources import delimited as D, documents as I, mapping as M, sinks as K, staging as G, text_files as X

HEADER = "ID      DATA      CONTO            IMPORTODESCRIZIONE         UTENTE    |"
POSITIONS = {"entry_id": (0, 8), "effective_date": (8, 18), "account": (18, 28), "net_amount": (28, 42), "description": (42, 62), "user_name": (62, 72)}


def fixed_line(n):
    amount = f"{n * 100},50" if n % 2 else f"-{n * 25},00"
    return f"{n:<8}{n:02d}/01/2026C{n % 3:<9}{amount:>14}{'Caffè e forniture' if n == 1 else f'Registrazione {n}':<20}{'' if n == 4 else 'USER1':<10}|"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_fixed_width_file_end_to_end(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\n".join(["", HEADER, *[fixed_line(n) for n in range(1, 11)], "", "corta"]), encoding="utf-8")
    lines = X.read_lines(spark, str(tmp_path))
    scan = X.fixed_width_scan(lines, HEADER, POSITIONS)
    assert [r.line_number for r in scan.filter("error IS NOT NULL").collect()] == [14]
    assert "Riga 14 troppo corta" in scan.filter("error IS NOT NULL").first().error
    mapped = M.map_journal(scan.filter("error IS NULL"), {f: f for f in POSITIONS})
    rows = M.accepted_rows(mapped, strict=True).orderBy("line_number").collect()
    assert len(rows) == 10 and rows[0].effective_date == date(2026, 1, 1) and rows[0].net_amount == Decimal("100.50")
    assert rows[0].description == "Caffè e forniture" and rows[3].user_name is None and rows[1].net_amount == Decimal("-50.00")
    probe = X.header_probe(lines).first()
    assert probe.header_index == 1 and probe.header == HEADER and len(probe.example_lines) == 5
    assert X.header_mismatches(lines, "other").count() == 1 and X.header_mismatches(lines, HEADER).count() == 0


def test_line_numbers_across_many_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("\n".join(f"{name}{i}" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = X.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 10000 and all(r.value[1:] == str(r.line_number - 1) for r in rows)


def test_encodings(spark):
    rows = [(1, "Caffè".encode()), (2, "Caffè €".encode("cp1252")), (3, b"a\x81b"), (4, b"a\x00b"), (5, b"\x01\x02\x03")]
    got = {r.id: (r.encoding, r.text) for r in X.text_decode(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert got[1] == ("utf-8", "Caffè") and got[2] == ("cp1252", "Caffè €") and got[3][0] == "latin-1"
    assert got[4] == (None, None) and got[5] == (None, None)


def test_mapping_italian_amounts_and_sides(spark):
    rows = [("1", "1/11/2024", "21.142,17", None), ("2", "2024-11-02", " ", "10,50"), ("3", "31/02/2024", "x", None), (None, "1/1/2024", "1.005", None)]
    raw = spark.createDataFrame(rows, "`Riga N.` string, `Data Reg.` string, D string, A string")
    mapped = M.map_journal(raw, {"entry_id": "Riga N.", "effective_date": "Data Reg.", "debit": "D", "credit": "A"}).collect()
    assert mapped[0].net_amount == Decimal("21142.17") and mapped[0].effective_date == date(2024, 11, 1) and mapped[1].net_amount == Decimal("-10.50")
    assert [r.rejected for r in mapped] == [[], [], ["effective_date", "net_amount"], ["entry_id", "net_amount"]]
    with pytest.raises(Exception, match="not importable"):
        M.accepted_rows(M.map_journal(raw, {"entry_id": "Riga N.", "effective_date": "Data Reg.", "debit": "D"}), strict=True).collect()


def test_headers(spark):
    cells = ["N. Reg.", "Data Reg.", "Conto", "Dare", "Dare", None]
    headers = constant_table(spark, "source_id string, position int, header string", [("s", i, c) for i, c in enumerate(cells, 1)])
    assert [r.unique_header for r in D.unique_headers(headers).orderBy("position").collect()] == ["N. Reg.", "Data Reg.", "Conto", "Dare", "Dare [2]", "Colonna 6"]
    found = {r.field: r.position for r in D.header_autodetect(headers.filter("header IS NOT NULL")).collect()}
    assert found["entry_number"] == 1 and found["registration_date"] == 2 and found["account_code"] == 3 and found["debit"] == 4


def test_staging_keeps_first_of_identical_rows(spark):
    rows = [("a", i, date(2026, 1, 1), None, None, str(i % 8), None, Decimal(1), None, None, None) for i in range(16)]
    schema = "source_id string, position bigint, effective_date date, created_date date, created_seconds int, entry_id string, document_number string, net_amount decimal(18,2), description string, user_name string, account string"
    staged = G.stage_rows(constant_table(spark, schema, rows), "position")
    sources = constant_table(spark, "source_id string, engagement_id string, active boolean, state string, created_at int", [("a", "P", True, "pronta", 1)])
    united = G.union_active_sources(staged, sources)
    assert united.count() == 16 and G.drop_identical_rows(united, "mantieni_tutti").count() == 16
    assert sorted(r.row_number for r in G.drop_identical_rows(united).collect()) == list(range(1, 9))


def test_sinks(spark, tmp_path):
    rows = spark.range(6).select(F.concat(F.lit("E"), F.col("id") % 2).alias("engagement_id"), "id")
    K.replace_partition(rows, str(tmp_path / "t"))
    K.replace_partition(rows.filter("id = 1"), str(tmp_path / "t"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 1, 2, 4]
    K.append_only_write(rows, str(tmp_path / "a"))
    with pytest.raises(ValueError):
        K.append_only_write(rows.filter("id = 3"), str(tmp_path / "a"))
    with pytest.raises(ValueError):
        K.append_only_write(rows.filter("id = 3").union(rows.filter("id = 3")), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 6


def test_replacing_by_nothing_leaves_nothing(spark, tmp_path):
    rows = spark.range(6).select(F.concat(F.lit("E"), F.col("id") % 2).alias("engagement_id"), "id")
    K.replace_partition(rows, str(tmp_path / "t"))
    K.replace_partition(rows.filter("id < 0"), str(tmp_path / "t"), replaced=["E1"])
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 2, 4]


@pytest.mark.parametrize("value", ["E:1", None, "", "a/b=c%"])
def test_replacing_any_value_by_nothing(spark, tmp_path, value):
    rows = spark.createDataFrame([(1, value), (2, "other")], "id int, engagement_id string")
    K.replace_partition(rows, str(tmp_path / "t"))
    K.replace_partition(rows.limit(0), str(tmp_path / "t"), replaced=[value])
    assert [r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [2]


def test_failed_replacement_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "E1"), (2, "E2")], "id int, engagement_id string")
    K.replace_partition(rows, path)
    with pytest.raises(Exception, match="broken"):
        K.replace_partition(rows.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("broken")).cast("int")).otherwise(9)), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    K.replace_partition(spark.read.parquet(path).withColumn("id", F.col("id") + 10).filter("id = 11"), path)  # reads what it replaces
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 11]


def test_first_blank_cells_cut_nothing_off(spark):
    df = constant_table(spark, "source_id string, line_number bigint, value string", [("s", 1, ";b;c;d;EXTRA"), ("s", 2, ";;;;;x"), ("s", 3, "")])
    cells = [r.cells for r in D.delimited_cells(df, 4).orderBy("line_number").collect()]
    assert cells == [[None, "b", "c", "d", "EXTRA"], [None] * 5 + ["x"], [None] * 4]


def made_files(seed):
    """Files written by a CSV writer, with separators, quotes and line breaks in cells, and files of random characters."""
    r = random.Random(seed)
    cell = lambda: "".join(r.choice('ab ;"\n') for _ in range(r.randint(0, 6)))
    for i in range(12):
        if i % 2:
            out = io.StringIO()
            csv.writer(out, delimiter=";", lineterminator="\n").writerows([[cell() for _ in range(r.randint(1, 6))] for _ in range(40)])
            yield f"f{i}", out.getvalue().split("\n")[:-1]
        else:
            yield f"f{i}", ["".join(r.choice('ab;"x') for _ in range(r.randint(0, 12))) for _ in range(40)]


@pytest.mark.parametrize("width", [3, 7, 1_000_000])
def test_records_equal_those_of_a_csv_reader(spark, width):
    files = dict(made_files(width))
    df = spark.createDataFrame([(s, i + 1, line) for s, lines in files.items() for i, line in enumerate(lines)], "source_id string, line_number bigint, value string")
    got = {}
    for r in D.delimited_cells(D.delimited_records(df, ";", width), 0).collect():
        got.setdefault(r.source_id, []).append((r.line_number, r.cells))
    for source, lines in files.items():
        reader, want, line = csv.reader([x + "\n" for x in lines], delimiter=";"), [], 1
        for row in reader:
            want.append((line, [c or None for c in row] or [None]))
            line = reader.line_num + 1
        mine = sorted(got[source])
        last = want[-1][1]
        if last[-1] != mine[-1][1][-1]:  # a quote that is never closed: the reader adds the file's last line break
            last[-1] = last[-1][:-1] or None
        assert mine == want


def test_a_quote_never_closed_stops_the_job(spark):
    df = spark.createDataFrame([("s", i, 'a;"b' if i == 5 else "a;b") for i in range(1, 200)], "source_id string, line_number bigint, value string")
    assert D.delimited_records(df).count() == 5
    with pytest.raises(Exception, match="quote of line 5 of s is not closed"):
        D.delimited_records(df, most_lines=50).count()


def test_a_record_across_splits_of_a_file(spark, tmp_path):
    """Splits of 64 bytes cut quoted cells; header and skipped rows are counted as records."""
    body = "".join(f'{i};"first {i}\nsecond; ""{i}""\nthird";x\n' for i in range(50))
    (tmp_path / "j.csv").write_text('\ufeffN;"Causa\nle";Conto\n-;-;-\n' + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        lines = X.read_lines(spark, str(tmp_path))
        got = sorted((int(r.cells[0]), r.cells[1], r.line_number) for r in D.delimited_journal_scan(lines, 3, 0, 1).collect())
        heads = [r.header for r in D.header_cells(lines, 3).orderBy("position").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, f'first {i}\nsecond; "{i}"\nthird', 4 + 3 * i) for i in range(50)] and heads == ["N", "Causa\nle", "Conto"]


def test_each_file_in_its_own_encoding(spark, tmp_path):
    texts = {"u.csv": ("utf-8", "Città;perché €\n1;è\n"), "w.csv": ("cp1252", "Città;perché €\n2;è\n"), "l.csv": ("latin-1", "Citt\xe0;\x81\n3;\xe8\n")}
    for name, (code, text) in texts.items():
        (tmp_path / name).write_bytes(text.encode(code))
    (tmp_path / "z.csv").write_bytes(b"\x00\x01\x02\xff\n")
    got = {}
    for r in X.read_lines(spark, str(tmp_path)).orderBy("line_number").collect():
        got.setdefault(r.source_id.split("/")[-1], []).append((r.encoding, r.value))
    for name, (code, text) in texts.items():
        assert got[name] == [(code, line) for line in text.split("\n")[:-1]]
    assert got["z.csv"] == [(None, None)]
    fallback = {r.encoding for r in X.read_lines(spark, str(tmp_path / "w.csv"), ("utf-8", "latin-1")).collect()}
    assert fallback == {"latin-1"}


def test_another_header_refuses_the_file(spark):
    rows = [("a", 1, " "), ("a", 2, HEADER), ("a", 3, fixed_line(1)), ("b", 1, "OTHER"), ("b", 2, fixed_line(2)), ("b", 3, HEADER), ("c", 1, "  ")]
    df = constant_table(spark, "source_id string, line_number bigint, value string", rows)
    got = {(r.source_id, r.line_number): r.error for r in X.fixed_width_scan(df, HEADER, POSITIONS).collect()}
    assert got == {("a", 3): None, ("b", 1): "L'intestazione del file TXT non corrisponde al profilo applicato"}


def test_trial_balances_with_their_own_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Conto;Nome;Saldo\n1;"Cassa; contanti";"1.234,50"\n;x;1\n')
    (tmp_path / "b.txt").write_bytes("Acc Nb\tDescrizione\tImporto\tPrior\n2\tCittà\t10\t5,5\n".encode("cp1252"))
    (tmp_path / "c.csv").write_text("codice|nome|amount\n3|Banca|-7\n")
    lines = X.read_lines(spark, str(tmp_path))
    kinds = {r.source_id[-5:]: r.separator for r in D.separators(lines).collect()}
    assert kinds == {"a.csv": ";", "b.txt": "\t", "c.csv": "|"}
    got = sorted((r.account, r.name, str(r.amount), str(r.prior)) for r in D.read_trial_balance(lines).collect())
    assert got == [("1", "Cassa; contanti", "1234.50", "None"), ("2", "Città", "10.00", "5.50"), ("3", "Banca", "-7.00", "None")]


def test_document_ids_equal_those_of_composed_paths(spark):
    r = random.Random(8)
    pool = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x300, 0x345), *range(0x1100, 0x1176), *range(0xAC00, 0xAC40), 0x1E9B, 0x212B, 0x0958, 0x1D15E, 0x2126)]
    paths = ["/".join("".join(r.choice(pool) for _ in range(r.randint(1, 8))) for _ in range(2)) for _ in range(10_000)]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.document_key(F.lit("E1"), F.col("p")).alias("k")).collect()
    for row in got:
        path = unicodedata.normalize("NFC", row.p)
        parts = [x for x in path.strip().split("/") if x not in ("", ".")]
        assert row.k == hashlib.sha1(f"E1:{'/'.join(parts)}".encode()).hexdigest()[:12]


def test_ragged_lines_keep_their_cells(spark):
    lines = [("s", 1, "a;b;c;d;EXTRA"), ("s", 2, "a;b"), ("s", 3, '"x;y";b;c;d;"e ""f"";g";;h'), ("s", 4, "a;b;c;")]
    df = constant_table(spark, "source_id string, line_number bigint, value string", lines)
    cells = [r.cells for r in D.delimited_cells(df, 4).orderBy("line_number").collect()]
    assert cells == [["a", "b", "c", "d", "EXTRA"], ["a", "b", None, None], ["x;y", "b", "c", "d", 'e "f";g', None, "h"], ["a", "b", "c", None]]


def test_cells(spark):
    assert value(spark, P.amount_lenient(F.lit("1.234,56"))) == value(spark, P.amount_lenient(F.lit("1,234.56"))) == Decimal("1234.56")
    assert value(spark, P.amount_lenient(F.lit(""))) == 0 and value(spark, P.amount_strict(F.lit("1.234"))) == Decimal("1.234")
    assert value(spark, P.date_strict(F.lit("1-2-2024"))) is None and value(spark, P.date_lenient(F.lit("1.2.70"))) == date(1970, 2, 1)
    assert value(spark, P.time_strict(F.lit("24:00"))) is None and value(spark, P.time_strict(F.lit("9:05:07"))) == 32707
    assert value(spark, P.text_or_null(F.lit("   "))) is None and value(spark, P.number_to_text(F.lit(3.0))) == "3"


LEDGER = """KLD  Mastrini                  Pagina     1
  Sottoconto   100000000001  CONTO VECCHIO
               01/04/26                               100 Prima riga
                                                Progr.e saldo al 30/06/26      1,00
KLD  Mastrini                  Pagina   284
  Sottoconto   500401100003  PLUSV. SU PARTECIP.                           Elaborazione Statistica
               13/05/26                               100 Rilevazione         897.352,73
                                                Progr.e saldo al 30/06/26     897.352,73
"""


def test_text_figures(spark):
    page = value(spark, T.last_print_page(F.lit(LEDGER)))
    assert "Pagina   284" in page and "CONTO VECCHIO" not in page
    closing = value(spark, T.ledger_closing(F.lit(page)))
    assert closing.page == 284 and closing.closing_date == "30/06/26" and "PLUSV" in closing.description
    receipt = F.lit("QUIETANZA\n629.91147\n18052026\nDATADELVERSAMENTO\nERARIO\n629.911,47\n")
    assert value(spark, T.tax_payment_amount(receipt)) == Decimal("629911.47") and value(spark, T.payment_date(receipt)) == "18/05/2026"
    assert value(spark, T.month_in_name(F.lit("F24 300626.pdf"))) == 6 and value(spark, T.date_in_name(F.lit("F24 160426.pdf"))) == date(2026, 4, 16)
    assert value(spark, T.fold_text(F.lit("Società ﬁn… Ⅳ ½ ø"))) == "societa fin... iv 12 "
    assert value(spark, T.normalise_path(F.lit("../a/./b\\c/../è"))) == "a/b/è"
    assert value(spark, T.period_quarter(F.lit("IV trim. 2024"))) == 4 and value(spark, T.period_months(F.lit("boh"))) is None
    names = ["Deutsche cc_401195 30.06.2026.pdf", "Deutsche cc_830320 30.06.2026.pdf", "Deutsche cc_830321 30.06.2026.pdf", "Passadore cc_1613722 30.06.2026.pdf",
             "Passadore cc_1614336 30.06.2026.pdf", "Bper cc_38035173 30.06.2026.pdf", "Bper cc_42216254 30.06.2026.pdf", "Intesa cc_Usd 30.06.2026.pdf", "Unicredit 30.06.2026.pdf"]
    keys = spark.createDataFrame([(n,) for n in names], "n string").select(T.bank_key(F.col("n"))).distinct().count()
    assert keys == 9


def test_assemble_entries_does_not_depend_on_buckets(spark, monkeypatch):
    from tallywright.plans.entry_queries import journal_sheet

    sheet = journal_sheet(spark, "/root/testdata/sf0.001")
    whole = sorted(map(tuple, E.assemble_entries(sheet).select("source_id", "position", "entry_start", "entry_number").collect()))
    monkeypatch.setattr(E, "number_bucket", lambda c: F.col(c) - F.pmod(F.col(c), F.lit(7)))
    small = sorted(map(tuple, E.assemble_entries(sheet).select("source_id", "position", "entry_start", "entry_number").collect()))
    assert whole == small


def test_inventory_of_a_folder(spark, tmp_path):
    for name in ("a/F24.TXT", "a/~$x.docx", "output/b.txt", "Thumbs.db", "c.bmp", "Template WPS.xlsx"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("uno\n  due")
    rows = I.document_inventory(I.read_documents(spark, str(tmp_path), "E")).collect()
    assert [(r.rel_path, r.name, r.extension, r.excerpt) for r in rows] == [("a/F24.TXT", "F24.TXT", ".txt", "uno due")]


def test_figures_with_other_blanks_and_scripts(spark):
    texts = ["1\u00a0234,56", "saldo contabile 12\u202f500,40", "\U0001d400bc\u2026 \ufb01 \u00bd \u00e9 \u216b", "plain", "\u65e5\u672c"]
    df = constant_table(spark, "i int, t string", list(enumerate(texts)))
    rows = df.select(T.find_amounts(F.col("t")).alias("a"), T.fold_text(F.col("t")).alias("f"), "t").orderBy("i").collect()
    assert rows[0].a == [Decimal("1234.56")] and rows[1].a == [Decimal("12500.40")]
    assert [r.f for r in rows] == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() for t in texts]


def test_records_after_the_header_are_not_one_task_per_file(spark):
    """The records of one file are spread when they meet the file's first row; the header itself may span lines."""
    rows = [("f", 1, 'a;"head'), ("f", 2, 'line";c')] + [("f", i, f"{i};x;y") for i in range(3, 4003)] + [("f", 4003, '9;"open'), ("f", 4004, 'end";z')]
    lines = constant_table(spark, "source_id string, line_number bigint, value string", rows)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = D._after_rows(lines, 1, ";")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        got = sorted((r.line_number, r.value) for r in found.collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == [(i, f"{i};x;y") for i in range(3, 4003)] + [(4003, '9;"open\nend";z')]
    assert len(sizes) > 1 and max(sizes) < 4001 / 2
