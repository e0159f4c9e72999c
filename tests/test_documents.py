from __future__ import annotations

import random

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywright.functions.tables import constant_table
from tallywright.operators import classification as D, reconciliation as B, verification as V

SEVEN = [
    ("Bilancino_30.06.2026.csv", "B.1", "conto;descrizione;saldo;prior\n100;INTESA;12000.00;11000.00"),
    ("Estratto_Intesa_30.06.2026.txt", "F.1", "ESTRATTO CONTO\nINTESA SANPAOLO SPA\nIBAN IT60X0306909606100000068796\nSaldo al 30/06/2026: 12.500,40\ne/c periodo aprile-giugno 2026"),
    ("Estratto_Unicredit_30.06.2026.txt", "F.1", "ESTRATTO CONTO\nUNICREDIT SPA\nConto: 101476918\nSaldo al 30/06/2026: 3.037,12"),
    ("F24_aprile_2026.txt", "E.1", "Quietanza F24\nData versamento: 16/04/2026\nImporto: 35.616,68\nProtocollo telematico: 26041514340545867\nMese: aprile 2026"),
    ("LIPE_2trim_2026.txt", "E.3", "LIPE comunicazione liquidazione periodica IVA\n2° trimestre 2026\nRicevuta invio 18/08/2026"),
    ("Registro_IVA_acquisti.txt", "D.3", "Registro IVA acquisti\nUltima registrazione n. 164 data 30/06/2026"),
    ("Verbale_CDA_05.05.2026.txt", "C.2", "Verbale del Consiglio di amministrazione\nData: 05/05/2026\nPagina 148\nSeduta del CDA Gruppo"),
]


def documents(spark, rows, engagement="P"):
    full = [(engagement, i, name, rel, text, "", False, "Aprile - Giugno 2026") for i, (name, rel, text) in enumerate(rows)]
    return spark.createDataFrame(full, "engagement_id string, load_order bigint, name string, rel_path string, text string, excerpt string, skip boolean, period string")


@pytest.fixture(scope="module")
def seven(spark):
    return D.classify_documents(documents(spark, [(n, n, t) for n, _, t in SEVEN])).cache()


def test_seven_documents_end_to_end(spark, seven):
    assert {r.name: r.item_id for r in seven.collect()} == {n: i for n, i, _ in SEVEN}
    applicable = spark.createDataFrame([("P", i) for i in D.ITEMS], "engagement_id string, item_id string")
    evidence = D.evidence_found(seven, applicable).unionByName(D.evidence_absent(seven, applicable))
    assert evidence.filter("found").count() == 7 and evidence.filter("NOT found").count() == 19
    extras = constant_table(spark, "engagement_id string, item_id string, section string, item_order int", [])
    overrides = constant_table(spark, "engagement_id string, scope string, target string, decision string, note string, seq int", [])
    rows = {r.section: r for r in V.evaluate_engagement(evidence, applicable, extras, overrides).collect()}
    assert {s: r.missing_items for s, r in rows.items()} == {
        "A": "A.1, A.2, A.3", "B": "B.4, D.1, D.2", "C": "E.2, E.4, E.5, G.1, G.2", "D": "B.4", "E": "F.2, F.3, A.4", "F": "C.1, C.3, C.4",
        "G": "B.2, B.3", "H": "", "I": "A.2, A.4"}
    assert {r.status for r in rows.values()} == {"wip"}


def test_fields_of_the_seven_documents(seven):
    got = {(r.load_order, r.kind): r.value for r in D.extract_fields(seven, ["load_order"]).collect()}
    assert got == {(1, "saldo_ec"): "12500.40", (2, "saldo_ec"): "3037.12", (3, "importo"): "35616.68", (3, "data_versamento"): "16/04/2026",
                   (3, "protocollo"): "26041514340545867", (6, "data_verbale"): "05/05/2026"}


NAMES = [
    ("MASTRINI.txt", "B Bilancio", "B.4"), ("Libro giornale al 301125 definitivo.pdf", "D Libri fiscali_Contabili", "D.1"),
    ("Registro AI.pdf", "D Libri fiscali_Contabili", "D.3"), ("Ricevute Previdenza Complementare.pdf", "E Adempimenti", "E.2"),
    ("Ricevute versamenti Fondi .pdf", "E Adempimenti", "E.2"), ("Ricevuta di trasmissione D.IVA 2026 - Periodo d'imposta 2025.pdf", "E", "E.4"),
    ("IMPOSTA DI BOLLO.pdf", "E Adempimenti", "E.1"), ("Personale Aprile.pdf", "G Personale", "G.1"), ("Contabile stipendi aprile.pdf", "G Personale", "G.2"),
    ("Deutsche cc_401195 30.06.2026.pdf", "EC 30.06.2026", "F.1"), ("qualcosa.bin", "", None),
]


def test_golden_names(spark):
    docs = documents(spark, [(n, f"{f}/{n}", "") for n, f, _ in NAMES])
    assert [r.item_id for r in D.classify_documents(docs).orderBy("load_order").collect()] == [i for _, _, i in NAMES]


def test_text_counts_wherever_it_stands(spark):
    late = "x" * 7000 + " registro iva acquisti"
    docs = documents(spark, [("atto.txt", "atto.txt", late)])
    whole, cut = D.classify_documents(docs).first(), D.classify_documents(docs, text_limit=6000).first()
    assert (whole.item_id, whole.method) == ("D.3", "content") and cut.item_id is None


def test_section_rules(spark):
    e = constant_table(spark, "engagement_id string", [("P",)])
    connected = constant_table(spark, "engagement_id string, section string, item_id string, position int", [("P", "B", "D.1", 0), ("P", "A", "A.1", 0), ("P", "C", "E.1", 0)])
    evidence = constant_table(spark, "engagement_id string, item_id string, found boolean", [("P", "D.1", True), ("P", "D.1", False), ("P", "A.1", True)])
    overrides = constant_table(spark, "engagement_id string, scope string, target string, decision string, note string, seq int",
                               [("P", "item", "E.1", "N/A", "", 1), ("P", "section", "G", "N/A", "", 2)])
    got = {r.section: (r.status, r.missing_items) for r in V.section_status(e, connected, evidence, overrides).collect()}
    assert got["B"] == ("✓", "") and got["A"] == ("wip", "") and got["C"] == ("✗", "") and got["G"] == ("N/A", "") and got["H"] == ("wip", "")


FINDING = ("finding_id string, client string, engagement_id string, period string, section string, check_no int, kind string, description string, status string, "
           "first_raised_engagement string, first_raised_period string, previous_id string, resolved_in string")


def test_findings_are_carried_once(spark):
    rows = [("f1", "C", "P1", "T1", "A", 1, "carenza", "x", "in_corso", "P1", "T1", None, None), ("f2", "C", "P1", "T1", "A", 1, "carenza", "y", "sistemato", "P1", "T1", None, "P1")]
    findings = constant_table(spark, FINDING, rows)
    new = constant_table(spark, "client string, engagement_id string, period string", [("C", "P2", "T2")])
    carried = V.carry_forward_findings(findings, new)
    row = carried.first()
    assert carried.count() == 1 and (row.status, row.previous_id, row.first_raised_period, row.resolved_in, row.engagement_id) == ("aperto", "f1", "T1", None, "P2")
    both = findings.unionByName(carried)
    assert V.carry_forward_findings(both, new).count() == 0
    later = constant_table(spark, "client string, engagement_id string, period string", [("C", "P3", "T3")])
    assert V.carry_forward_findings(both, later).count() == 2 and V.carry_forward_findings(both, later, heads_only=True).count() == 1


def test_records_across_bucket_borders(spark, monkeypatch):
    record = ["BU01", "INTESA", "EUR", "30/06/2026", "1.000,00", "900,00", "100,00", ""]
    lines = spark.createDataFrame([("s", i, v) for i, v in enumerate((["", "x"] + record) * 9, 1)], "source_id string, line_number bigint, value string")
    assert B.balance_records(lines).count() == 9
    for width in (3, 4, 7, 10):
        monkeypatch.setattr(B, "RECORD_BUCKET", width)
        got = B.balance_records(lines)
        assert got.count() == 9 and got.first().booked == Decimal("900.00")
    nested = spark.createDataFrame([("s", i, v) for i, v in enumerate(["BU01", "SA02", "EUR", "EUR", "1,00", "2,00", "3,00", "4,00"], 1)], lines.schema)
    assert B.balance_records(nested).count() == 1 and B.overlapping_records(nested).count() == 1
    chain = ["BU01", "bank", "EUR", "SA02", "5,00", "EUR", "1,00", "x", "BU03", "bank", "EUR", "30/06/2026", "1,00", "2,00", "3,00"]
    starts = spark.createDataFrame([("s", i, v) for i, v in enumerate(chain, 1)], lines.schema)
    assert sorted(r.line_number for r in B.balance_records(starts).collect()) == [1, 9]
    assert [r.line_number for r in B.overlapping_records(starts).collect()] == [4]


@pytest.mark.parametrize("block, blocks", [(7, 2), (10, 3), (4096, 256)])
def test_kept_starts_do_not_depend_on_blocks(spark, block, blocks):
    r = random.Random(block)
    sources = {f"s{k}": sorted(r.sample(range(500), k)) for k in (1, 60, 150, 300)} | {"dense": list(range(0, 400, 2)), "probe": [1, 4, 9]}
    want = []
    for source, numbers in sources.items():
        free = 0
        for n in numbers:
            if n >= free:
                want.append((source, n))
                free = n + 7
    df = spark.createDataFrame([(s, n) for s, own in sources.items() for n in own], "source_id string, n bigint")
    assert sorted(map(tuple, B.kept_starts(df, block, blocks).collect())) == sorted(want)


def test_checklist_shows_eight_names(spark):
    docs = documents(spark, [(f"F24_{i:02d}.pdf", "", "") for i in range(11)] + [("Verbale assemblea Collegio.pdf", "", "")])
    docs = docs.withColumn("item_id", F.when(F.col("load_order") < 11, "E.1").otherwise("C.1"))
    overrides = constant_table(spark, "engagement_id string, scope string, target string, decision string, note string, seq int", [("P", "item", "A.1", "✗", "", 1)])
    rows = {r.item_id: r for r in V.checklist_status(docs.select("engagement_id").distinct(), docs, overrides).collect()}
    assert rows["E.1"].note.endswith("F24_07.pdf (+3)") and rows["C.3"].status == "✓" and rows["A.1"].status == "✗" and rows["B.1"].status == "wip"


def test_statement_accounts_keep_all_their_digits(spark):
    from tallywright.functions import text as T

    df = constant_table(spark, "name string, text string", [("a", "Conto corrente n. 12345678901234567890123"), ("b", "Conto corrente n. 12345678901234567890124")])
    account = lambda *width: [r[0] for r in df.select(T.statement_account(F.col("name"), F.col("text"), *width)).collect()]
    assert account() == ["12345678901234567890123", "12345678901234567890124"] and set(account(20)) == {"12345678901234567890"}
