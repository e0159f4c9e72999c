"""Queries over evidence, checklists and findings (V)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywright.constants import CATALOGUE, JUDGEMENT_NOTE_ITEMS, SECTION_ITEMS
from tallywright.functions.tables import constant_table, held
from tallywright.operators import classification as D, verification as V
from tallywright.plans.document_queries import applicable, assigned_table, engagements
from tallywright.plans.views import define, define_shared, shared, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, build, sql: str | None, *views: str) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE[name] = with_views(sql, *views) if views else sql


EXTRA_SECTIONS = [("E0", "X.1", "F", 1), ("E1", "X.3", "F", 1), ("E2", "X.5", "D", 1)]
OVERRIDES = [
    ("E0", "item", "D.2", "✗", "", 1), ("E0", "item", "A.4", "N/A", "", 2), ("E0", "item", "B.2", "✗", "", 3), ("E1", "section", "G", "N/A", "", 4),
    ("E1", "section", "G", "✗", "seconda", 5), ("E1", "section", "I", "✗", "non richiesta", 6), ("E2", "item", "B.4", "✗", "", 7), ("E2", "item", "X.5", "N/A", "", 8),
    ("E2", "item", "A.2", "N/A", "", 9), ("E2", "item", "A.4", "✗", "", 10),
]
define("extra_sections", "SELECT * FROM (VALUES {}) AS t(engagement_id, item_id, section, item_order)".format(", ".join(map(str, EXTRA_SECTIONS))))
define("overrides", "SELECT * FROM (VALUES {}) AS t(engagement_id, scope, target, decision, note, seq)".format(", ".join(map(str, OVERRIDES))))
define("section_item", "SELECT * FROM (VALUES {}) AS t(section, item_id, position)".format(
    ", ".join(str((s, item, i)) for s, items in SECTION_ITEMS.items() for i, item in enumerate(items))))
define("catalogue_item", "SELECT * FROM (VALUES {}) AS t(item_id, label, need, item_order)".format(
    ", ".join("('{}', '{}', '{}', {})".format(i, label.replace("'", "''"), need.replace("'", "''"), n) for n, (i, label, need) in enumerate(CATALOGUE))))
define("nine", "SELECT engagement_id, unnest(['A','B','C','D','E','F','G','H','I']) AS section FROM engagements", "engagements")


def extra_sections(spark: SparkSession) -> DataFrame:
    return constant_table(spark, "engagement_id string, item_id string, section string, item_order int", EXTRA_SECTIONS)


def overrides(spark: SparkSession) -> DataFrame:
    return constant_table(spark, "engagement_id string, scope string, target string, decision string, note string, seq int", OVERRIDES)


def connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.connected_items(applicable(spark, sf_dir), extra_sections(spark))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = assigned_table(spark, sf_dir), applicable(spark, sf_dir)
    return D.evidence_found(docs, items).unionByName(D.evidence_absent(docs, items))


define("evidence", "SELECT * FROM found_evidence UNION ALL SELECT * FROM absent_evidence", "found_evidence", "absent_evidence")
define("connected", """
SELECT engagement_id, section, item_id, min(position) AS position FROM (
 SELECT engagement_id, section, item_id, position FROM applicable JOIN section_item USING (item_id)
 UNION ALL SELECT engagement_id, section, item_id, item_order + 1000 FROM extra_sections) t GROUP BY ALL""", "applicable", "section_item", "extra_sections")
_add("V01_connected_items", connected, "SELECT * FROM connected", "connected")
define("lacking", """
SELECT * FROM connected c WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE found AND e.engagement_id = c.engagement_id AND e.item_id = c.item_id)
 AND NOT EXISTS (SELECT 1 FROM overrides o WHERE scope = 'item' AND o.engagement_id = c.engagement_id AND o.target = c.item_id)""", "connected", "evidence", "overrides")


def lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.missing_items(connected(spark, sf_dir), evidence(spark, sf_dir), overrides(spark))


_add("V02_missing_items", lacking, "SELECT * FROM lacking", "lacking")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


define("sections", f"""
SELECT engagement_id, section, CASE WHEN decision IS NOT NULL THEN decision WHEN n IS NULL THEN 'wip' WHEN skipped = n THEN '✗'
  WHEN missing = 0 AND section NOT IN ('A','D','H','I') THEN '✓' ELSE 'wip' END AS status,
 CASE WHEN decision IS NOT NULL THEN coalesce(nullif(note, ''), 'Decisione umana applicata all''intera sezione.') WHEN n IS NULL THEN {_quoted(V.NO_ITEMS)}
  WHEN skipped = n THEN {_quoted(V.ALL_SKIPPED)}
  WHEN missing = 0 AND section NOT IN ('A','D','H','I') THEN concat('Tutte le voci collegate (', items, ') sono state trovate.')
  WHEN missing = 0 THEN concat('Tutte le voci collegate (', items, ') sono state trovate, ma questa è una sezione di giudizio umano (A/D/H/I): l''app non assegna ✓ da sola.')
  ELSE concat('Mancano ancora: ', missing_list, '.') END AS reasoning,
 CASE WHEN decision IS NOT NULL THEN '' ELSE coalesce(missing_list, '') END AS missing_items
FROM nine LEFT JOIN (SELECT c.engagement_id, c.section, count(*) AS n, string_agg(c.item_id, ', ' ORDER BY c.position) AS items,
  count(l.item_id) AS missing, string_agg(l.item_id, ', ' ORDER BY c.position) AS missing_list, count(o.target) AS skipped
 FROM connected c LEFT JOIN lacking l ON l.engagement_id = c.engagement_id AND l.section = c.section AND l.item_id = c.item_id
 LEFT JOIN overrides o ON o.scope = 'item' AND o.engagement_id = c.engagement_id AND o.target = c.item_id GROUP BY 1, 2) s USING (engagement_id, section)
LEFT JOIN (SELECT engagement_id, target AS section, arg_min(decision, seq) AS decision, arg_min(note, seq) AS note FROM overrides WHERE scope = 'section' GROUP BY 1, 2) h
USING (engagement_id, section)""", "nine", "connected", "lacking", "overrides")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.section_status(engagements(spark, sf_dir), connected(spark, sf_dir), evidence(spark, sf_dir), overrides(spark))


_add("V03_section_status", sections, "SELECT * FROM sections", "sections")
_add("V04_evaluate_engagement",
     lambda s, d: V.evaluate_engagement(evidence(s, d), applicable(s, d), extra_sections(s), overrides(s)), "SELECT * FROM sections", "sections")

define_shared("section_history", "orders", """
SELECT concat('P', CAST(o_custkey % 200 AS STRING)) AS engagement_id, substring('ABCDEFGHI', CAST(o_orderkey % 9 + 1 AS INT), 1) AS section,
 o_orderpriority AS status, CAST(o_orderdate AS DATE) AS computed_at, o_orderkey AS seq FROM {base}""")
_add("V05_latest_result", lambda s, d: V.latest_result(shared(s, d, "section_history")), """
SELECT engagement_id, section, status, computed_at, seq FROM (
 SELECT *, row_number() OVER (PARTITION BY engagement_id, section ORDER BY computed_at DESC, seq DESC) AS rn FROM section_history) t WHERE rn = 1""", "section_history")
define_shared("findings", "orders", """
SELECT concat('F', CAST(o_orderkey AS STRING)) AS finding_id, concat('C', CAST(o_custkey AS STRING)) AS client, concat('P', CAST(o_orderkey % 3 AS STRING)) AS engagement_id,
 concat('T', CAST(o_orderkey % 3 AS STRING)) AS period, substring('ABCDEFGHI', CAST(o_orderkey % 9 + 1 AS INT), 1) AS section, o_orderkey % 12 + 1 AS check_no,
 CASE WHEN o_orderkey % 3 = 0 THEN 'carenza' WHEN o_orderkey % 3 = 1 THEN 'anomalia' ELSE 'suggerimento' END AS kind, o_orderpriority AS description,
 CASE o_orderstatus WHEN 'F' THEN 'sistemato' WHEN 'O' THEN 'aperto' ELSE 'in_corso' END AS status, 'P0' AS first_raised_engagement, 'T0' AS first_raised_period,
 CASE WHEN o_orderkey % 4 = 3 THEN concat('F', CAST(o_orderkey - 1 AS STRING)) END AS previous_id, CAST(NULL AS STRING) AS resolved_in FROM {base}""")
define_shared("new_periods", "customer", """
SELECT concat('C', CAST(c_custkey AS STRING)) AS client, concat('P', CAST(c_custkey % 4 AS STRING)) AS engagement_id, 'T9' AS period FROM {base}""")
_add("V06_open_findings", lambda s, d: V.open_findings(shared(s, d, "findings")), "SELECT * FROM findings WHERE status <> 'sistemato'", "findings")
_CARRY = """
SELECT left(sha1(concat(n.engagement_id, ':', f.finding_id)), 12) AS finding_id, f.client, n.engagement_id, n.period, f.section, f.check_no, f.kind, f.description,
 'aperto' AS status, f.first_raised_engagement, f.first_raised_period, f.finding_id AS previous_id, CAST(NULL AS VARCHAR) AS resolved_in
FROM findings f JOIN new_periods n ON n.client = f.client AND n.engagement_id <> f.engagement_id WHERE f.status <> 'sistemato'
 AND NOT EXISTS (SELECT 1 FROM findings d WHERE d.previous_id = f.finding_id AND d.engagement_id = n.engagement_id)"""
_add("V07_carry_forward_findings", lambda s, d: V.carry_forward_findings(shared(s, d, "findings"), shared(s, d, "new_periods")), _CARRY, "findings", "new_periods")
_add("V07_carry_last_links", lambda s, d: V.carry_forward_findings(shared(s, d, "findings"), shared(s, d, "new_periods"), heads_only=True),
     _CARRY + " AND NOT EXISTS (SELECT 1 FROM findings d WHERE d.previous_id = f.finding_id)", "findings", "new_periods")

# --- checklist -----------------------------------------------------------------------------------

define("used", "SELECT * FROM assigned WHERE NOT skip AND item_id IS NOT NULL", "assigned")
define("checklist", """
SELECT g.engagement_id, g.item_id, g.item_order, CASE WHEN o.decision IS NOT NULL THEN o.decision WHEN n > 0 THEN '✓' ELSE 'wip' END AS status,
 CASE WHEN o.decision = '✗' THEN 'controllo saltato (operatore)' WHEN o.decision = 'N/A' THEN 'non applicabile'
  WHEN n > 0 THEN concat(array_to_string(names[1:8], ', '), CASE WHEN n > 8 THEN concat(' (+', n - 8, ')') ELSE '' END)
  ELSE 'documento non trovato in cartella' END AS note
FROM (SELECT engagement_id, item_id, item_order FROM engagements, catalogue_item) g LEFT JOIN (
 SELECT engagement_id, item_id, count(*) AS n, array_agg(name ORDER BY first, name) AS names FROM (
  SELECT engagement_id, item_id, name, min(load_order) AS first FROM (
   SELECT engagement_id, item_id, name, load_order FROM used UNION ALL
   SELECT engagement_id, 'C.3', name, load_order FROM used WHERE item_id = 'C.1' AND contains(lower(name), 'collegio')
    AND engagement_id NOT IN (SELECT engagement_id FROM used WHERE item_id = 'C.3')) a GROUP BY ALL) b GROUP BY ALL) d USING (engagement_id, item_id)
LEFT JOIN overrides o ON o.scope = 'item' AND o.engagement_id = g.engagement_id AND o.target = g.item_id""", "engagements", "catalogue_item", "used", "overrides")


def checklist(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    used = assigned_table(spark, sf_dir) if docs is None else docs
    return V.checklist_status(engagements(spark, sf_dir), used, overrides(spark))


_add("V08_checklist_status", checklist, "SELECT * FROM checklist", "checklist")
FIGURES, SKIPPED = [("E0", "C"), ("E1", "E"), ("E2", "G"), ("E2", "C")], [("E2", "F"), ("E0", "A")]
define("light", """
SELECT engagement_id, section, CASE WHEN (engagement_id, section) IN (('E2', 'F'), ('E0', 'A')) THEN '✗'
 WHEN section NOT IN ('A','D','H','I') AND closed AND any_done AND (section NOT IN ('C','E','G') OR (engagement_id, section) IN (('E0', 'C'), ('E1', 'E'), ('E2', 'G'), ('E2', 'C')))
 THEN '✓' ELSE 'wip' END AS status FROM nine LEFT JOIN (
 SELECT engagement_id, section, bool_and(status IN ('✓', '✗', 'N/A')) AS closed, bool_or(status = '✓') AS any_done
 FROM checklist JOIN section_item USING (item_id) GROUP BY 1, 2) t USING (engagement_id, section)""", "nine", "checklist", "section_item")


def light(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    pairs = "engagement_id string, section string"
    return V.section_light(checklist(spark, sf_dir) if items is None else items, constant_table(spark, pairs, FIGURES), constant_table(spark, pairs, SKIPPED))


_add("V09_section_light", light, "SELECT * FROM light", "light")
define("missing_docs", "SELECT engagement_id, item_id, item_order, label, need FROM checklist JOIN catalogue_item USING (item_id, item_order) WHERE status = 'wip'",
       "checklist", "catalogue_item")
_add("V10_missing_documents", lambda s, d: V.missing_documents(checklist(s, d)), "SELECT * FROM missing_docs", "missing_docs")
_NOTE_ROWS = ", ".join(str((s, item, i)) for s, items in JUDGEMENT_NOTE_ITEMS.items() for i, item in enumerate(items))
_add("V11_judgement_notes", lambda s, d: V.judgement_notes(engagements(s, d), assigned_table(s, d)), f"""
SELECT engagement_id, section, coalesce(note, 'Nessuna evidenza in cartella; chiusura e testo a mano.') AS note FROM nine LEFT JOIN (
 SELECT engagement_id, section, concat('Evidenza in cartella (nessuna conclusione): ', array_to_string((array_agg(concat(item_id, ' ', name)
  ORDER BY position, load_order))[1:8], '; ')) AS note FROM used JOIN (VALUES {_NOTE_ROWS}) AS w(section, item_id, position) USING (item_id) GROUP BY 1, 2) t
USING (engagement_id, section) WHERE section IN ('A','D','H','I')""", "nine", "used")


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = assigned_table(spark, sf_dir)
    items = held(spark, "checklist", sf_dir, lambda: checklist(spark, sf_dir, docs))
    return V.control_kpis(docs, items, light(spark, sf_dir, items))


_add("V12_control_kpis", kpis, """
SELECT engagement_id, count(*) AS files, count(item_id) AS classified,
 (SELECT count(*) FROM checklist c WHERE c.engagement_id = a.engagement_id AND status = 'wip') AS missing,
 (SELECT count(*) FROM light l WHERE l.engagement_id = a.engagement_id AND status = '✓') AS sections_done FROM assigned a GROUP BY 1""", "assigned", "checklist", "light")


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = assigned_table(spark, sf_dir)
    items = held(spark, "checklist", sf_dir, lambda: checklist(spark, sf_dir, docs))
    return V.section_board(light(spark, sf_dir, items), V.missing_documents(items), docs)


_add("V13_section_board", board, """
SELECT engagement_id, section, status, CASE WHEN status = '✗' THEN 'alert' WHEN needs IS NOT NULL OR status = 'wip' THEN 'pending' ELSE 'ok' END AS kind,
 coalesce(needs, '') AS missing_needs, first_document, CAST(round(done * 100 / 9) AS INT) AS done_percent FROM light LEFT JOIN (
 SELECT engagement_id, left(item_id, 1) AS section, string_agg(need, ' ' ORDER BY item_order) AS needs FROM missing_docs GROUP BY 1, 2) m USING (engagement_id, section)
LEFT JOIN (SELECT engagement_id, left(item_id, 1) AS section, arg_min(name, load_order) AS first_document FROM assigned WHERE item_id IS NOT NULL GROUP BY 1, 2) f
 USING (engagement_id, section) JOIN (SELECT engagement_id, count(*) FILTER (WHERE status = '✓') AS done FROM light GROUP BY 1) k USING (engagement_id)""",
     "light", "missing_docs", "assigned")


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    raised = shared(spark, sf_dir, "findings").withColumn("engagement_id", F.translate("engagement_id", "P", "E"))
    seen, items, decided = evidence(spark, sf_dir), connected(spark, sf_dir), overrides(spark)
    status = held(spark, "sections", sf_dir, lambda: V.section_status(engagements(spark, sf_dir), items, seen, decided))
    return V.section_detail(status, items, seen, V.missing_items(items, seen, decided), raised)


_add("V14_section_detail", detail, """
SELECT engagement_id, section, status, 'Motivazione' AS kind, '' AS item_id, reasoning AS label, '' AS detail FROM sections
UNION ALL SELECT e.engagement_id, c.section, s.status, 'Evidenza', e.item_id, e.source_name, coalesce(nullif(e.source_path, ''), e.excerpt)
 FROM evidence e JOIN connected c ON c.engagement_id = e.engagement_id AND c.item_id = e.item_id JOIN sections s ON s.engagement_id = c.engagement_id AND s.section = c.section WHERE found
UNION ALL SELECT l.engagement_id, l.section, s.status, 'Mancante', l.item_id, coalesce(label, l.item_id), coalesce(need, 'Documento non trovato in cartella.')
 FROM lacking l LEFT JOIN catalogue_item k ON k.item_id = l.item_id JOIN sections s ON s.engagement_id = l.engagement_id AND s.section = l.section
UNION ALL SELECT replace(engagement_id, 'P', 'E'), section, status, 'Finding aperto', '', description, 'Prima segnalazione: T0' FROM findings WHERE status <> 'sistemato'""",
     "sections", "evidence", "connected", "lacking", "catalogue_item", "findings")
