"""Queries over documents: text functions (F08-F24) and classification (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywright.constants import (
    BANK_ALIASES, CATALOGUE, FOLDER_RULES, HINT_POINTS_NAME, HINT_POINTS_TEXT, ITEM_HINTS, MONTHS, NAME_RULES, UNKNOWN_BANK,
)
from tallywright.functions import text as T
from tallywright.functions.tables import constant_table, held
from tallywright.operators import classification as D
from tallywright.plans.views import define, define_shared, italian_amount, shared, table, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, build, sql: str | None, *views: str) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE[name] = with_views(sql, *views) if views else sql


FILE_NAMES = [
    "F24_aprile_2026.txt", "F24 160426.pdf", "Quietanza giu26.pdf", "PREVIMODA_2TR26.pdf", "LIPE_IV TR 2026.txt",
    "Dichiarazione IVA annuale.pdf", "Contabile stipendi aprile.pdf", "Registro IVA acquisti.txt", "Cedolini maggio.pdf",
    "MASTRINI.txt", "Libro giornale al 301125 definitivo.pdf", "Giornale provvisorio 2026.txt", "Bilancino_30.06.2026.csv",
    "df_situazione banche.txt", "Centrale Rischi.pdf", "Verbale assemblea collegio sindacale.pdf", "Verbale_CDA_20260505.txt",
    "Verbale Collegio sindacale.pdf", "Libro soci.pdf", "Estratto_Intesa cc_401195 30.06.2026.txt", "Unicredit USD 30.06.2026.txt",
    "Bper cc_38035173 luglio.pdf", "nota.txt", "Organigramma società.docx", "Budget e cashflow.xlsx", "Intrastat giugno.pdf",
    "Mediobanca e-commerce giu.txt", "Atto.txt", "IMPOSTA DI BOLLO.pdf", "Libro inventari.pdf", "ENASARCO 1TR26 iii.pdf",
]
FOLDERS = ["F_Banche", "E_Adempimenti/x", "C_Libri sociali", "B_Bilancio", "D Libri fiscali_Contabili", "G Personale", "varie/g.2/x"]
PERIODS = ["Aprile - Giugno 2026", "III Trimestre 2025", "IV trim. 2024"]


def _cycle(values: list[str], key: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_NL = "chr(10)"
_AMOUNT = italian_amount("(doc_id * 777 + 123456)")
define_shared("document_files", "documents", f"""
SELECT concat('E', CAST(doc_id % 3 AS STRING)) AS engagement_id, doc_id AS load_order, name, concat(folder, '/', name) AS rel_path, text,
 concat('Estratto di prova ', CAST(doc_id AS STRING), ' organo di vigilanza') AS excerpt, doc_id % 53 = 0 AS skip, period FROM (
 SELECT doc_id, {_cycle(FILE_NAMES, 'doc_id')} AS name, {_cycle(FOLDERS, 'doc_id')} AS folder, {_cycle(PERIODS, 'doc_id')} AS period,
 concat(text, {_NL}, CASE doc_id % 5
  WHEN 0 THEN concat('Saldo iniziale al 01/04/2026: 1.000,00', {_NL}, 'Saldo al 30/06/2026: ', {_AMOUNT}, {_NL}, 'IBAN IT60X0306909606100000068796')
  WHEN 1 THEN concat('Quietanza', {_NL}, 'Data versamento: 16/04/2026', {_NL}, 'Importo: ', {_AMOUNT}, {_NL}, 'Protocollo: 2604151434', lpad(CAST(doc_id AS STRING), 7, '0'))
  WHEN 2 THEN concat('Pagina 1', {_NL}, '  01/04/26  100 Prima riga', {_NL}, 'Progr.e saldo al 31/05/26  1,00', {_NL}, 'KLD Pagina ', CAST(doc_id % 300 + 1 AS STRING), {_NL},
   '  Sottoconto   5004  PLUSV. SU PARTECIP.    Elaborazione', {_NL}, '  13/05/26   100 Rilevazione costi 1.234,00', {_NL}, '   Progr.e saldo al 30/06/26   10,00', {_NL}, '*** FINE STAMPA ***')
  WHEN 3 THEN concat('DATA DEL VERSAMENTO 18.05.2026', {_NL}, 'conto corrente n. 123 456 xyz', {_NL}, 'saldo contabile 45,10', {_NL}, 'conto bpm libro inventari', {_NL}, 'totale dovuto 1234,50')
  ELSE '' END) AS text FROM {{base}}) t""")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "document_files")


def _text_query(name: str, build, sql: str, columns: tuple[str, ...] = ("load_order",)) -> None:
    """A text function over every document: ``build`` and ``sql`` give the output columns."""
    _add(name, lambda s, d: files(s, d).select(*columns, *build()), f"SELECT {', '.join(columns)}, {sql} FROM document_files", "document_files")




def _text():
    return F.col("text")


def _name():
    return F.col("name")


_joined = lambda a: F.array_join(a.cast("array<string>"), "|")

_FIND = r"-?[0-9]{1,3}(?:[.\s][0-9]{3})+,[0-9]{2}|-?[0-9]{1,3}(?:[.\s][0-9]{3})*,[0-9]{2}|-?[0-9]+[.,][0-9]{2}"


def _sql_amount(x: str) -> str:
    bare = f"replace({x}, ' ', '')"
    return (
        f"TRY_CAST(regexp_replace(CASE WHEN regexp_matches({bare}, '^-?[0-9]{{1,3}}(\\.[0-9]{{3}})+,[0-9]{{1,2}}$') THEN replace(replace({bare}, '.', ''), ',', '.') "
        f"WHEN contains({bare}, ',') AND NOT contains({bare}, '.') THEN replace({bare}, ',', '.') ELSE {bare} END, '[^0-9.\\-]', '', 'g') AS DECIMAL(18,2))"
    )


def _sql_amounts(text: str, var: str = "x") -> str:
    parsed = f"list_transform(regexp_extract_all({text}, '{_FIND}'), lambda {var}: {_sql_amount(var)})"
    return f"list_filter({parsed}, lambda {var}: abs({var}) >= 0.01)"


_LINES = f"string_split(text, {_NL})"
_DATES = r"\b([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4})\b"

_text_query("F08_find_amounts", lambda: [_joined(T.find_amounts(_text())).alias("amounts")],
            f"coalesce(array_to_string({_sql_amounts('text')}, '|'), '') AS amounts")
_text_query("F09_find_dates", lambda: [_joined(T.find_dates(_text())).alias("dates")],
            f"coalesce(array_to_string(regexp_extract_all(text, '{_DATES}', 1), '|'), '') AS dates")
_GROUPED = f"list_filter(list_transform(regexp_extract_all(text, '[0-9]{{1,3}}(?:\\.[0-9]{{3}})+,[0-9]{{2}}'), lambda x: {_sql_amount('x')}), lambda x: x >= 1)"
_LABELLED = f"""flatten(list_transform(list_filter({_LINES}, lambda l: regexp_matches(l, '(?i)importo|versare|totale|erario|saldo')), lambda l: {_sql_amounts('l')}))"""
_text_query("F10_tax_payment_amount", lambda: [T.tax_payment_amount(_text()).alias("amount")], f"""coalesce(({_GROUPED})[-1],
 list_sort({_LABELLED}, 'DESC')[1], list_max(list_filter({_sql_amounts('text')}, lambda x: x >= 10))) AS amount""")
_text_query("F11_statement_balance", lambda: [T.statement_balance(_text()).alias("balance")], f"""list_filter(list_transform(
 list_filter(list_transform({_LINES}, lambda l: lower(l)), lambda l: regexp_matches(l, 'saldo|disponibilit|new balance|closing') AND NOT regexp_matches(l, 'saldo iniziale|previous|precedente')),
 lambda l: ({_sql_amounts('l')})[-1]), lambda x: abs(x) >= 1)[-1] AS balance""")
_text_query("F12_protocol_number", lambda: [T.protocol_number(_text()).alias("protocol")],
            r"nullif(regexp_extract(text, '\b([0-9]{15,20})\b', 1), '') AS protocol")
_COMPACT = r"regexp_replace(text, '[\s.:]', '', 'g')"
_MARK = f"strpos(upper(replace({_COMPACT}, 'ß', 'SS')), 'DATADELVERSAMENTO')"
_NEAR = f"CASE WHEN {_MARK} > 0 THEN substr({_COMPACT}, greatest(1, {_MARK} - 48), {_MARK} + 48 - greatest(1, {_MARK} - 48)) END"
_COMPACT_DATE = "(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])20[0-9]{2}"
_text_query("F13_payment_date", lambda: [T.payment_date(_text()).alias("payment_day")], f"""coalesce(
 list_transform(regexp_extract_all({_NEAR}, '{_COMPACT_DATE}')[-1:], lambda x: concat(x[1:2], '/', x[3:4], '/', x[5:8]))[1],
 list_filter(list_transform(list_filter({_LINES}, lambda l: regexp_matches(l, '{_DATES}') AND regexp_matches(l, '(?i)vers|delega|quietanza|pagat|protocol')),
  lambda l: regexp_extract_all(l, '{_DATES}', 1)[-1]), lambda x: x IS NOT NULL)[1],
 regexp_extract_all(text, '{_DATES}', 1)[-1]) AS payment_day""")
_text_query("F14_statement_account", lambda: [T.statement_account(_name(), _text()).alias("account")], """nullif(CASE
 WHEN regexp_matches(name, '(?i)cc[_\\s-]*[0-9]+') THEN regexp_extract(name, '(?i)cc[_\\s-]*([0-9]+)', 1)
 WHEN regexp_matches(name, '(?i)usd') THEN 'USD'
 WHEN regexp_matches(text, '(?i)conto\\s*corrente\\s*n\\.?\\s*([0-9 /]+)') THEN
  left(regexp_replace(regexp_extract(text, '(?i)conto\\s*corrente\\s*n\\.?\\s*([0-9 /]+)', 1), '\\s+', '', 'g'), 20)
 ELSE right(regexp_extract(replace(text, ' ', ''), '(?i)IT[0-9]{2}[A-Z][0-9]{10,}'), 12) END, '') AS account""")
_text_query("F15_fold_text", lambda: [F.md5(T.fold_text(_text())).alias("folded_text"), T.fold_text(_name()).alias("folded_name")], """
 md5(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'))) AS folded_text, lower(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g')) AS folded_name""")
_months = lambda a: F.array_join(F.transform(a, lambda m: F.concat_ws("-", m["year"], m["month"])), ",")
_text_query("F16_period_months", lambda: [_months(T.period_months(F.col("period"))).alias("months"), T.period_quarter(F.col("period")).alias("quarter"),
                                          T.period_year(F.col("period")).alias("year")], """
 CASE load_order % 3 WHEN 0 THEN '2026-4,2026-5,2026-6' WHEN 1 THEN '2025-7,2025-8,2025-9' ELSE '2024-10,2024-11,2024-12' END AS months,
 CASE load_order % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS quarter, CAST(2026 - load_order % 3 AS INT) AS year""")
_QUARTER = r"""CASE WHEN regexp_matches({n}, '(?:^|[_\s.-])4\s*tr|\biv\s*tr|4[°ºo]') THEN 4 WHEN regexp_matches({n}, '(?:^|[_\s.-])3\s*tr|\biii\s*tr|3[°ºo]') THEN 3
 WHEN regexp_matches({n}, '(?:^|[_\s.-])2\s*tr|\bii\s*tr|2[°ºo]') THEN 2 WHEN regexp_matches({n}, '(?:^|[_\s.-])1\s*tr|\bi\s*tr|1[°ºo]') THEN 1 END"""
_text_query("F17_quarter_in_name", lambda: [T.quarter_in_name(_name()).alias("quarter")], _QUARTER.format(n="lower(name)") + " AS quarter")
_MONTH = r"""coalesce(list_position(['gen','feb','mar','apr','mag','giu','lug','ago','set','ott','nov','dic'],
 nullif(regexp_extract(lower(name), '(gen|feb|mar|apr|mag|giu|lug|ago|set|ott|nov|dic)[\s._-]?[0-9]{2}', 1), '')),
 CASE WHEN TRY_CAST(regexp_extract(name, '\b([0-9]{2})([0-9]{2})([0-9]{2})\b', 2) AS INT) BETWEEN 1 AND 12
  AND TRY_CAST(regexp_extract(name, '\b([0-9]{2})([0-9]{2})([0-9]{2})\b', 1) AS INT) BETWEEN 1 AND 31
 THEN CAST(regexp_extract(name, '\b([0-9]{2})([0-9]{2})([0-9]{2})\b', 2) AS INT) END)"""
_text_query("F18_month_in_name", lambda: [T.month_in_name(_name()).alias("month"), T.date_in_name(_name()).alias("day")], _MONTH + r""" AS month,
 CAST(CASE WHEN regexp_matches(name, '\b[0-9]{6}\b') THEN try_strptime(regexp_extract(name, '\b([0-9]{6})\b', 1), '%d%m%y') END AS DATE) AS day""")
_ALIASES = "[" + ", ".join(f"'{a}'" for a, _ in BANK_ALIASES) + "]"
_BANKS = "[" + ", ".join(f"'{b}'" for _, b in BANK_ALIASES) + "]"
_text_query("F19_bank_key", lambda: [T.bank_key(_name()).alias("bank_key")], f"""coalesce(list_filter({_ALIASES}, lambda a: contains(lower(name), a))[1] || ':' ||
 coalesce(nullif(regexp_extract(lower(name), 'cc[_\\s-]*([0-9]+)', 1), ''), CASE WHEN contains(lower(name), 'usd') THEN 'usd'
  WHEN regexp_matches(lower(name), 'ecomm|e comm|e-comm') THEN 'ecom' ELSE 'cc' END), lower(name)) AS bank_key""")
_ALIAS_KEY = f"coalesce(list_filter({_ALIASES}, lambda a: contains(lower(name), a))[1], list_filter({_ALIASES}, lambda a: contains(lower(concat(name, ' ', text)), a))[1])"
_BANK_LABEL = f"coalesce({_BANKS}[list_position({_ALIASES}, {_ALIAS_KEY})], '{UNKNOWN_BANK}')"
_text_query("F20_bank_alias", lambda: [T.bank_alias(_name(), _text()).alias("bank")], f"{_BANK_LABEL} AS bank")
_text_query("F21_last_print_page", lambda: [F.md5(T.last_print_page(_text())).alias("page_md5")], r"""md5(CASE WHEN contains(text, chr(12)) THEN
 list_filter(string_split(text, chr(12)), lambda p: trim(p) <> '')[-1] WHEN regexp_matches(text, '(?i)pagina\s+[0-9]+') THEN
 regexp_extract(text, '(?is)^(?:.*\n)?([^\n]*pagina\s+[0-9]+.*)$', 1) ELSE text END) AS page_md5""")


def ledger_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    closing = T.ledger_closing(T.last_print_page(_text())).alias("c")
    return files(spark, sf_dir).select("load_order", closing).select("load_order", "c.*")


define("closings", rf"""
SELECT load_order, TRY_CAST(regexp_extract_all(text, '(?i)Pagina\s+([0-9]+)', 1)[-1] AS INT) AS page,
 coalesce(regexp_extract_all(text, '(?i)Progr\.e saldo al\s+([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}})', 1)[-1], regexp_extract_all(text, '{_DATES}', 1)[-1]) AS closing_date,
 CASE WHEN contains(text, 'Sottoconto') THEN concat(trim(regexp_extract(text, 'Sottoconto\s+[^\s]+\s+([^\n]+?)\s\s+Elaborazione', 1)), ' — ',
   trim(regexp_extract(text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}\s+[0-9]+ ([A-Za-z ]+) [0-9.]+,[0-9]{{2}}\n   Progr', 1)))
 ELSE coalesce(regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(9))), lambda s: length(s) >= 4 AND NOT starts_with(s, '-')
   AND regexp_matches(s, '[A-Za-zÀ-ÿ]{{4,}}') AND NOT regexp_matches(s, '(?i)FINE STAMPA|Saldi preced|Progr\.e saldo|Pagina\s+[0-9]+|Elaborazione'))[-1], '\s+', ' ', 'g'), '') END AS description
FROM document_files""", "document_files")
_add("F22_ledger_closing", ledger_pages, "SELECT * FROM closings", "closings")
_text_query("F23_normalise_path", lambda: [T.normalise_path(F.concat(F.lit(".././a//"), F.lit("b\\..\\"), "rel_path", F.lit("/"))).alias("path")],
            "concat('a/', rel_path) AS path")
_text_query("F24_document_key", lambda: [T.document_key(F.col("engagement_id"), F.col("rel_path")).alias("document_id")],
            "left(sha1(concat(engagement_id, ':', rel_path)), 12) AS document_id", ("load_order", "engagement_id"))

# --- classification ------------------------------------------------------------------------------

_FOLD = "lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g'))"


def _rule_rows(rules) -> str:
    return ", ".join(f"({i}, '{item}', {points}, '{needle}')" for i, (item, points, needles) in enumerate(rules) for needle in needles)


_HINT_ROWS = ", ".join(f"({order}, '{item}', {n}, '{hint}')" for order, (item, _, _) in enumerate(CATALOGUE) for n, hint in enumerate(ITEM_HINTS.get(item, [])))
define("folded", f"SELECT *, {_FOLD.format('name')} AS n, {_FOLD.format('rel_path')} AS p, {_FOLD.format('text')} AS t FROM document_files", "document_files")
define("named", f"""
SELECT load_order, item_id, sum(points) AS points, min(rule) AS stage FROM (
 SELECT DISTINCT load_order, item_id, rule, points FROM folded JOIN (VALUES {_rule_rows(NAME_RULES)}) AS r(rule, item_id, points, needle)
 ON contains(concat(p, ' ', n), needle)) x GROUP BY ALL""", "folded")
define("filed", f"""
SELECT load_order, item_id, sum(points) AS points, min(rule) + 100 AS stage FROM (
 SELECT DISTINCT load_order, item_id, rule, points FROM folded JOIN (VALUES {_rule_rows(FOLDER_RULES)}) AS r(rule, item_id, points, needle)
 ON contains(p, needle)) x GROUP BY ALL""", "folded")
define("ruled", """
SELECT load_order, item_id, CAST(sum(points) AS DECIMAL(10,2)) AS points, min(stage) AS stage, bool_or(stage < 100) AS in_name
FROM (SELECT * FROM named UNION ALL SELECT * FROM filed) x GROUP BY ALL""", "named", "filed")
define("wide", """
SELECT d.load_order, d.n, max(points) FILTER (WHERE item_id = 'C.1') AS c1, max(points) FILTER (WHERE item_id = 'C.3') AS c3,
 coalesce(max(points) FILTER (WHERE item_id = 'F.2'), 0) >= 10 AS support, contains(d.n, 'mastrini') AS ledgers,
 NOT contains(d.n, 'mastrini') AND contains(d.n, 'giornale') AND regexp_matches(d.n, 'definitiv|bollat') AS final,
 NOT contains(d.n, 'mastrini') AND contains(d.n, 'giornale') AND NOT regexp_matches(d.n, 'definitiv|bollat') AND contains(d.n, 'provvisor') AS draft
FROM folded d LEFT JOIN ruled r USING (load_order) GROUP BY ALL""", "folded", "ruled")
define("adjusted", """
SELECT load_order, item_id, CAST(CASE
 WHEN item_id = 'C.3' AND c1 >= 8 THEN least(points, 3)
 WHEN item_id = 'C.1' AND c1 >= 8 AND contains(n, 'collegio') THEN greatest(points, coalesce(least(c3, 3), 0) + 1)
 WHEN item_id = 'F.1' AND support THEN least(points, 1)
 WHEN item_id = 'B.4' AND (ledgers OR draft) THEN greatest(points, 16) WHEN item_id = 'B.4' AND final THEN least(points, 3)
 WHEN item_id = 'D.1' AND final THEN greatest(points, 16) WHEN item_id = 'D.1' AND (ledgers OR draft) THEN least(points, 2)
 ELSE points END AS DECIMAL(10,2)) AS points, stage, in_name FROM (
 SELECT load_order, item_id, sum(points) AS points, min(stage) AS stage, bool_or(in_name) AS in_name FROM (
  SELECT * FROM ruled
  UNION ALL SELECT load_order, 'F.1', 0, 200, false FROM wide WHERE support
  UNION ALL SELECT load_order, 'B.4', 0, CASE WHEN final THEN 202 ELSE 201 END, false FROM wide WHERE ledgers OR draft OR final
  UNION ALL SELECT load_order, 'D.1', 0, CASE WHEN final THEN 201 ELSE 202 END, false FROM wide WHERE ledgers OR draft OR final) x GROUP BY ALL) y
JOIN wide USING (load_order)""", "ruled", "wide")
define("hints", f"""
SELECT load_order, item_id, ord, sum(CASE WHEN contains(n, hint) THEN {HINT_POINTS_NAME} ELSE 0 END) AS name_points,
 sum(CASE WHEN contains(n, hint) THEN {HINT_POINTS_NAME} WHEN contains(t, hint) THEN {HINT_POINTS_TEXT} ELSE 0 END) AS all_points
FROM folded JOIN (VALUES {_HINT_ROWS}) AS h(ord, item_id, nth, hint) ON contains(n, hint) OR contains(t, hint) GROUP BY ALL""", "folded")
define("final_points", """
SELECT load_order, item_id, CAST(sum(by_name) AS DECIMAL(10,2)) AS by_name, CAST(sum(by_text) AS DECIMAL(10,2)) AS points,
 bool_or(has_name) AS has_name, min(stage_name) AS stage_name, min(stage) AS stage, bool_or(in_name) AS in_name FROM (
 SELECT load_order, item_id, points AS by_name, points AS by_text, true AS has_name, stage AS stage_name, stage, in_name FROM adjusted
 UNION ALL SELECT load_order, item_id, name_points, all_points, name_points > 0, CASE WHEN name_points > 0 THEN ord + 300 ELSE 999 END, ord + 300,
  name_points > 0 FROM hints) x GROUP BY ALL""", "adjusted", "hints")
define("classified", """
SELECT d.engagement_id, d.load_order, d.name, d.rel_path, d.text, d.excerpt, d.skip, d.period,
 CASE WHEN best_points > 0 THEN best_item END AS item_id,
 CAST(CASE WHEN best_points > 0 THEN round(least(0.95, 0.40 + best_points * 0.06), 2) ELSE 0 END AS DECIMAL(4,2)) AS confidence,
 CASE WHEN coalesce(best_points, 0) <= 0 THEN 'unclassified' WHEN best_in_name THEN 'filename' WHEN NOT sure AND d.text <> '' THEN 'content' ELSE 'folder' END AS method
FROM document_files d LEFT JOIN (
 SELECT load_order, sure, CASE WHEN sure THEN a.item ELSE b.item END AS best_item, CASE WHEN sure THEN a.points ELSE b.points END AS best_points,
  CASE WHEN sure THEN a.in_name ELSE b.in_name END AS best_in_name FROM (
  SELECT *, a IS NOT NULL AND a.points > 0 AND 0.40 + a.points * 0.06 >= 0.55 AS sure FROM (
   SELECT load_order, (array_agg(struct_pack(item := item_id, points := by_name, in_name := in_name) ORDER BY by_name DESC, stage_name) FILTER (WHERE has_name))[1] AS a,
    (array_agg(struct_pack(item := item_id, points := points, in_name := in_name) ORDER BY points DESC, stage))[1] AS b
   FROM final_points GROUP BY 1) x) y) z USING (load_order)""", "document_files", "final_points")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.classify_documents(files(spark, sf_dir))


_add("D01_name_rule_scores", lambda s, d: D.name_rule_scores(files(s, d), ["load_order"]), "SELECT load_order, item_id, CAST(points AS DECIMAL(10,2)) AS points FROM named", "named")
_add("D02_path_rule_scores", lambda s, d: D.path_rule_scores(files(s, d), ["load_order"]), "SELECT load_order, item_id, points FROM ruled", "ruled")
_add("D03_rule_adjustments", lambda s, d: D.rule_adjustments(files(s, d), ["load_order"]), "SELECT load_order, item_id, points FROM adjusted", "adjusted")
_add("D04_hint_scores", lambda s, d: D.hint_scores(files(s, d), ["load_order"]), "SELECT load_order, item_id, points FROM final_points", "final_points")
_RESULT = ["engagement_id", "load_order", "item_id", "confidence", "method"]
_RESULT_SQL = ", ".join(_RESULT)
_add("D05_classify_documents", lambda s, d: classified(s, d).select(*_RESULT), f"SELECT {_RESULT_SQL} FROM classified", "classified")

EXTRA_ROWS = [("E0", 1, 1, "X.1", "Vigilanza"), ("E0", 1, 2, "X.1", "nota"), ("E0", 2, 1, "X.2", "società"), ("E1", 1, 1, "X.3", "nota"), ("E1", 2, 1, "X.4", "prova 1")]
define("extras", "SELECT * FROM (VALUES {}) AS t(engagement_id, item_order, hint_order, item_id, hint)".format(", ".join(map(str, EXTRA_ROWS))))


def extras(spark: SparkSession) -> DataFrame:
    return constant_table(spark, "engagement_id string, item_order int, hint_order int, item_id string, hint string", EXTRA_ROWS)


def unsorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified documents where every fourth one has lost its item."""
    lost = F.col("load_order") % 4 == 1
    return classified(spark, sf_dir).withColumn("item_id", F.when(~lost, F.col("item_id")))


define("unsorted", "SELECT * REPLACE (CASE WHEN load_order % 4 <> 1 THEN item_id END AS item_id) FROM classified", "classified")
_add("D06_client_extra_items", lambda s, d: D.client_extra_items(unsorted_files(s, d), extras(s)).select(*_RESULT), f"""
SELECT engagement_id, load_order, coalesce(x.item_id, u.item_id) AS item_id,
 CASE WHEN x.item_id IS NULL THEN confidence WHEN x.in_name THEN 0.75 ELSE 0.55 END AS confidence,
 CASE WHEN x.item_id IS NULL THEN method WHEN x.in_name THEN 'filename' ELSE 'content' END AS method FROM unsorted u LEFT JOIN (
 SELECT load_order, item_id, in_name, row_number() OVER (PARTITION BY load_order ORDER BY item_order, hint_order) AS rn FROM (
  SELECT u.load_order, e.item_id, e.item_order, e.hint_order, contains({_FOLD.format('u.name')}, {_FOLD.format('e.hint')}) AS in_name
  FROM unsorted u JOIN extras e USING (engagement_id) WHERE u.item_id IS NULL AND (contains({_FOLD.format('u.name')}, {_FOLD.format('e.hint')})
   OR contains({_FOLD.format('u.excerpt')}, {_FOLD.format('e.hint')}) OR contains({_FOLD.format('u.text')}, {_FOLD.format('e.hint')}))) a) x USING (load_order) WHERE coalesce(rn, 1) = 1""", "unsorted", "extras")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        key.alias("load_order"),
        F.when(key % 6 == 0, "").when(key % 6 == 2, "A.1").alias("item_id"),
        F.when(key % 10 == 0, True).alias("skip"),
    )


define("patches", """
SELECT doc_id AS load_order, CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 2 THEN 'A.1' END AS item_id,
 CASE WHEN doc_id % 10 = 0 THEN true END AS skip FROM labels""")
define("assigned", """
SELECT c.engagement_id, c.load_order, c.name, c.rel_path, c.text, c.excerpt, c.period, CASE WHEN p.item_id IS NOT NULL THEN nullif(p.item_id, '') ELSE c.item_id END AS item_id,
 CASE WHEN p.item_id IS NOT NULL THEN 1 ELSE c.confidence END AS confidence, CASE WHEN p.item_id IS NOT NULL THEN 'umano' ELSE c.method END AS method,
 coalesce(p.skip, c.skip) AS skip FROM classified c LEFT JOIN patches p USING (load_order)""", "classified", "patches")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.manual_assignment(classified(spark, sf_dir), patches(spark, sf_dir), ["load_order"])


def assigned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified and corrected documents without their text, stored once a session for the queries that follow."""
    return held(spark, "assigned", sf_dir, lambda: assigned(spark, sf_dir).drop("text"))


_add("D07_manual_assignment", lambda s, d: assigned(s, d).select(*_RESULT, "skip"), f"SELECT {_RESULT_SQL}, skip FROM assigned", "assigned")
_add("D08_unclassified_documents", lambda s, d: D.unclassified_documents(assigned(s, d)).select("engagement_id", "load_order", "name"),
     "SELECT engagement_id, load_order, name FROM assigned WHERE item_id IS NULL", "assigned")

# --- evidence ------------------------------------------------------------------------------------

_ITEM_LIST = ", ".join(f"'{item}'" for item, _, _ in CATALOGUE)
define("engagements", "SELECT DISTINCT engagement_id FROM document_files", "document_files")
define("applicable", f"""
SELECT engagement_id, item_id FROM (SELECT engagement_id, unnest([{_ITEM_LIST}, 'X.1', 'X.3']) AS item_id FROM engagements) t
WHERE NOT (engagement_id = 'E1' AND item_id IN ('E.5', 'F.1', 'X.1')) AND NOT (engagement_id = 'E2' AND item_id IN ('A.1', 'A.2', 'A.3', 'X.1', 'X.3'))
 AND NOT (engagement_id = 'E0' AND item_id = 'X.3')""", "engagements")


def engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("engagement_id").distinct()


def applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that apply to each engagement: the catalogue with exceptions, plus extra items."""
    items = F.explode(F.array(*[F.lit(i) for i in [*D.ITEMS, "X.1", "X.3"]])).alias("item_id")
    rows = engagements(spark, sf_dir).select("engagement_id", items)
    return rows.filter(
        "NOT (engagement_id = 'E1' AND item_id IN ('E.5', 'F.1', 'X.1')) "
        "AND NOT (engagement_id = 'E2' AND item_id IN ('A.1', 'A.2', 'A.3', 'X.1', 'X.3')) AND NOT (engagement_id = 'E0' AND item_id = 'X.3')")


define("found_evidence", """
SELECT engagement_id, item_id, true AS found, rel_path AS source_path, name AS source_name, method, confidence, excerpt, '' AS notes
FROM assigned WHERE NOT skip AND item_id IS NOT NULL AND (engagement_id, item_id) IN (SELECT (engagement_id, item_id) FROM applicable)""", "assigned", "applicable")
define("absent_evidence", f"""
SELECT engagement_id, item_id, false AS found, CAST(NULL AS VARCHAR) AS source_path, CAST(NULL AS VARCHAR) AS source_name, 'scan' AS method, CAST(0 AS DECIMAL(4,2)) AS confidence,
 '' AS excerpt, '{D.ABSENCE_NOTE}' AS notes FROM applicable a
WHERE NOT EXISTS (SELECT 1 FROM assigned d WHERE NOT d.skip AND d.engagement_id = a.engagement_id AND d.item_id = a.item_id)""", "assigned", "applicable")
_add("D09_evidence_found", lambda s, d: D.evidence_found(assigned(s, d), applicable(s, d)), "SELECT * FROM found_evidence", "found_evidence")


_add("D10_evidence_absent", lambda s, d: D.evidence_absent(assigned(s, d), applicable(s, d)), "SELECT * FROM absent_evidence", "absent_evidence")


def _expression(name: str, column: str) -> str:
    """The SQL expression behind an already registered text function."""
    return ORACLE[name].split("SELECT load_order, ", 1)[1].rsplit(f" AS {column}", 1)[0]


_ANY_DATE = f"regexp_extract_all(text, '{_DATES}', 1)[-1]"
_FIELD_SQL = [
    ("('E.1')", "importo", f"CAST({_expression('F10_tax_payment_amount', 'amount')} AS VARCHAR)", "'EUR'"),
    ("('E.1')", "data_versamento", _expression("F13_payment_date", "payment_day"), "NULL"),
    ("('E.1')", "protocollo", _expression("F12_protocol_number", "protocol"), "NULL"),
    ("('F.1')", "saldo_ec", f"CAST({_expression('F11_statement_balance', 'balance')} AS VARCHAR)", "'EUR'"),
    ("('B.4', 'D.1')", "data_ultimo_verbale",
     f"coalesce(regexp_extract_all(text, '(?i)Progr\\.e saldo al\\s+([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}})', 1)[-1], {_ANY_DATE})", "NULL"),
    ("('B.4', 'D.1')", "ultima_pagina", "regexp_extract_all(text, '(?i)Pagina\\s+([0-9]+)', 1)[-1]", "NULL"),
    ("('C.1', 'C.2', 'C.4')", "data_verbale",
     "CASE WHEN regexp_matches(name, '20[0-9]{6}') THEN regexp_replace(regexp_extract(name, '20[0-9]{6}'), '^(....)(..)(..)$', '\\3/\\2/\\1') "
     f"ELSE {_ANY_DATE} END", "NULL"),
]
_add("D11_extract_fields", lambda s, d: D.extract_fields(assigned(s, d), ["engagement_id", "load_order"]),
     "SELECT * FROM (" + " UNION ALL ".join(
         f"SELECT engagement_id, load_order, item_id, '{kind}' AS kind, {value} AS value, CAST({unit} AS VARCHAR) AS unit "
         f"FROM assigned WHERE NOT skip AND item_id IN {items}" for items, kind, value, unit in _FIELD_SQL) + ") t WHERE value IS NOT NULL", "assigned")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a journal listing per engagement, numbered and dated on most rows."""
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), F.col("user_id") % 3).alias("engagement_id"),
        event.alias("load_order"),
        F.when(event % 5 != 0, event % 1000).alias("number"),
        F.when(event % 7 != 0, F.col("ts").cast("date")).alias("registration_date"),
        F.col("event_type").alias("description"),
        F.when(event % 40 == 0, F.floor(event / 40)).alias("page"),
    )


_add("D12_last_registration", lambda s, d: D.last_registration(listing(s, d), ["engagement_id"]), """
SELECT engagement_id, r.number, r.registration_date, r.description, CASE WHEN page > 1 THEN page END AS page FROM (
 SELECT concat('E', user_id % 3) AS engagement_id, arg_max(struct_pack(number := event_id % 1000, registration_date := CAST(ts AS DATE), description := event_type), event_id)
   FILTER (WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 1000 >= 1) AS r,
  max(CASE WHEN event_id % 40 = 0 THEN CAST(floor(event_id / 40) AS BIGINT) END) AS page FROM events GROUP BY 1) t""")
