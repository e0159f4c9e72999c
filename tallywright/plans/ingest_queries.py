"""Queries over raw text derived from the tables: sources and sinks (S), cell parsing (F01-F07)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywright.functions import parsing as P
from tallywright.functions.tables import shared_folder
from tallywright.plans.journal_queries import scored, sources as source_table
from tallywright.plans.views import define, define_shared, italian_amount, journal, shared, table, with_views
from tallywright.sources import delimited as D, documents as I, mapping as M, sinks as K, staging as G, text_files as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, build, sql: str | None, *views: str) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE[name] = with_views(sql, *views) if views else sql


_CENTS = "CAST(round(value * 3700) AS BIGINT)"
_DAY, _MONTH, _YEAR = "CAST(day(ts) AS STRING)", "CAST(month(ts) AS STRING)", "CAST(year(ts) AS STRING)"
define_shared("raw_cells", "events", f"""
SELECT event_id AS load_order, concat('S', CAST(event_id % 5 AS STRING)) AS source_id,
 CASE WHEN event_id % 9 = 0 THEN '   ' ELSE concat('  ', event_type, ' ', CAST(user_id AS STRING), ' ') END AS text_cell,
 CASE event_id % 6 WHEN 0 THEN concat({_DAY}, '/', {_MONTH}, '/', {_YEAR}) WHEN 1 THEN concat({_YEAR}, '-', {_MONTH}, '-', {_DAY})
  WHEN 2 THEN concat('3', {_DAY}, '/02/2024') WHEN 3 THEN concat({_DAY}, '-', {_MONTH}, '-', {_YEAR}) WHEN 4 THEN ' '
  ELSE concat(' ', lpad({_DAY}, 2, '0'), '/', lpad({_MONTH}, 2, '0'), '/', {_YEAR}) END AS date_cell,
 CASE event_id % 8 WHEN 0 THEN concat({_DAY}, '/', {_MONTH}, '/', {_YEAR}) WHEN 1 THEN concat({_DAY}, '-', {_MONTH}, '-', {_YEAR})
  WHEN 2 THEN concat({_YEAR}, '-', {_MONTH}, '-', {_DAY}) WHEN 3 THEN concat({_DAY}, '/', {_MONTH}, '/', '24')
  WHEN 4 THEN concat({_DAY}, '-', {_MONTH}, '-', '71') WHEN 5 THEN concat({_DAY}, '.', {_MONTH}, '.', {_YEAR})
  WHEN 6 THEN concat({_DAY}, '.', {_MONTH}, '.', '68') ELSE 'n/d' END AS loose_date_cell,
 CASE event_id % 5 WHEN 0 THEN concat(lpad(CAST(hour(ts) AS STRING), 2, '0'), ':', lpad(CAST(minute(ts) AS STRING), 2, '0'))
  WHEN 1 THEN concat(CAST(hour(ts) AS STRING), ':', CAST(minute(ts) AS STRING), ':07') WHEN 2 THEN '24:10'
  WHEN 3 THEN '' ELSE concat(' ', lpad(CAST(hour(ts) AS STRING), 2, '0'), ':05:59 ') END AS time_cell,
 CASE event_id % 6 WHEN 0 THEN {italian_amount(_CENTS)} WHEN 1 THEN concat('-', {italian_amount(_CENTS)})
  WHEN 2 THEN CAST(CAST(value AS DECIMAL(18,2)) AS STRING) WHEN 3 THEN 'abc' WHEN 4 THEN '  ' ELSE '1 234,5' END AS amount_cell,
 CASE event_id % 7 WHEN 0 THEN concat('€ ', {italian_amount(_CENTS)}) WHEN 1 THEN '1,234.56' WHEN 2 THEN '-' WHEN 3 THEN ''
  WHEN 4 THEN 'n.d.' WHEN 5 THEN '12,5' ELSE concat('$', CAST(CAST(value AS DECIMAL(18,2)) AS STRING)) END AS loose_amount_cell,
 CASE event_id % 5 WHEN 0 THEN concat('EUR ', {italian_amount(_CENTS)}) WHEN 1 THEN concat('circa ', CAST(CAST(value AS DECIMAL(18,2)) AS STRING))
  WHEN 2 THEN 'nessuno' WHEN 3 THEN '-1.234,50 €' ELSE '45,10' END AS free_amount_cell,
 CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS plain_amount FROM {{base}}""")


def _cells(parse, cell: str, out: str):
    return lambda s, d: shared(s, d, "raw_cells").select("load_order", parse(F.col(cell)).alias(out))


def _parse(name: str, parse, cell: str, out: str, sql: str) -> None:
    _add(name, _cells(parse, cell, out), f"SELECT load_order, {sql.replace('@@', cell)} AS {out} FROM raw_cells", "raw_cells")


_TRIM = "trim(@@)"
_LOOSE = """coalesce(CASE WHEN regexp_matches(@@, '^[0-9]+[-/.][0-9]+[-/.][0-9]{4}$')
 THEN try_strptime(translate(@@, '-.', '//'), '%d/%m/%Y') END, CASE WHEN regexp_matches(@@, '^[0-9]{4}-') THEN try_strptime(@@, '%Y-%m-%d') END,
 CASE WHEN regexp_matches(@@, '^[0-9]+[-/.][0-9]+[-/.][0-9]{2}$') THEN try_strptime(concat(regexp_extract(translate(@@, '-.', '//'), '^(.*/)', 1),
  CASE WHEN right(@@, 2) >= '69' THEN '19' ELSE '20' END, right(@@, 2)), '%d/%m/%Y') END)"""
_LOOSE_AMOUNT = """CASE WHEN @@ IN ('-', '', 'n.d.') THEN 0 ELSE CAST(CASE WHEN contains(@@, ',') AND contains(@@, '.') THEN
  CASE WHEN instr(reverse(@@), ',') < instr(reverse(@@), '.') THEN replace(replace(replace(@@, '€ ', ''), '.', ''), ',', '.')
  ELSE replace(@@, ',', '') END ELSE replace(replace(replace(@@, ',', '.'), '$', ''), '€ ', '') END AS DECIMAL(18,2)) END"""
_parse("F01_text_or_null", P.text_or_null, "text_cell", "text", f"nullif({_TRIM}, '')")
_parse("F02_date_strict", P.date_strict, "date_cell", "day", f"""CAST(coalesce(try_strptime({_TRIM}, '%d/%m/%Y'),
 CASE WHEN regexp_matches({_TRIM}, '^[0-9]{{4}}-') THEN try_strptime({_TRIM}, '%Y-%m-%d') END) AS DATE)""")
_parse("F03_time_strict", P.time_strict, "time_cell", "seconds", """CASE WHEN regexp_matches(trim(@@), '^[0-9]+:[0-9]+(:[0-9]+)?$')
 AND CAST(split_part(trim(@@), ':', 1) AS INT) < 24 THEN CAST(split_part(trim(@@), ':', 1) AS INT) * 3600 + CAST(split_part(trim(@@), ':', 2) AS INT) * 60
 + coalesce(TRY_CAST(split_part(trim(@@), ':', 3) AS INT), 0) END""")
_parse("F04_amount_strict", P.amount_strict, "amount_cell", "amount", """TRY_CAST(CASE WHEN contains(@@, ',')
 THEN replace(replace(replace(@@, ' ', ''), '.', ''), ',', '.') ELSE replace(@@, ' ', '') END AS DECIMAL(28,6))""")
_parse("F05_date_lenient", P.date_lenient, "loose_date_cell", "day", f"CAST({_LOOSE} AS DATE)")
_parse("F06_amount_lenient", P.amount_lenient, "loose_amount_cell", "amount", _LOOSE_AMOUNT)
_parse("F07_amount_text", P.amount_text, "free_amount_cell", "amount", """TRY_CAST(CASE WHEN contains(@@, ',') AND contains(@@, '.')
 THEN replace(replace(regexp_replace(@@, '[^0-9.,-]', '', 'g'), '.', ''), ',', '.')
 ELSE replace(regexp_replace(@@, '[^0-9.,-]', '', 'g'), ',', '.') END AS DECIMAL(18,2))""")

# --- lines of text files -------------------------------------------------------------------------

define_shared("fixed_lines", "events", """
SELECT concat('S', CAST(event_id % 3 AS STRING)) AS source_id, CAST(floor(event_id / 3) AS BIGINT) + 1 AS line_number,
 CASE WHEN event_id < 3 THEN '' WHEN event_id < 6 THEN 'ID      DATA      CONTO            IMPORTOUTENTE   ' WHEN event_id % 40 = 0 THEN '  '
  WHEN event_id % 501 = 0 THEN 'corta' ELSE concat(rpad(CAST(event_id AS STRING), 8, ' '), rpad(CAST(CAST(ts AS DATE) AS STRING), 10, ' '),
  rpad(concat('C', CAST(user_id % 40 AS STRING)), 10, ' '), lpad(CAST(CAST(value AS DECIMAL(18,2)) AS STRING), 13, ' '),
  rpad(concat('U', CAST(user_id AS STRING)), 9, ' ')) END AS value FROM {base}""")
FIXED_HEADER = "ID      DATA      CONTO            IMPORTOUTENTE"
FIXED_POSITIONS = {"entry_id": (0, 8), "effective_date": (8, 18), "account": (18, 28), "net_amount": (28, 41), "user_name": (41, 50)}


_add("S01_fixed_width_scan", lambda s, d: T.fixed_width_scan(shared(s, d, "fixed_lines"), FIXED_HEADER, FIXED_POSITIONS), """
SELECT source_id, line_number, CASE WHEN ok THEN substr(value, 1, 8) END AS entry_id, CASE WHEN ok THEN substr(value, 9, 10) END AS effective_date,
 CASE WHEN ok THEN substr(value, 19, 10) END AS account, CASE WHEN ok THEN substr(value, 29, 13) END AS net_amount,
 CASE WHEN ok THEN substr(value, 42, 9) END AS user_name,
 CASE WHEN NOT ok THEN concat('Riga ', line_number, ' troppo corta: ', length(value), ' caratteri, ne servono almeno 50 per il profilo') END AS error
FROM (SELECT *, length(value) >= 50 AS ok FROM fixed_lines) t WHERE trim(value) <> '' AND line_number > 2""", "fixed_lines")


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = T.header_probe(shared(spark, sf_dir, "fixed_lines"))
    return probe.withColumn("example_lines", F.array_join("example_lines", "|"))


_add("S02_header_probe", probed, """
SELECT source_id, min(line_number) FILTER (WHERE rn = 1) - 1 AS header_index, max(value) FILTER (WHERE rn = 1) AS header,
 string_agg(value, '|' ORDER BY line_number) FILTER (WHERE rn > 1) AS example_lines FROM (
 SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_number) AS rn FROM fixed_lines WHERE trim(value) <> '') t
WHERE rn <= 6 GROUP BY 1""", "fixed_lines")


def matched_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    headers = part.select(F.col("p_partkey").alias("source_id"), F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("header"))
    profiles = part.filter("p_size % 5 <> 0").select(
        F.col("p_partkey").alias("profile_id"), F.col("p_name").alias("header_text"), F.col("p_size").alias("created_at"))
    return T.profile_match(headers, profiles)


_add("S03_profile_match", matched_profiles, """
SELECT p_partkey AS source_id, concat(' ', p_name, '  ') AS header, profile_id FROM part LEFT JOIN (
 SELECT p_name AS n, p_partkey AS profile_id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey DESC) AS rn
  FROM part WHERE p_size % 5 <> 0) t WHERE rn = 1) q ON p_name = n""")


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes: every third one in a single-byte encoding, some with control characters."""
    text = F.regexp_replace("text", r"[^\x00-\xFF]", "?")
    noisy = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("\x01" * 4), F.left(text, F.lit(150)))).otherwise(text)
    content = F.when(F.col("doc_id") % 3 == 0, F.encode(noisy, "ISO-8859-1")).otherwise(F.encode(noisy, "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.text_decode(encoded_documents(spark, sf_dir)).select("doc_id", "encoding", F.md5("text").alias("text_md5"))


_add("S04_text_decode", decoded, """
SELECT doc_id, CASE WHEN noisy THEN NULL WHEN doc_id % 3 = 0 AND regexp_matches(t, '[^\\x00-\\x7F]') THEN 'cp1252' ELSE 'utf-8' END AS encoding,
 CASE WHEN noisy THEN NULL ELSE md5(t) END AS text_md5
FROM (SELECT doc_id, doc_id % 11 = 0 AS noisy, regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g') AS t FROM documents) x""")

define_shared("delimited_lines", "events", """
SELECT concat('S', CAST(event_id % 2 AS STRING)) AS source_id, CAST(floor(event_id / 2) AS BIGINT) + 1 AS line_number,
 CASE WHEN event_id < 2 THEN 'N. Reg.;Data Reg.;Conto;Dare;Avere' WHEN event_id < 4 THEN '---;---;---;---;---'
  WHEN event_id % 25 = 0 THEN ' ; ;;;' WHEN event_id % 26 = 0 THEN ''
  ELSE concat(CAST(event_id AS STRING), ';', CAST(CAST(ts AS DATE) AS STRING), ';C', CAST(user_id % 40 AS STRING), ';',
   CAST(CAST(value AS DECIMAL(18,2)) AS STRING), ';0') END AS value FROM {base}""")


def delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.delimited_journal_scan(shared(spark, sf_dir, "delimited_lines"), width=5, header_row=0, skip_rows=1)
    return rows.select("source_id", "line_number", *[F.col("cells")[i].alias(f"c{i}") for i in range(5)])


_add("S05_delimited_journal_scan", delimited, """
SELECT source_id, line_number, split_part(value, ';', 1) AS c0, split_part(value, ';', 2) AS c1, split_part(value, ';', 3) AS c2,
 split_part(value, ';', 4) AS c3, split_part(value, ';', 5) AS c4 FROM delimited_lines
WHERE line_number > 2 AND trim(replace(value, ';', '')) <> ''""", "delimited_lines")

define_shared("header_cells", "part", """
SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS source_id, p_partkey % 12 + 1 AS position,
 CASE p_partkey % 17 WHEN 0 THEN 'N. Reg.' WHEN 1 THEN 'Data Reg.' WHEN 2 THEN ' Data Doc. ' WHEN 3 THEN 'Descrizione Conto' WHEN 4 THEN 'CONTO'
  WHEN 5 THEN 'Importo Dare' WHEN 6 THEN 'Importo Avere' WHEN 7 THEN 'Causale' WHEN 8 THEN 'Rif. Doc.' WHEN 9 THEN 'Dare'
  WHEN 10 THEN concat('Dare', CASE WHEN p_size % 2 = 0 THEN '' ELSE ' 2' END) WHEN 11 THEN CASE WHEN p_size % 9 = 0 THEN ' ' ELSE 'Z' END
  ELSE p_name END AS header FROM {base}""")
_CANDIDATE_SQL = ", ".join(
    f"('{field}', {i}, '{name.lower()}')" for field, names in D.HEADER_CANDIDATES.items() for i, name in enumerate(names))
_add("S06_header_autodetect", lambda s, d: D.header_autodetect(shared(s, d, "header_cells")), f"""
SELECT source_id, field, position FROM (
 SELECT source_id, field, position, row_number() OVER (PARTITION BY source_id, field ORDER BY cand, position) AS rn
 FROM header_cells JOIN (VALUES {_CANDIDATE_SQL}) AS c(field, cand, name)
 ON contains(lower(trim(header)), name) OR contains(name, lower(trim(header)))) t WHERE rn = 1""", "header_cells")
_add("S07_unique_headers", lambda s, d: D.unique_headers(shared(s, d, "header_cells")), """
SELECT source_id, position, header, CASE WHEN rn = 1 THEN base ELSE concat(base, ' [', rn, ']') END AS unique_header FROM (
 SELECT *, row_number() OVER (PARTITION BY source_id, base ORDER BY position) AS rn FROM (
  SELECT *, coalesce(nullif(trim(header), ''), concat('Colonna ', position)) AS base FROM header_cells) t) u""", "header_cells")

# --- mapping and staging -------------------------------------------------------------------------

MAPPING = {
    "effective_date": "Data Reg.", "created_date": "Data Reg. [2]", "created_seconds": "C TIME", "entry_id": "Riga N.",
    "document_number": "Doc.No.", "debit": "Importo Dare", "credit": "Importo Avere", "description": "Descrizione",
    "user_name": "USER", "account": "Conto contabile",
}


def raw_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreadsheet-like text columns, a few of them unreadable."""
    c = F.col
    base = shared(spark, sf_dir, "raw_cells")
    bad_date = c("load_order") % 211 == 0
    amount = F.when(c("load_order") % 307 == 0, "abc").otherwise(F.replace("plain_amount", F.lit("."), F.lit(",")))
    return base.select(
        "load_order",
        "source_id",
        F.when(c("load_order") % 401 == 0, " ").otherwise(c("load_order").cast("string")).alias("Riga N."),
        F.lit(None).cast("string").alias("Doc.No."),
        F.when(bad_date, "31/02/2024").otherwise("1/11/2024").alias("Data Reg."),
        F.lit("2024-11-05").alias("Data Reg. [2]"),
        F.lit("08:30").alias("C TIME"),
        F.lit(" 36422000002 ").alias("Conto contabile"),
        F.when(c("load_order") % 2 == 0, amount).alias("Importo Dare"),
        F.when(c("load_order") % 2 == 1, amount).otherwise(" ").alias("Importo Avere"),
        c("text_cell").alias("Descrizione"),
        F.lit("USER1").alias("USER"),
    )


define("mapped", """
SELECT load_order, source_id, CASE WHEN load_order % 211 <> 0 THEN DATE '2024-11-01' END AS effective_date, DATE '2024-11-05' AS created_date,
 30600 AS created_seconds, CASE WHEN load_order % 401 <> 0 THEN CAST(load_order AS VARCHAR) END AS entry_id, CAST(NULL AS VARCHAR) AS document_number,
 CASE WHEN load_order % 307 = 0 THEN 0 WHEN load_order % 2 = 0 THEN CAST(plain_amount AS DECIMAL(18,2)) ELSE -CAST(plain_amount AS DECIMAL(18,2)) END AS net_amount,
 nullif(trim(text_cell), '') AS description, 'USER1' AS user_name, '36422000002' AS account,
 concat_ws(',', CASE WHEN load_order % 211 = 0 THEN 'effective_date' END, CASE WHEN load_order % 401 = 0 THEN 'entry_id' END,
  CASE WHEN load_order % 307 = 0 THEN 'net_amount' END) AS rejected FROM raw_cells""", "raw_cells")


def mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.map_journal(raw_journal(spark, sf_dir), MAPPING)


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumn("rejected", F.array_join("rejected", ","))


_add("S08_map_journal", lambda s, d: M.accepted_rows(mapped_rows(s, d)), "SELECT * EXCLUDE (rejected) FROM mapped WHERE rejected = ''", "mapped")

define_shared("mapping_rows", "part", """
SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS mapping_id,
 CASE p_partkey % 7 WHEN 0 THEN 'entry_id' WHEN 1 THEN 'effective_date' WHEN 2 THEN 'net_amount' WHEN 3 THEN 'debit' WHEN 4 THEN 'account'
  WHEN 5 THEN CASE WHEN p_size % 3 = 0 THEN 'importo' ELSE 'description' END ELSE 'user_name' END AS field,
 concat('col', CAST(p_size % 12 AS STRING)) AS column_name FROM {base}""")
define_shared("mapping_headers", "part", """
SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS mapping_id, concat('col', CAST((p_size + p_partkey) % 12 AS STRING)) AS header FROM {base}""")
_FIELD_VIOLATIONS = """SELECT DISTINCT mapping_id, 'unknown_field' AS violation, field AS item FROM {rows} WHERE field NOT IN ('effective_date',
 'created_date', 'created_seconds', 'entry_id', 'document_number', 'net_amount', 'description', 'user_name', 'account', 'debit', 'credit')
UNION ALL SELECT mapping_id, 'missing_field', 'entry_id' FROM {rows} GROUP BY 1 HAVING NOT bool_or(field = 'entry_id')
UNION ALL SELECT mapping_id, 'missing_field', 'effective_date' FROM {rows} GROUP BY 1 HAVING NOT bool_or(field = 'effective_date')
UNION ALL SELECT mapping_id, 'missing_field', 'net_amount' FROM {rows} GROUP BY 1 HAVING NOT bool_or(field IN ('net_amount', 'debit', 'credit'))"""
_add("S09_validate_mapping", lambda s, d: M.validate_mapping(shared(s, d, "mapping_rows"), shared(s, d, "mapping_headers")), f"""
SELECT DISTINCT mapping_id, 'unknown_column' AS violation, column_name AS item FROM mapping_rows m
WHERE NOT EXISTS (SELECT 1 FROM mapping_headers h WHERE h.mapping_id = m.mapping_id AND h.header = m.column_name)
UNION ALL {_FIELD_VIOLATIONS.replace('{rows}', 'mapping_rows')}""", "mapping_rows", "mapping_headers")


def profile_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared(spark, sf_dir, "mapping_rows")
    start = F.regexp_extract("column_name", "([0-9]+)", 1).cast("int") - 1
    return rows.select("mapping_id", "field", start.alias("start"), F.lit(8).alias("end"))


_add("S09_validate_profile", lambda s, d: M.validate_profile(profile_positions(s, d)), f"""
SELECT mapping_id, 'bad_range' AS violation, field AS item FROM mapping_rows
WHERE CAST(substr(column_name, 4) AS INT) - 1 < 0 OR 8 <= CAST(substr(column_name, 4) AS INT) - 1
UNION ALL {_FIELD_VIOLATIONS.replace('{rows}', 'mapping_rows')}""", "mapping_rows")
_add("S10_reject_rows", lambda s, d: _listed(M.reject_rows(mapped_rows(s, d))), "SELECT * FROM mapped WHERE rejected <> ''", "mapped")

define("staged", """
SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position) AS row_number, sha256(concat('{"effective_date":"', effective_date,
 '","created_date":', coalesce('"' || created_date || '"', 'null'), ',"created_seconds":', coalesce(CAST(created_seconds AS VARCHAR), 'null'),
 ',"entry_id":"', entry_id, '","document_number":', coalesce('"' || document_number || '"', 'null'), ',"net_amount":', net_amount,
 ',"description":', coalesce('"' || description || '"', 'null'), ',"user_name":', coalesce('"' || user_name || '"', 'null'),
 ',"account":', coalesce('"' || account || '"', 'null'), '}')) AS row_hash FROM (
 SELECT source_id, load_order AS position, effective_date, created_date, created_seconds, entry_id, document_number, net_amount, description,
  user_name, account FROM journal
 UNION ALL SELECT 'S9', load_order, effective_date, created_date, created_seconds, entry_id, document_number, net_amount, description,
  user_name, account FROM journal WHERE load_order % 10 = 0) t""", "journal")


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal rows of several sources; source S9 repeats every tenth row."""
    rows = journal(spark, sf_dir).withColumnRenamed("load_order", "position").drop("engagement_id")
    repeated = rows.filter("position % 10 = 0").withColumn("source_id", F.lit("S9"))
    return G.stage_rows(rows.unionByName(repeated), "position")


_STAGED = ["source_id", "position", "row_number", "row_hash"]
_add("S11_stage_rows", lambda s, d: staged(s, d).select(*_STAGED), f"SELECT {', '.join(_STAGED)} FROM staged", "staged")

define("journal_sources", """
SELECT source_id, engagement_id, active, state, created_at FROM (
 SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS source_id, 'P1' AS engagement_id, s_suppkey <> 2 AS active,
  CASE WHEN s_suppkey = 4 THEN 'errore' ELSE 'pronta' END AS state, -(s_suppkey % 2) AS created_at FROM supplier) t""")


def journal_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), key).alias("source_id"), F.lit("P1").alias("engagement_id"), (key != 2).alias("active"),
        F.when(key == 4, "errore").otherwise("pronta").alias("state"), (-(key % 2)).alias("created_at"),
        F.concat(F.lit("giornale_"), key, F.lit(".txt")).alias("file_name"))


define("united", """
SELECT s.*, engagement_id, rank * 1000000000000 + row_number AS load_order FROM staged s JOIN (
 SELECT *, row_number() OVER (PARTITION BY engagement_id ORDER BY created_at, source_id) AS rank FROM journal_sources
 WHERE active AND state = 'pronta') r USING (source_id)""", "staged", "journal_sources")
_UNITED = ["engagement_id", "source_id", "row_number", "row_hash", "load_order"]


def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.union_active_sources(staged(spark, sf_dir), journal_sources(spark, sf_dir))


_add("S12_union_active_sources", lambda s, d: united(s, d).select(*_UNITED), f"SELECT {', '.join(_UNITED)} FROM united", "united")
_add("S13_drop_identical_rows", lambda s, d: G.drop_identical_rows(united(s, d)).select(*_UNITED), f"""
SELECT {', '.join(_UNITED)} FROM (SELECT *, row_number() OVER (PARTITION BY engagement_id, row_hash ORDER BY load_order) AS rn FROM united) t
WHERE rn = 1""", "united")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return T.source_fingerprint(files)


_add("S14_source_fingerprint", fingerprints, """
SELECT concat('doc_', doc_id) AS path, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS INT) AS size_bytes FROM documents""")
_add("S14_identical_files", lambda s, d: T.identical_files(fingerprints(s, d)), """
SELECT sha256(text) AS sha256, CAST(octet_length(encode(text)) AS INT) AS size_bytes, count(*) AS files, min(concat('doc_', doc_id)) AS first_path
FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")

define_shared("folder_files", "documents", """
SELECT concat('E', CAST(doc_id % 3 AS STRING)) AS engagement_id, n_chars AS size_bytes, text,
 concat(CASE doc_id % 5 WHEN 0 THEN 'F_Banche/2026/' WHEN 1 THEN './C_Libri/../B_Bilancio/' WHEN 2 THEN '/output/' WHEN 3 THEN 'E' || chr(92) || 'F24/'
  ELSE '' END, CASE doc_id % 9 WHEN 0 THEN '~$bozza.docx' WHEN 1 THEN 'Thumbs.db' WHEN 2 THEN 'Template WPS.xlsx' WHEN 3 THEN 'foto.bmp' WHEN 4 THEN '.nascosto.txt'
  ELSE 'Atto_' || CAST(doc_id AS STRING) || '.TXT' END) AS path FROM {base}""")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = I.document_inventory(shared(spark, sf_dir, "folder_files"))
    return listed.select("engagement_id", "document_id", "name", "rel_path", "extension", "size_bytes", "excerpt")


_add("S15_document_inventory", inventory, """
SELECT engagement_id, left(sha1(concat(engagement_id, ':', p)), 12) AS document_id, regexp_extract(p, '[^/]*$') AS name, p AS rel_path,
 '.txt' AS extension, size_bytes, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 280) AS excerpt FROM (
 SELECT *, replace(replace(trim(path, '/'), './C_Libri/../', ''), chr(92), '/') AS p FROM folder_files) t
WHERE path LIKE '%Atto_%' AND NOT starts_with(path, '/output/')""", "folder_files")


def balance_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the text rows of a trial balance with aliased headers."""
    c = F.col("c_custkey")
    money = lambda x: F.replace(x.cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    balance = F.col("c_acctbal").cast("decimal(18,2)")
    prior = F.when(c % 7 == 0, "").when(c % 7 == 1, "0,00").otherwise(money(balance * F.lit(0.9).cast("decimal(2,1)")))
    return table(spark, sf_dir, "customer").select(
        F.when(c % 50 == 0, "").otherwise(F.concat(F.lit(" "), c.cast("string"))).alias(" Conto"),
        F.col("c_name").alias("Descrizione"),
        F.when(c % 11 == 0, F.lit(None).cast("string")).otherwise(money(balance)).alias("SALDO"),
        prior.alias("Saldo N-1"),
    )


define("trial_balance", """
SELECT CAST(c_custkey AS VARCHAR) AS account, c_name AS name, CASE WHEN c_custkey % 11 <> 0 THEN b END AS amount,
 CASE WHEN c_custkey % 7 = 1 THEN 0 WHEN c_custkey % 7 <> 0 THEN CAST(round(b * 0.9, 2) AS DECIMAL(18,2)) END AS prior
FROM (SELECT *, CAST(c_acctbal AS DECIMAL(18,2)) AS b FROM customer) t WHERE c_custkey % 50 <> 0""")
_add("S16_trial_balance_scan", lambda s, d: D.trial_balance_scan(balance_sheet(s, d)), "SELECT * FROM trial_balance", "trial_balance")

# --- sinks ---------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all engagements, replace one of them by its non-zero rows, read the table back."""
    rows = journal(spark, sf_dir).select("engagement_id", "load_order", "net_amount")
    path = _folder(spark, "replace_partition")
    K.replace_partition(rows, path)
    K.replace_partition(rows.filter("engagement_id = 'E1' AND net_amount <> 0"), path)
    return spark.read.parquet(path).select("engagement_id", "load_order", "net_amount")


_add("S17_replace_partition", replaced,
     "SELECT engagement_id, load_order, net_amount FROM journal WHERE engagement_id <> 'E1' OR net_amount <> 0", "journal")


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append two batches; a third one with a stored id is refused and leaves no trace; the rest comes last."""
    rows = journal(spark, sf_dir).select(F.col("load_order").alias("id"), "net_amount")
    path = _folder(spark, "append_only")
    K.append_only_write(rows.filter("id % 2 = 0"), path)
    K.append_only_write(rows.filter("id % 4 = 1"), path)
    try:
        K.append_only_write(rows.filter("id % 4 <> 2"), path)
    except ValueError:
        pass
    K.append_only_write(rows.filter("id % 4 = 3"), path)
    return spark.read.parquet(path)


_add("S18_append_only_write", appended,
     "SELECT load_order AS id, net_amount FROM journal", "journal")


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("row_number", F.col("load_order") + 1)
    return K.export_results(rows, journal_sources(spark, sf_dir).filter("source_id <> 'S3'"), to_investigate=True)


_add("S19_export_results", exported, """
SELECT entry_id AS "ID registrazione", document_number AS "Numero documento", effective_date AS "Data effettiva", account AS "Conto contabile",
 net_amount AS "Importo netto", description AS "Descrizione", user_name AS "Utente", risk_score AS "Punteggio", 'Sì' AS "Da investigare",
 reasons AS "Criteri scattati", CASE WHEN source_id = 'S3' THEN '' ELSE concat('giornale_', substr(source_id, 2), '.txt') END AS "Fonte",
 load_order + 1 AS "Riga fonte" FROM scored WHERE to_investigate""", "scored")
