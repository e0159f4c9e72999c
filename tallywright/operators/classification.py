"""Classification of documents onto the checklist, and the evidence that follows from it.

Rules are constants of the library, so scoring is one projection per document: no join with rule
tables and no pair of document and keyword is ever materialised.

``documents``: engagement_id, load_order, name, rel_path, text, excerpt, skip.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tallywright.constants import CATALOGUE, FOLDER_RULES, HINT_POINTS_NAME, HINT_POINTS_TEXT, ITEM_HINTS, NAME_RULES
from tallywright.functions import text as T
from tallywright.functions.tables import broadcast_if_small

ITEMS = [item for item, _, _ in CATALOGUE]
LABELS = {item: label for item, label, _ in CATALOGUE}
PLACE = {item: i for i, item in enumerate(ITEMS)}
# Points are kept in whole tenths while scoring.
TENTHS = 10
POINTS = "decimal(10,2)"
# Where an item first gets points decides ties: name rules, folder rules, adjustments, hints.
FOLDER_STAGE, ADJUSTED_STAGE, HINT_STAGE, UNSEEN = 100, 200, 300, 999
SURE = 55
ABSENCE_NOTE = "Nessun documento classificato su questa voce dopo la scansione completa della cartella."


def _tenths(points: str) -> int:
    return round(float(points) * TENTHS)


def _any(column: str, needles: list[str]) -> str:
    pattern = "|".join(re.escape(n) for n in needles).replace("\\", "\\\\").replace("'", "\\'")
    return f"{column} RLIKE '{pattern}'"


def _kept(entries: list[str]) -> Column:
    """An array that is computed once: the slice keeps the optimizer from copying it into each access."""
    return F.expr(f"slice(array({', '.join(entries)}), 1, {len(entries)})")


def _rule_sql(column: str, rules, item: str, first_stage: int) -> tuple[str, str]:
    """SQL for an item's points from a rule list (0 when no rule fires) and the stage of its first rule."""
    own = [(stage, _tenths(points), _any(column, needles)) for stage, (i, points, needles) in enumerate(rules, first_stage) if i == item]
    if not own:
        return "0", str(UNSEEN)
    points = " + ".join(f"IF({hit}, {points}, 0)" for _, points, hit in own)
    stages = [f"IF({hit}, {stage}, {UNSEEN})" for stage, _, hit in own]
    return points, stages[0] if len(stages) == 1 else f"least({', '.join(stages)})"


def _with_rules(documents: DataFrame) -> DataFrame:
    """Folded name and path, and ``_rules``: points and stage per item from name and folder.

    A stage of 999 marks an item that no rule has touched.
    """
    folded = documents.withColumns({"_name": T.fold_text(F.col("name")), "_path": T.fold_text(T.normalise_path(F.col("rel_path")))})
    entries = []
    for item in ITEMS:
        named, named_stage = _rule_sql("_blob", NAME_RULES, item, 0)
        filed, filed_stage = _rule_sql("_path", FOLDER_RULES, item, FOLDER_STAGE)
        entries.append(
            f"named_struct('named', {named}, 'filed', {filed}, 'stage', least({named_stage}, {filed_stage}))"
        )
    return folded.withColumn("_blob", F.concat_ws(" ", "_path", "_name")).withColumn("_rules", _kept(entries))


def _with_adjustments(ruled: DataFrame) -> DataFrame:
    """Settle conflicts between items into ``_adjusted``, and count hints in the name."""
    entry = {item: f"_rules[{i}]" for item, i in PLACE.items()}
    points = {item: f"({e}.named + {e}.filed)" for item, e in entry.items()}
    seen = {item: f"({e}.stage < {UNSEEN})" for item, e in entry.items()}
    facts = {
        "_assembly": f"{points['C.1']} >= {8 * TENTHS}",
        "_board": f"IF({points['C.1']} >= {8 * TENTHS} AND {points['C.3']} > 0, least({points['C.3']}, {3 * TENTHS}), {points['C.3']})",
        "_support": f"{points['F.2']} >= {10 * TENTHS}",
        "_ledgers": "contains(_name, 'mastrini')",
        "_final": "NOT contains(_name, 'mastrini') AND contains(_name, 'giornale') AND _name RLIKE 'definitiv|bollat'",
    }
    known = ruled.withColumns({name: F.expr(sql) for name, sql in facts.items()})
    known = known.withColumn(
        "_draft",
        F.expr("NOT _ledgers AND NOT _final AND contains(_name, 'giornale') AND contains(_name, 'provvisor')"),
    )
    provisional = "(_ledgers OR _draft)"
    top, low, under = 16 * TENTHS, 2 * TENTHS, 3 * TENTHS
    first, second = ADJUSTED_STAGE + 1, ADJUSTED_STAGE + 2
    adjusted = {
        "C.3": ("_board", None),
        "C.1": (f"IF(_assembly AND contains(_name, 'collegio'), greatest({points['C.1']}, _board + {TENTHS}), {points['C.1']})", None),
        "F.1": (f"IF(_support, least({points['F.1']}, {TENTHS}), {points['F.1']})", f"IF(_support, {ADJUSTED_STAGE}, {UNSEEN})"),
        "B.4": (
            f"CASE WHEN {provisional} THEN greatest({points['B.4']}, {top}) WHEN _final THEN least({points['B.4']}, {under}) ELSE {points['B.4']} END",
            f"CASE WHEN {provisional} THEN {first} WHEN _final THEN {second} ELSE {UNSEEN} END",
        ),
        "D.1": (
            f"CASE WHEN _final THEN greatest({points['D.1']}, {top}) WHEN {provisional} THEN least({points['D.1']}, {low}) ELSE {points['D.1']} END",
            f"CASE WHEN _final THEN {first} WHEN {provisional} THEN {second} ELSE {UNSEEN} END",
        ),
    }
    entries = []
    for item in ITEMS:
        value, inserted = adjusted.get(item, (points[item], None))
        stage = f"{entry[item]}.stage" if inserted is None else f"least({entry[item]}.stage, {inserted})"
        entries.append(f"named_struct('points', {value}, 'stage', {stage}, 'in_name', {entry[item]}.named > 0)")
    settled = known.withColumn("_adjusted", _kept(entries))
    return settled.withColumn("_named_hints", _kept([_hints_in("_name", item) for item in ITEMS]))


def _contains(column: str, hint: str) -> str:
    return f"contains({column}, '{hint}')"


def _hints_in(column: str, item: str) -> str:
    """Number of an item's hints found in a text; a hint listed twice counts twice."""
    return " + ".join(f"IF({_contains(column, h)}, 1, 0)" for h in ITEM_HINTS.get(item, [])) or "0"


def _hints_only_in(column: str, item: str) -> str:
    found = [f"IF({_contains(column, h)} AND NOT {_contains('_name', h)}, 1, 0)" for h in ITEM_HINTS.get(item, [])]
    return " + ".join(found) or "0"


def _with_hints(adjusted: DataFrame, text: str | None, out: str) -> DataFrame:
    """Items that have points, with their total, first stage and whether the name shows them."""
    if text is not None:
        adjusted = adjusted.withColumn("_text_hints", _kept([_hints_only_in(text, item) for item in ITEMS]))
    name_points, text_points = _tenths(HINT_POINTS_NAME), _tenths(HINT_POINTS_TEXT)
    entries = []
    for item, i in PLACE.items():
        hinted, hints = f"_named_hints[{i}] > 0", f"_named_hints[{i}] * {name_points}"
        if text is not None:
            hinted, hints = f"({hinted} OR _text_hints[{i}] > 0)", f"{hints} + _text_hints[{i}] * {text_points}"
        entries.append(
            f"named_struct('points', _adjusted[{i}].points + {hints}, "
            f"'early', -least(_adjusted[{i}].stage, IF({hinted}, {HINT_STAGE + i}, {UNSEEN})), 'item_id', '{item}', "
            f"'in_name', _adjusted[{i}].in_name OR _named_hints[{i}] > 0)"
        )
    return adjusted.withColumn(out, F.expr(f"filter(array({', '.join(entries)}), e -> e.early > -{UNSEEN})"))


def _as_points(tenths: Column) -> Column:
    return (tenths / F.lit(TENTHS)).cast(POINTS)


def _thousandths(tenths: Column) -> Column:
    """Confidence in thousandths: 0.40 plus 0.06 per point, at most 0.95."""
    return F.least(F.lit(950), F.lit(400) + tenths * 6)


def _exploded(df: DataFrame, entries: str, keys: list[str]) -> DataFrame:
    """One row per item with points; ``entries`` is an array of (points, stage) in catalogue order."""
    items = ", ".join(f"'{item}'" for item in ITEMS)
    # The outer form keeps the optimizer from copying the whole array into a filter on its size.
    rows = df.select(*keys, F.posexplode_outer(F.expr(entries)).alias("_i", "e")).filter(F.col("e.stage") < UNSEEN)
    return rows.select(*keys, F.expr(f"array({items})[_i]").alias("item_id"), _as_points(F.col("e.points")).alias("points"))


def name_rule_scores(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Points per document and item from keywords in path and name; each rule counts once."""
    named = f"transform(_rules, e -> named_struct('points', e.named, 'stage', IF(e.named > 0, 0, {UNSEEN})))"
    return _exploded(_with_rules(documents), named, keys)


def path_rule_scores(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Name points plus the fractional points of folder keywords."""
    both = "transform(_rules, e -> named_struct('points', e.named + e.filed, 'stage', e.stage))"
    return _exploded(_with_rules(documents), both, keys)


def rule_adjustments(documents: DataFrame, keys: list[str]) -> DataFrame:
    return _exploded(_with_adjustments(_with_rules(documents)), "_adjusted", keys)


def _text(text_limit: int | None) -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return T.fold_text(text if text_limit is None else F.left(text, F.lit(text_limit)))


def hint_scores(documents: DataFrame, keys: list[str], text_limit: int | None = None) -> DataFrame:
    """Final points per document and item with the catalogue's hints in name or text."""
    scored = _with_adjustments(_with_rules(documents)).withColumn("_text", _text(text_limit))
    scored = _with_hints(scored, "_text", "_scores")
    return scored.select(*keys, F.explode_outer("_scores").alias("e")).filter("e.item_id IS NOT NULL").select(
        *keys, F.col("e.item_id").alias("item_id"), _as_points(F.col("e.points")).alias("points")
    )


def classify_documents(documents: DataFrame, text_limit: int | None = None) -> DataFrame:
    """Best item, confidence and method per document.

    The text is folded and searched only where the name alone leaves no item or a low confidence.
    """
    columns = documents.columns
    named = _with_hints(_with_adjustments(_with_rules(documents)), None, "_by_name")
    named = named.withColumn("_best_name", F.array_max("_by_name"))
    tenths = F.col("_best_name.points")
    unsure = F.coalesce(tenths <= 0, F.lit(True)) | (_thousandths(tenths) < SURE * 10)
    named = named.withColumn("_text", F.when(unsure, _text(text_limit)))
    both = _with_hints(named, "_text", "_by_text")
    best = F.when(F.col("_text").isNull(), F.col("_best_name")).otherwise(F.array_max("_by_text"))
    chosen = both.withColumn("_best", best)
    found = F.coalesce(F.col("_best.points") > 0, F.lit(False))
    read = F.coalesce(F.col("_text"), F.lit("")) != ""
    method = F.when(~found, "unclassified").when(F.col("_best.in_name"), "filename").when(read, "content").otherwise("folder")
    confidence = F.when(found, _thousandths(F.col("_best.points")) / 1000).otherwise(0).cast("decimal(6,4)")
    return chosen.select(
        *columns,
        F.when(found, F.col("_best.item_id")).alias("item_id"),
        confidence.cast("decimal(4,2)").alias("confidence"),
        method.alias("method"),
    )


def client_extra_items(classified: DataFrame, extras: DataFrame) -> DataFrame:
    """Match unclassified documents with a client's extra items, first item and hint first.

    ``extras``: engagement_id, item_order, hint_order, item_id, hint (a handful per engagement). Hints are
    looked for in the name, the excerpt and, where the table has it, the whole text.
    """
    hint = T.fold_text(F.col("hint"))
    listed = (
        extras.withColumn("hint", hint)
        .filter("hint <> ''")
        .groupBy("engagement_id")
        .agg(F.sort_array(F.collect_list(F.struct("item_order", "hint_order", "item_id", "hint"))).alias("_extras"))
    )
    joined = classified.join(broadcast_if_small(listed, bound=extras), "engagement_id", "left")
    content = [c for c in ("excerpt", "text") if c in classified.columns]
    name, excerpt = T.fold_text(F.col("name")), T.fold_text(F.concat_ws("\n", *content))
    joined = joined.withColumns({"_n": name, "_e": excerpt})
    hits = F.filter(
        "_extras", lambda x: F.contains(F.col("_n"), x["hint"]) | F.contains(F.col("_e"), x["hint"])
    )
    joined = joined.withColumn("_hit", F.when(F.col("item_id").isNull(), F.get(hits, F.lit(0))))
    found = F.col("_hit").isNotNull()
    named = F.contains(F.col("_n"), F.col("_hit.hint"))
    return joined.withColumns(
        {
            "item_id": F.when(found, F.col("_hit.item_id")).otherwise(F.col("item_id")),
            "method": F.when(found, F.when(named, "filename").otherwise("content")).otherwise(F.col("method")),
            "confidence": F.when(found, F.when(named, F.lit("0.75")).otherwise(F.lit("0.55")).cast("decimal(4,2)")).otherwise(
                F.col("confidence")
            ),
        }
    ).drop("_extras", "_n", "_e", "_hit")


def manual_assignment(classified: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """Operator corrections: an item (empty clears it) and/or the skip flag."""
    renamed = patches.select(*key, F.col("item_id").alias("_item"), F.col("skip").alias("_skip"))
    joined = classified.join(renamed, key, "left")
    moved = F.col("_item").isNotNull()
    return joined.withColumns(
        {
            "item_id": F.when(moved, F.nullif(F.col("_item"), F.lit(""))).otherwise(F.col("item_id")),
            "method": F.when(moved, "umano").otherwise(F.col("method")),
            "confidence": F.when(moved, F.lit(1).cast("decimal(4,2)")).otherwise(F.col("confidence")),
            "skip": F.coalesce("_skip", "skip"),
        }
    ).drop("_item", "_skip")


def unclassified_documents(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("item_id").isNull())


def used_documents(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("item_id").isNotNull() & ~F.coalesce("skip", F.lit(False)))


EVIDENCE = ["engagement_id", "item_id", "found", "source_path", "source_name", "method", "confidence", "excerpt", "notes"]


def evidence_found(classified: DataFrame, applicable: DataFrame) -> DataFrame:
    """One row per document that is not skipped and whose item applies to the client."""
    pairs = applicable.select("engagement_id", "item_id").distinct()
    kept = used_documents(classified).join(broadcast_if_small(pairs, bound=applicable), ["engagement_id", "item_id"], "left_semi")
    return kept.select(
        "engagement_id", "item_id", F.lit(True).alias("found"), F.col("rel_path").alias("source_path"),
        F.col("name").alias("source_name"), "method", "confidence", "excerpt", F.lit("").alias("notes"),
    )


def evidence_absent(classified: DataFrame, applicable: DataFrame) -> DataFrame:
    """One row per applicable item without any document: absence is a fact too."""
    present = used_documents(classified).select("engagement_id", "item_id").distinct()
    pairs = applicable.select("engagement_id", "item_id").distinct()
    none = F.lit(None).cast("string")
    return pairs.join(present, ["engagement_id", "item_id"], "left_anti").select(
        "engagement_id", "item_id", F.lit(False).alias("found"), none.alias("source_path"), none.alias("source_name"),
        F.lit("scan").alias("method"), F.lit(0).cast("decimal(4,2)").alias("confidence"), F.lit("").alias("excerpt"),
        F.lit(ABSENCE_NOTE).alias("notes"),
    )


def minutes_date(name: Column, text: Column) -> Column:
    stamp = r"(20\d{2})(\d{2})(\d{2})"
    in_name = F.concat_ws("/", *[F.regexp_extract(name, stamp, i) for i in (3, 2, 1)])
    return F.when(name.rlike(stamp), in_name).otherwise(F.try_element_at(T.find_dates(text), F.lit(-1)))


def extract_fields(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Figures read from a document's text, one row per field, by kind of item."""
    text, item = F.coalesce("text", F.lit("")), F.col("item_id")

    def field(on: Column, kind: str, value: Column, unit: str | None = None) -> Column:
        filled = F.when(on, value.cast("string"))
        return F.struct(F.lit(kind).alias("kind"), filled.alias("value"), F.lit(unit).cast("string").alias("unit"))

    tax, bank = item == "E.1", item == "F.1"
    ledger, minutes = item.isin("B.4", "D.1"), item.isin("C.1", "C.2", "C.4")
    fields = F.array(
        field(tax, "importo", T.tax_payment_amount(text), "EUR"),
        field(tax, "data_versamento", T.payment_date(text)),
        field(tax, "protocollo", T.protocol_number(text)),
        field(bank, "saldo_ec", T.statement_balance(text), "EUR"),
        field(ledger, "data_ultimo_verbale", T.ledger_date(text)),
        field(ledger, "ultima_pagina", T.ledger_page(text)),
        field(minutes, "data_verbale", minutes_date(F.col("name"), text)),
    )
    read = used_documents(classified).filter(item.isin("E.1", "F.1", "B.4", "D.1", "C.1", "C.2", "C.4"))
    long = read.select(*keys, "item_id", F.explode(fields).alias("f")).filter("f.value IS NOT NULL")
    return long.select(*keys, "item_id", "f.kind", "f.value", "f.unit")


def last_registration(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last numbered, dated row of a journal listing and its highest page (above 1)."""
    numbered = (F.col("number") >= 1) & F.col("registration_date").isNotNull()
    last = F.max_by(
        F.struct("number", "registration_date", "description"), F.when(numbered, F.col("load_order"))
    )
    grouped = rows.groupBy(*keys).agg(last.alias("r"), F.max("page").alias("highest_page"))
    return grouped.select(
        *keys, "r.number", "r.registration_date", "r.description",
        F.when(F.col("highest_page") > 1, F.col("highest_page")).alias("page"),
    ).filter("number IS NOT NULL")
