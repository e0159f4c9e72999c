"""Section status, checklist, missing items, continuity of findings and control figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywright.constants import (
    CATALOGUE, DEFAULT_NEED, JUDGEMENT_NOTE_ITEMS, JUDGEMENT_SECTIONS, SECTION_ITEMS, SECTIONS_NEEDING_FIGURES,
)
from tallywright.functions.ordered import first_n
from tallywright.functions.tables import constant_table
from tallywright.operators.classification import used_documents

SECTIONS = list(SECTION_ITEMS)
PAIR = ["engagement_id", "item_id"]
NO_ITEMS = (
    "Nessuna voce di catalogo collegata a questa sezione per questo cliente "
    "(sezione di solo giudizio umano, oppure tutte le voci collegate sono N/A "
    "per questo cliente): resta wip finché un umano non decide."
)
ALL_SKIPPED = "Tutte le voci collegate sono state saltate per scelta (controllo non richiesto questo trimestre)."
NOT_FOUND = "documento non trovato in cartella"


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(item, label, need, i) for i, (item, label, need) in enumerate(CATALOGUE)]
    return constant_table(spark, "item_id string, label string, need string, item_order int", rows)


def section_items(spark: SparkSession) -> DataFrame:
    rows = [(s, item, i) for s, items in SECTION_ITEMS.items() for i, item in enumerate(items)]
    return constant_table(spark, "section string, item_id string, position int", rows)


def _per_section(engagements: DataFrame, sections: list[str] | None = None) -> DataFrame:
    letters = F.explode(F.array(*[F.lit(s) for s in (sections or SECTIONS)])).alias("section")
    return engagements.select("engagement_id", letters)


def connected_items(applicable: DataFrame, extras: DataFrame) -> DataFrame:
    """(engagement, section, item, position): catalogue items that apply, then the client's extras.

    ``extras``: engagement_id, item_id, section, item_order.
    """
    spark = applicable.sparkSession
    standard = applicable.select(*PAIR).distinct().join(section_items(spark), "item_id").select(
        "engagement_id", "section", "item_id", "position"
    )
    added = extras.select("engagement_id", "section", "item_id", (F.col("item_order") + 1000).alias("position"))
    both = standard.unionByName(added)
    return both.groupBy("engagement_id", "section", "item_id").agg(F.min("position").alias("position"))


def _found_items(evidence: DataFrame) -> DataFrame:
    return evidence.filter("found").select(*PAIR).distinct()


def _skipped_items(overrides: DataFrame) -> DataFrame:
    return overrides.filter(F.col("scope") == "item").select("engagement_id", F.col("target").alias("item_id")).distinct()


def missing_items(connected: DataFrame, evidence: DataFrame, overrides: DataFrame) -> DataFrame:
    """Connected items that no evidence shows and no operator decision excludes."""
    return connected.join(_found_items(evidence), PAIR, "left_anti").join(_skipped_items(overrides), PAIR, "left_anti")


def _ordered_list(items: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(items)), lambda x: x["item_id"]), ", ")


def section_status(engagements: DataFrame, connected: DataFrame, evidence: DataFrame, overrides: DataFrame) -> DataFrame:
    """Status, reasoning and missing items of all nine sections of every engagement.

    Documents are reduced to distinct (engagement, item) pairs first; everything after that is at
    most one row per checklist item of an engagement.
    """
    found = _found_items(evidence).withColumn("_found", F.lit(True))
    skipped = _skipped_items(overrides).withColumn("_skipped", F.lit(True))
    marked = connected.join(found, PAIR, "left").join(skipped, PAIR, "left")
    no = F.lit(False)
    item = F.struct("position", "item_id")
    lacking = ~F.coalesce("_found", no) & ~F.coalesce("_skipped", no)
    summary = marked.groupBy("engagement_id", "section").agg(
        _ordered_list(item).alias("connected_list"),
        _ordered_list(F.when(lacking, item)).alias("missing_list"),
        F.count_if(lacking).alias("missing_count"),
        F.bool_and(F.coalesce("_skipped", no)).alias("all_skipped"),
    )
    decided = overrides.filter(F.col("scope") == "section").groupBy("engagement_id", F.col("target").alias("section")).agg(
        F.min_by("decision", "seq").alias("decision"), F.min_by("note", "seq").alias("note")
    )
    keys = ["engagement_id", "section"]
    rows = _per_section(engagements).join(summary, keys, "left").join(decided, keys, "left")
    c = F.col
    human, empty = c("decision").isNotNull(), c("connected_list").isNull()
    judged = c("section").isin(JUDGEMENT_SECTIONS)
    complete = c("missing_count") == 0
    status = (
        F.when(human, c("decision")).when(empty, "wip").when(c("all_skipped"), "✗")
        .when(complete & ~judged, "✓").otherwise("wip")
    )
    everything = F.concat(F.lit("Tutte le voci collegate ("), c("connected_list"))
    reasoning = (
        F.when(human, F.coalesce(F.nullif(c("note"), F.lit("")), F.lit("Decisione umana applicata all'intera sezione.")))
        .when(empty, NO_ITEMS)
        .when(c("all_skipped"), ALL_SKIPPED)
        .when(complete & ~judged, F.concat(everything, F.lit(") sono state trovate.")))
        .when(complete, F.concat(everything, F.lit(
            ") sono state trovate, ma questa è una sezione di giudizio umano (A/D/H/I): l'app non assegna ✓ da sola.")))
        .otherwise(F.concat(F.lit("Mancano ancora: "), c("missing_list"), F.lit(".")))
    )
    missing = F.when(human, "").otherwise(F.coalesce("missing_list", F.lit("")))
    return rows.select(*keys, status.alias("status"), reasoning.alias("reasoning"), missing.alias("missing_items"))


def evaluate_engagement(
    documents_evidence: DataFrame, applicable: DataFrame, extras: DataFrame, overrides: DataFrame
) -> DataFrame:
    """All nine sections for every engagement that has applicable items."""
    engagements = applicable.select("engagement_id").distinct()
    return section_status(engagements, connected_items(applicable, extras), documents_evidence, overrides)


def latest_result(results: DataFrame) -> DataFrame:
    """Newest result per engagement and section; later insertion wins a tie."""
    newest = F.max_by(F.struct(*results.columns), F.struct("computed_at", "seq")).alias("r")
    return results.groupBy("engagement_id", "section").agg(newest).select("r.*")


def open_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("status") != "sistemato")


def carry_forward_findings(findings: DataFrame, engagements: DataFrame, heads_only: bool = False) -> DataFrame:
    """Copies of each open finding for its client's new engagement, linked to the original.

    ``engagements``: client, engagement_id, period. A finding already carried there is left out.
    All open rows of the client are carried, older links of a chain included; ``heads_only`` keeps
    only the last link of each chain.
    """
    previous = open_findings(findings)
    if heads_only:
        followed = findings.filter("previous_id IS NOT NULL").select(F.col("previous_id").alias("finding_id")).distinct()
        previous = previous.join(followed, "finding_id", "left_anti")
    new = engagements.select("client", F.col("engagement_id").alias("_new"), F.col("period").alias("_period"))
    carried = previous.join(new, "client").filter(F.col("engagement_id") != F.col("_new"))
    done = findings.filter("previous_id IS NOT NULL").select(
        F.col("engagement_id").alias("_new"), F.col("previous_id").alias("finding_id")).distinct()
    fresh = carried.join(done, ["_new", "finding_id"], "left_anti")
    return fresh.select(
        F.left(F.sha1(F.concat_ws(":", "_new", "finding_id")), F.lit(12)).alias("finding_id"),
        "client",
        F.col("_new").alias("engagement_id"),
        F.col("_period").alias("period"),
        "section", "check_no", "kind", "description",
        F.lit("aperto").alias("status"),
        "first_raised_engagement", "first_raised_period",
        F.col("finding_id").alias("previous_id"),
        F.lit(None).cast("string").alias("resolved_in"),
    )


def checklist_status(
    engagements: DataFrame, documents: DataFrame, overrides: DataFrame, shown_names: int = 8
) -> DataFrame:
    """Status and note of every catalogue item of every engagement.

    Names are made distinct and limited to the shown ones before they are listed, so an item with
    very many documents is never gathered. Without documents of its own, the audit-board item
    falls back to assembly minutes that name the board.
    """
    spark = engagements.sparkSession
    used = used_documents(documents).select("engagement_id", "item_id", "name", "load_order")
    board = used.filter((F.col("item_id") == "C.1") & F.contains(F.lower("name"), F.lit("collegio")))
    own = used.filter(F.col("item_id") == "C.3").select("engagement_id").distinct()
    fallback = board.join(own, "engagement_id", "left_anti").withColumn("item_id", F.lit("C.3"))
    names = used.unionByName(fallback).groupBy(*PAIR, "name").agg(F.min("load_order").alias("first"))
    total = names.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("names"))
    top = first_n(names, PAIR, [F.col("first"), F.col("name")], shown_names)
    shown = top.groupBy(*PAIR).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank_no", "name"))), lambda x: x["name"]), ", ").alias("shown")
    )
    decided = overrides.filter(F.col("scope") == "item").groupBy("engagement_id", F.col("target").alias("item_id")).agg(
        F.bool_or(F.col("decision") == "✗").alias("skipped")
    )
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("item_id"), F.lit(n).alias("item_order")) for n, (i, _, _) in enumerate(CATALOGUE)]))
    grid = engagements.select("engagement_id", items.alias("i")).select("engagement_id", "i.*")
    rows = grid.join(total, PAIR, "left").join(shown, PAIR, "left").join(decided, PAIR, "left")
    c = F.col
    more = F.when(c("names") > shown_names, F.concat(F.lit(" (+"), c("names") - shown_names, F.lit(")"))).otherwise("")
    status = F.when(c("skipped"), "✗").when(~c("skipped"), "N/A").when(c("names") > 0, "✓").otherwise("wip")
    note = (
        F.when(c("skipped"), "controllo saltato (operatore)").when(~c("skipped"), "non applicabile")
        .when(c("names") > 0, F.concat("shown", more)).otherwise(NOT_FOUND)
    )
    return rows.select(*PAIR, "item_order", status.alias("status"), note.alias("note"))


def section_light(checklist: DataFrame, figures: DataFrame, skipped_sections: DataFrame) -> DataFrame:
    """Stricter section status from the checklist; C, E and G also need extracted figures.

    ``figures`` and ``skipped_sections``: engagement_id, section.
    """
    spark = checklist.sparkSession
    c = F.col
    per = checklist.join(section_items(spark), "item_id").groupBy("engagement_id", "section").agg(
        F.bool_and(c("status").isin("✓", "✗", "N/A")).alias("closed"), F.bool_or(c("status") == "✓").alias("some")
    )
    keys = ["engagement_id", "section"]
    rows = (
        _per_section(checklist.select("engagement_id").distinct())
        .join(per, keys, "left")
        .join(figures.select(*keys).distinct().withColumn("_figures", F.lit(True)), keys, "left")
        .join(skipped_sections.select(*keys).distinct().withColumn("_skipped", F.lit(True)), keys, "left")
    )
    enough = ~c("section").isin(SECTIONS_NEEDING_FIGURES) | c("_figures").isNotNull()
    done = F.coalesce(c("closed") & c("some"), F.lit(False)) & enough & ~c("section").isin(JUDGEMENT_SECTIONS)
    status = F.when(c("_skipped").isNotNull(), "✗").when(done, "✓").otherwise("wip")
    return rows.select(*keys, status.alias("status"))


def missing_documents(checklist: DataFrame) -> DataFrame:
    """Open items with label and what is needed, catalogue order first, then unknown ids by name."""
    spark = checklist.sparkSession
    still = checklist.filter(F.coalesce("status", F.lit("")).isin("wip", "")).select(*PAIR)
    joined = still.join(catalogue(spark), "item_id", "left")
    return joined.select(
        *PAIR,
        F.coalesce("item_order", F.lit(len(CATALOGUE))).alias("item_order"),
        F.coalesce("label", "item_id").alias("label"),
        F.coalesce("need", F.lit(DEFAULT_NEED)).alias("need"),
    ).orderBy("engagement_id", "item_order", "item_id")


def judgement_notes(engagements: DataFrame, documents: DataFrame, shown: int = 8) -> DataFrame:
    """Per judgement section the first evidences by item, or a fixed note without any."""
    spark = engagements.sparkSession
    rows = [(s, item, i) for s, items in JUDGEMENT_NOTE_ITEMS.items() for i, item in enumerate(items)]
    wanted = constant_table(spark, "section string, item_id string, position int", rows)
    used = used_documents(documents).select("engagement_id", "item_id", "name", "load_order").join(wanted, "item_id")
    top = first_n(used, ["engagement_id", "section"], [F.col("position"), F.col("load_order")], shown)
    label = F.struct("rank_no", F.concat_ws(" ", "item_id", "name").alias("label"))
    listed = top.groupBy("engagement_id", "section").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(label)), lambda x: x["label"]), "; ").alias("labels")
    )
    grid = _per_section(engagements, list(JUDGEMENT_NOTE_ITEMS))
    note = F.coalesce(
        F.concat(F.lit("Evidenza in cartella (nessuna conclusione): "), "labels"),
        F.lit("Nessuna evidenza in cartella; chiusura e testo a mano."),
    )
    return grid.join(listed, ["engagement_id", "section"], "left").select("engagement_id", "section", note.alias("note"))


def control_kpis(documents: DataFrame, checklist: DataFrame, sections: DataFrame) -> DataFrame:
    """Files, classified files, open items (from the checklist, else from documents) and closed sections."""
    files = documents.groupBy("engagement_id").agg(
        F.count(F.lit(1)).alias("files"), F.count("item_id").alias("classified")
    )
    catalogue_ids = [item for item, _, _ in CATALOGUE]
    present = used_documents(documents).filter(F.col("item_id").isin(catalogue_ids)).select(*PAIR).distinct()
    have = present.groupBy("engagement_id").agg(F.count(F.lit(1)).alias("have"))
    filled = F.col("status").isin("✓", "wip", "✗", "N/A")
    items = checklist.groupBy("engagement_id").agg(
        F.count_if(filled).alias("filled"), F.count_if(F.coalesce("status", F.lit("")).isin("wip", "")).alias("open_items")
    )
    done = sections.groupBy("engagement_id").agg(F.count_if(F.col("status") == "✓").alias("sections_done"))
    rows = files.join(have, "engagement_id", "left").join(items, "engagement_id", "left").join(done, "engagement_id", "left")
    missing = F.when(F.col("filled") > 0, F.col("open_items")).otherwise(len(CATALOGUE) - F.coalesce("have", F.lit(0)))
    return rows.select(
        "engagement_id", "files", "classified", missing.alias("missing"), F.coalesce("sections_done", F.lit(0)).alias("sections_done")
    )


def section_board(sections: DataFrame, missing: DataFrame, documents: DataFrame) -> DataFrame:
    """Per section its kind, what is missing, the first document and the share of closed sections.

    Missing items and documents belong to the section whose letter their item starts with.
    """
    letter = F.upper(F.left("item_id", F.lit(1))).alias("section")
    keys = ["engagement_id", "section"]
    needs = missing.select("engagement_id", letter, F.struct("item_order", "need").alias("n")).groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("n")), lambda x: x["need"]), " ").alias("missing_needs")
    )
    first = documents.filter("item_id IS NOT NULL").select("engagement_id", letter, "name", "load_order").groupBy(*keys).agg(
        F.min_by("name", "load_order").alias("first_document")
    )
    closed = sections.groupBy("engagement_id").agg(F.count_if(F.col("status") == "✓").alias("_done"))
    rows = sections.join(needs, keys, "left").join(first, keys, "left").join(closed, "engagement_id")
    c = F.col
    status = F.lower("status")
    kind = (
        F.when((status == "✗") | (status == "error") | F.contains(status, F.lit("anomalia")), "alert")
        .when(c("missing_needs").isNotNull() | status.isin("wip", "pending") | F.contains(status, F.lit("mancante")), "pending")
        .when(status.isin("✓", "done", "completed", "conforme"), "ok")
        .otherwise("idle")
    )
    return rows.select(
        *keys, "status", kind.alias("kind"), F.coalesce("missing_needs", F.lit("")).alias("missing_needs"),
        "first_document", F.round(c("_done") * 100 / 9).cast("int").alias("done_percent"),
    )


def section_detail(
    sections: DataFrame, connected: DataFrame, evidence: DataFrame, missing: DataFrame, findings: DataFrame,
    anomalies: DataFrame | None = None,
) -> DataFrame:
    """Reasoning, found evidence, missing items, anomalies and open findings as one long table.

    ``missing``: engagement_id, section, item_id. ``anomalies``: engagement_id, section, severity,
    item_id, kind, description.
    """
    spark = sections.sparkSession
    keys = ["engagement_id", "section"]
    status = sections.select(*keys, "status")
    none = F.lit("")

    def shape(df: DataFrame, kind, item, label, detail) -> DataFrame:
        return df.select(
            *keys, "status", kind.alias("kind"), item.alias("item_id"), label.alias("label"), detail.alias("detail")
        )

    c = F.col
    reasons = shape(sections, F.lit("Motivazione"), none, c("reasoning"), none)
    shown = evidence.filter("found").join(connected.select(*keys, "item_id"), PAIR).join(status, keys)
    found = shape(
        shown, F.lit("Evidenza"), c("item_id"), F.coalesce("source_name", F.lit("Fonte non disponibile")),
        F.coalesce(F.nullif(c("source_path"), none), "excerpt"),
    )
    needed = missing.select(*keys, "item_id").join(catalogue(spark), "item_id", "left").join(status, keys)
    lacking = shape(
        needed, F.lit("Mancante"), c("item_id"), F.coalesce("label", "item_id"), F.coalesce("need", F.lit(DEFAULT_NEED))
    )
    raised = open_findings(findings)
    noted = shape(
        raised, F.lit("Finding aperto"), none, c("description"),
        F.concat(F.lit("Prima segnalazione: "), c("first_raised_period")),
    )
    parts = reasons.unionByName(found).unionByName(lacking).unionByName(noted)
    if anomalies is not None:
        flagged = anomalies.withColumnRenamed("kind", "_kind").join(status, keys)
        parts = parts.unionByName(
            shape(flagged, F.concat(F.lit("Anomalia: "), c("severity")), F.coalesce("item_id", none), c("_kind"), c("description"))
        )
    return parts
