"""Filtering, searching, sorting and paging of result tables, and source state queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallywright.functions.ordered import BUCKET_ROWS, number_bucket


def filter_results(
    results: DataFrame, to_investigate: bool | None = None, account: str | None = None, minimum_score: int | None = None
) -> DataFrame:
    if to_investigate is not None:
        results = results.filter(F.col("to_investigate") == F.lit(to_investigate))
    if account is not None:
        results = results.filter(F.col("account") == F.lit(account))
    if minimum_score is not None:
        results = results.filter(F.col("risk_score") >= minimum_score)
    return results


def page_results(results: DataFrame, page: int = 1, size: int = 50, width: int = BUCKET_ROWS) -> DataFrame:
    """One page, highest score first, then load order.

    The first page is a distributed top-k. For a later one the rows are counted by score and load-order range; the
    ranges that the page lies in, at most ``size + 1`` of them, follow from these counts, and only their rows are ordered.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    ordered = [F.col("risk_score").desc(), F.col("load_order").asc()]
    if page == 1:
        return results.orderBy(*ordered).limit(size)
    skipped = (page - 1) * size
    placed = results.withColumn("_range", number_bucket("load_order", width))
    counts = placed.groupBy(F.col("risk_score").alias("_score"), F.col("_range").alias("_place")).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy(F.col("_score").desc(), F.col("_place")).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    touched = counts.filter((F.col("_before") < skipped + size) & (F.col("_before") + F.col("_rows") > skipped)).drop("_rows")
    same = F.col("risk_score").eqNullSafe(F.col("_score")) & F.col("_range").eqNullSafe(F.col("_place"))
    rows = placed.join(F.broadcast(touched), same)  # no more rows than the page has, and one
    rank = F.col("_before") + F.row_number().over(W.partitionBy("_score", "_place").orderBy("load_order"))
    chosen = rows.withColumn("_rank", rank).filter((F.col("_rank") > skipped) & (F.col("_rank") <= skipped + size))
    return chosen.orderBy(*ordered).select(*results.columns)


def page_totals(results: DataFrame, size: int = 50) -> DataFrame:
    total = results.agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("pages", F.ceil(F.col("total") / size).cast("bigint"))


def _text(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))


def table_search(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the query as a substring of any column, ignoring case."""
    if not query.strip():
        return df
    cells = F.array(*[_text(name) for name in (columns or df.columns)])
    return df.filter(F.exists(cells, lambda cell: F.contains(cell, F.lit(query.lower()))))


def column_contains(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    for name, wanted in filters.items():
        if wanted and name in df.columns:
            df = df.filter(F.contains(_text(name), F.lit(wanted.lower())))
    return df


def null_aware_sort(df: DataFrame, key: str, direction: str = "asc") -> DataFrame:
    """NULL last when ascending, first when descending."""
    if direction not in ("asc", "desc"):
        raise ValueError("direction is 'asc' or 'desc'")
    return df.orderBy(F.col(key).asc_nulls_last() if direction == "asc" else F.col(key).desc_nulls_first())


def latest_source(sources: DataFrame) -> DataFrame:
    """Newest source per engagement; later insertion wins a tie."""
    newest = F.max_by(F.struct(*sources.columns), F.struct("created_at", "seq"))
    return sources.groupBy("engagement_id").agg(newest.alias("s")).select("s.*")


def analysis_readiness(engagements: DataFrame, sources: DataFrame) -> DataFrame:
    """Per engagement what still blocks the analysis, as counts and a text.

    ``engagements`` has has_parameters; ``sources`` has active, state, file_format.
    """
    waiting = F.col("active") & ~F.col("state").isin("pronta", "errore")
    profiled = F.col("file_format").isin("txt", "pdf")
    per_engagement = sources.groupBy("engagement_id").agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if("active").alias("active_sources"),
        F.count_if(F.col("active") & (F.col("state") == "errore")).alias("sources_in_error"),
        F.count_if(waiting & profiled).alias("sources_without_profile"),
        F.count_if(waiting & ~profiled).alias("sources_without_mapping"),
    )
    counts = ["sources", "active_sources", "sources_in_error", "sources_without_profile", "sources_without_mapping"]
    joined = engagements.join(per_engagement, "engagement_id", "left").fillna(0, counts)
    c = F.col
    blockers = F.array_compact(
        F.array(
            F.when(~c("has_parameters"), "parametri"),
            F.when((c("sources") > 0) & (c("active_sources") == 0), "almeno una fonte attiva"),
            F.when(c("sources") == 0, "nessuna fonte"),
            F.when(c("sources_in_error") > 0, "fonte non valida"),
            F.when(c("sources_without_profile") > 0, "profilo di estrazione"),
            F.when(c("sources_without_mapping") > 0, "mappatura colonne"),
        )
    )
    return joined.select(
        "engagement_id", *counts, F.concat_ws(", ", blockers).alias("blockers"), (F.size(blockers) == 0).alias("ready")
    )
