"""Text sources: numbered lines, encodings, fingerprints, headers and fixed-width columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallywright.functions.ordered import first_n
from tallywright.functions.parsing import strip
from tallywright.functions.tables import broadcast_if_bounded, planned_bytes, session_bytes

SUMMARY_ROW_BYTES = 300
LINE_SUMMARY_LIMIT = 64 * 1024 * 1024


# --- Fixed values: characters of code page 1252 that differ from Latin-1, bytes 80 to 9F ---------
CP1252_BYTES = "80 82 83 84 85 86 87 88 89 8A 8B 8C 8E 91 92 93 94 95 96 97 98 99 9A 9B 9C 9E 9F"
CP1252_CHARACTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNDEFINED = r"[\x81\x8D\x8F\x90\x9D]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _western(latin: Column) -> Column:
    """Code page 1252 from bytes read as Latin-1."""
    return F.translate(latin, "".join(chr(int(code, 16)) for code in CP1252_BYTES.split()), CP1252_CHARACTERS)


ENCODINGS = ("utf-8", "cp1252", "latin-1")


def read_lines(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """(source_id, line_number, value, encoding) for every line of the files under ``path``, each file in its own encoding.

    A file has the first of ``encodings`` that all its bytes fit and in which it is readable, as in ``text_decode``; a
    file that fits none keeps its lines with NULL value and encoding. Lines are cut at line breaks, which are the same
    bytes in all three, and decoded where they lie.

    A line's place in its file follows from its place in the scanned split and the number of lines in
    earlier splits, so no line is shuffled: only one summary row per split is aggregated, which also says what bytes
    the split has. That table is broadcast when the files' own size proves it small, and joined by shuffle otherwise.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        "value",
        F.monotonically_increasing_id().alias("_at"),
    )
    single = F.decode(F.col("value").cast("binary"), "ISO-8859-1")  # one character per byte
    whole = F.is_valid_utf8("value")
    splits = raw.groupBy("source_id", "_block").agg(
        F.min("_at").alias("_base"), F.count(F.lit(1)).alias("_lines"), F.min(whole).alias("_utf8"),
        F.max(F.when(whole, False).otherwise(F.rlike(single, F.lit(CP1252_UNDEFINED)))).alias("_undefined"),
        F.max(F.contains("value", F.lit("\x00"))).alias("_nul"), F.sum(F.regexp_count(single, F.lit(CONTROLS))).alias("_controls"),
        F.sum(F.length(single) + 1).alias("_size"))
    every = W.partitionBy("source_id")
    before = every.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    readable = ~F.max("_nul").over(every) & (F.sum("_controls").over(every) <= F.greatest(F.lit(1), F.floor(F.sum("_size").over(every) / 100)))
    fits = {"utf-8": F.min("_utf8").over(every), "cp1252": ~F.max("_undefined").over(every), "latin-1": F.lit(True)}
    encoding = F.lit(None).cast("string")
    for name in reversed(encodings):
        encoding = F.when(readable & fits[name], name).otherwise(encoding)
    splits = splits.select(
        "source_id", "_block", "_base", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_earlier"), encoding.alias("encoding"))
    size = planned_bytes(spark.read.text(path))
    split_bytes = session_bytes(spark, "spark.sql.files.maxPartitionBytes", 128 * 1024 * 1024)
    bound = None if size is None else (size // max(split_bytes, 1) + 1 + len(raw.inputFiles())) * SUMMARY_ROW_BYTES
    if bound is not None and bound <= LINE_SUMMARY_LIMIT:
        splits = F.broadcast(splits)
    line = (F.col("_at") - F.col("_base") + F.col("_earlier") + 1).alias("line_number")
    text = F.when(F.col("encoding") == "utf-8", F.col("value")).when(F.col("encoding") == "cp1252", _western(single)).when(
        F.col("encoding") == "latin-1", single)
    return raw.join(splits, ["source_id", "_block"]).select("source_id", line, text.alias("value"), "encoding")


def _is_blank(c: Column) -> Column:
    return strip(c) == ""


def header_probe(lines: DataFrame, examples: int = 5) -> DataFrame:
    """First non-blank line of each source, its 0-based index and the next non-blank lines."""
    filled = lines.filter(~_is_blank(F.col("value")))
    top = first_n(filled, ["source_id"], [F.col("line_number")], examples + 1)
    rest = F.sort_array(F.collect_list(F.when(F.col("rank_no") > 1, F.struct("line_number", "value"))))
    return top.groupBy("source_id").agg(
        (F.min("line_number") - 1).alias("header_index"),
        F.min_by("value", "line_number").alias("header"),
        F.transform(rest, lambda s: s["value"]).alias("example_lines"),
    )


def profile_match(headers: DataFrame, profiles: DataFrame) -> DataFrame:
    """The newest profile whose stored header equals a file's header without outer blanks."""
    newest = profiles.groupBy(strip(F.col("header_text")).alias("_header")).agg(
        F.max_by("profile_id", F.struct("created_at", "profile_id")).alias("profile_id")
    )
    keyed = headers.withColumn("_header", strip(F.col("header")))
    return keyed.join(newest, "_header", "left").drop("_header")


def fixed_width_scan(lines: DataFrame, header: str, positions: dict[str, tuple[int, int]]) -> DataFrame:
    """Cut every non-blank line after the header by 0-based half-open offsets.

    The header is the first non-blank line of a source. Where it isn't ``header`` (outer blanks apart) the source is
    refused: its only row stands for that line, has NULL fields and an ``error`` that says so. Lines shorter than the
    largest end keep NULL fields and an ``error`` naming their line number.
    """
    value, number = F.col("value"), F.col("line_number")
    filled, same = ~_is_blank(value), strip(value) == F.lit(header.strip())
    tops = lines.groupBy("source_id").agg(F.min(F.when(filled, number)).alias("_top"), F.min(F.when(same, number)).alias("_match"))
    body = lines.filter(filled).join(broadcast_if_bounded(tops, lines, 1), "source_id")
    refused = ~F.col("_top").eqNullSafe(F.col("_match"))
    body = body.filter(F.when(refused, number == F.col("_top")).otherwise(number > F.col("_top")))
    needed = max((end for _, end in positions.values()), default=0)
    short = F.length("value") < needed
    message = F.concat(
        F.lit("Riga "), number, F.lit(" troppo corta: "), F.length("value"),
        F.lit(f" caratteri, ne servono almeno {needed} per il profilo"),
    )
    other = F.lit("L'intestazione del file TXT non corrisponde al profilo applicato")
    fields = [
        F.when(~short & ~refused, F.substring("value", start + 1, end - start)).alias(name)
        for name, (start, end) in positions.items()
    ]
    return body.select("source_id", "line_number", *fields, F.when(refused, other).when(short, message).alias("error"))


def header_mismatches(lines: DataFrame, header: str) -> DataFrame:
    """Sources whose first non-blank line is not the profile's header."""
    return header_probe(lines, 0).filter(strip(F.col("header")) != F.lit(header.strip())).select("source_id", "header")


def _readable(c: Column) -> Column:
    controls = F.regexp_count(c, F.lit(CONTROLS))
    allowed = F.greatest(F.lit(1), F.floor(F.length(c) / 100))
    return ~F.contains(c, F.lit("\x00")) & (controls <= allowed)


def text_decode(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``text`` and ``encoding``: UTF-8, else code page 1252, else Latin-1; NULL when unreadable."""
    utf8 = F.col(content).cast("string")
    latin = F.decode(F.col(content), "ISO-8859-1")
    western = _western(latin)
    choices = [
        ("utf-8", F.is_valid_utf8(utf8) & _readable(utf8), utf8),
        ("cp1252", ~latin.rlike(CP1252_UNDEFINED) & _readable(western), western),
        ("latin-1", _readable(latin), latin),
    ]
    encoding, text = None, None
    for name, fits, value in choices:
        encoding = F.when(fits, name) if encoding is None else encoding.when(fits, name)
        text = F.when(fits, value) if text is None else text.when(fits, value)
    return files.withColumns({"encoding": encoding, "text": text})


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file under ``path``, folders included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


def source_fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 and size of every file."""
    return files.withColumns({"sha256": F.sha2(F.col(content), 256), "size_bytes": F.length(content)}).drop(content)


def identical_files(fingerprints: DataFrame) -> DataFrame:
    """Digests that occur more than once, with the first path and the number of files."""
    return (
        fingerprints.groupBy("sha256", "size_bytes")
        .agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))
        .filter("files > 1")
    )
