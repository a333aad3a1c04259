"""Season CSV files whose headers differ, read as one table of texts.

Two scans, whatever the number of files.  The first goes over the lines as text
and brings each file down to one row on the executors: its header's layout (where
each known column is), the numbers of fields its lines have, how many of its bytes
could be read.  The second is one CSV scan with positional columns; each row picks
its columns by the layout of its file.  The driver sees one number, the widest
header.  What is left out, a file or a row, is named with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.runtime import Lookup, checkpointed
from touchline.schema import MATCH_COLUMNS, RAW_MATCH_SCHEMA

REJECT_SCHEMA = "path string, record string, error string"

_CORRUPT = "_corrupt_record"
_PATH = "source_path"


@dataclass
class SeasonScan:
    """All rows of the readable files; the files; and every file or row that was left out."""

    matches: DataFrame
    files: DataFrame
    rejected: DataFrame


def _options(suffix: str) -> dict:
    # A file that breaks is read as far as it goes; the count of its bytes tells.
    return {"pathGlobFilter": f"*{suffix}", "recursiveFileLookup": True, "ignoreCorruptFiles": True, "ignoreMissingFiles": True}


def _unquoted(line: Column) -> Column:
    """The line without its quoted parts."""
    return F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)


def _occurrences(text: Column, sign: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def field_count(line: Column) -> Column:
    """Fields of a CSV line; 0 if it opens a quote that it does not close."""
    bare = _unquoted(line)
    return F.when(F.contains(bare, F.lit('"')), 0).otherwise(_occurrences(bare, ",") + 1)


def _names(header: Column) -> Column:
    """The fields of a header line, without quotes; commas in quotes do not separate."""
    fields = F.split(F.regexp_replace(header, "^\ufeff", ""), ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(fields, lambda f: F.regexp_replace(f, '^"|"$', ""))


def _listed(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """path and size of each file."""
    found = spark.read.format("binaryFile").options(**_options(suffix)).load(folder)
    sized = checkpointed(found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")))
    if len(found._jdf.inputFiles()) == sized.count():
        return sized
    # Scans pass over empty files; only where there are some, all names are asked for.
    names = [(name.replace("file:///", "file:/", 1),) for name in found.inputFiles()]
    names = spark.createDataFrame(names, "path string")
    return sized.unionByName(names.join(sized, "path", "left_anti").withColumn("size", F.lit(0).cast("bigint")))


def audit_files(spark: SparkSession, folder: str, suffix: str = ".csv", long_rows: str = "file") -> DataFrame:
    """path, width, layout and error of each file below ``folder``; hidden and underscore files are left out.

    ``layout`` holds the place of each match column, from 1, the first one if a
    name is repeated, 0 if there is none.  ``error`` is null for a file to read.
    """
    listed = _listed(spark, folder, suffix)
    lines = spark.read.options(**_options(suffix)).text(folder).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    filled = F.trim("value") != ""
    # collect_set makes this a hash aggregate although texts are kept, so lines are never sorted;
    # a file's lines come in order, so the first one of the split at 0 is the header.
    seen = lines.groupBy("path").agg(
        F.first(F.when((F.col("at") == 0) & filled, F.col("value")), ignorenulls=True).alias("header"),
        F.collect_set(F.when(filled, field_count(F.col("value")))).alias("widths"),
        F.sum(F.octet_length("value").cast("bigint")).alias("bytes"), F.count(F.lit(1)).alias("lines"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    files = listed.join(seen, "path", "left").withColumn("names", _names(F.col("header")))
    files = files.withColumns({
        "width": F.size("names"), "most": F.array_max("widths"),
        "layout": F.array(*[F.array_position("names", c).cast("int") for c in MATCH_COLUMNS]),
    })
    # The scan does not return the one or two bytes that end a line, nor three that may mark a file as UTF-8.
    missing = F.col("size") - F.col("bytes") - 2 * F.col("lines") - 3
    error = (
        F.when(F.col("size") == 0, "no header: the file is empty")
        .when(F.col("lines").isNull(), "the file could not be read")
        .when(missing > 0, F.format_string("reading broke off after %d of %d bytes", "bytes", "size"))
        .when(F.col("header").isNull(), "no header: all lines are blank")
        .when(~F.col("utf8"), "the text is not UTF-8")
        .when(F.array_max("layout") == 0, "no known column in the header")
    )
    if long_rows == "file":
        error = error.when(F.array_contains("widths", 0), "a quote is not closed in its line").when(
            F.col("most") > F.col("width"), F.format_string("a line has %d fields, the header %d", "most", "width"))
    return files.select("path", "width", "layout", error.alias("error"))


def scan_season_files(spark: SparkSession, folder: str, suffix: str = ".csv", long_rows: str = "file", short_rows: str = "keep") -> SeasonScan:
    """Outer union by name of every CSV below ``folder``; columns no file has are null.

    A file without a usable header, that is not UTF-8 or breaks in mid-read is
    left out as a whole.  So is one with a line of more fields than its header
    or with an open quote, if ``long_rows`` is ``file``; if it is ``row``, only
    that line is.  A line with too few fields counts as null in the others, or
    is left out, too, if ``short_rows`` is ``reject``.  Blank lines do not count.
    """
    files = Lookup(audit_files(spark, folder, suffix, long_rows))
    wanted = files.table.where("error IS NULL")
    bad_files = files.table.where("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("record"), "error")
    widest = wanted.agg(F.max("width")).first()[0]
    if widest is None:
        return SeasonScan(spark.createDataFrame([], RAW_MATCH_SCHEMA), files.table, bad_files)

    places = [f"c{i}" for i in range(widest)]
    positional = T.StructType([T.StructField(c, T.StringType()) for c in (*places, _CORRUPT)])
    rows = (
        spark.read.schema(positional).options(**_options(suffix))
        .options(header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT, multiLine=False)
        .csv(folder).select("*", F.col("_metadata.file_path").alias(_PATH))
    )
    rows = files.join(rows, {_PATH: "path"}, {"width": "__width", "layout": "__layout", "error": "__error"}, "inner").where("__error IS NULL")
    # A line with another number of fields than the widest header comes with its text.
    # The first value is mentioned because Spark refuses a query, such as a count, that asks for that text alone.
    whole = F.greatest(F.lit(widest), F.octet_length(places[0]) * 0)
    fields = F.when(F.col(_CORRUPT).isNull(), whole).otherwise(field_count(F.col(_CORRUPT)))
    rows = rows.withColumns({"__fields": fields, "__values": F.array(*places)})
    fine = (F.col("__fields") > 0) & (F.col("__fields") <= F.col("__width"))
    if short_rows == "reject":
        fine = fine & (F.col("__fields") == F.col("__width"))
    matches = rows.where(fine).select(*[
        F.get("__values", F.col("__layout")[i] - 1).alias(c) for i, c in enumerate(MATCH_COLUMNS)])
    text = F.array_join(F.transform("__values", lambda v: F.coalesce(v, F.lit(""))), ",")
    reason = F.when(F.col("__fields") == 0, "a quote is not closed").otherwise(
        F.format_string("%d fields instead of %d", "__fields", "__width"))
    bad_rows = rows.where(~fine).select(
        F.col(_PATH).alias("path"), F.coalesce(_CORRUPT, text).alias("record"), reason.alias("error"))
    return SeasonScan(matches, files.table, bad_files.unionByName(bad_rows))
