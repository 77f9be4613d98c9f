"""Application log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Log levels and the number of lines shown.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
LAST_LINES = 1000


def parse_lines(lines: DataFrame) -> DataFrame:
    """(pos, level, value): the level is the first level word standing between spaces."""
    level = F.regexp_extract("value", f" ({'|'.join(LEVELS)}) ", 1)
    return lines.select("pos", F.when(level != "", level).alias("level"), "value")


def log_lines(
    spark: SparkSession, path: str, n: int = LAST_LINES, level: str | None = None, text: str | None = None
) -> DataFrame:
    """The last ``n`` lines, newest last, then filtered by level and text.

    Files follow each other by the time they were last written, so rotated files come before the
    current one; files written at the same time follow by path.
    """
    # Time, file, block and row number within the task give the order of lines without a global sort.
    order = F.struct(
        "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")
    )
    lines = spark.read.text(path).select(order.alias("pos"), "value")
    return filter_lines(lines, n, level, text)


def filter_lines(lines: DataFrame, n: int = LAST_LINES, level: str | None = None, text: str | None = None) -> DataFrame:
    last = parse_lines(lines.orderBy(F.desc("pos")).limit(n))
    if level:
        last = last.where(F.contains("value", F.lit(f" {level.upper()} ")))
    if text:
        last = last.where(F.contains(F.lower("value"), F.lit(text.lower())))
    return last.orderBy("pos")
