"""Raw command captures: JSON arrays written back to back in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: one element per command output.
CAPTURE_SCHEMA = (
    "status INT, timestamp BIGINT, cmd_timestamp BIGINT, cmd STRING, devtype STRING, "
    "namespace STRING, hostname STRING, address STRING, version STRING, data STRING"
)
REQUIRED = ["status", "timestamp", "cmd", "devtype", "namespace", "hostname"]


def parse_capture_text(df: DataFrame, column: str = "value") -> DataFrame:
    """Capture text (one or several arrays per row) to records."""
    # Inside JSON a raw newline only stands between tokens, so "]\n[" is always
    # the seam of two arrays.
    body = F.trim(F.regexp_replace(F.col(column), r"\]\s*\n\s*\[|\]\[(?=\s*\{)", "]\u0001["))
    pieces = F.split(body, "\u0001")
    whole = F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s*\[?|\]?\s*$", ""))
    arrays = F.transform(
        whole, lambda p: F.from_json(
            F.concat(F.lit("["), p, F.lit("]")), f"array<struct<{_as_struct()}>>"))
    return df.select(F.explode(F.flatten(F.filter(arrays, lambda a: a.isNotNull()))).alias("r")
                     ).select("r.*").where("cmd is not null or data is not null")


def _as_struct() -> str:
    return ",".join(f"{f.split()[0]}:{f.split()[1]}" for f in CAPTURE_SCHEMA.split(", "))


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """Records of all capture files under a path.

    Files are cut at array seams while they are scanned, so a large file is
    read by many tasks and never becomes one row.
    """
    rows = spark.read.option("lineSep", "]\n[").text(path)
    return parse_capture_text(rows)
