"""Session logs: JSON lines of which some are blank, broken or no objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.schemas import SESSION_LOG

_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_corrupt"}


def _whole_number(text: Column) -> Column:
    """A JSON number without fraction, or text that is one."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long"))


def parse_session_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tag each line ``valid``, ``invalid`` or ``blank`` and read message and sequence numbers of valid ones.

    A value that is no object is invalid. Sequence numbers may be numbers or numeric text.
    """
    raw = F.trim(F.regexp_replace(F.col(column), r"[\t\r\f\x0B]", " "))
    entry = F.from_json(raw, f"{SESSION_LOG}, _corrupt string", _STRICT)
    parsed = lines.withColumns({"_raw": raw, "_entry": entry})
    valid = F.col("_raw").startswith("{") & F.col("_raw").endswith("}") & F.col("_entry._corrupt").isNull()
    tag = F.when(F.col("_raw") == "", "blank").when(valid, "valid").otherwise("invalid")

    def field(name: str) -> Column:
        return F.when(F.col("line_tag") == "valid", F.col(f"_entry.{name}"))

    return parsed.withColumn("line_tag", tag).select(
        *lines.columns, "line_tag", field("msg").alias("msg"),
        _whole_number(field("globalSeq")).alias("seq"), _whole_number(field("missingSeq")).alias("missing_seq"),
    )


def read_session_log(spark: SparkSession, path: str) -> DataFrame:
    """Session logs of one or many files; ``file`` names the log of each line."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    return parse_session_log(lines)


def log_line_counts(log: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Valid, invalid and blank lines."""
    return log.groupBy(*keys, "line_tag").agg(F.count("*").alias("lines"))
