"""Contact form records: validation and the sink that leaves out what robots send."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.records import is_valid_submission, passes_honeypot

SUBMISSION = "name string, email string, organisation string, message string, bot_field string, form_name string"


def accepted(submissions: DataFrame) -> DataFrame:
    """Rows that are complete and whose honeypot is empty, without the honeypot."""
    return submissions.where(passes_honeypot("bot_field") & is_valid_submission()).drop("bot_field")


def write_submissions(submissions: DataFrame, path: str, form: str = "parquet", mode: str = "append") -> None:
    """Writes the accepted rows as Parquet, JSON or CSV, one folder per form."""
    accepted(submissions).write.mode(mode).partitionBy("form_name").format(form).save(path)
