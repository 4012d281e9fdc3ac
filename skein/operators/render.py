"""Selected chunks as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTHING_B = "No relevant code found for the query."


def _joined(df: DataFrame, text: Column, sep: str) -> DataFrame:
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda r: r["t"]), sep).alias("text"))


def _named(text: Column) -> Column:
    return F.when(F.coalesce("name", F.lit("")) != "", text).otherwise(F.lit(""))


def markdown_p(selected: DataFrame) -> DataFrame:
    head = F.concat(F.lit("## "), "path", F.lit(":L"), "start_line", F.lit("-"), "end_line", _named(F.concat(F.lit(" ("), "chunk_type", F.lit(": "), "name", F.lit(")"))))
    body = F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), "content", F.lit("\n```"))
    return _joined(selected, F.concat(head, F.lit("\n\n"), body), "\n\n---\n\n")


def xml_p(selected: DataFrame) -> DataFrame:
    head = F.concat(F.lit('<file path="'), "path", F.lit('"'), _named(F.concat(F.lit(' name="'), "name", F.lit('" type="'), "chunk_type", F.lit('"'))), F.lit(' lines="'), "start_line", F.lit("-"), "end_line", F.lit('"'), F.when(F.coalesce("language", F.lit("")) != "", F.concat(F.lit(' language="'), "language", F.lit('"'))).otherwise(F.lit("")))
    return _joined(selected, F.concat(head, F.lit(">\n"), "content", F.lit("\n</file>")), "\n\n")


def markdown_b(selected: DataFrame) -> DataFrame:
    """Files in the order of their best chunk, chunks by line."""
    lines = F.when(F.col("start_line") == F.col("end_line"), F.concat(F.lit("Line "), "start_line")).otherwise(F.concat(F.lit("Lines "), "start_line", F.lit("-"), "end_line"))
    text = F.concat(F.lit("### "), lines, _named(F.concat(F.lit(" ("), "chunk_type", F.lit(": "), "name", F.lit(")"))), F.lit("\n\n```"), "language", F.lit("\n"), "content", F.lit("\n```\n"))
    files = selected.groupBy("path").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("start_line", text.alias("t")))).alias("c"))
    one = F.concat(F.lit("## "), "path", F.lit("\n\n"), F.array_join(F.transform("c", lambda c: c["t"]), "\n"))
    return _joined(files, one, "\n").select(F.when(F.col("text") == "", NOTHING_B).otherwise(F.col("text")).alias("text"))
