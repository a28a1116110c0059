"""JSON lines source and sink."""

from pyspark.sql import DataFrame, SparkSession

SEGMENT_SCHEMA = "article_number bigint, paragraph_number bigint, text string"
DOCUMENT_SCHEMA = f"doc_id bigint, {SEGMENT_SCHEMA}"  # lines of several documents


def read_jsonl(spark: SparkSession, path, schema: str = SEGMENT_SCHEMA) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a malformed line aborts the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls written, replacing what was there."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_sections(segments: DataFrame, path: str) -> None:
    """JSON lines with one folder per section; the document id stays a field."""
    segments.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(
        "section"
    ).json(path)
