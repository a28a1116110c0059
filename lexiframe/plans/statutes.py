"""From page text to validated segment files and an embedded chunk index."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.operators.chunks import hash_embed, stack_sections, to_chunks
from lexiframe.operators.lines import default_rules, select_pages
from lexiframe.operators.segment import segment
from lexiframe.operators.validate import only_valid, validation_report
from lexiframe.session import checkpointed
from lexiframe.sources.index import bootstrap_index, read_index, rebuild_index
from lexiframe.sources.jsonl import DOCUMENT_SCHEMA, read_jsonl, write_sections


def parse_statutes(
    pages: DataFrame, ranges: DataFrame, header_lines: int = 0, rules=None
) -> DataFrame:
    """Segments of pages(doc_id, page_no, text) with page ranges per document."""
    return segment(select_pages(pages, ranges), rules or default_rules(header_lines))


def publish_segments(segments: DataFrame, expected: DataFrame, path: str) -> DataFrame:
    """Write JSON lines of the documents that pass validation; returns the report.

    One invalid section keeps its whole document out.  The report is read once more to
    filter, so segments are written to the shared folder first.
    """
    segments = checkpointed(segments)
    report = checkpointed(validation_report(segments, expected))
    write_sections(
        only_valid(segments, report).select(
            "doc_id", "section", "article_number", "paragraph_number", "text"
        ),
        path,
    )
    return report


def ingest(
    spark: SparkSession,
    body_path: str,
    elucidation_path: str,
    index_path: str,
    dim: int,
    embed=hash_embed,
    source: str = fixed.STATUTE_SOURCE,
    once: bool = False,
) -> None:
    """Read both JSON lines files, embed, check and write the chunk index.

    Lines may carry a ``doc_id``; chunk ids then name their document.
    """
    rows = stack_sections(
        read_jsonl(spark, body_path, DOCUMENT_SCHEMA),
        read_jsonl(spark, elucidation_path, DOCUMENT_SCHEMA),
    )
    chunks = embed(to_chunks(rows, source), text="text")
    if once:
        bootstrap_index(chunks, index_path, dim)
    else:
        rebuild_index(chunks, index_path, dim)


def index_health(spark: SparkSession, index_path: str) -> DataFrame:
    """Chunk counts per type, from metadata columns only."""
    return (
        read_index(spark, index_path)
        .groupBy("chunk_type")
        .agg(F.count("*").alias("chunks"))
    )
