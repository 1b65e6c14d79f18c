"""Files of pages as a stream: row-wise operators run as they come, whole-document ones per batch.

A document is a file, and a file is never cut between batches, so no state is kept from one batch to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sahifa.config import PAGES, ChunkConfig
from sahifa.plans.services import chunk, normalise
from sahifa.sources.text import blocks_of_pages


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of blocks from a folder to which files of pages (JSON) are added."""
    files = spark.readStream.schema(PAGES).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)
    return blocks_of_pages(files.select(F.input_file_name().alias("doc_id"), "pageNumber", "blocks"))


def stream_chunks(blocks: DataFrame, out: str, checkpoint: str, config: ChunkConfig = ChunkConfig(), once: bool = False) -> StreamingQuery:
    """Write the chunks of each batch's documents to ``out``, a folder for each batch, so that a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        chunk(normalise(batch), config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = blocks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
