"""A stream of files into the index: each micro-batch is written by path, so that running it again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sondage.operators import maintenance
from sondage.operators.chunking import chunks


def apply_batch(files: DataFrame, stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) after a batch of (path, content, hash, mtime, size, ext, ctime, atime): rows replaced, chunks rewritten, completion marked."""
    new = chunks(batch)
    written = maintenance.upserted(files, batch)
    empty = batch.where("content is null or content = ''")
    done = maintenance.completed(written, new.select("path", "last"))
    return maintenance.without_content(done, empty), maintenance.replaced(stored, batch, new.select("path", "chunk_no", "content"))


def ingest(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Hands micro-batches of source to write. Without seconds it takes what there is and ends."""
    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
