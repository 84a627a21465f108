"""Optional: the coverage check on a stream of document files (micro-batches through ``foreachBatch``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.chunks import find_missed_blocks
from quire.sources.documents import text_blocks


def stream_missed_blocks(spark: SparkSession, folder: str, chunks: DataFrame, out: str, checkpoint: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> StreamingQuery:
    """New Parquet files of documents in ``folder``: their lost blocks are appended to ``out``; documents are whole rows,
    so no state or watermark is needed."""

    def batch(docs: DataFrame, _: int) -> None:
        find_missed_blocks(text_blocks(docs), chunks).write.mode("append").parquet(out)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
