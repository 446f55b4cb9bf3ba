"""The audit as a stream: files arrive in a folder, issues and reports are appended to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specmill.operators.issues import audit
from specmill.session import frames_removed
from specmill.sources.files import documents_of

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def audit_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Audit the files of a folder as they arrive, each batch as the batch audit does it.

    Documents are independent, so no state is kept; a document's id is the hash of its path. A batch that is
    run again after a failure overwrites its own partition, so that every issue is written once."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        with frames_removed(spark):
            docs = documents_of(batch).where("error IS NULL").select(F.xxhash64("path").alias("doc_id"), "kind", "blocks")
            issues, reports = audit(docs)
            issues.write.mode("overwrite").parquet(f"{out}/issues/batch={number}")
            reports.write.mode("overwrite").parquet(f"{out}/reports/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
