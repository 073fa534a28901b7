"""Record operators over a stream of files; they hold no state, so nothing is waited for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossator.functions.safety import DOMAINS, text_reasons
from glossator.operators.spans import span_faults
from glossator.schema import RECORD


def record_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Records of JSON files as they arrive in a folder."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_at_once).json(path)


def flagged(records: DataFrame, domains=DOMAINS) -> DataFrame:
    """(case_id, split, reasons, faults) of records with an unsafe text or malformed spans; for streams and tables alike."""
    found = records.select("case_id", "split", text_reasons("text", domains).alias("reasons"), span_faults("text", "annotations").alias("faults"))
    return found.filter((F.size("reasons") > 0) | (F.size("faults") > 0))


def scan(records: DataFrame, to: str, checkpoint: str):
    """Start writing what is flagged; the checkpoint folder must be shared by the cluster."""
    return flagged(records).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
