"""A stream's records written once, however often and late they are delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.dedup import OffsetLedger


def write_once(stream: DataFrame, target: str, ledger: OffsetLedger, checkpoint: str) -> None:
    """Append the first deliveries of what a stream holds now, then stop.

    Each micro-batch has a partition of its own. One that runs again takes the same
    records from the ledger and replaces what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            ledger.take(batch, batch_id)
            .withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(target)
        )

    (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )
