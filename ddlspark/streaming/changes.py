"""Change capture as a stream of Parquet files, applied batch by batch, and cutover by a pointer file."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.copy import applied, latest_changes


def stream(spark: SparkSession, path: str, schema: str, start_after: int = -1, files_per_batch: int = 10) -> DataFrame:
    """Change rows (seq, op, key and columns) as files arrive; those at or before the snapshot's position are dropped."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.filter(F.col("seq") > start_after)


class Shadow:
    """A shadow table of versions under one folder; a pointer file, replaced at once, names the current one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.pointer = spark, folder, os.path.join(folder, "current.json")

    def state(self) -> dict:
        with open(self.pointer) as f:
            return json.load(f)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.state()["path"])

    def publish(self, df: DataFrame, batch: int) -> None:
        """Write a new version beside the others, then swap the pointer."""
        path = os.path.join(self.folder, f"v-{batch}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        new = f"{self.pointer}.{uuid.uuid4().hex}"
        with open(new, "w") as f:
            json.dump({"path": path, "batch": batch}, f)
        os.replace(new, self.pointer)

    def apply(self, changes: DataFrame, key: str) -> StreamingQuery:
        """Run all waiting changes through; a batch that was already published, as after a crash, is not applied again."""

        def each(batch: DataFrame, number: int) -> None:
            if number > self.state()["batch"]:
                last = latest_changes(batch, key, ["seq"])
                self.publish(applied(self.read(), last, key), number)

        query = changes.writeStream.foreachBatch(each).option("checkpointLocation", os.path.join(self.folder, "checkpoint")).trigger(availableNow=True)
        return query.start()
