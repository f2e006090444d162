"""Write once, read many: the shared-folder table that cuts lineage between two stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lucerna.session import checkpoint_dir


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Persist a stage as parquet under the session's checkpoint folder and read it back.

    Unlike a cache it survives lost executors, and unlike an RDD checkpoint it keeps column pruning.
    """
    spark = df.sparkSession
    target = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)
