"""Where intermediate tables go when lineage has to be cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.session import checkpointed, ensure_checkpoint_dir


def small_batches(spark: SparkSession, limit: int = 1 << 21) -> None:
    """Bound the Arrow batches that go to Python workers by bytes; by default only rows bound them.

    A session that names a smaller limit keeps it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.isdigit() or int(now) > limit:
        spark.conf.set(name, limit)


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its columns of these names (in any letter case) renamed, so that none is overwritten.

    ``x`` becomes ``x_input``, with more of that suffix until the name is free.
    """
    wanted, taken = {n.lower() for n in names}, {c.lower() for c in df.columns}
    out = []
    for c in df.columns:
        new = c
        while new.lower() in wanted or (new != c and new.lower() in taken):
            new += "_input"
        taken.add(new.lower())
        out.append(F.col(f"`{c}`").alias(new))
    return df.select(*out)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
