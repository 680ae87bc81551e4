"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is set only when none is named and the session is local (tests); on a
    cluster a missing setting is an error, because executors could not see a local folder.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomlog-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


#: Rows of a few numbers that one task takes: some MB, as much as Spark's adaptive execution gives one by default.
ROWS_A_TASK = 1 << 17


def tasks_for(rows: int) -> int:
    """Over how many tasks so many rows of a few numbers are dealt."""
    return max(1, -(-rows // ROWS_A_TASK))


def checkpointed(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """``df`` computed once into the shared folder, with its lineage cut; in at most ``tasks`` partitions, if given.

    Else a short table keeps the partitions of its last shuffle, however many, and each step after it has a task for every one of
    them, of which the driver keeps a record.  A table in one partition is grouped without a shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if tasks is None:
        return df.checkpoint(eager=True)
    # Said once more afterwards, as a checkpoint forgets how its rows are dealt.
    return df.coalesce(tasks).checkpoint(eager=True).coalesce(tasks)


def shared_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder below the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored_by(df: DataFrame, name: str, parts: int, *keys: str) -> DataFrame:
    """``df`` written once into the shared folder and read back, dealt over ``parts`` by the keys.

    What needs rows of equal keys together afterwards shuffles none of them.
    """
    path = shared_folder(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")  # listed in the session's catalog, which knows how the files are dealt
    df.write.option("path", path).option("compression", "zstd").bucketBy(parts, *keys).saveAsTable(table)
    return df.sparkSession.table(table)
