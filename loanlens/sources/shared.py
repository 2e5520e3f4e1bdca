"""Results computed once into the folder that all machines of a cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. A session on one machine that names none gets
    one of its own; a cluster has to name one, since no machine's own folder is seen by the others."""
    context = spark.sparkContext
    named = spark.conf.get(FOLDER, None)
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError(f"{FOLDER} has to name a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def kept(frame: DataFrame) -> DataFrame:
    """The frame, computed once and written to the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that `new_folder` named, once nothing reads it any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
