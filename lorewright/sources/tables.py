"""Parquet tables of a folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``.

    A table of fewer splits than the cluster has cores (a small file of one
    row group is read by one task) is spread over all of them; larger tables are
    read as they lie.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where none is set a session of one machine gets a temporary one of its
    own; on a cluster that is an error, for executors share no local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lorewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables written by each thread of this process that nobody has dropped yet.
_OWN = threading.local()


def _list() -> list[str]:
    if not hasattr(_OWN, "paths"):
        _OWN.paths = []
    return _OWN.paths


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, read back: a cut of lineage that outlives executors."""
    path = f"{scratch(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    _list().append(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def mark() -> int:
    """A place in the order of the thread's written tables, for :func:`drop_written`."""
    return len(_list())


def drop_written(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the scratch tables that this thread wrote after ``since``, but for the files of ``keep``; their number.

    For the owner of a job, after the last action that reads them.
    """
    held = {f.rpartition("/")[0] for f in keep.inputFiles()} if keep is not None else set()
    stays = lambda path: any(path.split(":", 1)[-1].lstrip("/") == h.split(":", 1)[-1].lstrip("/") for h in held)
    gone = [p for p in _list()[since:] if not stays(p)]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _list()[since:] = [p for p in _list()[since:] if p not in gone]
    return len(gone)
