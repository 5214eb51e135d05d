"""Shared scratch storage: checkpoints and written intermediate tables."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one in one-process local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="corpuslab-")
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write to the shared folder and read back.

    Cuts the lineage so that a lost executor re-reads files instead of redoing
    the plan, and gives the planner a measured size: whether a later join
    broadcasts the table is then decided against autoBroadcastJoinThreshold.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for iterative jobs (keeps vector columns)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table that nothing reads any more."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def write_once(spark: SparkSession, path: str, line: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed."""
    files, target = _file_system(spark, path)
    _, beside = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(beside, True)
    out.write(bytearray(line.encode()))
    out.close()
    if not files.rename(beside, target):
        files.delete(beside, False)
        raise RuntimeError(f"{path} is there already")
