"""Session-level helpers: the shared folder, written intermediate tables, spreading of small inputs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach: ``spark.checkpoint.dir`` of the session; a temporary one only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="linkspark-")
    return "file://" + _own_dir[app]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives the loss of executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table behind a result of ``written`` that no later step reads."""
    path = getattr(df, "_written_to", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later step reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete from the moment it has its name; its folder must not hold one of that name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(path + ".draft")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, where):
        raise OSError(f"{path} is there already")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders right in a folder; none if it does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of fewer partitions than cores one partition a core; larger scans stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, whatever folder or path they were started with."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="linkspark-ship-"), "linkspark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, str(p.relative_to(home.parent)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
