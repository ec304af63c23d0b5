"""Sessions, and tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that results rely on (UTC) and adaptive execution."""
    b = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a full URI; in local mode, where it may be unset, a folder of our own that goes at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            path = tempfile.mkdtemp(prefix="heddle-")
            atexit.register(shutil.rmtree, path, True)
            _own[app] = f"file://{path}"
        folder = _own[app]
    if "://" not in folder:  # a plain path is of the cluster's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        if folder.startswith("file:/") and not folder.startswith("file://"):
            folder = "file://" + folder.removeprefix("file:")
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. On a local file system it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/heddle-{uuid.uuid4().hex}"
    if folder.startswith("file://"):
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
    return f"{folder}/{name}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again: lineage ends, lost executors don't matter."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """df, once its application's executors have been sent this package, which functions in Python refer to."""
    app = df.sparkSession.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="heddle-code-")
        atexit.register(shutil.rmtree, folder, True)  # Spark copies the file at once
        path = Path(folder) / "heddle-library.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        df.sparkSession.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return df
