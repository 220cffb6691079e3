"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "lexiscore", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. A temporary folder of this machine is used only where
    every task runs on this machine too, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = _own_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="lexiscore-")


_written: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder and read that back.

    This cuts lineage in a way that survives lost executors, and gives the planner real sizes. The table stays until
    ``clear_scratch``, as results that read it are computed later.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Remove the tables that ``written`` has made in this application; how many. Call it when no result needs them."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)


@cache
def _package_zip() -> str:
    """The package in one file, on the driver alone; Spark hands it to the executors."""
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="lexiscore-")) / "lexiscore.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    return str(path)


#: Bytes of a batch of rows on its way to Python. A worker holds several copies of a batch.
ARROW_BYTES = 1 << 22


def bound_arrow(spark: SparkSession) -> None:
    """Have rows reach Python in batches of about ``ARROW_BYTES``, or fewer, if the session says so; Spark's own bound is 64 MB.

    The setting is the session's, as a lazy result needs it when it is computed.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(setting))
    if not now or not 0 < int(now[1]) <= ARROW_BYTES:
        spark.conf.set(setting, str(ARROW_BYTES))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to executors on which it is not installed; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        spark.sparkContext.addPyFile(_package_zip())
        _shipped.add(app)
