"""Results kept between runs: a Parquet table found again by what it was made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(df: DataFrame) -> str:
    """A digest of what a table reads and does: its files with their sizes and times of change, and its plan.

    Two tables of equal fingerprints hold equal rows, as long as a changed file has another size or time. A file that is
    replaced, added or removed gives another fingerprint. Names that Spark gives to columns while it plans are left out.
    """
    spark = df.sparkSession
    files = []
    for name in sorted(df.inputFiles()):
        place, system = _file_system(spark, name)
        status = system.getFileStatus(place)
        files.append([name, status.getLen(), status.getModificationTime()])
    plan = df._jdf.queryExecution().analyzed().canonicalized()
    seen = [files, df.semanticHash(), plan.toString(), df.schema.json()]
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()


def stored(
    build: Callable[..., DataFrame], inputs: dict[str, DataFrame], root: str, options: dict | None = None, version: str = "1"
) -> DataFrame:
    """``build(**inputs, **options)`` as a Parquet table under ``root``, made only if no equal call has made it before.

    The key is a digest of the name of ``build``, the ``version`` that its caller gives to its code, the fingerprints of the
    inputs and the options. It outlives the session and its executors, and other sessions find it too. A table counts once
    its writer has finished, so one that was cut off is made anew; of two writers at a time the later one replaces the other's
    equal table. Options must be plain values. Inputs without files, such as rows of the program, are told apart by their plan.
    """
    spark = next(iter(inputs.values())).sparkSession
    seen = [build.__module__, build.__qualname__, version, {k: fingerprint(df) for k, df in inputs.items()}, options or {}]
    key = hashlib.sha256(json.dumps(seen, sort_keys=True).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{build.__name__}-{key}"
    mark, system = _file_system(spark, f"{path}/_SUCCESS")
    if not system.exists(mark):
        build(**inputs, **(options or {})).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
