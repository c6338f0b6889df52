"""Session settings shared by every operator."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master (tests).

    On a cluster every executor has its own disk, so without ``spark.checkpoint.dir``
    this raises instead of writing tables that other machines cannot read.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="routeloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def write_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """Store a small driver-made file in the shared folder and return its address."""
    address = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    _WRITTEN.append(address)
    return address


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_routeloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    package = os.path.join(root, "routeloom")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(write_shared(spark, "routeloom.zip", packed.getvalue()))
    context._routeloom_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    Iterative plans stay short, branches do not recompute their input, and the
    rows survive the loss of executors.  (``checkpoint()`` would run the plan
    twice: once to count, once to write.)
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/routeloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_later(path: str) -> None:
    """Enter a folder that an operator wrote itself; ``drop_scratch`` deletes it too."""
    _WRITTEN.append(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote; call when results are stored."""
    dropped = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        dropped += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return dropped
