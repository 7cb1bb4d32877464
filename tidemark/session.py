"""Session helpers: shared folder, materialised steps and shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session on one machine gets a temporary folder, set as
    its checkpoint folder; a cluster's session uses its warehouse, which must not
    be a folder of one machine.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at and context.master.split("[")[0] == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoints-"))
        at = context.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir")
        if machine_local(spark, at):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: {at} is local to each machine")
    return at.rstrip("/")


def machine_local(spark: SparkSession, path: str) -> bool:
    """Whether Spark would read the path from the disk of whatever machine it runs on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver's JVM ends."""
    at = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if at not in _MARKED:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: later jobs read files that survive the loss of any
    executor, and the step is not computed twice.
    """
    spark = df.sparkSession
    at = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application.

    Pickled functions name their module, so Python workers must be able to
    import it wherever they start.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.suffix == ".zip" or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="tidemark-ship-")
    target = os.path.join(folder, "tidemark_pkg.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
