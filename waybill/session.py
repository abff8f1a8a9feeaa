"""Session settings and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the split costs one more exchange later
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application.

    The archive is uploaded by Spark, so the local copy is only read here. A
    package that came with ``--py-files`` is on the workers already.
    """
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="waybill-")) / "waybill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Ship the package and apply the run-time settings the operators rely on."""
    ship_package(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="waybill-")
    if current is None:
        sc.setCheckpointDir(named)
    return named or current


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table under the shared folder."""
    return f"{shared_dir(spark)}/waybill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    Spark then knows their real size, so a join broadcasts them only when they
    are below its threshold.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
