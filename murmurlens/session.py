"""Session defaults and the shared staging area."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine is tuned for.  They are hints for whoever builds the
#: session; nothing in the package changes a session it was handed.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_LOCAL_STAGING: dict[str, str] = {}


def build_session(app_name: str = "murmurlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`RECOMMENDED_CONF`, overridable by ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    A cluster must name one, because executors come and go and a machine-local
    folder would go with them.  Only a ``local[...]`` session that names none
    gets a temporary folder, removed when Python ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    checkpoint = sc._jsc.sc().getCheckpointDir()
    if checkpoint.isDefined():
        return checkpoint.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if sc.applicationId not in _LOCAL_STAGING:
        _LOCAL_STAGING[sc.applicationId] = tempfile.mkdtemp(prefix="murmurlens-")
        atexit.register(shutil.rmtree, _LOCAL_STAGING[sc.applicationId], ignore_errors=True)
    return _LOCAL_STAGING[sc.applicationId]


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the staging area and read it back.

    Cuts lineage like a checkpoint, but leaves a columnar table, so a later
    step that needs two columns reads two columns.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
