"""Session helpers: sane defaults for tests and the one shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: What ``decode_pages`` needs in its session: all charsets, and replacement characters for broken bytes.
CHARSET_OPTIONS = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}


def local_session(cores: str = "*", partitions: int = 8, app: str = "corpusloom") -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass your own session to the jobs instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config(map=CHARSET_OPTIONS)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset (tests, one machine) a local
    temporary folder stands in for it and is remembered on the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusloom.work.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("corpusloom.work.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df):
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(spark, "checkpoint"))
    return df.checkpoint()
