"""Session construction and lineage cutting.

``spark_session`` is for local work and tests; on a cluster the session comes
from outside and nothing here overrides its settings.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def spark_session(cores: int | str = 8, app: str = "brinewell", **conf: str) -> SparkSession:
    """A local session with UTC time, AQE and as many shuffle partitions as cores."""
    n = str(cores)
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BRINEWELL_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir where it is set.

    Only where it is unset (local work, tests) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="brinewell-")
    sc.setCheckpointDir(path)
    return path


_CUT: dict[str, list[str]] = {}


def drop_cut_tables(spark: SparkSession) -> int:
    """Delete the tables that this session's operators wrote; frames that still read them fail afterwards."""
    jvm = spark.sparkContext._jvm
    paths = _CUT.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Survives lost executors: the files are in the shared folder, not on the executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _CUT.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder (a Parquet file or folder of that name)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give this package's code to the Python workers of a session, once.

    Needed where the workers' PYTHONPATH doesn't have the package. Spark's own file
    server carries the archive to every executor, those that join later too.
    """
    sc = spark.sparkContext
    if getattr(sc, "_brinewell_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    shared = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    folder = os.path.join(shared, f"code-{uuid.uuid4().hex}") if shared.startswith("/") else tempfile.mkdtemp(prefix="brinewell-code-")
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, "brinewell_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("brinewell", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    sc._brinewell_shipped = True
