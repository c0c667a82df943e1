"""Session builder and lineage cuts.

`materialize` writes a DataFrame as a Parquet table below the folder named by ``spark.checkpoint.dir`` (shared by all
executors, so the table outlives any of them) and reads it back with its schema. Where that setting is missing, a
local session uses a folder of its own, and a cluster is told to set it. Nothing here calls ``localCheckpoint``.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

_LIVE: dict[str, SparkSession] = {}


def build_session(app: str = "paperlens", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, AQE with skew handling, Arrow."""
    n = os.cpu_count() if cores == "*" else int(cores)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or one of our own where none is set."""
    own = getattr(spark, "_paperlens_dir", None)
    if own:
        return own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="paperlens-")
    spark._paperlens_dir = named.rstrip("/")  # type: ignore[attr-defined]
    return spark._paperlens_dir  # type: ignore[attr-defined]


def materialize(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    _LIVE[path] = spark
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._paperlens_path = path  # type: ignore[attr-defined]
    return out


def materialize_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """`materialize`, and aggregates of the rows observed while they are written, without a second job."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(name) for name, c in counts.items()]), df.schema)
    return out, {name: seen.get.get(name) or 0 for name in counts}


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote, once nothing reads it any more."""
    path = getattr(df, "_paperlens_path", None)
    if path in _LIVE:
        _delete(path)


def _delete(path: str) -> None:
    spark = _LIVE.pop(path)
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder goes with the cluster
        pass


@atexit.register
def _cleanup() -> None:
    for path in list(_LIVE):
        _delete(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once in a session, wherever they run and whatever their paths are."""
    if getattr(spark.sparkContext, "_paperlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="paperlens-code-"), "paperlens_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("paperlens", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._paperlens_shipped = True  # type: ignore[attr-defined]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
