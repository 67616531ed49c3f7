"""Session helpers: a tuned local builder, table loading and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def build_session(app: str = "echotrace", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; `conf` adds or overrides settings."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors of a cluster import this package: a zip of it in the shared checkpoint folder, once per application. Local sessions need none."""
    sc = spark.sparkContext
    if sc.master == "local" or sc.master.startswith("local[") or sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    target = f"{_work_folder(spark)}/{root.name}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(data.getvalue())
    out.close()
    sc.addPyFile(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data folder; no inference, columns are pruned by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; only a local session without one gets its own.

    A machine-local folder would lose data with its executor, so on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="echotrace-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def _work_folder(spark: SparkSession) -> str:
    """This application's folder of intermediate tables inside the shared checkpoint folder; removed at exit."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    folder = f"{sc.getCheckpointDir()}/tables-{sc.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(drop_path, spark, folder)
    return folder


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it; a stopped session or a missing folder is no error."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass


def cut_lineage(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it back, so later stages survive lost executors.

    A written table is compact and, unlike checkpoint(), carries no inferred constraints into the next plan, whose number
    would grow exponentially over the rounds of a loop. With `keep`, the table's path is appended to it, for drop_path.
    """
    spark = df.sparkSession
    path = f"{_work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)
