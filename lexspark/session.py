"""Session helpers: table access, shared folder, cutting lineage."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def build_session(app: str = "lexspark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings this library expects; a cluster supplies its own."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a session on one machine gets a
    temporary one; on a cluster an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif sc.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="lexspark-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as a parquet table in the shared folder and reads it back: the lineage ends there, and a lost
    executor costs nothing but the rereading. Smaller on disk than checkpoint(), which keeps rows as objects. The table
    lies there until the session ends or `release` is called."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._lexspark_cut = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes what `cut` wrote for these tables, once nothing reads them any more; others are left alone."""
    for t in tables:
        path = getattr(t, "_lexspark_cut", None)
        if path in _WRITTEN:
            _delete(_WRITTEN.pop(path), path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per context, so that they need no path of their own
    to it. The archive is made in memory and lies in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_lexspark_shipped", False):
        return
    package, archive = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    path = f"{shared_dir(spark)}/lexspark-{uuid.uuid4().hex}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(archive.getvalue()))
    finally:
        out.close()
    _WRITTEN[path] = spark
    sc.addPyFile(path)
    sc._lexspark_shipped = True


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more; iterative operators
    call it between rounds so that disk does not grow with their number."""
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_written() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:
            pass
