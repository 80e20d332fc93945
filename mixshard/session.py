"""Session helpers: a local session for tests and the checkpoint folder rule.

On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a shared
filesystem). A machine-local temporary folder is only used when nothing is set
and Spark runs in local mode (tests, smoke runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "mixshard") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``mixshard`` importable on every executor (as ``--py-files`` would).

    Grouped pandas functions are pickled by reference to their module, so the
    Python workers must import the package. Zipped once per application and added
    with ``addPyFile``; harmless where the package is already installed.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED or any(os.path.basename(f).startswith("mixshard-pkg-") for f in sc._python_includes or []):
        return
    if not sc.master.startswith("local") and _importable_on_executors(sc):
        _SHIPPED.add(app)  # installed on the cluster or passed with --py-files
        return
    # the zip is code served by the driver (what --py-files does), not data
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="mixshard-pyfiles-"), f"mixshard-pkg-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join("mixshard", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def _importable_on_executors(sc) -> bool:
    def probe(_):
        import importlib.util

        yield importlib.util.find_spec("mixshard") is not None

    return bool(sc.parallelize([0], 1).mapPartitions(probe).first())


def prepare_session(spark: SparkSession) -> str:
    """Ship the package and return the checkpoint folder (see ``ensure_checkpoint_dir``)."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; only in local mode create one if unset."""
    d = checkpoint_dir(spark)
    sc = spark.sparkContext
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a shared folder (HDFS, S3, ...) "
            "so that round state survives executor loss"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mixshard-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder for written round state."""
    base = prepare_session(spark).rstrip("/")
    return f"{base}/mixshard/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "cut", after: DataFrame | None = None) -> DataFrame:
    """``df`` written to the checkpoint folder and read back: its lineage ends here.

    Unlike ``DataFrame.checkpoint()`` it computes the frame once, and the frame read back has
    the size of its files; a checkpointed frame keeps the size that its plan was guessed to
    have, which loops over joins multiply without end. ``after``: a frame that ``cut``
    returned earlier and that nothing reads any more; its files are deleted.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if after is not None:
        delete_path(spark, after._cut_path)
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
