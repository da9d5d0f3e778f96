"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "loupe") -> SparkSession:
    """Build (or reuse) a session with adaptive execution switched on.

    AQE re-plans at runtime: it coalesces small shuffle partitions, splits
    skewed join partitions and turns a sort-merge join into a broadcast join
    when the measured size of a side is under the broadcast threshold. That
    runtime measurement is the size check for data-derived join sides.
    Master, driver memory and shuffle partitions are left as submitted unless
    given here.
    """
    builder = (
        SparkSession.builder
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("LOUPE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (distributed) folder and is
    always read from the session. Only when it is unset, as in local tests, a
    scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # unset: only the case in local tests and benches
        path = tempfile.mkdtemp(prefix="loupe-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``loupe`` importable in executor Python workers (pandas UDFs).

    The package is zipped once on the driver and registered with
    ``addPyFile``, which distributes it to every executor.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="loupe-pkg-"), "loupe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def prepare(spark: SparkSession) -> str:
    """Ship the package to the executors; return the shared folder."""
    ship_package(spark)
    return checkpoint_dir(spark)


_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This program's folder in the shared one. Results read from it, so it is removed when the program ends."""
    shared = prepare(spark).rstrip("/")
    if shared not in _SCRATCH:
        _SCRATCH[shared] = f"{shared}/kept-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _SCRATCH[shared])
    return _SCRATCH[shared]


def remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    With ``free`` the shuffle files of the write go when it ends, instead of when
    the driver's garbage collector finds that nothing refers to them. Only for a
    plan without shuffles that others read, and where no other thread starts queries.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, None)
    try:
        if free:
            spark.conf.set(FREE, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)
