"""Session set-up and lineage cuts."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "landweave") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for what must outlive an executor: the session's ``spark.checkpoint.dir``.

    Only on a local master that names none a temporary one is made. A cluster without a shared folder is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="landweave-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """Make this package importable in the session's Python workers (once per application), and return ``df``."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        root = pathlib.Path(__file__).parent
        to = pathlib.Path(tempfile.mkdtemp(prefix="landweave-")) / "landweave_package.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(to))
        _shipped.add(sc.applicationId)
    return df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the session has cores, for work that is heavy per row.

    Large inputs have more splits than that and stay as they are; a few small files are dealt out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
