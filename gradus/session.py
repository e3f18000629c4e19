"""Session helpers: a local session for tests, and tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gradus")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only where none is (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gradus_")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders of the scratch tables that this process has written.
_ROOTS: list[str] = []


def drop_scratch(spark: SparkSession) -> int:
    """Removes all scratch tables that this process has written, once no result that reads them is needed any more; how many runs they were of."""
    n = len(_ROOTS)
    while _ROOTS:
        _delete(spark, _ROOTS.pop())
    return n


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Whether Spark removes the shuffle files of a query when it has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables of one run, below the shared folder.

    ``keep`` writes a DataFrame as Parquet and gives it back read from there: the lineage ends, the written files
    survive the loss of executors, and the planner knows their size. ``drop`` removes tables that no later plan reads.
    ``tidy``: the shuffle files of a table are removed as soon as it is written, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark = spark
        self.tidy = tidy
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        _ROOTS.append(self.root)

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        """The table as written; ``by`` names columns of which each value gets a folder of its own, as ``column=value``."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        before = self.spark.conf.get(TIDY)
        self.spark.conf.set(TIDY, "true" if self.tidy else before)
        try:
            df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
        finally:
            self.spark.conf.set(TIDY, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._gradus_scratch = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_gradus_scratch", None)
            if path:
                _delete(self.spark, path)

    def drop_all(self) -> None:
        """Removes all tables of the run."""
        _delete(self.spark, self.root)
