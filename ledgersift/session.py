"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "ledgersift") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineages: the one the cluster names, else a local one in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="ledgersift-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def work_partitions(spark: SparkSession, groups: int) -> int:
    """Partitions for work that is heavy per byte: a few per core, never more than groups.

    Adaptive execution merges partitions by their size in bytes; an explicit
    number keeps compute-bound stages spread over all cores.
    """
    cores = spark.sparkContext.defaultParallelism
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(groups, max(shuffle, 4 * cores)))


@contextmanager
def open_files(spark: SparkSession, number: int) -> Iterator[None]:
    """Tasks that write folders by key keep up to ``number`` files open, and sort their rows only beyond that."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(number))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is built and run inside leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _write(df: DataFrame, path: str) -> str:
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    return path


def _new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ledgersift/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on executors that computed it, keeps columnar
    pruning and gives the optimizer real sizes.
    """
    path = _write(df, _new_path(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written on the way to a result and removed on leaving; by then the result must be written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = _new_path(spark)
        self._tables = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)

    def __call__(self, df: DataFrame) -> DataFrame:
        """As :func:`materialize`."""
        return self.rounds([df])

    def rounds(self, parts: Iterable[DataFrame]) -> DataFrame:
        """The rows of all ``parts``, each taken when the one before is written: only one part's shuffles lie on disk."""
        self._tables += 1
        paths, schema = [], None
        for part in parts:
            schema = schema or part.schema
            paths.append(_write(part, f"{self.base}/{self._tables}/{len(paths)}"))
        return self.spark.read.schema(schema).parquet(*paths)
