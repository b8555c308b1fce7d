"""What the operators of this subpackage share: the working folder and input rules.

Input rules that hold for every operator unless its docstring says otherwise:

* Only the columns named in the call are read; all others are ignored, so extra
  columns with any name, clashing ones too, do no harm.
* A null text counts as the empty text.  Rows are never dropped for a null.
* Repeated rows are kept: a row in gives a row out.
* An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.session import importable

#: Most rows and bytes of one Arrow batch, so that a batch of very long texts stays small.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20
#: Most numbers that a table may hold to be broadcast; a larger one is shuffled for its join.
BROADCAST_NUMBERS = 1_000_000
#: A key with more than this part of the rows is hot.
HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; one is made only in local mode where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-framewalk-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches where the session's user has not set a bound of their own."""
    given = spark.conf.getAll
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if key not in given:
            spark.conf.set(key, str(bound))


class Workspace:
    """A new folder below the shared one, for tables that cut a lineage.

    A table written here survives lost executors, and later steps read it
    instead of computing it again.  Operators drop what they do not read any more;
    what their result is read from stays until release() is called.
    """

    #: Of all operators since the last release().
    made: list["Workspace"] = []

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        bounded_batches(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Workspace.made.append(self)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Writes the frame and returns it as read from there."""
        frame.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def side(self, frame: DataFrame, name: str, size=None) -> DataFrame:
        """The frame, written and counted: to be broadcast if it holds few numbers, as it is if not.

        size is a column, the numbers of a row (1 unless given).
        """
        kept = self.keep(frame, name)
        held = kept.agg(F.sum(size if size is not None else F.lit(1))).first()[0] or 0
        return F.broadcast(kept) if held <= BROADCAST_NUMBERS else kept

    def matched(self, rows: DataFrame, side: DataFrame, keys: list[str], count: str, name: str) -> DataFrame:
        """rows joined to the side (left), which has each key once and in `count` how many of the rows have it.

        A side of few numbers is broadcast.  Of a larger one, the keys with more than a share of 1 / HEAVY of the
        rows are: they are fewer than HEAVY.  The other rows are shuffled, so that no task gets a hot key's.
        """
        kept = self.keep(side, name)
        held, counted = kept.agg(F.count("*") * len(kept.columns), F.sum(count)).first()
        if held <= BROADCAST_NUMBERS:
            return rows.join(F.broadcast(kept), keys, "left")
        heavy = F.col(count) * HEAVY > counted
        often = rows.join(F.broadcast(kept.where(heavy)), keys)
        rest = rows.join(F.broadcast(kept.where(heavy).select(*keys)), keys, "left_anti")
        return often.unionByName(rest.join(kept.where(~heavy), keys, "left"))

    def drop(self, *names: str) -> None:
        """Removes tables that are not read any more; without names the whole folder."""
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(*keep: Workspace) -> None:
    """Removes the folders of all operators that have run, but for those given: to be called when their results are written."""
    for work in [w for w in Workspace.made if w not in keep]:
        work.drop()
        Workspace.made.remove(work)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
