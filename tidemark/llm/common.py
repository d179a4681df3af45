"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_checkpoint_dir(sc) -> None:
    """Use spark.checkpoint.dir; only where that is unset (local tests) a temporary folder of this machine."""
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    set_checkpoint_dir(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def doc_key(column: str = "doc_id"):
    """A join key that is never null."""
    return F.coalesce(F.col(column).cast("string"), F.lit("~null"))


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A function that writes a table to the shared folder and rereads it; all are deleted at the end.

    For compact columnar intermediates: what is returned to the caller must
    have been cut before the end.
    """
    sc = spark.sparkContext
    set_checkpoint_dir(sc)
    folder = f"{sc._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"
    count = iter(range(1 << 30))

    def put(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(count)}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield put
    finally:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def merge_dealt(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join whatever the sizes, for sides that both grow with the input."""
    return left.join(right.hint("merge"), on, how)


#: A key is heavy if it has more than one in SHARE of all rows: there are fewer than SHARE of them, whatever the table.
SHARE = 10_000


def heavy(counts: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """The heavy keys of a table of keys and their rows, and the parts in which each is dealt: fewer than SHARE rows."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    parts = F.ceil(F.col(n) * SHARE / F.lit(max(total, 1))).cast("long")
    return counts.where(F.col(n) * SHARE > total).where(F.col(n) > SHARE).select(*on, F.least(parts, F.lit(1000)).alias("_parts"))


def merge_split(left: DataFrame, right: DataFrame, on: list[str], heavies: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join that deals the left rows of each heavy key in parts, by a hash of `by`; right has few rows of a key."""
    few = F.broadcast(heavies)  # bounded by SHARE
    left = left.join(few, on, "left").withColumn("_part", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    right = right.join(few, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return merge_dealt(left, right, [*on, "_part"], how).drop("_part")
