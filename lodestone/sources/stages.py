"""Stage tables: each is computed once, and kept in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


class Stored:
    """A table written to the shared folder as Parquet, with its number of rows `n`, and counts of rows for which conditions hold,
    asked for when they are first wanted."""

    def __init__(self, df: DataFrame, **counts: Column) -> None:
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.df = spark.read.schema(df.schema).parquet(path)
        self._conditions = counts

    @functools.cached_property
    def counts(self) -> dict[str, int]:
        told = [F.count_if(c).alias(k) for k, c in self._conditions.items()]
        return self.df.agg(F.count(F.lit(1)).alias("n"), *told).first().asDict()

    @property
    def n(self) -> int:
        return self.counts["n"]


class Bucketed:
    """A table in the shared folder, in `parts` buckets by `key`: what groups or joins by this key finds its rows in place."""

    def __init__(self, df: DataFrame, key: str, parts: int) -> None:
        self._spark, self._name = df.sparkSession, f"lodestone_{uuid.uuid4().hex}"
        self._path = f"{shared_dir(self._spark)}/{self._name}"
        df.repartition(parts, key).write.bucketBy(parts, key).option("path", self._path).saveAsTable(self._name, format="parquet")
        self.df = self._spark.table(self._name)

    @functools.cached_property
    def n(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        self._spark.sql(f"DROP TABLE {self._name}")
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """`df` as it is now, without the plan that made it."""
    return Stored(df).df
