"""A keyed table of Parquet files that loads change bucket by bucket.

Keys are dealt to a fixed number of buckets by a hash.  A load brings its rows to the buckets of their keys, merges
these with what the buckets hold, writes them anew below the load's number and then a manifest that says for each bucket
which load wrote it last.  Buckets without rows in a load are not read or written.  A load that fails before its
manifest leaves the store as it was, and may be run again.  Older files stay until ``clean``.

Merging keeps, for each column, the value of the first row, of the last row that has one, or of the first that has one, in
the order of a column, over all loads in whatever order they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """A store at a path; keys, order and the rules of its columns are those that it was made with."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, first: list[str] = (), last_filled: list[str] = (), first_filled: list[str] = (), buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.rules = {"first": list(first), "last_filled": list(last_filled), "first_filled": list(first_filled)}

    def _names(self, folder: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def loads(self) -> int:
        """Number of complete loads."""
        return max([int(n[2:]) for n in self._names("manifest") if n.startswith("n=") and self._exists(f"manifest/{n}/_SUCCESS")], default=0)

    def manifest(self) -> dict[int, int]:
        """The load that last wrote each bucket: as many entries as buckets at most."""
        n = self.loads()
        return {r["bucket"]: r["load"] for r in self.spark.read.parquet(f"{self.path}/manifest/n={n:06d}").collect()} if n else {}

    def _held(self, of: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/load={n:06d}/bucket={b}" for b, n in of.items()]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths).drop("load", "bucket") if paths else None

    def load(self, rows: DataFrame) -> dict[int, int]:
        """Merge rows (keys, order, columns; others are left out) into the store; the manifest after it."""
        columns = [(rule, c) for rule, cs in self.rules.items() for c in cs]
        ranked = lambda rule, c: F.struct(F.col(self.order).alias("o"), F.col(c).alias("v")) if rule == "first" else F.when(F.col(c).isNotNull(), F.struct(F.col(self.order).alias("o"), F.col(c).alias("v")))
        new = rows.select(*self.keys, *[ranked(rule, c).alias(f"{c}_{rule}") for rule, c in columns])
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r["b"] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most as many as buckets
        manifest, n = self.manifest(), self.loads() + 1
        held = self._held({b: manifest[b] for b in touched if b in manifest})
        both = new if held is None else held.select(new.columns).unionByName(new)
        # the struct of a value and its order is its own rank: merging is the least or the largest of them
        best = [(F.max if rule == "last_filled" else F.min)(f"{c}_{rule}").alias(f"{c}_{rule}") for rule, c in columns]
        merged = both.groupBy(*self.keys).agg(*best).withColumn("bucket", bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/load={n:06d}")
        manifest |= dict.fromkeys(touched, n)
        self.spark.createDataFrame(list(manifest.items()), "bucket int, load int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/n={n:06d}")
        return manifest

    def current(self) -> DataFrame:
        """``(keys, column_rule...)`` of all keys."""
        held = self._held(self.manifest())
        if held is None:
            raise ValueError("nothing was loaded yet")
        return held.select(*self.keys, *[F.col(f"{c}_{rule}.v").alias(f"{c}_{rule}") for rule, cs in self.rules.items() for c in cs])

    def clean(self) -> list[str]:
        """Delete the files that the newest manifest doesn't name; their folders."""
        manifest, gone = self.manifest(), []
        for load in self._names("data"):
            for b in self._names(f"data/{load}"):
                if b.startswith("bucket=") and manifest.get(int(b[7:])) != int(load[5:]):
                    at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{load}/{b}")
                    at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
                    gone.append(f"{load}/{b}")
        return gone
