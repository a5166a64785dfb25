"""Data quality as data: each check gives violations ``(check, key)``; none means that it holds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respondex.functions.scalar import version
from respondex.plans.shipping import ship
from respondex.plans.staging import staged

#: Files and bytes that a task hashes, about, and bytes that it reads at a time; tasks that list folders, and entries that one hands on at a time.
FILES, BYTES, PIECE, WIDE, HELD = 1_000, 128 << 20, 1 << 20, 32, 1_000


def failing(df: DataFrame, name: str, key: str | Column, wrong: Column) -> DataFrame:
    """Rows for which ``wrong`` is true."""
    return df.where(wrong).select(F.lit(name).alias("check"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"))


def counts_are_whole(df: DataFrame, key: str, value: str) -> DataFrame:
    v = F.col(value)
    return failing(df, "counts", key, v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0) | (v != F.floor(v)))


def repeated(df: DataFrame, keys: list[str], name: str = "repeated") -> DataFrame:
    d = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    return failing(d, name, F.concat_ws("|", *keys), F.lit(True))


def unique_in_panel(panel: DataFrame, by: list[str] = (), columns: tuple[str, ...] = ("promoter", "grp")) -> DataFrame:
    """Promoters and unit groups that a panel (of each run in ``by``) names more than once; missing values are not asked."""
    found = [repeated(panel.where(F.col(c).isNotNull()), [*by, c], f"panel_{c}") for c in columns]
    return reduce(DataFrame.unionByName, found)


def same_universe(counts: DataFrame, least: int) -> DataFrame:
    """Samples without all features, and conditions of too few samples."""
    total = counts.select("feature").distinct().agg(F.count("*").alias("all"))
    per = counts.groupBy("sample").agg(F.count_distinct("feature").alias("n"))
    few = counts.groupBy("condition").agg(F.count_distinct("sample").alias("n"))
    return failing(per.join(F.broadcast(total)), "universe", "sample", F.col("n") != F.col("all")).unionByName(failing(few, "replicates", "condition", F.col("n") < least))


def orphans(child: DataFrame, parent: DataFrame, keys: list[str], name: str = "foreign_key") -> DataFrame:
    """Keys of the child that the parent lacks; keys with nulls are not asked."""
    d = child.select(*keys).dropna().distinct().join(parent.select(*keys).distinct(), keys, "left_anti")
    return failing(d, name, F.concat_ws("|", *keys), F.lit(True))


def domain(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    return failing(df, f"domain_{column}", key, ~F.coalesce(F.col(column).isin(values), F.lit(False)))


def within(df: DataFrame, key: str, column: str, low: float, high: float) -> DataFrame:
    """Values that are there but not between the limits."""
    return failing(df, f"range_{column}", key, F.col(column).isNotNull() & ~F.coalesce(F.col(column).between(low, high) & ~F.isnan(column), F.lit(False)))


def one_target(df: DataFrame, key: str, kind: str, columns: list[str]) -> DataFrame:
    """Rows whose kind does not name their only filled target column."""
    filled = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return failing(df, "target", key, ~((F.size(filled) == 1) & (F.get(filled, F.lit(0)) == F.col(kind))))


def same_rows(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on one side only, and keys whose values disagree."""
    d = a.select(F.col(key), F.col(value).alias("x"), F.lit(1).alias("in_a")).join(b.select(F.col(key), F.col(value).alias("y"), F.lit(1).alias("in_b")), key, "full")
    return failing(d, "agreement", key, F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("x").eqNullSafe(F.col("y")))


def doses(df: DataFrame, key: str) -> DataFrame:
    """Doses that are negative or not finite, or that lack a unit, or units without a dose."""
    v = F.col("dose")
    return failing(df, "dose", key, F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0), F.lit(False)) | (v.isNull() != F.col("unit").isNull()))


def fingerprint(parts: DataFrame, name: str, content: str) -> DataFrame:
    """One ``run_id`` from all named contents: a hash of the sorted hashes; parts are few (files, not rows)."""
    return parts.select(F.concat_ws(":", F.col(name), F.sha2(F.col(content), 256)).alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("run_id"))


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table's rows, made where the rows are: (rows, digest), one row.

    A row's hash is the first 60 bits of the MD5 of its values as text, null apart from any text; hashes are added, so
    that repeated rows count each.
    """
    shown = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns])
    h = F.conv(F.substring(F.md5(shown), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(h).cast("string").alias("digest"))


def lock_mismatches(files: DataFrame, lock: DataFrame) -> DataFrame:
    """Files whose hash or size is not what the lock says, or that are on one side only; both: (name, sha256, size)."""
    d = files.join(lock.select("name", F.col("sha256").alias("want"), F.col("size").alias("want_size")), "name", "full")
    return failing(d, "lock", "name", ~(F.col("sha256").eqNullSafe(F.col("want")) & F.col("size").eqNullSafe(F.col("want_size"))))


def releases(sources: DataFrame, least: str) -> DataFrame:
    """Sources whose release is not the one that most have (ties: the lesser), and those of a version below ``least``; sources: (name, release, version), few rows."""
    first = sources.groupBy("release").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "release").first()
    d = sources.where(~F.col("release").eqNullSafe(F.lit(first["release"] if first else None)))
    old = failing(sources, "version", "name", ~F.coalesce(version(F.col("version")) >= version(F.lit(least)), F.lit(False)))
    return failing(d, "release", "name", F.lit(True)).unionByName(old)


def listed(folders: DataFrame, root: str) -> DataFrame:
    """``(at, folder, size)``: what lies in folders (at), itself a folder or a file; names that begin with a dot or an underscore are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for at in batch["at"].to_pylist():
                found = [x for x in place.get_file_info(fs.FileSelector(at)) if not x.base_name.startswith((".", "_"))]
                for i in range(0, len(found), HELD):
                    some = found[i : i + HELD]
                    yield pa.RecordBatch.from_arrays([pa.array([x.path for x in some], pa.string()), pa.array([x.type == fs.FileType.Directory for x in some], pa.bool_()), pa.array([x.size for x in some], pa.int64())], ["at", "folder", "size"])

    return folders.select("at").mapInArrow(run, "at string, folder boolean, size long")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(name, path, sha256, size)`` of the files below a URI, which ``pyarrow.fs`` knows.

    Folders are listed level by level, and files are read a piece at a time, all by tasks; the driver only counts them.
    """
    ship(spark)
    _, at = fs.FileSystem.from_uri(path)
    root = path[: len(path) - len(at)] if path.endswith(at) else path[: path.index("://") + 3]
    level, found = spark.createDataFrame([(at,)], "at string"), []
    while n := level.count():
        here = staged(listed(level.repartition(max(min(n, WIDE), n // HELD), "at"), path), "listed")
        found.append(here.where("NOT folder").select("at", "size"))
        level = here.where("folder").select("at")
    files = reduce(DataFrame.unionByName, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            hashes = []
            for at in batch["at"].to_pylist():
                h = hashlib.sha256()
                with place.open_input_stream(at) as f:
                    while piece := f.read(PIECE):
                        h.update(piece)
                hashes.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["at"], pa.array(hashes, pa.string()), batch["size"]], ["at", "sha256", "size"])

    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, total["n"] // FILES, min(total["n"], total["bytes"] // BYTES))
    d = files.repartition(tasks, "at").mapInArrow(run, "at string, sha256 string, size long")
    return d.select(F.element_at(F.split("at", "/"), -1).alias("name"), F.concat(F.lit(root), "at").alias("path"), "sha256", "size")


def no_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """A violation if two tables share no key."""
    shared = a.select(key).join(b.select(key), key, "left_semi").limit(1).agg(F.count("*").alias("n"))
    return failing(shared, "no_overlap", F.lit(key), F.col("n") == 0)
