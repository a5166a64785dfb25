"""Writers of results: partitioned tables, display copies, FASTA, folders of text files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondex.functions.scalar import half_even
from respondex.plans.shipping import ship

#: Files of a folder that ``write_texts`` fills, about.
FILES = 1_000


def dealt(rows: DataFrame, path: str, by: str, parts: int) -> None:
    """One Parquet partition for each value of ``by``; its rows are gathered by ``parts`` tasks, as many as its files."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    salted.repartition(F.col(by), F.col("__salt")).drop("__salt").write.partitionBy(by).parquet(path)


def standardised(results: DataFrame, path: str, expression: DataFrame | None = None, samples: DataFrame | None = None, by: str = "dataset", parts: int = 16) -> None:
    """A data set's standard folder: ``results``, and where given ``expression`` and ``samples`` beside them, each by contrast.

    expression: (dataset, feature, sample, value).  samples: (dataset, sample, condition, replicate, ...), the
    metadata of the samples of the expression; a sample of the expression without one, or in another order, is
    an error of the caller, see ``unnamed_samples``.
    """
    dealt(results, f"{path}/results", by, parts)
    if expression is not None:
        dealt(expression, f"{path}/expression", by, parts)
    if samples is not None:
        dealt(samples, f"{path}/samples", by, 1)


def unnamed_samples(expression: DataFrame, samples: DataFrame) -> DataFrame:
    """``(dataset, sample)`` of the expression that have no metadata."""
    return expression.select("dataset", "sample").distinct().join(samples.select("dataset", "sample").distinct(), ["dataset", "sample"], "left_anti")


def display(df: DataFrame, places: int = 2) -> DataFrame:
    """Doubles rounded half to even, for reading."""
    return df.select(*[half_even(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def by_regulation(results: DataFrame, path: str, places: int = 2) -> None:
    """Display copy split by regulation."""
    display(results, places).write.partitionBy("regulation").parquet(path)


def fasta_lines(name: Column, sequence: Column) -> Column:
    """A FASTA record; null for a null sequence."""
    return F.concat(F.lit(">"), name, F.lit("\n"), sequence)


def write_fasta(df: DataFrame, name: str, sequence: str, path: str) -> None:
    df.where(F.col(sequence).isNotNull()).select(fasta_lines(F.col(name).cast("string"), F.col(sequence)).alias("value")).write.text(path)


def write_texts(texts: DataFrame, path: str) -> int:
    """A UTF-8 file for each row (name, text), in folders of some ``FILES`` below a URI; how many; names are distinct.

    Files are written by ``pyarrow.fs``: Spark's writers start a process for each file and folder of a local store, to set its rights.
    A file gets its name once it is whole, so a task may be run again.
    """
    place, at = fs.FileSystem.from_uri(path)
    place.create_dir(at, recursive=True)
    folders = texts.count() // FILES + 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at = fs.FileSystem.from_uri(path)
        made: set[str] = set()
        for b in batches:
            for folder, name, text in zip(b["folder"].to_pylist(), b["name"].to_pylist(), b["text"].to_pylist(), strict=True):
                if folder not in made:
                    place.create_dir(f"{at}/{folder}", recursive=True)
                    made.add(folder)
                draft = f"{at}/{folder}/.{uuid.uuid4().hex}"
                with place.open_output_stream(draft) as out:
                    out.write(text.encode())
                place.move(draft, f"{at}/{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    ship(texts.sparkSession)
    dealt = texts.select(F.pmod(F.xxhash64("name"), F.lit(folders)).cast("string").alias("folder"), "name", "text").repartition(folders, "folder")
    return dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
