"""Tar archives of text members, read member by member.

The ``tar_members`` data source walks an archive's headers by seeking from one to the next, so planning
reads no content, and gives each member a partition of its own, or where there are many, neighbours that are small
together one; a gzipped member is unpacked as a stream.
Archives are opened where they lie by ``pyarrow.fs``, which seeks in local and shared folders and in the
object stores that it knows.
"""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from respondex.plans.shipping import ship
from respondex.plans.skew import broadcast_if_small
from respondex.plans.staging import staged

#: Lines of a batch; members that may each have a partition, and bytes of the small ones that share one beyond that.
LINES, ALONE, SHARED = 4_096, 256, 1 << 20
KIND = "archive string, member string, line_no long, line string"


@dataclass
class Member(InputPartition):
    """A member of an archive: where its content begins, and its bytes."""

    archive: str
    name: str
    offset: int
    size: int


@dataclass
class Members(InputPartition):
    """Members that one task reads."""

    members: list[Member]


def packed(members: list[Member]) -> list[Members]:
    """A partition for each member, or if there are more than ``ALONE``, for neighbours of up to ``SHARED`` bytes, and a share of all."""
    most = min(SHARED, sum(m.size for m in members) // ALONE) if len(members) > ALONE else -1
    out, held = [], 0
    for m in members:
        if not out or held + m.size > most:
            out.append(Members([]))
            held = 0
        out[-1].members.append(m)
        held += m.size
    return out


class Part(io.RawIOBase):
    """Some bytes of a file that can seek, as a stream."""

    def __init__(self, file, offset: int, size: int):
        file.seek(offset)
        self.file, self.left = file, size

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.file.read(min(len(into), self.left))
        into[: len(got)] = got
        self.left -= len(got)
        return len(got)


def archives_below(path: str) -> list[str]:
    """The archive at a URI, or those below it, by name."""
    place, at = fs.FileSystem.from_uri(path)
    root = path[: len(path) - len(at)] if path.endswith(at) else path[: path.index("://") + 3]
    if place.get_file_info(at).type == fs.FileType.File:
        return [path]
    return sorted(root + x.path for x in place.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(".tar"))


def opened(path: str):
    place, at = fs.FileSystem.from_uri(path)
    return place.open_input_file(at)


class TarReader(DataSourceReader):
    def __init__(self, path: str, holds: str, first: bool):
        self.path, self.holds, self.first = path, holds, first

    def partitions(self) -> list[Members]:
        out = []
        for archive in archives_below(self.path):
            with opened(archive) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                out += [Member(archive, m.name, m.offset_data, m.size) for m in tar if m.isfile() and self.holds in m.name]
        return packed(out)

    def read(self, part: Members) -> Iterator[pa.RecordBatch]:
        for member in part.members:
            yield from self.lines(member)

    def lines(self, member: Member) -> Iterator[pa.RecordBatch]:
        with opened(member.archive) as f:
            raw = io.BufferedReader(Part(f, member.offset, member.size))
            plain = gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
            lines, n = [], 0
            for line in io.TextIOWrapper(plain, encoding="utf-8", errors="replace", newline=None):
                lines.append(line.rstrip("\n"))
                if self.first:
                    break
                if len(lines) == LINES:
                    yield self.batch(member, n, lines)
                    n, lines = n + len(lines), []
            if lines:
                yield self.batch(member, n, lines)

    def batch(self, member: Member, n: int, lines: list[str]) -> pa.RecordBatch:
        same = lambda x: pa.array([x] * len(lines), pa.string())
        return pa.RecordBatch.from_arrays([same(member.archive), same(member.name), pa.array(range(n, n + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["archive", "member", "line_no", "line"])


class TarMembers(DataSource):
    """``(archive, member, line_no, line)``; options: path; holds, a text that the names of members hold; first, whether each one's first line is all that is read."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return KIND

    def reader(self, schema) -> TarReader:
        return TarReader(self.options["path"], self.options.get("holds", ""), self.options.get("first", "") == "true")


def members(spark: SparkSession, path: str, holds: str = "", first: bool = False) -> DataFrame:
    """Lines of the members of the tar archives at a URI or below it whose names hold the text; first: only the first line of each is read."""
    ship(spark)
    spark.dataSource.register(TarMembers)
    return spark.read.format("tar_members").option("holds", holds).option("first", str(first).lower()).load(path)


def member_values(lines: DataFrame, id_column: str, pattern: str, suffix: str | None = None, groups: dict[str, list[str]] | None = None, sep: str = "\t", notes: list[str] = (), heads: DataFrame | None = None) -> DataFrame:
    """``(feature, sample, grp, replicate, condition, value, member[, notes])`` of tables, one a member.

    suffix: None takes the last column as the value and its name as the sample, and tries the pattern on that name
    first, then on the member's; else the first column whose name ends with the suffix, whatever its
    case, is the value, the name without it is the sample, and the pattern is tried on the member's
    name only.  pattern: groups 1 and 2 are a sample's group and replicate; members that it fits nowhere are
    passed over.  groups: conditions to their groups; members of no group are passed over.  notes: further
    columns to keep.  The header of a member, one row each, is joined by its name.  heads: the first lines of the same members, if
    they can be read alone.
    """
    key = ["archive", "member"]
    cells = F.split("line", sep)
    head = (lines if heads is None else heads).where("line_no = 0").select(*key, cells.alias("names"))
    if suffix is None:
        value = F.size("names") - 1
        head = head.withColumn("at", value).withColumn("sample", F.col("names")[value])
        tried = [F.col("sample"), F.col("member")]
    else:
        hit = F.transform("names", lambda x: F.lower(x).endswith(suffix.lower()))
        head = head.withColumn("at", F.array_position(hit, True).cast("int") - 1)
        head = head.withColumn("sample", F.regexp_replace(F.get("names", F.col("at")), f"_{suffix}$", ""))
        tried = [F.col("member")]
    fits = [F.when(F.regexp_extract(c, pattern, 1) != "", F.struct(F.regexp_extract(c, pattern, 1).alias("grp"), F.regexp_extract(c, pattern, 2).alias("replicate"))) for c in tried]
    head = head.withColumn("fit", F.coalesce(*fits)).where("fit IS NOT NULL AND at >= 0")
    of = {g: c for c, names in (groups or {}).items() for g in names}
    condition = F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("fit.grp")) if of else F.lit(None).cast("string")
    head = head.withColumn("condition", condition)
    head = staged(head.where("condition IS NOT NULL") if of else head, "heads")
    place = lambda name: (F.array_position("names", name) - 1).cast("int")
    d = lines.where("line_no > 0 AND trim(line) <> ''").join(broadcast_if_small(head), key)
    got = lambda at: F.get(cells, at)
    return d.select(got(place(id_column)).alias("feature"), "sample", "fit.grp", "fit.replicate", "condition", got(F.col("at")).try_cast("double").alias("value"), "member", *[got(place(n)).alias(n) for n in notes])


def write_archives(tables: DataFrame, path: str) -> DataFrame:
    """Write a tar archive for each value of ``archive``, of gzipped members with their lines in order; ``(archive, members)``.

    tables: (archive, member, line_no, line).  An archive is written by one task, so give it few rows.
    """

    def write(batch: pa.Table) -> pa.Table:
        rows = sorted(zip(batch["member"].to_pylist(), batch["line_no"].to_pylist(), batch["line"].to_pylist(), strict=True))
        texts: dict[str, list[str]] = {}
        for member, _, line in rows:
            texts.setdefault(member, []).append(line)
        name = batch["archive"][0].as_py()
        place, at = fs.FileSystem.from_uri(path)
        place.create_dir(at, recursive=True)
        with place.open_output_stream(f"{at}/{name}.tar") as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for member, lines in texts.items():
                content = gzip.compress(("\n".join(lines) + "\n").encode(), mtime=0)
                info = tarfile.TarInfo(member)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        return pa.table({"archive": pa.array([name]), "members": pa.array([len(texts)], pa.int64())})

    ship(tables.sparkSession)
    return tables.select("archive", "member", "line_no", "line").groupBy("archive").applyInArrow(write, "archive string, members long")
