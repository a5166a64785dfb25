"""File layouts."""

import gzip
import io
import tarfile

from pyspark.sql import functions as F

from respondex.sources import archives, readers
from respondex.sources.keyed_store import KeyedStore


def test_sections_and_platform(spark, tmp_path):
    (tmp_path / "a.txt").write_text('!t\n!begin\n"ID"\t"s1"\t"s2"\n"x"\t1\t2\n"y"\tnull\t4\n!end\nrest\n')
    rows = readers.sectioned(spark, f"file://{tmp_path}/a.txt", "!begin", "!end")
    assert sorted((r["feature"], r["sample"], r["value"]) for r in readers.section_values(rows).collect() if r["value"] is not None) == [("x", "s1", 1.0), ("x", "s2", 2.0), ("y", "s2", 4.0)]
    (tmp_path / "p.txt").write_text("!b\nID\tSymbol\n1\tab /// cd\n1\tzz\n2\t\n!e\n")
    got = readers.platform(readers.sectioned(spark, f"file://{tmp_path}/p.txt", "!b", "!e"), {"ID": "id", "Symbol": "symbol"})
    assert {r["id"]: r["symbol"] for r in got.collect()} == {"1": "ab", "2": None}


def test_reference_and_edges(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("# c\n1)id\t2)name\n7\t x \n")
    assert [r.asDict() for r in readers.reference(spark, f"file://{tmp_path}/r.tsv").collect()] == [{"id": "7", "name": "x"}]
    (tmp_path / "e.tsv").write_text("# c\n1)a\n\nA\tb\t+\t\nshort\tx\nq\tR\t-\tS\n")
    got = readers.edge_lines(spark, f"file://{tmp_path}/e.tsv", ["src", "dst", "sign", "confidence"], 3)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b", "+", "?"), ("q", "r", "-", "S")]


def test_fasta_chunks(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 text\nACGT\nAC\n>c2\nGG\n")
    got = sorted(tuple(r) for r in readers.fasta(spark, f"file://{tmp_path}/g.fa", 4).collect())
    assert got == [("c1", 0, 1, "ACGT"), ("c1", 1, 5, "AC"), ("c2", 0, 1, "GG")]


def test_archive_members_are_partitions(spark, tmp_path):
    body = lambda k: "id\tnote\ts%d\n" % k + "".join(f"g{i}\tn\t{i * k}\n" for i in range(5000))
    (tmp_path / "in").mkdir()
    for a in range(2):
        with tarfile.open(tmp_path / "in" / f"x{a}.tar", "w") as t:
            for k in range(4):
                data = gzip.compress(body(k).encode()) if k % 2 else body(k).encode()
                info = tarfile.TarInfo(f"dir/drug{a}_{k}.txt" + ".gz" * (k % 2))
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
            t.addfile(tarfile.TarInfo("dir/empty_9.txt"), io.BytesIO())
            sub = tarfile.TarInfo("dir")
            sub.type = tarfile.DIRTYPE
            t.addfile(sub)
    lines = archives.members(spark, f"file://{tmp_path}/in", "drug")
    assert lines.rdd.getNumPartitions() == 8 and lines.count() == 8 * 5001
    assert archives.members(spark, f"file://{tmp_path}/in/x1.tar").select("archive").distinct().count() == 1
    got = {(r["sample"], r["grp"], r["replicate"]): (r["n"], r["s"]) for r in archives.member_values(lines, "id", r"drug(\d)_(\d)").groupBy("sample", "grp", "replicate").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert got == {(f"s{k}", str(a), str(k)): (5000, float(k * sum(range(5000)))) for a in range(2) for k in range(4)}
    # the column's name comes before the member's, and a member without a header line is no table
    named = archives.member_values(archives.members(spark, f"file://{tmp_path}/in/x0.tar"), "id", r"([a-z]+)\d?_?(\d)", groups={"treated": ["s"]}).select("grp", "replicate", "condition").distinct().collect()
    assert sorted(tuple(r) for r in named) == [("s", str(k), "treated") for k in range(4)]


def test_many_small_members_share_partitions(spark, tmp_path):
    m = [archives.Member("a", str(i), 0, size) for i, size in enumerate([100] * 3000 + [5_000_000] * 3 + [0] * 2000)]
    parts = archives.packed(m)
    assert [x for p in parts for x in p.members] == m and len(parts) < 2 * archives.ALONE
    assert all(len(p.members) == 1 or sum(x.size for x in p.members) <= archives.SHARED for p in parts)
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        for k in range(1000):
            data = gzip.compress(f"id\tGSM_a{k}\nf\t{k}\ng\t1\n".encode())
            info = tarfile.TarInfo(f"m{k}.gz")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    lines, heads = archives.members(spark, f"file://{tmp_path}/x.tar"), archives.members(spark, f"file://{tmp_path}/x.tar", first=True)
    assert lines.rdd.getNumPartitions() < 600 and heads.count() == 1000 and lines.count() == 3000
    got = archives.member_values(lines, "id", r"GSM_([a-z])(\d+)", heads=heads).groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()
    assert {(x["feature"], x["n"], x["s"]) for x in got} == {("f", 1000, 499500.0), ("g", 1000, 1000.0)}


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    return spark


def test_large_files_are_read_by_splits(spark, tmp_path):
    body = [f'"x{i}"\t{i}\t{i * 2}' for i in range(400)]
    body.insert(7, "")
    (tmp_path / "big.txt").write_text("\n".join(["!t", "!end", "!begin", '"ID"\t"s1"\t"s2"', *body, "!end", *["rest\t1"] * 50]))
    (tmp_path / "none.txt").write_text("!begin\na\tb\n")
    genome = "".join("ACGT"[i * i % 7 % 4] for i in range(5000))
    (tmp_path / "g.fa").write_text(">c1 text\n" + "\n".join(genome[i : i + 61] for i in range(0, 5000, 61)) + "\n> c2\nGG\n>empty\n>c3\nAC\nGT")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        small_splits(spark, "600b")
        lines = readers.numbered_lines(spark, f"file://{tmp_path}/big.txt")
        assert lines.select("block").distinct().count() > 5
        rows = readers.sectioned(spark, f"file://{tmp_path}/*.txt", "!begin", "!end")
        got = sorted((r["feature"], r["sample"], r["value"]) for r in readers.section_values(rows).collect())
        assert got == sorted((f"x{i}", s, float(v)) for i in range(400) for s, v in (("s1", i), ("s2", i * 2)))
        assert {r["row"] for r in rows.collect()} == {*range(402)} - {8}
        chunks = sorted(tuple(r) for r in readers.fasta(spark, f"file://{tmp_path}/g.fa", 100).collect())
        assert chunks == sorted([("c1", i, i * 100 + 1, genome[i * 100 : i * 100 + 100]) for i in range(50)] + [("c2", 0, 1, "GG"), ("empty", 0, 1, ""), ("c3", 0, 1, "ACGT")])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_load_rewrites_the_buckets_that_it_names(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", ["k"], "at", first=["a"], last_filled=["b"], first_filled=["b"], buckets=16)
    rows = [(k, t, f"a{k}-{t}", f"b{t}" if (k + t) % 3 else None) for k in range(300) for t in (5, 6)]
    kind = "k long, at long, a string, b string"
    first = store.load(spark.createDataFrame(rows, kind))
    assert set(first.values()) == {1} and store.loads() == 1
    more = [(k, t, f"a{k}-{t}", "late" if t > 6 else None) for k in (7, 8, 900) for t in (4, 9)]
    after = store.load(spark.createDataFrame(more, kind))
    named = {r["b"] for r in spark.createDataFrame(more, kind).select(F.pmod(F.xxhash64("k"), F.lit(16)).cast("int").alias("b")).collect()}
    assert {b for b, n in after.items() if n == 2} == named and len(named) <= 3
    assert {p.name for p in (tmp_path / "s" / "data" / "load=000002").iterdir() if p.is_dir()} == {f"bucket={b}" for b in named}
    want = {}
    for k, t, a, b in sorted(rows + more, key=lambda x: x[1]):
        w = want.setdefault(k, [a, None, None])
        w[1], w[2] = (b, w[2] or b) if b is not None else w[1:]
    assert {r["k"]: [r["a_first"], r["b_last_filled"], r["b_first_filled"]] for r in store.current().collect()} == want
    # a load that broke off before its manifest changes nothing, and runs again
    spark.createDataFrame([(1,)], "x int").write.parquet(f"file://{tmp_path}/s/data/load=000003/bucket=0")
    assert {r["k"] for r in store.current().collect()} == set(want)
    gone = store.clean()
    assert len([g for g in gone if g.startswith("load=000001")]) == len(named & set(first)) and {r["k"] for r in store.current().collect()} == set(want)
    store.load(spark.createDataFrame([(1, 0, "zero", None)], kind))
    assert store.current().where("k = 1").first()["a_first"] == "zero"


def test_files_are_written_and_hashed_by_tasks(spark, tmp_path, monkeypatch):
    import hashlib

    from respondex.operators import checks
    from respondex.plans import catalog
    from respondex.sources import sinks

    monkeypatch.setattr(sinks, "FILES", 10)
    texts = {str(i): f"línea {i}\n" * (i % 3) for i in range(95)} | {"big": "x" * (3 << 20)}
    path = f"file://{tmp_path}/below"
    assert sinks.write_texts(spark.createDataFrame(list(texts.items()), "name string, text string"), path) == 96
    assert len(list((tmp_path / "below").iterdir())) > 5 and not [p for p in (tmp_path / "below").rglob(".*")]
    deep = tmp_path / "below" / "a" / "b c"
    deep.mkdir(parents=True)
    (deep / "last").write_bytes(b"\xff")
    for hidden in ("_SUCCESS", ".last.crc"):
        (deep / hidden).write_text("no")
    (tmp_path / "below" / "empty").mkdir()
    want = {(k, hashlib.sha256(v.encode()).hexdigest(), len(v.encode())) for k, v in texts.items()} | {("last", hashlib.sha256(b"\xff").hexdigest(), 1)}
    got = checks.file_hashes(spark, path).collect()
    assert {(x["name"], x["sha256"], x["size"]) for x in got} == want and len(got) == len(want)
    assert {x["path"] for x in got if x["name"] == "last"} == {f"file://{deep}/last"}
    assert checks.file_hashes(spark, f"{path}/empty").count() == 0
    # a size in bytes, not letters
    spark.createDataFrame([(i, "größe", "b") for i in range(1, 60)], "p_partkey long, p_name string, p_brand string").write.parquet(f"file://{tmp_path}/sf/part.parquet")
    assert [tuple(x) for x in catalog.QUERIES["v10_file_hashes"](spark, f"file://{tmp_path}/sf").collect()] == [(6, 2)]


def test_display_rounds_as_numpy(spark):
    import numpy as np

    from respondex.sources import sinks

    values = [0.8500000000000001, 1.6500000000000001, 0.25, 0.35, -0.85, -0.0, 2.675, 1e300, float("inf"), None]
    shown = [r["x"] for r in sinks.display(spark.createDataFrame([(v,) for v in values], "x double"), 1).collect()]
    assert shown[:2] == [0.8, 1.6] and shown[-3:] == [1e300, float("inf"), None] and shown[:-3] == [float(np.round(v, 1)) for v in values[:-3]]
