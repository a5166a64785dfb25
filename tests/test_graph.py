"""Components, intervals, panels, sets, reviews, checks."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from respondex.operators import candidates, checks, cross, graph, identity, interval, panel, reviews, store
from respondex.operators.components import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty", "loops"])
def test_components(spark, kind):
    r = random.Random(4)
    edges = {"random": [(r.randrange(80), r.randrange(80)) for _ in range(60)], "chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 30)], "empty": [], "loops": [(5, 5), (6, 7), (7, 7)]}[kind]
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    assert {x["node"]: x["component"] for x in connected_components(df).collect()} == union_find(edges)


def test_overlaps_equal_brute_force_without_nested_loop(spark):
    r = random.Random(9)
    rows = [(i, i % 3, s, s + r.randrange(0, 50)) for i in range(60) for s in [r.randrange(300)]]
    df = spark.createDataFrame([*rows, (99, 1, 20, 10), (98, 1, None, 5)], "id long, k long, s long, e long")
    rows += [(i, 1, s, s + n) for i, s, n in ((60, 0, 5000), (61, -700, 1), (62, 4096, 4096), (63, 64, 63), (64, -3, 200))]
    df = spark.createDataFrame([*rows, (99, 1, 20, 10), (98, 1, None, 5)], "id long, k long, s long, e long")
    got = interval.overlaps(df, df, ["k"], 16)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()
    pairs = [(x["id"], x["id_b"]) for x in got.collect()]
    want = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]]
    assert sorted(pairs) == sorted(want)


def test_a_long_interval_is_few_rows(spark):
    long = spark.createDataFrame([(1, 0, 1 << 40)], "id long, s long, e long")
    short = spark.createDataFrame([(2, 5, 9), (3, (1 << 40) + 1, (1 << 40) + 2)], "id long, s long, e long")
    found = interval.overlaps(long, short, [], 1000)
    assert [(r["id"], r["id_b"]) for r in found.collect()] == [(1, 2)]
    leveled = long.withColumn("__l", interval.level_of(1000))
    assert leveled.first()["__l"] == 31 and interval.in_bins(leveled, 1000).count() <= 2
    assert interval.in_bins(short.withColumn("__l", interval.level_of(1000)), 1000, [0, 31]).count() <= 8


def test_components_of_large_hubs(spark, monkeypatch):
    from respondex.operators import components

    monkeypatch.setattr(components, "HUB", 3)
    monkeypatch.setattr(components, "HELD", 16)
    r = random.Random(12)
    for kind in range(3):
        edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] if kind == 0 else [(i, i + 1) for i in range(300)] if kind == 1 else [(r.choice([0, 500]), i) for i in range(1, 400)]
        df = spark.createDataFrame(edges, "src long, dst long").repartition(7)
        assert {x["node"]: x["component"] for x in connected_components(df).collect()} == union_find(edges)
    names = [(f"n{a}", f"n{b}") for a, b in edges]
    assert {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(names, "src string, dst string")).collect()} == union_find(names)


def test_a_task_hands_on_a_forest(spark):
    from respondex.operators import components

    r = random.Random(1)
    edges = [(a, b) for a, b in ((r.randrange(50), r.randrange(50)) for _ in range(5000)) if a != b]
    out = components.in_forests(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()
    assert len(out) <= 4 * 49 and union_find([(x["u"], x["v"]) for x in out]) == union_find(edges)


def test_unit_groups(spark):
    lists = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "d"), (4, "a"), (4, "b")], "unit long, member string")
    groups = graph.unit_groups(lists)
    names = {r["name"] for r in graph.group_names(lists, groups).collect()}
    assert names == {"a;b;c", "d"}


def test_unit_groups_take_all_orders(spark, tmp_path):
    from respondex.plans import catalog

    r = random.Random(8)
    orders = [(i, f"{r.randrange(1992, 1999)}-0{r.randrange(1, 9)}-11") for i in range(40)]
    lines = [(i, r.randrange(60)) for i in range(40) for _ in range(r.randrange(1, 3))]
    d = f"file://{tmp_path}"
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate string").selectExpr("o_orderkey", "to_timestamp_ntz(o_orderdate) AS o_orderdate").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    root = union_find([(u, 1000 + m) for u, m in lines])
    want = {i: root[i] for i in range(40)}
    assert {x["unit"]: x["grp"] for x in catalog.QUERIES["g4_unit_groups"](spark, d).collect()} == want
    names = {k: ";".join(map(str, sorted({m for u, m in lines if want[u] == k}))) for k in set(want.values())}
    assert {x["grp"]: x["name"] for x in catalog.QUERIES["g4_group_names"](spark, d).collect()} == names


def test_unit_groups_leave_out_no_unit(spark):
    lists = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "b"), (3, None), (3, "c"), (4, None), (None, "c"), (5, "b")], "unit long, member string")
    groups = graph.unit_groups(lists)
    assert sorted(tuple(r) for r in groups.select("unit", "grp", "members").collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 0), (5, 1, 2)]
    assert {tuple(r) for r in graph.group_names(lists, groups).collect()} == {(1, "a;b"), (3, "c"), (4, None)}


def test_crossed_equals_a_join(spark, monkeypatch):
    from respondex.plans import skew

    r = random.Random(5)
    left = [(r.choice([1, 1, 2, 3, None]), r.choice([*range(40), None])) for _ in range(150)]
    right = [(r.choice([1, 1, 2, 4, None]), r.choice([*"abcdefghijklmnop", None])) for _ in range(90)]
    want = {"inner": [(k, x, y) for k, x in left for m, y in right if k == m and k is not None]}
    want["left"] = want["inner"] + [(k, x, None) for k, x in left if k not in (1, 2)]
    l, d = spark.createDataFrame(left, "k long, x long"), spark.createDataFrame(right, "k long, y string")
    for limit in (1000, 10):
        monkeypatch.setattr(skew, "LISTED_ROWS", limit)
        for run, each, how in ((1, 50, "left"), (2, 400, "inner"), (256, 1 << 22, "left")):
            assert sorted((tuple(x) for x in skew.crossed(l, d, "k", run, each, how).collect()), key=repr) == sorted(want[how], key=repr)
    assert skew.crossed(l.limit(0), d, "k").count() == 0


def test_pairs_are_written_in_runs(spark, tmp_path):
    from respondex.plans import skew

    one = spark.range(2000).selectExpr("id % 2 AS k", "concat('r', id) AS x")
    two = spark.range(4000).selectExpr("id % 2 AS k", "concat('g', id) AS y")
    size = {}
    for name, df in (("join", one.repartition(4, "x").join(F.broadcast(two), "k")), ("crossed", skew.crossed(one, two, "k"))):
        df.write.parquet(f"{tmp_path}/{name}")
        assert spark.read.parquet(f"{tmp_path}/{name}").distinct().count() == 4_000_000
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).iterdir())
    assert size["crossed"] * 3 < size["join"], size


def test_reachable_beyond_ten_steps(spark):
    chain = spark.createDataFrame([*[(i, i + 1) for i in range(14)], (14, 3)], "src long, dst long")
    got = graph.reachable(chain, spark.createDataFrame([(0,), (12,)], "start long"))
    assert sorted((r["start"], r["node"]) for r in got.collect()) == sorted([(0, i) for i in range(15)] + [(12, i) for i in range(3, 15)])


def test_whole_queries_take_all_ids(spark):
    from respondex.plans import bindings, catalog, registry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    q = lambda name: catalog.QUERIES[name](spark, d)
    raw = [r.asDict() for r in bindings.interactions(spark, d).collect()]
    assert {r["interaction"] for r in q("j19_actor_interactions").collect()} == {r["interaction"] for r in raw}
    one = store.actor_interactions(bindings.interactions(spark, d), 3, "tu").collect()
    assert {r["interaction"] for r in one} == {r["interaction"] for r in raw if r["regulator"] == 3 and r["kind"] == "tu"}
    assert {r["interaction"] for r in q("j21_promoter_paths").collect()} == {r["interaction"] for r in raw if r["kind"] == "promoter"}
    reached = {(r["start"], r["node"]) for r in q("g8_reachable").collect()}
    genes = [tuple(r) for r in bindings.tu_genes(spark, d).collect()]
    steps = {}
    for a, b in [*((f"r{r['regulator']}", r["kind"][0] + str(next(r[k] for k in ("promoter", "tu", "gene") if r[k] is not None))) for r in raw), *((f"p{r['promoter']}", f"t{r['tu']}") for r in bindings.tu_promoters(bindings.tu_genes(spark, d)).collect()), *((f"t{a}", f"g{b}") for a, b in genes)]:
        steps.setdefault(a, set()).add(b)
    want = set()
    for start in {f"r{r['regulator']}" for r in raw}:
        todo = [start]
        while todo:
            x = todo.pop()
            if (start, x) not in want:
                want.add((start, x))
                todo += steps.get(x, ())
    assert reached == want
    people = registry.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").collect()
    pairs = {(a[0], b[0]) for a in people for b in people if a[1] == b[1] and a[2] == "BUILDING" and b[2] != "BUILDING"}
    assert {(r["condition"], r["control"]) for r in q("j27_pairings").collect()} == pairs
    of, seeds = {}, {r["feature"] for r in bindings.seeds(spark, d).collect()}
    for r in bindings.weights(spark, d).where(F.abs("weight") > 0.25).collect():
        of.setdefault(r["feature"], set()).add(r["component"])
    typed = {(min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in bindings.edges(spark, d).collect()}
    shared = {(a, b): len(of[a] & of[b]) for a in of for b in of if a < b and of[a] & of[b] and (a, b) not in typed}
    assert {(r["a"], r["b"]): r["shared"] for r in q("g5_co_members").collect()} == shared
    m = bindings.weights(spark, d).where(F.abs("weight") > 0.25)
    blocked = graph.co_members(m, m.select("feature"), bindings.edges(spark, d), block=3).collect()
    assert {(r["a"], r["b"]): (r["shared"], r["components"]) for r in blocked} == {k: (n, sorted(of[k[0]] & of[k[1]])) for k, n in shared.items()} and len(blocked) == len(shared)
    near = {c for f in of if f in seeds for c in of[f]}
    assert {r["feature"]: r["components"] for r in q("g6_neighbours").collect()} == {f: len(of[f] & near) for f in of if f not in seeds and of[f] & near}


def test_pairs_of_blocks_equal_brute_force(spark):
    import pyarrow as pa

    r = random.Random(1)
    for trial in range(20):
        y, n = trial % 2, r.choice([0, 1, 5, 30])
        rows = [(0, y, r.choice([0, y]), f"f{i:02d}", sorted(r.sample(range(10), r.randint(1, 6)))) for i in r.sample(range(99), n)]
        kinds = dict(x=pa.int32(), y=pa.int32(), own=pa.int32(), feature=pa.string(), components=pa.list_(pa.int32()))
        m = pa.table({c: pa.array([x[i] for x in rows], kind) for i, (c, kind) in enumerate(kinds.items())})
        want = {(a[3], b[3]): sorted(set(a[4]) & set(b[4])) for a in rows for b in rows if a[3] < b[3] and set(a[4]) & set(b[4]) and (y == 0 or a[2] != b[2])}
        barred = r.sample(sorted(want), len(want) // 3)
        known = pa.table({c: pa.array([p[i] for p in barred], pa.string()) for i, c in enumerate("ab")})
        for each in (1, 7, 1 << 21):
            got = graph.block_pairs(m, known, each).to_pylist()
            assert {(x["a"], x["b"]): x["components"] for x in got} == {k: v for k, v in want.items() if k not in barred}
            assert len({(x["a"], x["b"]) for x in got}) == len(got) and all(x["shared"] == len(x["components"]) for x in got)
    m = spark.createDataFrame([(f"f{i}", i % 3) for i in range(40)], "feature string, component int")
    pairs = graph.co_members(m, m.select("feature"), spark.createDataFrame([("f0", "f3"), ("f6", "f0"), ("f3", "zz")], "src string, dst string"), block=7)
    got = {(x["a"], x["b"]) for x in pairs.collect()}
    assert got == {(f"f{i}", f"f{j}") for i in range(40) for j in range(40) if i % 3 == j % 3 and f"f{i}" < f"f{j}"} - {("f0", "f3"), ("f0", "f6")}
    top = pairs._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroups")  # no pair is shuffled
    assert len(top) > 1 and "Exchange" not in top[0]


def test_blocks_are_shuffled_packed(spark, monkeypatch):
    m = spark.range(3000).selectExpr("id AS feature", "explode(array(int(id % 9), int(10 + id % 7))) AS component")
    pairs = graph.co_members(m, m.select("feature"), spark.createDataFrame([(0, 9)], "src long, dst long"), block=100)
    rows, put = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, *a: rows.append(df) or put(df, *a))
    graph.co_members(m, m.select("feature"), spark.createDataFrame([(0, 9)], "src long, dst long"), block=100)
    assert rows[0].count() == 30 * 30  # blocks, not 30 times all features
    want = {(a, b): [c for c in (a % 9,) if a % 9 == b % 9] + [10 + a % 7] * (a % 7 == b % 7) for a in range(60) for b in range(a + 1, 60)}
    got = {(r["a"], r["b"]): r["components"] for r in pairs.where("b < 60").collect()}
    assert got == {k: v for k, v in want.items() if v and k != (0, 9)}


def test_totals_and_names_read_their_tables_once(spark, monkeypatch):
    from respondex.operators import store

    names, write = [], store.staged
    monkeypatch.setattr(store, "staged", lambda df, name, codec=None: names.append(name) or write(df, name, codec))
    i = spark.createDataFrame([("x", "gene", 1, None, None), ("y", "promoter", None, 5, None), ("z", "tu", None, None, 7), ("w", "tu", None, None, 7)], "interaction string, kind string, gene long, promoter long, tu long")
    units = spark.createDataFrame([(7, 1)], "tu long, gene long")
    got = store.path_counts(spark.createDataFrame([(1,)], "feature long"), i, units, spark.createDataFrame([(7, 5)], "tu long, promoter long")).collect()
    assert {(x["kind"], x["n"]) for x in got} == {("gene", 1), ("promoter", 1), ("tu", 2)} and names == ["target-totals"]
    named = graph.group_names(spark.createDataFrame([(1, "a"), (2, "a"), (2, None)], "unit long, member string"), spark.createDataFrame([(1, 1), (2, 1)], "unit long, grp long"))
    assert [tuple(x) for x in named.collect()] == [(1, "a")] and "collect_set" not in named._jdf.queryExecution().toString()


def test_fragment_window(spark):
    prom = spark.createDataFrame([("p", 100, "+"), ("q", 100, "-"), ("r", None, "+")], "promoter string, tss long, strand string")
    sites = spark.createDataFrame([("p", 75, 130), ("q", 75, 130), ("p", 0, 5), ("p", 9, 3)], "promoter string, left long, right long")
    got = {r["promoter"]: (r["start"], r["end"], r["status"]) for r in interval.fragments(prom, sites, 1000, 10, 5).collect()}
    assert got == {"p": (75, 130, "ready"), "q": (75, 130, "ready"), "r": (None, None, "missing_coordinates")}


def test_reference_match(spark):
    rows = [("ACGTTGCAAC", "ttG", 6, "+"), ("ACGTTGCAAC", "gcA", 5, "-"), ("ACGTTGCAAC", "ttC", 6, "+"), ("ACGTTGCAAC", "ttG", None, "+")]
    df = spark.createDataFrame([(i, f"g{i}", *r[1:]) for i, r in enumerate(rows)], "id int, contig string, seq string, tss long, strand string")
    genomes = spark.createDataFrame([(f"g{i}", r[0]) for i, r in enumerate(rows)], "contig string, s string")
    for width in (3, 4, 100):
        got = {r["id"]: r["matches"] for r in interval.reference_match(df, interval.chunked(genomes, "contig", "s", width), width).collect()}
        assert got == {0: True, 1: True, 2: False, 3: None}


def test_slices_across_chunks(spark):
    r = random.Random(6)
    genomes = {c: "".join(r.choice("ACGT") for _ in range(n)) for c, n in (("x", 97), ("y", 10), ("z", 0))}
    chunks = interval.chunked(spark.createDataFrame(list(genomes.items()), "contig string, s string"), "contig", "s", 10)
    assert chunks.where(F.length("seq") > 10).count() == 0 and chunks.count() == 11
    asked = [(i, r.choice("xyzw"), a, a + r.randrange(-2, 60)) for i in range(80) for a in [r.randrange(-9, 110)]]
    got = {x["id"]: x["piece"] for x in interval.slices(spark.createDataFrame(asked, "id int, contig string, start long, end long"), chunks, 10).collect()}
    want = {i: genomes[c][max(a, 1) - 1 : max(b, 0)] for i, c, a, b in asked if c in genomes}
    assert got == {i: s for i, s in want.items() if s}


def test_reversed_pair(spark):
    pairs = spark.createDataFrame([("g", "x", "y", -4.0, -5.0, -3.0)], "feature string, numerator string, denominator string, lfc double, ci_low double, ci_high double")
    wanted = spark.createDataFrame([("g", "y", "x")], "feature string, numerator string, denominator string")
    r = cross.oriented_pairs(wanted, pairs).first()
    assert (r["lfc"], r["ci_low"], r["ci_high"]) == (4.0, 3.0, 5.0)


def test_enrichment_golden(spark):
    u = spark.createDataFrame([("beta", i, i < 3, False) for i in range(20)], "dataset string, feature int, up boolean, down boolean")
    # both signs stay in the background and respond in neither direction
    v = spark.createDataFrame([("beta", i, i < 3, i == 2) for i in range(20)], "dataset string, feature int, up boolean, down boolean")
    mixed = candidates.enrichment(spark.createDataFrame([("tf", 1, "activates"), ("tf", 2, "activates")], "src string, dst int, effect string"), v).where("direction = 'up'").first()
    assert (mixed["background"], mixed["targets"], mixed["responsive"], mixed["a"]) == (20, 2, 2, 1)
    e = spark.createDataFrame([("tf", i, "activates") for i in range(3)], "src string, dst int, effect string")
    got = {r["direction"]: r for r in candidates.enrichment_tests(candidates.enrichment(e, u, overlap=True)).collect()}
    assert got["up"]["p"] == pytest.approx(1 / 1140) and got["up"]["padj"] == pytest.approx(2 / 1140) and got["up"]["background"] == 20
    assert got["up"]["odds"] == float("inf") and got["up"]["overlap"] == [0, 1, 2] and got["down"]["odds"] is None


def test_background_needs_eligible_rows_of_verified_identity(spark):
    rows = [(f"g{i}", d, 3.0 if i < 3 else -3.0 if i == 3 else 0.0, 0.001, i != 19, "source_name" if i == 18 else "mapped") for d in ("beta", "amino") for i in range(20)]
    obs = spark.createDataFrame([*rows, ("g0", "beta", 2.5, 0.01, None, "mapped"), ("g1", "beta", -2.5, 0.01, True, "mapped")], "feature string, dataset string, lfc double, p double, eligible boolean, basis string")
    edges = spark.createDataFrame([("tf", f"g{i}", "activates") for i in (0, 1, 2, 18, 19)], "src string, dst string, effect string")
    got = {(r["dataset"], r["direction"]): r for r in candidates.enrichment(edges, candidates.universe(obs, 0.05, 2.0)).collect()}
    assert all(r["background"] == 18 and r["targets"] == 3 for r in got.values())
    assert (got["amino", "up"]["responsive"], got["beta", "up"]["responsive"], got["beta", "down"]["responsive"]) == (3, 2, 1)  # g1 has both signs in beta


OPTIONS = "feature string, class string, promoter string, grp string, n_supporting long, screen_fraction double, confidence_rank int, stronger_fraction double, max_other double, effect double, regulators array<string>, matches boolean"


def options(spark, rows):
    return spark.createDataFrame(rows, OPTIONS)


def test_balanced_panel_keeps_the_order_of_keys(spark):
    # support, then screens, then confidence come before reuse; reuse before the direct share; the largest effect is near the end
    rows = [
        ("a", "one", "p1", "t1", 2, 0.5, 1, 0.0, 9.0, 1.0, ["r"], True), ("b", "one", "p2", "t2", 1, 1.0, 3, 1.0, 0.0, 9.0, ["r"], True), ("x", "one", "p9", "t9", 9, 1.0, 3, 1.0, 0.0, 9.0, ["r"], False),
        ("c", "two", "p1", "t3", 9, 1.0, 3, 1.0, 0.0, 9.0, ["s"], True), ("d", "two", "p4", "t1", 9, 1.0, 3, 1.0, 0.0, 9.0, ["s"], True), ("e", "two", "p5", "t5", 1, 0.5, 2, 0.1, None, 1.0, ["r"], True),
        ("f", "two", "p6", "t6", 1, 0.5, 2, 0.0, 5.0, 0.5, ["q"], True), ("g", "two", "p7", "t7", 1, 0.5, 2, 1.0, 0.0, 9.0, [], True),
    ]
    for order in (rows, rows[::-1]):
        got = [(r["class"], r["feature"], r["reuse"]) for r in panel.listing(panel.balanced(options(spark, order), 3)).collect()]
        # c and d share a promoter or group with a; f reuses nothing, e reuses r, g has no regulator and comes last
        assert got == [("one", "a", 0), ("two", "f", 0), ("one", "b", 1), ("two", "e", 2), ("two", "g", None)]
    base = [(r["class"], r["feature"], r["promoter"]) for r in panel.effect_only(options(spark, rows), 2).collect()]
    assert base == [("one", "b", "p2"), ("two", "c", "p1"), ("one", "a", "p1"), ("two", "d", "p4")]
    m = panel.metrics(panel.effect_only(options(spark, rows), 2)).first()
    assert (m["n"], m["features"], m["promoters"], m["groups"], m["median_effect"], m["missing_other"]) == (4, 4, 3, 3, 9.0, 0)


def test_panel_violations(spark):
    row = ("a", "one", "p1", "t1", 2, 0.5, 1, 0.0, 9.0, 1.0, ["r"], True)
    pool = options(spark, [row, ("b", "one", "p2", "t2", 1, 1.0, 3, 1.0, 0.0, 9.0, ["r"], True), ("c", "two", "p3", "t3", 1, 1.0, 3, 1.0, 0.0, 9.0, ["r"], False)])
    chosen = options(spark, [row, ("b", "one", "p2", "t2", 1, 0.9, 3, 1.0, 0.0, 9.0, ["r"], True), ("c", "two", "p3", "t3", 1, 1.0, 3, 1.0, 0.0, 9.0, ["r"], False)])
    assert sorted(tuple(r) for r in panel.violations(chosen, pool, 1).collect()) == [("budget", "one"), ("outside_pool", "two|c|p3"), ("stale_metrics", "one|b|p2")]
    assert panel.violations(panel.balanced(pool, 2), pool, 2).count() == 0
    assert [tuple(r) for r in panel.violations(panel.balanced(pool, 2), pool.unionByName(options(spark, [row])), 2).collect()] == [("repeated_option", "one|a|p1")]


def test_options_take_the_group_of_the_feature(spark):
    # a and b meet in unit 1, b and c in unit 2: one group; a has promoter p through both of its units, but one option
    units = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "a"), (7, "d")], "unit long, member string")
    groups = panel.feature_groups(units).withColumn("grp", F.col("grp").cast("string"))
    assert {r["feature"]: r["grp"] for r in groups.collect()} == {"a": "1", "b": "1", "c": "1", "d": "7"}
    stable = spark.createDataFrame([(f, "one", 1, 1.0, 1.0) for f in "abde"], "feature string, class string, n_supporting long, effect double, screen_fraction double")
    cross_ = spark.createDataFrame([], "feature string, class string, stronger_fraction double, max_other double")
    cv = spark.createDataFrame([("a", 0.5), ("a", 0.7)], "feature string, cv double")
    regs = spark.createDataFrame([(f, ["r"]) for f in "abde"], "feature string, regulators array<string>")
    mapped = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "p"), ("d", "q"), ("e", "q"), ("b", None)], "feature string, promoter string")
    fragments = spark.createDataFrame([("p", 1, True), ("q", None, True)], "promoter string, confidence_rank int, matches boolean")
    got = sorted((r["feature"], r["promoter"], r["grp"], r["confidence_rank"]) for r in panel.options(stable, cross_, cv, regs, mapped, groups, fragments).collect())
    assert got == [("a", "p", "1", 1), ("b", "p", "1", 1), ("d", "q", "7", 0), ("e", "q", "e", 0)]


def test_evidence_tiers(spark):
    rows = [
        ("one_hit", "d1", "beta", "discovery", 3.0, 0.01), ("one_hit", "d2", "beta", "discovery", 0.1, 0.5), ("two_hits", "d1", "beta", "discovery", 3.0, 0.01), ("two_hits", "d2", "beta", "discovery", 2.5, 0.01), ("two_hits", "d3", "amino", "discovery", -4.0, 0.01),
        ("clash", "d1", "beta", "discovery", 3.0, 0.01), ("clash", "d2", "beta", "discovery", -3.0, 0.01), ("both", "d1", "beta", "discovery", 3.0, 0.01), ("both", "d3", "amino", "discovery", 5.0, 0.01),
        ("challenge_only", "d4", "amino", "challenge", 6.0, 0.001), ("down", "d1", "beta", "discovery", -6.0, 0.001), ("lone", "d3", "amino", "discovery", 2.2, 0.04), ("lone", "d1", "beta", "discovery", None, None),
    ]
    unusable = [("flagged", "d1", "beta", "discovery", 9.0, 0.001, False), ("flagged", "d2", "beta", "discovery", 9.0, 0.001, None), ("two_hits", "d4", "amino", "challenge", 9.0, 0.001, False)]
    obs = spark.createDataFrame([*[(*r, r[4] is not None) for r in rows], *unusable], "feature string, dataset string, class string, role string, lfc double, p double, eligible boolean")
    obs = obs.withColumn("basis", F.when(F.col("feature") == "clash", "source_name").otherwise("mapped"))
    ev = candidates.evidence(obs, {"beta": ["d1", "d2"], "amino": ["d3", "d4"]}, 0.05, 2.0, lone="d3", caveats={"d2": "few samples"})
    got = {r["feature"]: r for r in ev.collect()}
    assert set(got) == {"one_hit", "two_hits", "clash", "both", "lone"}
    single, multiple, within = "single_comparison_supported", "multiple_comparisons_supported", "within_class_direction_difference"
    assert {k: r["tier"] for k, r in got.items()} == {"one_hit": single, "two_hits": multiple, "clash": within, "both": single, "lone": single}
    assert {k: r["grp"] for k, r in got.items()} == {"one_hit": "beta", "two_hits": "beta", "clash": "beta", "both": "cross", "lone": "amino"}
    assert {x["class"]: x["share"] for x in got["one_hit"]["support"]} == {"beta": 0.5, "amino": 0.0} and got["two_hits"]["caveats"] == ["few samples"]
    assert got["two_hits"]["flags"] == ["cross_class_direction_difference"] and got["clash"]["flags"] == [within, "identity_mapping_not_verified"] and got["lone"]["flags"] == ["d3_only"] and not got["both"]["flags"]
    assert {k: (r["n_up"], r["n_down"]) for k, r in got.items()} == {"one_hit": (1, 0), "two_hits": (2, 0), "clash": (1, 0), "both": (2, 0), "lone": (1, 0)}
    assert {x["dataset"]: (x["status"], x["regulation"]) for x in got["two_hits"]["profile"]} == {"d1": ("significant_response", ["up"]), "d2": ("significant_response", ["up"]), "d3": ("significant_response", ["down"]), "d4": ("unavailable", ["not_regulated"])}
    assert [x["status"] for x in got["lone"]["profile"]] == ["unavailable", "significant_response"] and got["both"]["primary_effect"] == 5.0
    assert [r["feature"] for r in candidates.ranked(ev).orderBy("rank").collect()] == ["two_hits", "both", "one_hit", "lone", "clash"]
    short = candidates.shortlist(ev)
    assert [r["feature"] for r in short.where("class = 'beta'").orderBy("place").collect()] == ["two_hits", "both", "one_hit", "clash"]
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, candidates.shortlist(ev, 9).collect()))


def test_stability_and_rank_change(spark):
    rows = [("a", "d1", "beta", "discovery", 3.0, 1.0, 0.01), ("a", "d2", "beta", "discovery", 2.4, 2.3, 0.01), ("b", "d1", "beta", "discovery", 9.0, 2.0, 0.01), ("c", "d1", "beta", "discovery", 2.2, 2.2, 0.01), ("d", "d1", "beta", "discovery", -9.0, -9.0, 0.01), ("e", "d4", "beta", "challenge", 9.0, 9.0, 0.01), ("a", "d3", "amino", "discovery", 1.8, 1.0, 0.01)]
    flagged = [("a", "d5", "beta", "discovery", 8.0, 8.0, 0.01, False), ("f", "d1", "beta", "discovery", 8.0, 8.0, 0.01, None)]
    obs = spark.createDataFrame([*[(*r, True) for r in rows], *flagged], "feature string, dataset string, class string, role string, lfc double, shrunk double, p double, eligible boolean")
    counts = spark.createDataFrame([(f, v) for f, vs in {"a": [10, 20, 50], "b": [50, 50, 50], "c": [10, 10, 10]}.items() for v in vs], "feature string, value int")
    s = candidates.stability(obs, counts, [10, 20, 50], [-0.5, 0.0, 0.5], 0.05, 2.0)
    got = {(r["class"], r["feature"]): (r["n_supporting"], r["raw_effect"], r["effect"], r["passed"]) for r in s.collect()}
    assert got == {("beta", "a"): (2, 3.0, 2.3, 3), ("beta", "b"): (1, 9.0, 2.0, 9), ("beta", "c"): (1, 2.2, 2.2, 2)}
    assert {r["feature"]: (r["raw_place"], r["shrunk_place"], r["change"]) for r in candidates.rank_change(s).collect()} == {"a": (1, 1, 0), "b": (2, 3, -1), "c": (3, 2, 1)}


def test_cross_status(spark):
    rows = [("s", 3.0, 1.0, 5.0, 0.01, 0.2, 0.5, -0.4, 0.8), ("c", -3.0, -5.0, -1.0, 0.01, 4.0, 0.001, 3.0, 5.0), ("i", 3.0, -0.1, 5.0, 0.01, 0.2, 0.5, -0.4, 1.8), ("n", 3.0, 1.0, 5.0, 0.2, None, None, None, None)]
    # a pair or a counterpart that is not eligible shows nothing, nor does one whose flag is missing
    sure = ("s", 3.0, 1.0, 5.0, 0.01, 9.0, 0.001, -0.4, 0.8)
    rows = [*[(*r, True, r[5] is not None) for r in rows], ("x", *sure[1:], False, False), ("y", *sure[1:], None, None)]
    df = spark.createDataFrame(rows, "feature string, lfc double, ci_low double, ci_high double, family_padj double, other_lfc double, other_p double, other_low double, other_high double, eligible boolean, other_eligible boolean")
    got = {r["feature"]: (r["status"], r["detected"], r["within_bound"]) for r in cross.status(df, 0.05, 2.0, 1.0).collect()}
    assert got == {"s": ("discovery_response_stronger", False, True), "c": ("counterpart_response_stronger", True, False), "i": ("inconclusive", False, False), "n": ("inconclusive", False, False), "x": ("inconclusive", False, False), "y": ("inconclusive", False, False)}


def test_places_and_percentiles_of_large_groups(spark):
    from respondex.operators import modules
    from respondex.plans import ranges

    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None]), float(r.randrange(9)), r.random() < 0.7) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, v double, ok boolean")
    got = {x["id"]: x["place"] for x in ranges.places(df, ["k"], [F.col("v").desc(), F.col("id").asc()], "place").collect()}
    for k in ("a", "b", None):
        assert [got[i] for i, *_ in sorted((x for x in rows if x[1] == k), key=lambda x: (-x[2], x[0]))] == list(range(1, sum(x[1] == k for x in rows) + 1))
    p = {x["id"]: x["percentile"] for x in modules.percentile(df, "v", "k", "ok").collect()}
    for i, k, v, ok in rows:
        mine = [x[2] for x in rows if x[1] == k and x[3]]
        assert (p[i] is None) if not ok else p[i] == pytest.approx(100 * sum(x <= v for x in mine) / len(mine), abs=0.006)


def test_latest_review_is_by_time(spark):
    rows = [("e", "2024-01-02", "a", "new"), ("e", "2024-01-01", "z", "old"), ("e", "2024-01-02", "b", "tie")]
    df = spark.createDataFrame(rows, "feature string, edited_at string, edit_id string, status string")
    assert reviews.latest(df, ["feature"]).first()["status"] == "tie"


def test_history_of_a_hot_entity(spark):
    r = random.Random(7)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), r.randrange(50), r.choice(["x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "edit_id int, feature string, edited_at int, status string")
    out = reviews.history(df, ["feature"], "status", parts=9)
    want, last = {}, {}
    for i, k, _, v in sorted(rows, key=lambda x: (x[2], x[0])):
        want[i] = last.get(k)
        last[k] = v
    assert {x["edit_id"]: x["old_value"] for x in out.collect()} == want and out.columns == [*df.columns, "old_value"]


def test_edge_collapse_and_search(spark):
    raw = spark.createDataFrame([("r", "g", "+", "S"), ("r", "g", "-", "W"), ("r", "h", "?", "C"), ("q", "h", "+", "?")], "src string, dst string, sign string, confidence string")
    got = {(r["src"], r["dst"]): (r["rank"], r["effect"], r["n_evidence"]) for r in graph.collapsed_edges(raw).collect()}
    assert got == {("r", "g"): (2, "dual", 2), ("q", "h"): (0, "activates", 1)}
    c = spark.createDataFrame([("g", "A")], "feature string, tier string")
    ev = spark.createDataFrame([("g", "challenge", 0.01, 5.0)], "feature string, role string, p double, lfc double")
    assert store.search(c, ev, 0.05, 1.0).count() == 0
    with pytest.raises(ValueError):
        store.search(c, ev, 1.5)


def test_ambiguous_alias(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    al = spark.createDataFrame([("x", "a"), ("X", "b"), ("y", "a")], "alias string, id string")
    asked = spark.createDataFrame([("x",), ("Y",), ("a",), ("?",)], "text string")
    assert {r["text"]: r["status"] for r in identity.exact(asked, ids, al).collect()} == {"x": "ambiguous", "Y": "alias", "a": "exact", "?": "unknown"}


def test_checks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, -1.0), (3, 1.5), (4, float("nan")), (5, None)], "k long, v double")
    assert {r["key"] for r in checks.counts_are_whole(df, "k", "v").collect()} == {"2", "3", "4", "5"}
    assert {r["key"] for r in checks.within(df, "k", "v", 0, 1).collect()} == {"2", "3", "4"}
    dose = spark.createDataFrame([(1, 1.0, "mg"), (2, None, None), (3, None, "mg"), (4, -1.0, "mg"), (5, 2.0, None)], "k long, dose double, unit string")
    assert {r["key"] for r in checks.doses(dose, "k").collect()} == {"3", "4", "5"}
    assert checks.content_digest(df, ["k"]).first() == checks.content_digest(df.orderBy(F.desc("k")), ["k"]).first()
    pair = lambda x: checks.content_digest(spark.createDataFrame([(x,), (x,)], "k long"), ["k"]).first()
    assert pair(1) != pair(2)


def test_combined_sets_equal_brute_force(spark):
    from itertools import combinations
    from math import comb

    from respondex.operators import modules

    r = random.Random(10)
    n, fdr = 120, 0.2
    sets = {f"s{i:02d}": {f for f in range(n) if r.random() < r.choice([0.03, 0.1, 0.3])} for i in range(50)}
    comps = {c: {f for f in range(n) if r.random() < 0.04} | set(r.sample(sorted(sets["s07"] | sets["s08"]), 3)) for c in ("c1", "c2", "c3")}
    comps["c1"] |= sets["s01"] & sets["s02"]
    comps["c2"] |= sets["s03"] | set(list(sets["s04"])[:6])
    tail = lambda a, size, c: sum(comb(c, j) * comb(n - c, size - j) for j in range(a, min(size, c) + 1)) / comb(n, size)
    want = {}
    for c, members in comps.items():
        met = sorted(k for k, v in sets.items() if v & members)
        tests = [(k, None, "one", sets[k]) for k in met]
        for a, b in combinations(met, 2):
            tests += [(a, b, "and", sets[a] & sets[b]), (a, b, "or", sets[a] | sets[b])]
        assert len(tests) == len(met) ** 2
        ps = [(round(tail(len(x & members), len(x), len(members)), 9), a, b, op, len(x & members), len(x)) for a, b, op, x in tests]
        ps.sort(key=lambda x: -x[0])
        low = 1.0
        for i, (p, a, b, op, shared, size) in enumerate(ps):
            upto = sum(y[0] <= p for y in ps)
            low = min(low, p * len(ps) / upto)
            if low <= fdr:
                want[c, a, b, op] = (shared, size, p, low)
    got = {(x["component"], x["a"], x["b"], x["op"]): x for x in modules.combined_sets(spark.createDataFrame([(c, f) for c, m in comps.items() for f in m], "component string, feature int"), spark.createDataFrame([(k, f) for k, m in sets.items() for f in m], "set string, feature int"), n, fdr).collect()}
    assert set(got) == set(want) and {k[3] for k in want} == {"one", "and", "or"}
    for k, (shared, size, p, q) in want.items():
        x = got[k]
        assert (x["shared"], x["in_set"], x["in_component"]) == (shared, size, len(comps[k[0]])) and x["p"] == pytest.approx(p, abs=2e-9) and x["q"] == pytest.approx(q, abs=1e-6)


def test_combined_sets_make_no_pairs_that_are_left_out(spark, monkeypatch):
    from respondex.operators import modules

    made, write = [], modules.staged

    def counted(df, name, codec=None):
        out = write(df, name, codec)
        made.append(out.count())
        return out

    monkeypatch.setattr(modules, "staged", counted)
    sets = spark.createDataFrame([(f"s{f // 5:03d}", f) for f in range(2000)], "set string, feature int")
    m = spark.createDataFrame([("c", f) for f in range(2000) if f % 5 == 0 or f < 10], "component string, feature int")
    got = {(x["a"], x["b"], x["op"], x["shared"], x["in_set"]) for x in modules.combined_sets(m, sets, 2000, 0.05).collect()}
    assert ("s000", "s001", "or", 10, 10) in got and all({a, b} & {"s000", "s001"} for a, b, *_ in got)
    assert max(made) < 2000


def test_identity_keeps_every_row(spark):
    al = identity.alias_map(spark.createDataFrame([("thra", "thrA", 1, "b0002"), ("b0002", "thrA", 1, "b0002"), ("nolocus", "xyz", 2, ""), ("b0009", "abc", 3, None)], "token string, feature string, ord int, locus string"))
    rows = [(1, "b0002", "x"), (2, "zz", "geneX"), (3, "b4444", None), (4, None, "THRA"), (5, "", " "), (6, "b0009", "own"), (7, None, "nolocus")]
    got = {r["key"]: (r["feature"], r["locus"], r["basis"]) for r in identity.resolved(spark.createDataFrame(rows, "key int, locus_tag string, symbol string"), "key", ["locus_tag", "symbol"], al, ["symbol", "locus_tag"], ["locus_tag"]).collect()}
    assert got == {1: ("thrA", "b0002", "mapped"), 2: ("geneX", None, "source_name"), 3: ("b4444", "b4444", "source_name"), 4: ("thrA", "b0002", "mapped"), 5: (None, None, "unknown"), 6: ("abc", "b0009", "mapped"), 7: ("xyz", None, "mapped")}


def test_batch_search_equals_contains(spark):
    r = random.Random(2)
    names = [("".join(r.choice("abAé#") for _ in range(r.randrange(0, 9))), f"id{i % 40}") for i in range(120)] + [(None, "id1")]
    texts = {"".join(r.choice("abE\u00e9#") for _ in range(r.randrange(0, 6))) for _ in range(60)} | {"ID3", "zz", "d", ""}
    ids = [f"id{i}" for i in range(45)]
    df = identity.matching_all(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(names, "alias string, id string"))
    want = {(t, i) for t in texts if t for i in ids if t.lower() in i or any(n is not None and k == i and t.lower() in n.lower() for n, k in names)}
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    got = [tuple(x) for x in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def path_tables(spark, seed=5):
    """Candidates, some with a promoter of their own, interactions of all kinds, units and their promoters; targets are shared and some lead nowhere."""
    rnd = random.Random(seed)
    genes = [(t, g) for g in range(30) for t in {rnd.randrange(8) for _ in range(rnd.randrange(3))}]
    proms = sorted({(t, rnd.randrange(6)) for t in range(9) for _ in range(2) if t != 4})
    rows = {(r, k, rnd.randrange({"gene": 32, "promoter": 8, "tu": 10}[k])) for r in range(12) for k in ("gene", "promoter", "tu") for _ in range(6)}
    inter = [(f"{r}-{k}{x}-{n}", r, k, *[x if k == c else None for c in ("gene", "promoter", "tu")]) for r, k, x in sorted(rows) for n in range(1 + x % 2)]
    return (
        spark.createDataFrame([(f, f % 6 if f % 2 else None) for f in range(0, 30, 2)] + [(f, 3) for f in (1, 3)], "feature long, promoter long"),
        spark.createDataFrame(inter, "interaction string, regulator long, kind string, gene long, promoter long, tu long"), spark.createDataFrame(genes, "tu long, gene long"), spark.createDataFrame(proms, "tu long, promoter long"),
    )


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_path_ends_join_no_interaction_to_candidates(spark):
    inputs = path_tables(spark)
    by = store.candidate_paths(*inputs).groupBy("feature", "kind")
    want = by.agg(F.min("interaction").alias("first"), F.max("interaction").alias("last"), F.count("*").alias("n"))
    assert sorted_rows(store.path_ends(*inputs).select(want.columns)) == sorted_rows(want)


def test_local_graph_counts_make_no_graph(spark):
    inputs = path_tables(spark)
    want = store.local_graph(store.candidate_paths(*inputs), inputs[1]).groupBy("feature", "kind").agg(F.count("*").alias("n"))
    assert sorted_rows(store.local_graph_counts(*inputs)) == sorted_rows(want)


def test_local_node_counts_make_no_graph(spark):
    inputs = path_tables(spark)
    want = store.local_nodes(store.local_graph(store.candidate_paths(*inputs), inputs[1])).groupBy("feature", "kind").agg(F.count("*").alias("n"))
    assert sorted_rows(store.local_node_counts(*inputs)) == sorted_rows(want)


@pytest.mark.parametrize("wide", [1, 256])
def test_reachable_equals_a_search(spark, wide):
    rnd = random.Random(wide)
    edges = sorted({(f"n{rnd.randrange(14)}", f"{rnd.choice('nz')}{rnd.randrange(25)}") for _ in range(60)} | {("a", "z1"), ("a", "n1"), ("b", "n1"), ("b", "z40")})
    to = {}
    for s, d in edges:
        to.setdefault(s, []).append(d)
    want = set()
    for start in ("a", "b", "n3", "z2", "c"):
        todo, seen = [start], {start}
        while todo:
            for d in to.get(todo.pop(), []):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        want |= {(start, x) for x in seen}
    e = spark.createDataFrame([(s, d, 1) for s, d in edges for _ in range(2)], "src string, dst string, n int")
    got = graph.reachable(e, spark.createDataFrame([(x,) for x in ("a", "b", "n3", "z2", "c", "a")], "start string"), fold=2, wide=wide).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_sequences_are_cut_in_one_pass(spark):
    texts = [(i, "".join(random.Random(i).choices("ACGT\n", k=n))) for i, n in enumerate((1, 31, 255, 256, 257, 512, 2000))]
    d = interval.chunked(spark.createDataFrame([*texts, (99, ""), (98, None)], "id long, g string"), "id", "g", 256)
    assert sorted_rows(d) == sorted([(i, n, t[n * 256 : n * 256 + 256]) for i, t in texts for n in range((len(t) + 255) // 256)], key=repr)
    assert "substring" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_reference_totals_make_no_paths(spark):
    _, *tables = path_tables(spark)
    by = store.reference_paths(*tables).groupBy("regulator", "kind", "basis")
    want = by.agg(F.count("*").alias("n"), F.count_distinct("gene").alias("genes"), F.count_distinct("promoter").alias("promoters"))
    assert {r["basis"] for r in want.collect()} == {"direct", "context", "missing"}
    assert sorted_rows(store.reference_totals(*tables).select(want.columns)) == sorted_rows(want)


def test_path_texts_are_the_sorted_paths(spark):
    inputs = path_tables(spark)
    want = {r["feature"]: set() for r in inputs[0].collect()}
    for r in store.candidate_paths(*inputs).collect():
        want[r["feature"]].add(f"{r['kind']}:{r['interaction']}")
    got = {r["feature"]: ";".join(r["texts"]) for r in store.path_texts(*inputs).collect()}
    assert got == {f: ";".join(sorted(x)) for f, x in want.items()}
    base = inputs[0].select("feature").distinct().withColumn("seen", F.col("feature") * 2)
    d = store.path_texts(*inputs, base=base, each=10)
    assert {(r["feature"], r["seen"]): ";".join(r["texts"]) for r in d.collect()} == {(f, 2 * f): x for f, x in got.items()}
    plan = d._jdf.queryExecution().sparkPlan().toString()  # texts are met last, after all shuffles of rows
    assert "SortMergeJoin [__cls" in plan.split("Exchange")[0]


def test_unit_context_sums_up_each_remainder_once(spark, tmp_path):
    from respondex.plans import catalog

    spark.range(400).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(500).select(F.col("id").alias("s_suppkey")).union(spark.range(7, 8)).write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog.QUERIES["a28_unit_context"](spark, str(tmp_path))
    rows = {r["set"]: r for r in got.collect()}
    assert len(rows) == 500 and rows[7]["features"] == 16 and rows[57]["features"] == 8 and rows[7]["share"] == rows[57]["share"]


def test_pairings_are_dealt_by_their_pairs(spark, monkeypatch):
    from respondex.operators import modules
    from respondex.plans import skew

    rows = [(i, i % 3 if i % 10 else None, i % 4 == 0 if i % 11 else None) for i in range(200)] + [(900, 7, True), (901, 8, False), (902, 1, False), (902, 1, False)]
    monkeypatch.setattr(modules, "dealt_by_output", lambda *a: skew.dealt_by_output(*a, each=200))
    d = modules.pairings(spark.createDataFrame(rows, "condition long, background long, treated boolean"), block=5)
    want = [(b, x, y) for x, b, t in rows for y, c, u in rows if t and u is False and b == c and b is not None]
    assert sorted_rows(d) == sorted(want, key=repr)
    tasks = d.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) < len(want) / 3


def test_edges_of_features_are_chosen_before_the_shuffle(spark, tmp_path):
    from respondex.plans import bindings

    rows = [(o, o % 5, o % 7, "O" if o % 2 else "F") for o in range(60)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(o, f"{1 + o % 5}-X") for o in range(50)], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    few = spark.createDataFrame([(2,), (3,), (3,), (99,)], "feature long")
    d = str(tmp_path)
    some = bindings.edges(spark, d, few)
    assert sorted_rows(some) == sorted_rows(bindings.edges(spark, d).where("dst IN (2, 3)"))
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Inner")


def test_panel_options_shuffle_edges_of_their_features_only(spark, monkeypatch):
    from respondex.plans import bindings, q_joins

    asked, whole = [], bindings.edges
    monkeypatch.setattr(q_joins.b, "edges", lambda *a: asked.append(a[2:]) or whole(*a))
    q_joins._options(spark, "/root/testdata/sf0.001")
    assert len(asked) == 1 and "feature" in asked[0][0].columns


def test_seeds_are_made_once_and_edges_dealt_by_counted_rows(spark, monkeypatch):
    from respondex.operators.candidates import seeded
    from respondex.plans import bindings, skew

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    seeds = bindings.seeds(spark, d)
    assert sum("Relation" in x and "l_partkey" in x for x in seeds._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1
    assert sorted(seeds.collect()) == sorted(seeded(bindings.observations(spark, d), bindings.P_MAX, bindings.LFC_MIN).select("feature").distinct().collect())
    want = sorted(bindings.edges(spark, d).collect())
    monkeypatch.setattr(skew, "TASK_ROWS", 600)
    dealt = bindings.edges(spark, d)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "SortAggregate" not in plan
    assert sorted(dealt.collect()) == want and {x["effect"] for x in want} == {"activates", "represses", "dual"}


def test_a_task_reduces_few_edges_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from respondex.operators import components

    r = np.random.default_rng(5)
    ends = r.integers(0, 9_000_000, (2, components.HELD))
    batches = [pa.RecordBatch.from_arrays([pa.array(ends[0, i : i + 10_000]), pa.array(ends[1, i : i + 10_000])], ["u", "v"]) for i in range(0, components.HELD, 10_000)]
    tracemalloc.start()
    out = components.forest(batches)
    assert tracemalloc.get_traced_memory()[1] < 40e6 and not batches
    tracemalloc.stop()
    root = union_find(list(zip(*ends.tolist(), strict=True)))
    assert all(root[u] == v for u, v in zip(*(c.to_pylist() for c in out.columns), strict=True)) and out.num_rows == sum(k != v for k, v in root.items())


def test_reference_paths_are_dealt_by_the_rows_they_make(spark):
    genes = spark.createDataFrame([(t, g) for t in (1, 2) for g in range(50)], "tu long, gene long")
    promoters = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "tu long, promoter long")
    i = spark.createDataFrame([(f"{n}", n, "promoter", None, p, None) for n, p in enumerate([7] * 40 + [8, 9])] + [("t", 1, "tu", None, None, 2), ("g", 1, "gene", 5, None, None)], "interaction string, regulator long, kind string, gene long, promoter long, tu long")
    out = store.reference_paths(i, genes, promoters, ("promoter",), each=200)
    assert out.rdd.getNumPartitions() == 20
    sizes = [n for n in out.rdd.glom().map(len).collect() if n]
    assert sum(sizes) == 40 * 100 + 2 and max(sizes) < 1500 and len(sizes) > 6
    got = {(x["interaction"], x["promoter"], x["tu"], x["gene"], x["basis"]) for x in out.collect()}
    want = {(f"{n}", 7, t, g, "context") for n in range(40) for t in (1, 2) for g in range(50)} | {("40", 8, 3, None, "missing"), ("41", 9, None, None, "missing")}
    assert got == want
    assert {x["kind"]: x["count"] for x in store.reference_paths(i, genes, promoters).groupBy("kind").count().collect()} == {"promoter": 4002, "tu": 50, "gene": 1}
