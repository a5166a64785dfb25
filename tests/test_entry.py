"""The entry file: every query of the library against its SQL on the smallest tables, the panels on larger ones too."""

import os

import duckdb
import pytest

from respondex.plans import catalog
from respondex.plans.staging import clear

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PANELS = ["j5_panel_options", "k5_balanced_panel", "k6_effect_only_panel", "k7_panel_violations", "k7_planted_violations", "k7_selection_comparison", "v6_panel_unique"]
CASES = [(SMALL, name) for name in sorted(catalog.SQL)] + [(LARGER, name) for name in PANELS]


@pytest.fixture(scope="module")
def views():
    out = {}
    for folder in (SMALL, LARGER):
        con = out[folder] = duckdb.connect()
        for f in os.listdir(folder) if os.path.isdir(folder) else ():
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return out


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize(("folder", "name"), CASES, ids=[f"{os.path.basename(f)}-{n}" for f, n in CASES])
def test_query_equals_sql(spark, views, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    res = views[folder].execute(catalog.SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=repr)
    clear(spark)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables here")
def test_option_keys_are_unique(spark):
    options = catalog.QUERIES["j5_panel_options"](spark, LARGER)
    assert options.count() == options.select("class", "feature", "promoter").distinct().count() > 100


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "minimum_slice" in e.queries()
