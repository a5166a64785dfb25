"""The pipeline's stages against brute force on their own inputs."""

import os

import pytest

import corpus_pipeline
from tests.llm.test_ops import brute_jaccard, brute_windows

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == docs.columns, name
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [[r["doc_id"] for r in d.collect()] for d in seen]
    assert all(set(b) <= set(a) and len(b) == len(set(b)) for a, b in zip(ids, ids[1:])) and len(ids[1]) >= 0.97 * len(ids[0])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(i) == 1 for i in ids[2]) >= 0.97 * sum(labels.get(i) == 1 for i in ids[1])
    _, comp = brute_jaccard([(r["doc_id"], r["text"]) for r in seen[2].collect()], 5, 80)
    assert set(ids[3]) == {i for i, c in comp.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = seen[3].collect()
    dirty = brute_windows([r["text"] for r in rows], items, 13, 20)
    assert set(ids[4]) == {r["doc_id"] for i, r in enumerate(rows) if not dirty[i][3]}
    tokens = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in tokens.collect()} == set(ids[4])


def test_odd_documents_in_each_stage(spark, tmp_path):
    d = f"file://{tmp_path}"
    prose = ["the house of the garden was near the water and people came there every summer " * 4 + f"for reason {i}" for i in range(6)]
    texts = [None, "", " ", "x", "123 !!", *prose, *prose[:2], "word " * 30_000]
    rows = [(i if i != 3 else None, t, ["en", None][i % 2], "s", len(t or ""), 1.5, "clash") for i, t in enumerate(texts)] + [(5, prose[0], "en", "s", 3, 1.5, "clash")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, component string"
    docs = spark.createDataFrame(rows, kind)
    spark.createDataFrame([(i, int(i < 9), 0) for i in range(12)] + [(None, 1, 0), (77, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "people came there every summer for reason 2")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        none = stage(spark, docs.where("false"), d)
        assert none.count() == 0 and none.columns == out.columns, name
        if name != "tokens":
            assert out.columns == docs.columns, name
            kept = [tuple(r) for r in out.collect()]
            assert all(r in rows for r in kept), name
            ids = sorted(-1 if r[0] is None else r[0] for r in kept)
            if name == "language":
                assert not {0, 1, 2, 4} & set(ids)
            if name == "near_duplicates":  # the repeated row, and whatever repeats a text of a lower id, is gone
                assert ids == sorted(set(ids)) and {0, 1, 2, 4, -1} <= set(ids) and not {11, 12} & set(ids)
            if name == "decontamination":
                assert 7 not in ids and {0, 1, 2, 4} <= set(ids)
        else:
            assert out.count() == len(rows) and out.where("n_tokens = 0").count() == 2
    docs.write.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and got.count() <= len(rows)
