"""The pipeline against brute force, stage by stage, on a small folder of tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import queries
from tests.llm.test_operators import SCHEMA, brute_classes, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    texts = [prose(int(r.integers(20, 200))) for _ in range(60)]
    texts += [texts[0], texts[1] + " more", "short", None, "a b c d e f " * 20, "&&& " * 50, "write to jane.roe@mail.net about " + texts[2]]
    rows = [(k, t, "en", f"s{k % 4}", None if t is None else len(t)) for k, t in enumerate(texts)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    return str(d), texts


def test_stages(spark, folder):
    d, texts = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    good = corpus_pipeline.quality_rules(spark, docs, d)
    kept = ids(good)
    assert set(range(60)) <= set(kept) and not {62, 63, 64, 65} & set(kept) and good.columns == corpus_pipeline.COLUMNS
    one = corpus_pipeline.near_duplicates(spark, good, d)
    root, _ = brute_classes([texts[k] for k in kept], 5, 80)
    assert ids(one) == sorted({kept[x] for x in root})
    safe = corpus_pipeline.private_data(spark, one, d)
    rows = {r["doc_id"]: r for r in safe.collect()}
    assert sorted(rows) == ids(one) and all("jane.roe" not in r["text"] and r["n_chars"] == len(r["text"]) for r in rows.values())
    assert all(r["text"] == texts[k] for k, r in rows.items() if k < 60)
    mixed = corpus_pipeline.source_mix(spark, safe, d)
    assert set(ids(mixed)) <= set(rows) and mixed.columns == corpus_pipeline.COLUMNS
    last = corpus_pipeline.token_ids(spark, mixed, d).collect()
    assert all(r["intact"] and r["n_tokens"] == len(r["ids"]) for r in last) and sorted(r["doc_id"] for r in last) == ids(mixed)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, name):
    text = prose(80)
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text + " x", None, None, None), (2, None, None, "s", None), (3, "", "en", None, 0), (4, prose(90) + " mail to a.b@mail.org", "fr", "t", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df.withColumns({c: F.lit(1) for c in ("id", "n", "kept", "ids", "value", "_value", "row", "weight", "rejected_by")})
    stage = dict(corpus_pipeline.STAGES)[name]
    out = [r.asDict() for r in stage(spark, odd, "").collect()]
    assert all(r["doc_id"] in (None, 1, 2, 3, 4) for r in out) and stage(spark, odd.limit(0), "").collect() == []
    if name == "quality_rules":
        assert sorted(str(r["doc_id"]) for r in out) == ["1", "1", "4", "None"]
    if name == "near_duplicates":
        assert sorted(str(r["doc_id"]) for r in out) == ["1", "2", "3", "4", "None"]
    if name == "private_data":
        assert len(out) == 6 and not any("a.b@" in (r["text"] or "") for r in out)
    if name == "token_ids":
        assert len(out) == 6 and sorted(r["n_tokens"] for r in out)[:2] == [0, 0]
    else:
        assert not out or list(out[0]) == corpus_pipeline.COLUMNS


def test_run(spark, folder):
    d, _ = folder
    first, second = (sorted((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, d).collect()) for _ in range(2))
    assert first == second and len(first) > 20


def test_every_operator_has_its_query():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
