"""What operator 3 keeps on the driver: the sketch, and no side of a join that was shuffled first."""

import numpy as np

from ledgerloom.llm import ngram_join


def test_the_sketch_is_two_bytes_a_cell(spark):
    """It was eight on the driver and four in the broadcast; counts are still told apart and in order."""
    counts = np.concatenate([np.arange(1 << 14), (1.01 ** np.arange(980, 4300)).astype(np.int64)])
    levels = ngram_join._levels(counts).astype(np.int64)
    assert (np.diff(levels) >= 0).all() and (np.diff(levels)[: 1 << 14] > 0).all() and (np.diff(levels)[1 << 14 :] > 0).all()
    assert int(ngram_join._levels(np.array([2**62]))[0]) < 1 << 16
    docs = spark.createDataFrame([("a b c d e",), ("a b c d f",)], "text string").repartition(2)
    cells = ngram_join._sketch(docs, 4)
    assert cells.nbytes == 2 * ngram_join.BUCKETS and sorted(cells[cells > 0]) == [1, 1, 2]


def test_joins_are_not_made_broadcasts_on_the_way(spark, monkeypatch):
    """AQE broadcast dozens of shuffled sides through the driver; the session's own setting is back afterwards."""
    name, seen = "spark.sql.adaptive.autoBroadcastJoinThreshold", set()
    real = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag: (seen.add(spark.conf.get(name, None)), real(df, tag))[1])
    before = spark.conf.get(name, None)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "A b c d e"), (3, None)], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.classes(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert seen == {"-1"} and spark.conf.get(name, None) == before
