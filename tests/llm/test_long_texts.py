"""Very long texts, and input columns named as the operators' outputs: every operator gives its defined result."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, chat, licenses, mixing, ngram_join, pii, ppm, quality, sharding
from ledgerloom.llm.queries import tokenizer_path

PROSE = " ".join(map("w{}".format, np.random.default_rng(3).integers(0, 50_000, 400_000)))
ONE_WORD = "ab" * 500_000
NOTICE = "general public license"
MAIL = "jane.doe@mail.org"
TEXTS = [PROSE, f"{PROSE} {NOTICE} {MAIL}", ONE_WORD, "a b c d e f g h i j k l", None]
CLASH = ["shard", "slot", "group_size", "text_crc32", "rejected_by", "weight", "probability", "kept", "n_shingles", "component_id", "n_links", "n_tokens", "score", "labels", "blocks", "n_words", "n_entities", "n", "piece"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(k, t, "en", "s", None) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("x") for c in CLASH})


def by_id(df, *columns):
    return {r["doc_id"]: r for r in df.select("doc_id", *columns).collect()}


def test_shard(docs):
    out = by_id(sharding.shard(docs, shards=3), "shard", "slot", "_ld_size", "group_size", "weight")
    assert [out[k]["_ld_size"] for k in range(5)] == [len(t or "") + 1 for t in TEXTS] == [out[k]["group_size"] for k in range(5)]
    assert len({out[k]["shard"] for k in range(3)}) == 3 and out[0]["weight"] == "x"


def test_quality(docs):
    out = by_id(quality.features(docs), "n_words", "word_chars", "n_repeat_words", "base_failed")
    assert [out[k]["n_words"] for k in range(5)] == [len((t or "").split()) for t in TEXTS]
    assert out[2]["word_chars"] == 1_000_000 and out[0]["n_repeat_words"] == 0 and [out[k]["base_failed"] for k in range(5)] == [False, False, True, False, True]
    assert by_id(quality.cascade(docs), "rejected_by", "shard")[2]["rejected_by"] not in (None, "x")


def test_join(docs):
    out = by_id(ngram_join.classes(docs), "n_shingles", "component_id", "n_links")
    assert [out[k]["component_id"] for k in range(5)] == [0, 0, 2, 3, 4] and out[2]["n_shingles"] == 1 and out[0]["n_links"] == out[1]["n_links"] == 1
    assert out[0]["n_shingles"] == 400_000 - 3
    assert sorted(by_id(ngram_join.dedupe(docs), "n_shingles")) == [0, 2, 3, 4]


def test_chat(spark):
    quote = "> " + ONE_WORD
    rows = [(1, 0, "user", ONE_WORD), (1, 1, "user", PROSE), (1, 2, "assistant", quote + "\nyes"), (1, 3, "user", ">" * 100_000 + " deep")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("x") for c in ("parent_turn", "linked", "depth", "hash", "node")})
    out = {r["turn"]: r for r in chat.format_chats(turns).collect()}
    assert len(out) == 4 and out[2]["parent_turn"] == 0 and out[2]["text"] == "yes" and out[1]["text"] == PROSE


def test_encode(docs):
    out = by_id(bpe.round_trip(docs, tokenizer_path()), "n_tokens", "decoded_sha256")
    assert all(out[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for k, t in enumerate(TEXTS))


def test_mix(docs):
    out = by_id(mixing.mix(docs), "weight", "probability", "kept", "shard")
    assert len(out) == 5 and all(0 < r["probability"] <= 1 and isinstance(r["kept"], bool) and r["shard"] == "x" for r in out.values())


def test_scan(docs):
    out = by_id(licenses.scan(docs), "n_words", "n_base", "first_word", "base_labels")
    assert [out[k]["n_words"] for k in range(3)] == [400_000, 400_007, 1]
    assert [out[k]["n_base"] for k in range(5)] == [0, 1, 0, 0, 0] and out[1]["first_word"] == 400_000 and out[1]["base_labels"] == "gpl"


def test_score(docs):
    out = by_id(ppm.score(docs), "n_tokens", "score", "base_score")
    assert [out[k]["n_tokens"] for k in range(5)] == [len((t or "").split()) + 1 for t in TEXTS]
    assert all(np.isfinite(out[k]["score"]) and out[k]["score"] < 0 for k in range(5)) and out[0]["score"] < out[3]["score"]


def test_replace(docs):
    out = by_id(pii.replace(docs, count_col="n_entities"), "text", "n_entities", "shard")
    assert [out[k]["n_entities"] for k in range(5)] == [0, 1, 0, 0, 0] and all(out[k]["text"] == TEXTS[k] for k in (0, 2, 3, 4))
    assert out[1]["text"].startswith(f"{PROSE} {NOTICE} ") and not out[1]["text"].endswith(MAIL) and out[0]["shard"] == "x"


def test_replace_forms_that_go_on_and_on(spark):
    """A pattern's repetitions take no stack: names of 100,000 initials, hosts of as many labels, long runs of digits."""
    texts = ["Maria " + "A. " * 100_000 + "Keller", "x@" + "b.c" * 100_000, "1" * 1_000_000, "+1 " + "234 " * 200_000, "Dr. " + "A. " * 100_000 + "Featherby", "GB82" + " WEST" * 200_000, "Maria " + "de " * 100_000 + "Keller"]
    out = by_id(pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), count_col="n_entities"), "text", "n_entities")
    assert len(out) == len(texts) and all(out[k]["text"] != texts[k] for k in (0, 4, 6)) and out[2]["text"] == texts[2]
    assert "Keller" not in out[0]["text"] and out[0]["n_entities"] == out[4]["n_entities"] == out[6]["n_entities"] == 1
