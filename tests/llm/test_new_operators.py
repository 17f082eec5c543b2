"""Prefix trie, filter audit and digest index on small tables, against brute force and their SQL."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import digest_index, filter_audit, names, oracles, prefix_trie
from tests.test_queries import canonical

rng = np.random.default_rng(8)
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(f"{name}_arrow", t.toArrow())
        con.sql(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return canonical(df.toPandas()) == canonical(con.sql(sql).df())


def odd(df):
    """With columns whose names the operators might use."""
    return df.withColumns({c: F.lit(1) for c in ("pos", "name", "size", "n", "row", "digest", "part", "mask", "keep_id", "node", "depth", "same", "kept", "role_")})


# --- names ---


def test_dense_names_have_no_gaps_and_hot_keys_are_joined(spark):
    keys = spark.range(0, 5000, 1, 7).select((F.col("id") * 3).alias("k"))
    assert sorted(r[1] for r in rows_of(names.dense(keys, "t"))) == list(range(5000))
    rows = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").count()
    out = names.attach(rows, table, ["k"], "count")
    assert out.count() == 20000 and out.agg(F.sum("count")).first()[0] == 6667**2 + 13333


# --- 11 ---


def brute_trie(turns):
    convs = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), x or ""))
    original = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = original.get(c - c % 5, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sorted(rebuilt.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return out


def talks():
    out = []
    for c in [*range(40), 57, 1003]:
        n = int(rng.integers(1, 14)) if c != 23 else 40
        for t in range(n):
            out.append((c, None if t == 0 and c % 7 == 0 else t, ["user", "assistant", None][t % 3], [None, "hi", "ünï", "x" * (t % 3)][int(rng.integers(4))] if rng.random() < 0.5 else f"turn {t % 2}"))
    out += [(5, 2, "user", "again"), (5, 2, "user", "again"), (5, 2, "user", "other"), (None, 1, "user", "nobody"), (61, 0, "user", "only one, no base"), (80, 0, None, None)]
    return out


def test_trie_equals_brute_force_and_sql(spark):
    turns = talks()
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    seq = prefix_trie.regrafted(prefix_trie.sequences(odd(df)))
    out = prefix_trie.trie(seq)
    want = brute_trie(turns)
    assert sorted(rows_of(out), key=str) == sorted(want, key=str) and len(want) > 60
    assert any(r["length"] == 0 for r in seq.convs.collect())
    assert same_as_sql(out, oracles.op11(), conversations=df)


def test_trie_of_copies_one_long_talk_and_nothing(spark):
    turns = [(c, t, "user", f"t{t}") for c in range(300) for t in range(3)] + [(1000, t, "user", f"z{t % 5}") for t in range(900)] + [(1001, 0, "user", "w" * 1_000_000)]
    seq = prefix_trie.sequences(spark.createDataFrame(turns, TURNS).repartition(6))
    out = {(r["conv_id"], r["depth"]): r for r in prefix_trie.trie(seq).collect()}
    assert len(out) == 1 + 3 + 900 + 1
    assert out[0, 3]["n_convs"] == 300 and out[0, 3]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()
    assert out[0, 0]["n_leaves"] == 3 and out[0, 0]["saved_tokens"] == 299 * 6 and out[1000, 1]["n_leaves"] == 1
    assert rows_of(prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame([], TURNS)))) == []
    lost = prefix_trie.regrafted(prefix_trie.sequences(spark.createDataFrame([(61, 0, "user", "x")], TURNS)))  # h > 0 and no base: no turns are left
    assert rows_of(prefix_trie.trie(lost)) == [(61, 0, None, 1, 0, 1, 0, hashlib.sha256(b"61").hexdigest())]


# --- 12 ---

WORDS = re.compile("[^\x20\x09-\x0d]+")


def fails(text):
    w = WORDS.findall(text)
    return [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def measured(texts, **how):
    parts = [t.encode() for t in texts]
    m = filter_audit.measure(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), **how)
    return list(zip(*(m[k].tolist() for k in ("words", "distinct", "capitals", "points", "symbols")), strict=True))


def counted(text):
    w = WORDS.findall(text)
    return len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab AZ\t\n\x0b\x1f#|é日\U0001f600\x85\xa0"), max_size=30), max_size=8))
def test_buffers_are_counted_as_by_hand(texts):
    assert measured(texts) == [counted(t) for t in texts]
    # Even if all words shared one hash.
    assert measured(texts, hashes=lambda data, start, end: np.zeros(len(start), np.uint64)) == [counted(t) for t in texts]


def test_long_words_and_pieces_are_counted():
    long = ["x" * 3_000_000, " ".join(["y" * 300, "y" * 299 + "z"] * 50), " ".join(f"w{i % 70000}" for i in range(400_000)), "", "A" * 1_100_000 + " " + "A" * 1_100_000]
    assert measured(long) == [counted(t) for t in long]


def brute_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    table = defaultdict(list)
    for i, t, lang, *_ in docs:
        copy = (t or "") in least and (i is None or least[t or ""] < i)
        table[lang or ""].append((dict(zip("ABCDE", [*fails(t or ""), copy], strict=True)), i in good, i in toxic))
    out = {}
    for part, rows in table.items():
        removed = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone, stay = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                removed[f] += len(gone)
                failing = sum(r[0][f] for r in rows)
                out[part, "".join(order), k + 1] = [len(stay), len(gone), failing - len(gone), sum(sum(r[0].values()) == 1 for r in rows if r[0][f]), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                left = stay
        for part_, order, k in list(out):
            if part_ == part:
                out[part_, order, k].append(removed[order[k - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_equals_brute_force_and_sql(spark):
    texts = [None, "", "one", " ".join(f"w{i}" for i in range(120)), " ".join(["a b"] * 80), "ABC " * 40, " ".join(f"W{i} #" for i in range(110)), " ".join(f"É{i}" for i in range(130)), "x\x1fy" * 3]
    docs = [(i, texts[int(rng.integers(len(texts)))], [None, "", "en", "fr"][i % 4], "s", 1) for i in range(60)]
    docs += [docs[3], (None, "one", "en", None, None), (None, None, None, None, None), (None, "unique to nobody", "de", None, None), (0, docs[1][1], "en", "s", 1)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 60, 3)] + [(3, 0, 1), (3, 1, None), (None, 1, 1), (999, 1, 1)]
    df, lf = odd(spark.createDataFrame(docs, DOCS)).repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = filter_audit.audit(df, lf)
    assert set(rows_of(out)) == brute_audit(docs, labels) and out.count() == 4 * 600
    assert same_as_sql(out, oracles.op12(), documents=df, labels=lf)
    assert filter_audit.audit(df.limit(0), lf.limit(0)).count() == 0
    assert filter_audit.audit(df, lf.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


# --- 13 ---


def fresh(spark, tmp_path, **how):
    return digest_index.DigestIndex(spark, f"file://{tmp_path}/index", **how)


def test_report_equals_brute_force_and_sql(spark, tmp_path):
    texts = ["a b", "a  b", "a\t\n b", " a b", "A b", "", None, " ", "z" * 2_000_000, "a b"]
    docs = [(i, texts[int(rng.integers(len(texts)))], "en", "s", 1) for i in range(200)] + [(7, "a b", "en", "s", 1), (7, "a b", "en", "s", 1), (None, "a b", None, None, None), (None, "only null", None, None, None), (None, "only null", None, None, None)]
    df = odd(spark.createDataFrame(docs, DOCS)).repartition(5)
    out = digest_index.report(df, fresh(spark, tmp_path))
    normal = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, *_ in docs:
        groups[normal(t)].append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            want.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    assert sorted(rows_of(out), key=str) == sorted(want, key=str)
    assert same_as_sql(out, oracles.op13(), documents=df)
    assert digest_index.report(df.limit(0), fresh(spark, tmp_path / "none")).count() == 0


def test_index_lasts_and_grows_by_what_is_new(spark, tmp_path):
    index = fresh(spark, tmp_path, buckets=8)
    first = spark.createDataFrame([(i, f"t{i % 6}", "en", "s", 1) for i in range(30)], DOCS)
    assert sorted(r["doc_id"] for r in digest_index.dedupe(odd(first), index, "monday").collect()) == list(range(6))
    files = sorted(p.name for p in (tmp_path / "index" / "v1-of-8").glob("*.parquet"))
    later = spark.createDataFrame([(i, f"t{i % 9}", "en", "s", 1) for i in range(100, 130)] + [(2, "t5", "en", "s", 1)], DOCS)
    again = digest_index.DigestIndex(spark.newSession(), index.path)  # another session
    assert sorted(r["text"] for r in digest_index.dedupe(later, again, "tuesday").collect()) == ["t6", "t7", "t8"]
    assert set(files) < {p.name for p in (tmp_path / "index" / "v1-of-8").glob("*.parquet")} and again.entries().count() == 9
    # A batch delivered once more decides as before and adds nothing.
    assert sorted(r["doc_id"] for r in digest_index.dedupe(first, index, "monday").collect()) == list(range(6)) and index.entries().count() == 9
    index.compact(4)
    assert index.entries().count() == 9 and len(list((tmp_path / "index" / "v2-of-4").glob("*.parquet"))) <= 4
    assert rows_of(digest_index.dedupe(later, index, "wednesday")) == [] or {r["text"] for r in digest_index.dedupe(later, index, "thursday").collect()} <= {"t6", "t7", "t8"}
    with pytest.raises(ValueError):
        digest_index.dedupe(first.withColumn("_dedup_row", F.lit(1)), index)


def test_index_side_is_not_shuffled(spark, tmp_path):
    index = fresh(spark, tmp_path, buckets=8)
    rows = digest_index.digests(spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in range(50)], DOCS))
    index.add(rows)
    dealt = digest_index.firsts(rows).repartition(8, "digest").join(index.entries().select("digest").hint("merge"), "digest", "left_anti")
    plan = dealt._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    known = plan[plan.index("SortMergeJoin") :].split("FileScan parquet spark_catalog")[0].rsplit("\n", 6)[-6:]
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 8 out of 8" in plan and "Bucketed: true" in plan and not any("Exchange" in x and "REPARTITION_BY_NUM" not in x and "HashAggregate" not in x for x in known[-3:])
