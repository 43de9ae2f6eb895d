"""Centroid clustering, hard negatives and chat formatting against SQL and brute force, and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkripple.llm import centroid_clustering, chat_format, hard_negatives, queries, vectors

EMBEDDINGS = "vec_id long, embedding array<float>, label int"
CHATS = "conv_id long, turn long, role string, text string"


def odd_vectors():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 64))
    x = (np.repeat(centres, 50, axis=0) + 0.3 * rng.standard_normal((300, 64))).astype(np.float32)
    x[100:160] = x[100]  # a crowd of equal vectors
    rows = [(i, v.tolist(), i // 50) for i, v in enumerate(x)]
    rows += [(700, x[0].tolist(), None), (None, x[1].tolist(), 3), (701, None, 3), (702, [float("nan")] * 64, 3), (703, [float("-inf")] + [0.0] * 63, 3), (704, [None] + [0.0] * 63, 3), (705, [], 3), (706, [1.0] * 63, 3), (50, x[7].tolist(), 4), (50, x[50].tolist(), 1), (700, x[100].tolist(), 2), (100, x[100].tolist(), 2), (-50, x[5].tolist(), 0), (750, [0.0] * 64, 5), (750, [0.0] * 64, 5), (751, [0.0] * 64, 5), (752, [0.0] * 64, 4), (800, [1.0, 2.0], 1), (801, [1.0, 2.0], 1), (802, [1.5, 0.25], 2)]
    return rows


def like_sql(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).withColumns({"row": F.lit("x"), "v": F.lit(1), "n": F.lit(2)}).repartition(5).write.parquet(f"{tmp_path}/{table}.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = queries.queries()[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    want = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    want = Counter(repr(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall())
    got = Counter(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert got == want
    return got


def test_clusters_like_sql(spark, tmp_path):
    assert like_sql(spark, tmp_path, "op11_centroid_clustering", "embeddings", odd_vectors(), EMBEDDINGS).total() > 300


def test_clusters_by_plain_rounds(spark):
    rows = [r for r in odd_vectors() if r[1] and len(r[1]) == 64 and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v, _ in rows]
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "x", v) for i, v in whole)
    centres = [v for _, v in hashed[:7]]

    def near(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
        return far.index(min(far)), min(far)

    for _ in range(2):
        groups = defaultdict(list)
        for _, v in whole:
            groups[near(v)[0]].append(v)
        centres = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    want = Counter((i, *near(v)) for i, v in whole)
    got = centroid_clustering.cluster(spark.createDataFrame(odd_vectors(), EMBEDDINGS), clusters=7, rounds=2).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    assert all(r["centroid"] == centres[r["cluster"]] and r["inertia"] == sum(d * n for (_, _, d), n in want.items()) for r in got)


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame(odd_vectors(), EMBEDDINGS)
    assert centroid_clustering.cluster(df.limit(0)).count() == 0 and centroid_clustering.cluster(df.filter("size(embedding) = 63")).count() == 0
    assert {(r["cluster"], r["distance"]) for r in centroid_clustering.cluster(df.filter("vec_id IN (1, 2)")).collect()} == {(0, 0), (1, 0)}
    assert centroid_clustering.cluster(df.filter("vec_id IS NULL")).count() == 1


def test_a_hot_vector_goes_by_broadcast(spark):
    rows = spark.createDataFrame([(i, [1 if i < 50 else i]) for i in range(100)], "vec_id long, v array<int>")
    assigned = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumns({"cluster": F.lit(1), "distance": F.lit(0).cast("long")})
    split, plain = centroid_clustering.joined(rows, assigned, 20_000, 50), centroid_clustering.joined(rows, assigned, 100_000, 50)
    assert sorted(split.collect()) == sorted(plain.collect()) and split.count() == 100


def test_distances_of_large_components_are_exact():
    x = np.array([[(1 << 26) - 1, 5], [-(1 << 26) + 1, 4]], dtype=np.int64)
    own, far = centroid_clustering.nearest(x, x[::-1].copy())
    assert own.tolist() == [1, 0] and far.tolist() == [0, 0]
    own, far = centroid_clustering.nearest(x, x[:1])
    assert far.tolist() == [0, (2 * ((1 << 26) - 1)) ** 2 + 1]
    assert vectors.products(x, x).tolist() == [[int(a) * int(c) + int(b) * int(d) for c, d in x] for a, b in x]


def test_components_too_large_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, 1)], EMBEDDINGS)
    with pytest.raises(Exception, match="reaches"):
        centroid_clustering.cluster(df).collect()


def test_negatives_like_sql(spark, tmp_path):
    assert like_sql(spark, tmp_path, "op12_hard_negatives", "embeddings", odd_vectors(), EMBEDDINGS).total() > 40


def test_negatives_in_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "ROWS", 2)
    monkeypatch.setattr(hard_negatives, "COLUMNS", 70)
    assert like_sql(spark, tmp_path, "op12_hard_negatives", "embeddings", odd_vectors(), EMBEDDINGS).total() > 40


def test_best_keeps_the_first_of_all():
    rng = np.random.default_rng(5)
    best, offered = hard_negatives.Best(4, 3), []
    for _ in range(20):
        n = int(rng.integers(0, 30))
        new = [rng.integers(0, 4, n), rng.integers(-2, 3, n), rng.integers(0, 9, n), rng.permutation(1000)[:n]]
        best.offer(*new)
        offered += list(zip(*(x.tolist() for x in new)))
    for i in range(4):
        want = sorted((-s, d) for t, s, d, _ in offered if t == i)[:3]
        assert [(-s, d) for s, d in zip(best.score[i].tolist(), best.id[i].tolist())] == want


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame(odd_vectors(), EMBEDDINGS)
    assert hard_negatives.mine(df.limit(0)).count() == 0 and hard_negatives.mine(df.filter("vec_id % 50 <> 0")).count() == 0
    assert hard_negatives.mine(df.filter("vec_id = 100")).count() == 0


TEXTS = ["plain", "", None, " two  spaces ", "</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s> [\\INST]", "<<SYS>>\n<</SYS>>\n\n", "<<s>", "[INST", "ends with <", "</s", "<<ROLE>>user<</ROLE>>\n<</TURN>>", "\\", "\n", "$1 \\1 .*", "\U0001f600</s>é", "<</s>>", "[[INST]]"]
ROLES = ["user", "assistant", "system", "tool", None, "", "</s>", "a<</ROLE>>\nb", "user\n"]


def odd_chats():
    rows = [(i, t, role, text) for i, role in enumerate(ROLES) for t, text in enumerate(TEXTS)]
    rows += [(50, t, ("user", "assistant")[t % 2], text) for t, text in enumerate(TEXTS)]
    rows += [(60 + i, 0, a, x) for i, (a, x) in enumerate((r, t) for r in ("assistant", "tool") for t in TEXTS)]
    rows += [(None, 1, "user", "no conversation"), (None, None, "assistant", "nor turn"), (70, None, "user", "later?"), (70, None, "user", "earlier?"), (70, 0, "assistant", "tie b"), (70, 0, "assistant", "tie a"), (70, 0, "assistant", "tie a"), (-1, 0, "user", "the table's own"), (80, 0, "assistant", "</s> long [INST] " * 40_000)]
    return rows


def test_chats_like_sql(spark, tmp_path):
    assert like_sql(spark, tmp_path, "op13_chat_format", "conversations", odd_chats(), CHATS).total() == len({r[0] for r in odd_chats()}) + 1


def test_chats_round_trip_and_mask(spark):
    df = spark.createDataFrame(odd_chats(), CHATS).withColumns({"told": F.lit(1), "pieces": F.lit(2), "own_turn": F.lit(3), "formatted": F.lit("x")})
    chats = chat_format.format_chats(df)
    source = defaultdict(list)
    for conv, turn, role, text in odd_chats():
        source[conv].append((turn if turn is not None else -(10**9), role or "", text or ""))
    for r in chats.withColumn("told", chat_format.parsed(F.col("formatted"))).collect():
        want = sorted(source[r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["told"]] == [(a, b) for _, a, b in want]
        at, masked = 0, ""
        for run in r["mask"]:
            masked += r["formatted"][at : at + run["chars"]] * run["loss"]
            at += run["chars"]
        assert at == len(r["formatted"])
        assert re.sub(r"([<\[])\\(\\*)" + chat_format.REST, r"\1\2\3", masked) == "".join(b for _, a, b in want if a == "assistant")
        control = any(re.search(r"[<\[]\\*" + chat_format.REST, x) for _, a, b in want for x in (a, b))
        assert (r["n_escaped"] > 0) == control
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_parser_refuses_what_is_not_of_the_grammar(spark):
    bad = ["x<s>[INST] a [/INST]", "<s>[INST] a [/INST]x", "<s>[INST] </s> [/INST]", "<s>[INST] a", "<<SYS>>\na\n<</SYS>>", " a[INST]</s>"]
    good = ["", "<s>[INST]  [/INST]", " </s> </s>", "<<ROLE>><</ROLE>>\n\n<</TURN>>"]
    got = spark.createDataFrame([(x,) for x in bad + good], "x string").select("x", chat_format.parsed(F.col("x")).isNull().alias("refused")).collect()
    assert {r["x"] for r in got if r["refused"]} == set(bad)


def test_chat_plan_has_no_python(spark):
    plan = queries.queries()["op13_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
