"""Operators that learn, and those on vectors and tokens."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import public_tokenizers  # noqa: E402

from logevidence.llm.langid import identify_languages, op8_language_id  # noqa: E402
from logevidence.llm.neighbours import Balls, VantageTree, in_balls, nearest, visitors  # noqa: E402
from logevidence.llm.packing import SquaresPacker, encoder, pack_documents  # noqa: E402
from logevidence.llm.quality import op5_quality, score_quality  # noqa: E402
from logevidence.llm.toxicity import op3_toxicity, score_toxicity, train  # noqa: E402

SF = "/root/testdata/sf0.01"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def auc(truth, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in set(score):
        same = score == s
        rank[same] = rank[same].mean()
    n = truth.sum()
    return (rank[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


@pytest.mark.parametrize("query,label,parts,rest", [(op3_toxicity, "toxic", 5, 0), (op5_quality, "quality", 3, 1)])
def test_held_out_rows_are_ranked(spark, query, label, parts, rest):
    found = query(spark, SF)
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % parts == rest and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert auc(np.array([r[label] for r in rows]), np.array([r["score"] for r in rows])) >= 0.9


def test_scores_at_the_edges(spark):
    docs = brute.frame(spark, [*brute.EDGES, "fine words here", "awful words here"])
    labels = spark.createDataFrame([(12, 1, 0), (13, 0, 1), (None, 1, 1), (13, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for marked in (labels, none):
        for scored in (score_quality(docs, marked), score_toxicity(docs, marked, docs.select("doc_id"))):
            rows = scored.collect()
            assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert score_quality(docs.limit(0), marked).collect() == [] and score_toxicity(docs.limit(0), marked, docs.select("doc_id")).collect() == []


def test_risk_does_not_learn_the_unlabelled_positives():
    r = np.random.default_rng(1)
    clean = [np.unique(r.integers(0, 500, 30)) for _ in range(900)]
    toxic = [np.unique(np.append(r.integers(0, 500, 30), r.integers(600, 610, 3))) for _ in range(200)]
    w, bias = train(toxic[:100], clean + toxic[100:], prior=0.1)
    hidden = np.mean([w[d].sum() + bias > 0 for d in toxic[100:]])
    wrong = np.mean([w[d].sum() + bias > 0 for d in clean])
    assert hidden > 0.9 and wrong < 0.05


def test_languages_of_held_out_rows(spark):
    rows = op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in rows)


def test_predictions_do_not_depend_on_the_rows_around(spark):
    labelled = spark.createDataFrame([("en", "the and of that which " * 50), ("de", "der und die das nicht ein " * 50), ("fr", "les des une que pour est " * 50)], "lang string, text string")
    short = ["a", "de", "un", "die", "of", "es", "le", "to", "ein", "que"]
    answers = []
    for fill in (None, "die das und der ", "les une des que "):
        rows = [x for i, t in enumerate(short) for x in ([(i, t)] if fill is None else [(100 + i, fill), (i, t)])]
        found = identify_languages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), labelled)
        answers.append(sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in found.collect() if r["doc_id"] < 100))
    assert answers[0] == answers[1] == answers[2]


def test_mixtures_and_texts_without_letters(spark):
    known = spark.createDataFrame([("aa", "lorem ipsum dolor sit amet " * 40), ("bb", "quick brown foxes jump over " * 40), (None, "x"), ("aa", None)], "lang string, text string")
    texts = ["lorem ipsum dolor " * 30 + "quick brown foxes " * 20, "dolor sit amet lorem", "123 ... !", None, "", "жщ"]
    docs = brute.frame(spark, texts)
    rows = {r["doc_id"]: r for r in identify_languages(docs, known, carry=True).where("doc_id IS NOT NULL").collect()}
    assert set(rows[1]["shares"]) == {"aa", "bb"} and rows[1]["lang_pred"] == "aa" and 0.5 < rows[1]["score"] < 0.7
    assert rows[2]["lang_pred"] == "aa" and set(rows[2]["shares"]) == {"aa"}
    assert [(rows[i]["lang_pred"], rows[i]["score"]) for i in (3, 4, 5)] == [("und", 0.0)] * 3 and rows[6]["lang_pred"] != "und"
    assert rows[2]["row"]["text"] == texts[1] and rows[2]["row"]["row"] == "n"
    assert {r["lang_pred"] for r in identify_languages(docs, known.limit(0)).collect()} == {"und"}
    assert identify_languages(docs.limit(0), known).collect() == []


def cosine(rows, queries, k):
    out = []
    for q, x in queries:
        scored = sorted((-(np.dot(x, y) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y)))).round(12), i) for i, y in rows if i != q)
        out += [(q, n, i, round(-s, 12)) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400 + i, [2 * x for x in rows[9][1]]) for i in range(3)]
    bad = [(500, None), (501, []), (502, [0.0] * 6), (503, [1.0, None] + [0.0] * 4), (504, [float("nan")] * 6), (505, [float("inf")] * 6), (None, [1.0] * 6), (506, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in [*rows, *bad, rows[3]]], "vec_id long, embedding array<double>, rank int, score double")
    found = nearest(df, df.where("vec_id % 10 = 0"), 5, shard_rows=50, block_rows=8)
    queries = [(i, np.array(v)) for i, v in rows if i % 10 == 0]
    got = sorted((x["query_id"], x["rank"], x["vec_id"], round(x["score"], 12)) for x in found.collect())
    assert got == cosine([(i, np.array(v)) for i, v in rows], queries, 5)
    few = df.where("vec_id IN (0, 1, 2)")
    assert [x["rank"] for x in nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [1, 2]
    assert nearest(df.limit(0), df.limit(0)).collect() == [] and nearest(df, df.limit(0)).collect() == []


def test_queries_visit_only_balls_that_may_help(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 8))
    x = np.repeat(centres, 60, axis=0) + 0.01 * r.normal(size=(720, 8))
    x[240:480] = x[240]  # a third of all rows is one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0, 2.0]), (901, [2.0, 1.0]), (902, [1.0])], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 20 = 0 OR vec_id >= 900")
    got = sorted((y["query_id"], y["rank"], y["vec_id"], round(y["score"], 12)) for y in nearest(df, queries, 5, shard_rows=30, block_rows=4).where("query_id < 900").collect())
    assert got == cosine(list(enumerate(x)), [(i, x[i]) for i in range(0, 720, 20)], 5)
    assert {(y["query_id"], y["vec_id"]) for y in nearest(df, queries, 5, shard_rows=30).where("query_id >= 900").collect()} == {(900, 901), (901, 900)}
    balls = Balls([v.tolist() for v in centres])
    dealt = in_balls(df.where("vec_id < 900"), balls)
    for y in dealt.groupBy("ball").agg(F.min("distance").alias("near"), F.max("distance").alias("far")).collect():
        balls.near[y["ball"]], balls.far[y["ball"]], balls.shards[y["ball"]] = y["near"], y["far"], 3
    asked = dealt.where("vec_id % 20 = 0").selectExpr("vec_id", "embedding", "0.05D AS radius", "ball", "0 AS shard")
    visits = visitors(asked, balls, 1.0)
    assert visits.count() == 2 * 36  # the two other shards of the own ball, none of the eleven other balls


def test_ties_of_any_number_and_vectors_of_any_size(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=8)
    multiples = [(61 + i, (v * 2.0**i).tolist()) for i in range(40)]
    other = [(200 + i, r.normal(size=8).tolist()) for i in range(300)]
    asked = [(50, (v + 0.01 * r.normal(size=8)).tolist())]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest(frame(multiples + other + asked), frame(asked)).orderBy("rank").collect()
    assert [x["vec_id"] for x in found] == [61, 62, 63, 64, 65] and len({x["score"] for x in found}) == 1
    sizes = [(1, [1e-200, 2e-200]), (2, [1e200, 1e199]), (3, [3.0, -1.0]), (4, [5e-324, 0.0])]
    found = {x["vec_id"]: x["score"] for x in nearest(frame(sizes), frame([(9, [2.0, 1.0]), (3, [3.0, -1.0])])).where("query_id = 9").collect()}
    plain = lambda a, b: (a[0] * b[0] + a[1] * b[1]) / np.hypot(*a) / np.hypot(*b)
    assert found == pytest.approx({1: plain((1, 2), (2, 1)), 2: plain((10, 1), (2, 1)), 3: plain((3, -1), (2, 1)), 4: plain((1, 0), (2, 1))}, abs=1e-12)


def test_relaxed_pruning_skips_and_keeps_recall():
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 8))
    x = np.repeat(centres, 100, axis=0) + 0.05 * r.normal(size=(4000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = VantageTree(x)
    truth = np.argsort(-(x[:50] @ x.T), axis=1)[:, :5]
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        found = tree.search(x[:50], 5, factor)
        assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, truth, strict=True)]) >= least


TRICKY = ["a  b\n c", " x", "x ", "  ", "\n\n a", "don't  's \t 1 2", "<|endoftext|> a <|endoftext|>b", "é 　 ü", "a​ b", " \u0085 q \x1c z", "I'll we've THEY'RE 12ab ½ ²"]


def test_ids_are_those_of_tokenizers():
    fast, slow = encoder(JSON, RANKS), encoder(JSON)
    for text in [*TRICKY, *(t or "" for t in brute.EDGES)]:
        assert fast.encode(text) == slow.encode(text), text


def test_packing_round_trip(spark):
    texts = [*brute.EDGES, *TRICKY, *("word%d " % i * (i * 37 % 900) for i in range(60))]
    docs = brute.frame(spark, texts)
    for open_windows in (4096, 2):
        pieces = pack_documents(docs.coalesce(3), JSON, RANKS, max_open=open_windows).collect()
        by_doc, by_sequence = {}, {}
        for p in pieces:
            by_doc.setdefault(p["doc_id"], []).append(p)
            by_sequence.setdefault(p["sequence_id"], []).append(p)
        padding = 0
        for held in by_sequence.values():
            held.sort(key=lambda p: p["offset"])
            ends = np.cumsum([p["length"] for p in held])
            assert [p["offset"] for p in held] == [0, *ends[:-1]] and ends[-1] <= 2048
            padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else 2048 - ends[-1]
        assert padding == 0
        for i, text in enumerate(texts[1:], 2):  # the first text stands twice
            ids = encoder(JSON).encode(text or "") + np.array([1], "<u4").tobytes()
            held = sorted(by_doc[i], key=lambda p: p["start"])
            assert sum(p["length"] for p in held) == len(ids) // 4 == held[0]["doc_tokens"]
            at = 0
            for p in held:
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])])
                at += p["length"]
        assert [sum(p["length"] for p in by_doc[d]) for d in (1, None)] == [2, 6]
    assert pack_documents(docs.limit(0), JSON, RANKS).collect() == []


def test_the_level_is_the_one_with_the_least_squares():
    r = np.random.default_rng(6)
    packer = SquaresPacker(32)
    for _ in range(400):
        size = int(r.integers(1, 32))
        levels = packer.levels.copy()

        def squares(at, levels=levels, size=size):
            n = levels.copy()
            if at:
                n[at] -= 1
            if at + size < 32:
                n[at + size] += 1
            return int((n[1:32] ** 2).sum())

        allowed = [0] + [at for at in range(1, 33 - size) if levels[at]]
        assert squares(packer.level_for(size)) == min(map(squares, allowed))
        packer.place((0, 0, bytes(4 * size)))
