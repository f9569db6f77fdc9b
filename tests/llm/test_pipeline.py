"""The stages against brute force, and the guard around the subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from logevidence.llm.components import components  # noqa: E402
from logevidence.llm.common import Scratch  # noqa: E402

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs, SF)
    assert told.columns == columns and told.count() == docs.count()
    alone = stages["near_duplicates"](spark, told, SF)
    groups = brute.components([(r["doc_id"], r["text"]) for r in told.collect()], corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert alone.columns == columns
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted({c for _, c in groups.values()})
    clean = stages["decontamination"](spark, alone, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    verdict = brute.contaminated([(r["doc_id"], r["text"]) for r in alone.collect()], items)
    assert clean.columns == columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(v[0] for v in verdict if not v[-1])
    private = stages["privacy"](spark, clean, SF)
    assert private.columns == columns and private.count() == clean.count()
    assert all(brute.personal(r["text"])[0] == 0 and len(r["text"]) == r["n_chars"] for r in private.collect())
    pieces = stages["packing"](spark, private, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in private.collect()}


def test_run_gives_the_last_stage(spark):
    assert "sequence_id" in corpus_pipeline.run(spark, SF).columns


def test_stages_at_the_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "good words stand here and there"), (4, "good words stand here and there"), (None, "good words stand here and there"),
            (5, "Good words stand here and there"), (6, "x" * 30_000)]
    docs = spark.createDataFrame([(d, t, None if d == 4 else "en", None, None, "z") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, root string")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF))
        assert kept[-1].columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept[1].collect()) == [(False, 4), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept[2].collect()) == [(False, 4), (False, 6)]
    assert kept[4].count() == 2
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, SF)
        assert empty_out.collect() == []


def test_no_stage_loses_documents_of_shared_or_missing_ids_or_unknown_language(spark):
    """Each row stands for itself; column names may hold dots or be those that operators use."""
    t1, t2, t3 = ("the first text of all with words enough", "another text that has nothing in common with it", "and a third one without any id here")
    rows = [(5, t1), (5, t2), (3, t1), (9, t2), (None, t3), (None, t3 + " at all"), (None, t1), (5, t1)]
    docs = spark.createDataFrame([(*r, None, "a", "b", "c") for r in rows], "doc_id long, text string, lang string, `every.x` string, doc_of string, row string")
    told = corpus_pipeline.language_id(spark, docs, SF)
    assert told.count() == len(rows) and told.columns == docs.columns
    alone = corpus_pipeline.near_duplicates(spark, told, SF)
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in alone.collect()))
    assert kept == sorted([(5, t2), (3, t1), (0, t3), (0, t3 + " at all")]) and alone.columns == docs.columns
    clean = corpus_pipeline.privacy(spark, corpus_pipeline.decontamination(spark, alone, SF), SF)
    assert clean.columns == docs.columns and clean.count() == 4


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (2, 1), (500, 400), (450, 500)], "u long, v long")
    found = {r["node"]: r["root"] for r in components(df, Scratch(spark)).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, **{i: 400 for i in (400, 450, 500)}}
    assert components(df.limit(0), Scratch(spark)).collect() == []


def test_queries_remain_without_the_subpackage():
    code = "import sys; sys.modules['logevidence.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 60
