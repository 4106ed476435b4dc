"""The pipeline's stages, each on its own input, and the registered queries."""

import collections

import pytest

import corpus_pipeline
from millrace.llm import mixing
from millrace.llm.registry import ORACLES, QUERIES

from .test_operators import classes_of, contaminated


@pytest.fixture(scope="module")
def folder(docs, spark, corpus, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('sf')}"
    docs.write.parquet(f"{d}/documents.parquet")
    items = [(1, " ".join(corpus[10][1].split()[:12])), (2, "no such words stand in any document here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def test_stages(spark, docs, corpus, folder):
    d, items = folder
    stages, now = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{d}/documents.parquet")
    assert list(stages) == ["language", "near_copies", "decontaminate", "mix_sources", "shard"]

    kept = stages["language"](spark, now, d)
    texts = {r["text"] for r in kept.collect()}
    assert kept.columns == docs.columns and not texts & {None, "", " ", "\n\n", "12 34"}
    lettered = [r for r in corpus if r[1] and any(c.isalpha() for c in r[1])]
    assert kept.count() >= 0.9 * len(lettered)

    one = stages["near_copies"](spark, kept, d).cache()
    ids = [r["doc_id"] for r in one.collect()]
    assert one.columns == docs.columns and len(ids) == len(set(ids))
    clear = [(r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] not in (None, 3, 5)]
    roots = classes_of(clear)
    assert {i for i in ids if i not in (None, 3, 5)} == {i for i, c in roots.items() if i == c}

    clean = stages["decontaminate"](spark, one, d).cache()
    bad = {r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in one.collect()], items) if r[3]}
    assert bad and clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(ids) - bad

    mixed = stages["mix_sources"](spark, clean, d).cache()
    words, want = collections.Counter(), collections.Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
    for r in mixing.mix_digest(clean).collect():
        want[r["doc_id"]] += r["taken"]
    assert mixed.columns == docs.columns and +words == +want

    out = stages["shard"](spark, mixed, d).collect()
    assert len(out) == mixed.count() and {r["doc_id"] for r in out} == {r["doc_id"] for r in mixed.collect()}


def test_run_is_repeatable(spark, folder):
    d, _ = folder
    first, second = (sorted(map(str, corpus_pipeline.run(spark, d).collect())) for _ in range(2))
    assert first == second and first


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_empty_and_odd_tables(spark, no_docs, folder):
    """No rows give no rows and the same columns; rows of nulls, blanks and repeats pass every stage or are dropped as stated."""
    d, _ = folder
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        out = stage(spark, no_docs, d)
        assert out.count() == 0 and (name == "shard" or out.columns == no_docs.columns)
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "12 34"), (5, "plain words"), (5, "plain words"), (6, "a" * 100_000)]
    odd = spark.createDataFrame([(i, t, "en" if t else None, None, None, "a", "b", "c", "d", "e") for i, t in rows], no_docs.schema)
    assert {r["text"] for r in stages["language"](spark, odd, d).collect()} <= {"plain words", "a" * 100_000}
    ids = sorted(r["doc_id"] or 0 for r in stages["near_copies"](spark, odd, d).collect())
    assert ids == [0, 1, 2, 3, 4, 5, 6]
    assert stages["decontaminate"](spark, odd, d).count() == len(rows)
    mixed = stages["mix_sources"](spark, odd, d).collect()
    assert all(r["text"].split() and r["n_chars"] == len(r["text"]) for r in mixed)
    assert stages["shard"](spark, odd, d).count() == len(rows)
