"""The pipeline's stages on the smallest tables, and the guard of the entry."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from spoor.session import land

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(land(stage(spark, out[-1], SF), f"test_{name}"))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]


def test_columns_stay(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "shard", "slot"]


def test_toxicity_stage(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(stages[1]))
    clean = {i for i, y in labels.items() if y == 0}
    toxic = {i for i, y in labels.items() if y == 1}
    assert len(kept & clean) >= 0.97 * len(clean) and len(kept & toxic) <= 0.1 * len(toxic)


def test_simhash_stage(stages):
    from spoor.llm.simhash import simhash_groups

    groups = {r["doc_id"]: r["component_id"] for r in simhash_groups(stages[1]).collect()}
    assert ids(stages[2]) == sorted(set(groups.values()))


def test_leak_stage(spark, stages):
    from spoor.llm.decontaminate import leaks

    bad = {r["doc_id"] for r in leaks(stages[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(stages[3]) == sorted(set(ids(stages[2])) - bad)


def test_mix_stage(stages):
    from collections import Counter

    before, after = set(ids(stages[3])), Counter(ids(stages[4]))
    assert set(after) <= before and max(after.values()) <= 2


def test_shard_stage(stages):
    assert ids(stages[5]) == ids(stages[4])
    slots = {}
    for r in stages[5].select("shard", "slot").collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
