"""The pipeline's stages against plain Python, and its rows against its stages."""

from collections import Counter

import pytest

import corpus_pipeline
from quern.llm import decontam, rules, sharding
from quern.llm.common import normal

from .test_neardup import groups_by_brute_force


@pytest.fixture(scope="module")
def staged(spark, testdata, tmp_path_factory):
    sf = f"{testdata}/sf0.001"
    at = tmp_path_factory.mktemp("stages")
    out = [("documents", spark.read.parquet(f"{sf}/documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1][1], sf).write.parquet(f"{at}/{name}")
        out.append((name, spark.read.parquet(f"{at}/{name}")))
    return {name: (df.columns, df.collect()) for name, df in out}


def test_stages(spark, testdata, staged):
    sf = f"{testdata}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert all(staged[name][0] == columns for name, _ in corpus_pipeline.STAGES[:-1])
    ids = lambda name: [r.doc_id for r in staged[name][1]]

    learned = rules.fit_rules(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in rules.apply_rules(docs, learned).where("keep").collect()}
    assert learned and sorted(ids("quality_rules")) == sorted(kept)

    copies = groups_by_brute_force([(r.doc_id, r.text) for r in staged["quality_rules"][1]])
    gone = kept - set(ids("near_dedup"))
    assert len(ids("near_dedup")) == len(kept) - len(gone) and gone <= set(copies) and len(gone) >= 0.9 * len(copies) > 0

    items = [normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in staged["near_dedup"][1] if any(decontam.locate(w, normal(r.text), decontam.budget(len(w))) for w in items)}
    assert leaked and sorted(ids("decontamination")) == sorted(set(ids("near_dedup")) - leaked)

    assert set(ids("mixing")) <= set(ids("decontamination")) and max(Counter(ids("mixing")).values()) > 1

    rows = staged["sharding"][1]
    assert staged["sharding"][0] == [*columns, "shard"] and sorted(r.doc_id for r in rows) == sorted(ids("mixing"))
    size = Counter()
    for r in rows:
        size[r.text] += len(r.text)
    loads = Counter()
    for text, shard in {(r.text, r.shard) for r in rows}:
        loads[shard] += size[text]
    plain = Counter()
    sizes = sorted(size.values(), reverse=True)
    for n, shard in zip(sizes, sharding.lpt(sizes, sharding.SHARDS)):
        plain[shard] += n
    assert sorted(loads.values()) == sorted(plain.values())


def test_run_equals_stages(spark, testdata, staged):
    rows = corpus_pipeline.run(spark, f"{testdata}/sf0.001").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, staged["sharding"][1]))


def test_empty_documents(spark, testdata):
    sf = f"{testdata}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
