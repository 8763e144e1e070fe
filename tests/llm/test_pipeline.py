"""The pipeline's stages on the smallest tables: what each may drop, keep and change, and its columns."""

from collections import Counter

import corpus_pipeline
from quillspark.llm import mixing, quality_rules, secrets, similar

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    assert list(stages) == ["quality rules", "simhash near-dedup", "secret scans", "mixing", "packing"]
    good = stages["quality rules"](spark, docs, FOLDER)
    rows = {r.doc_id: r.text for r in good.collect()}
    model = quality_rules.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert good.columns == columns and set(rows) == {r.doc_id for r in quality_rules.judge(docs, model).where("kept").collect()}
    groups = {r.doc_id: r.component_id for r in similar.similar_groups(good).collect()}
    single = stages["simhash near-dedup"](spark, good, FOLDER)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(groups.values())
    assert len({t for k, t in rows.items() if groups[k] == k}) == len(set(groups.values()))
    clean = stages["secret scans"](spark, single, FOLDER)
    net = secrets.train()
    found = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert clean.columns == columns and set(found) == set(groups.values())
    for key, (text, size) in found.items():
        want = secrets.redact(rows[key], secrets.spans(rows[key], net))
        assert text == want and size == len(text)
    mixed = stages["mixing"](spark, clean, FOLDER)
    assert mixed.columns == columns
    taken = Counter(r.doc_id for r in mixed.collect())
    assert set(taken) <= set(found) and max(taken.values()) <= mixing.EPOCHS
    packed = stages["packing"](spark, mixed, FOLDER).collect()
    assert Counter({k: n for k, n in taken.items()}) == Counter(r.doc_id for r in packed if r.start == 0)


def test_stages_on_awkward_and_empty_tables(spark, docs, empty):
    for table in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, FOLDER).count() >= 0
