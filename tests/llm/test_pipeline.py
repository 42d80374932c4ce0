"""The pipeline's stages one after the other, each held against what its input says."""

import re
from collections import Counter

from conftest import TINY

import corpus_pipeline
from millrace.llm import packing, quality, queries, secrets, simhash


def test_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, TINY).cache()
        out[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = out["quality"]
    kept = {r.doc_id for r in quality.quality_table(before).collect() if r.kept}
    assert Counter(r.doc_id for r in after.collect()) == Counter(kept)
    before, after = out["near_duplicates"]
    texts = {}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        texts.setdefault(r.text, r.doc_id)
    left = {r.doc_id for r in after.collect()}
    assert left <= set(texts.values()) and len(left) > 0.9 * len(texts)
    assert left == {r.best_id for r in simhash.similar_documents(before).collect()}
    before, after = out["secrets"]
    token = re.compile(r'(?<=token = ")[0-9a-f]{40}(?=")')
    assert {(r.doc_id, token.sub(secrets.MASK, r.text)) for r in before.collect()} == {(r.doc_id, r.text) for r in after.collect()}
    before, after = out["mixing"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()} and max(Counter(r.doc_id for r in after.collect()).values()) <= 2
    before, after = out["packing"]
    words = Counter()
    for r in before.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) + 1
    placed = Counter()
    for r in after.collect():
        placed[r.doc_id] += r.length
    assert placed == words and {r.bin_length for r in after.collect()} <= set(packing.LENGTHS)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, TINY).columns == ["bin_id", "bin_length", "bin_used", "bin_offset", "doc_id", "copy", "piece", "start", "length"]
    assert corpus_pipeline.ORACLE_SQL is None and queries.QUERIES["pipeline"] is corpus_pipeline.run


def test_mix_equals_sql(spark, duck):
    from helpers import duck_rows, spark_rows

    assert spark_rows(queries.QUERIES["op4_source_mixing"](spark, TINY)) == duck_rows(duck, queries.ORACLE_SQL["op4_source_mixing"])


def test_all_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 11))
