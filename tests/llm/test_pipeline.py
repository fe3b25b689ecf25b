"""The pipeline on a small table against what each stage promises."""

from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from ticktrail.llm import packing
from ticktrail.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    enc = packing.encoder(packing.PackParams())
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(enc(r.text or "")) + 1
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want


def test_run_and_registration(spark):
    q = entry.queries()
    assert q["pipeline"] is corpus_pipeline.run and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in q}
    assert corpus_pipeline.run(spark, SF).count() > 0
