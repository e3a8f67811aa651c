from pathlib import Path

import pytest

import corpus_pipeline

pytest.importorskip("public_tokenizers")


def test_stages_leave_no_working_tables(spark, tmp_path):
    """A stage's output goes when the next one is written, the tables of the join inside go in it."""
    text = lambda i: " ".join(f"the w{i}x{k} of" for k in range(60))
    rows = [(i, text(i % 8), "en", "src1", len(text(i % 8))) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = {p.name.rpartition("-")[0] for p in set(shared.iterdir()) - before}
    assert {x for x in left if x.startswith("stage-")} == {"stage-secret_scan"}
    assert not left & {"sets", "classes", "shared", "tree-sets", "leaves", "nodes", "pairs", "pair-sets", "placed", "roots", "met"}
    assert {x.doc_id for x in out.collect()} == set(range(8))
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 12
