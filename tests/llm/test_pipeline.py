import random

import pytest

import corpus_pipeline

pytest.importorskip("public_tokenizers")


def prose(r, n):
    return " ".join(r.choice(["the", "of", "and", "to", "in"]) if r.random() < 0.4 else f"word{r.randrange(5000)}" for _ in range(n))


def test_stages(spark, tmp_path):
    r = random.Random(5)
    clean = [prose(r, 120) for _ in range(30)]
    w = clean[0].split()
    w[40] = "changed"
    near = " ".join(w)
    secret = clean[1] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(clean)]
    rows += [(100, near, "en", "src2", len(near)), (101, clean[2], "en", "src2", len(clean[2])), (102, secret + prose(r, 60), "en", "src2", 0), (103, "too short", "en", "src3", 9), (104, None, "en", None, None), (105, "x$$ " * 100, "en", "src3", 400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept[name] = {x.doc_id: x for x in out.collect()}
        docs = out
    assert set(kept["quality_rules"]) == set(range(30)) | {100, 101, 102}
    assert set(kept["ngram_jaccard_join"]) == set(range(30)) | {102}
    assert "[secret]" in kept["secret_scan"][102].text and kept["secret_scan"][102].n_chars == len(kept["secret_scan"][102].text)
    assert all(kept["secret_scan"][i].text == clean[i] for i in range(30))
    assert set(kept["best_fit_packing"]) == set(range(30)) | {102}
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(30)) | {102}
