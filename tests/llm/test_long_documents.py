from netlens.llm.quality_rules import quality_rules


def test_a_clean_text_is_kept_whatever_its_length(spark):
    text = "".join(f"the word w{i} of x{i}\n" for i in range(210_000))
    (r,) = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_words", "failed_rules", "kept").collect()
    assert (r.n_words, r.failed_rules, r.kept) == (1_050_000, [], True)
