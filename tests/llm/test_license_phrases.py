"""The phrases of op1's contract, not those of the operator's own list."""

from corvane.llm import license_scan, queries


def test_contract_phrases(spark, tmp_path):
    texts = ["the MIT license", "released under the MIT license.", "Under\nthe mit license under the mit license", "under mit license; Apache License, Version 2.0 cc-by-nc", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in queries.op1_license_scans(spark, str(tmp_path)).collect()}
    assert got == {0: (3, 0, None, None, ""), 1: (5, 1, 1, 1, "mit"), 2: (8, 2, 0, 4, "mit"), 3: (11, 2, 3, 8, "apache-2,cc-by-nc"), 4: (0, 0, None, None, "")}


def test_phrases_need_no_gate_of_the_rules(spark):
    docs = spark.createDataFrame([(1, "Free as in beer")], "doc_id long, text string")
    r = license_scan.license_scan(docs, phrases=(("as in", "x"),)).first()
    assert (r["n_base"], r["first_word"], r["base_labels"], r["labels"]) == (1, 1, "x", "x")
