"""Boilerplate phrases count as whole words, and fail short lines or lines that they fill."""

from corvane.llm import quality_rules

PROSE = " ".join(f"Man{i} sees house{i} near river{i} and hill{i}." for i in range(12))


def judge(spark, texts):
    rows = quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(list(r["dropped_rules"]), r["kept"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_phrases_inside_words_are_none(spark):
    lines = ["The catalog in the hall is old.", "Our blog in French goes on.", "A dialog in verse.", "A design in blue.", "They spread more seed.", "\u00e9log in.", "log inn."]
    assert judge(spark, ["\n".join([*lines, PROSE])]) == [([], True)]


def test_a_long_clean_line_stays(spark):
    texts = [f"{PROSE} Then they log in, and read more of it.", f"They log in at the desk, {PROSE}"]
    assert judge(spark, texts) == [([], True)] * 2


def test_furniture_goes(spark):
    short = ["Log in", "Please  LOG  IN here now.", "\u00bb Read\tmore", "\u00a9 2020 Some House. All rights reserved."]
    full = "Privacy policy, terms of use, cookie policy, terms of service, back to top, sign in, sign up, share on facebook."
    assert judge(spark, ["\n".join([PROSE, *short, full])]) == [(["boilerplate"] * 5, True)]
