"""Contamination by near-verbatim copies, and clean documents that look alike."""

from tidewatch.llm import decontam

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def judged(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts, 1)], SCHEMA)
    return [r["contaminated"] for r in decontam.judge(docs, bench).orderBy("doc_id").collect()]


def test_one_changed_value_leaves_the_verbatim_windows(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(60)]
    words[4] = words[49] = "2019"
    one, merged = list(words), list(words)
    one[49] = "2020"
    merged[20], words[20] = "7", "31"
    words[30], merged[30] = "44", "7"
    one[20], one[30] = "31", "44"
    assert judged(spark, [" ".join(words)], [" ".join(one), " ".join(merged)]) == [True, True]


def test_windows_add_up_over_near_diagonals(spark):
    words = [f"w{chr(97 + i)}x" for i in range(20)]
    more = [*words[:10], "inserted", *words[10:]]
    far = [*words[:10], *[f"other{chr(97 + i)}" for i in range(26)], *words[10:]]
    assert judged(spark, [" ".join(words)], [" ".join(more), " ".join(far)]) == [True, False]


def test_placeholders_alone_match_by_value_only(spark):
    numbers = " ".join(str(100 + 7 * i) for i in range(13))
    names = " ".join(f"Name{chr(97 + i)}" for i in range(13))
    texts = [f"so {numbers} it is", "so " + " ".join(str(500 + i) for i in range(13)) + " it is", f"so {names} it is", "so " + " ".join(f"Other{chr(97 + i)}" for i in range(13)) + " it is"]
    assert judged(spark, [f"x {numbers}", f"x {names}"], texts) == [True, False, True, False]


def test_short_items_match_exactly(spark):
    items = ["What is 5 + 7?", "Answer"]
    texts = ["and what is 3 4 here", "Now: what is 5 + 7? Well", "the answer is no", "answer", ""]
    assert judged(spark, items, texts) == [False, True, False, True, False]


def test_case_and_punctuation_do_not_hide_a_copy(spark):
    item = "The train to Oslo left early. Many people from Bergen missed it. Then Anna called her brother in Rome and Paris."
    assert judged(spark, [item], [item.upper(), item.replace(".", ""), item.lower()]) == [True, True, True]
    assert judged(spark, ["Run 5 KM in Oslo with Anna and Bob from Rome and then go to Paris"], ["run 5 km in oslo with anna and bob from rome and then go to paris"]) == [True]
