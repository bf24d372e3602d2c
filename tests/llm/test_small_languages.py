"""Languages of a handful of documents reject what they do not resemble, too."""

from __future__ import annotations

import random

from palaver.llm import language_id


def test_a_language_of_five_documents_borrows_a_limit(spark):
    rnd = random.Random(6)
    word = lambda parts: "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4)))
    text = lambda parts, n=80: " ".join(word(parts) for _ in range(n))
    a, b, c = ["the", "ing", "er", "on", "an"], ["der", "ung", "ich", "sch", "ein"], ["zza", "qua", "olo", "imi"]
    rows = [(k, text(a), "aa") for k in range(60)] + [(100 + k, text(b), "bb") for k in range(60)] + [(200 + k, text(c), "cc") for k in range(5)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = model.identify([text(a), text(b), text(c), "".join(rnd.choice("zqxjkvwp0 ") for _ in range(600)), "x7 " * 200, "ζωη και φως " * 40])
    assert found["lang_pred"].tolist()[:3] == ["aa", "bb", "cc"] and found["accepted"].tolist() == [True, True, True, False, False, False]
    alone = language_id.learn(spark.createDataFrame(rows[-5:], "doc_id long, text string, lang string"))
    assert alone.identify([text(a)])["accepted"].tolist() == [True]  # nothing to calibrate by
