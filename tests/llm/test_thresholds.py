"""Thresholds that are no whole percent: a pair exactly at one is linked, one just below is not."""

from __future__ import annotations

import pytest

from palaver.llm import line_dedup, near_dup, words

#: threshold: words shared and in all, exactly there and as near below as so few words allow
AT = {0.875: ((7, 8), (6, 7)), 0.855: ((171, 200), (170, 199)), 0.8: ((4, 5), (7, 9)), 2 / 3: ((6, 9), (5, 8)), 1.0: ((9, 9), (9, 10))}


def documents(spark, threshold):
    rows = []
    for k, (both, union) in enumerate(AT[threshold]):
        rows += [(2 * k, " ".join(f"w{k}x{i}" for i in range(both))), (2 * k + 1, " ".join(f"w{k}x{i}" for i in range(union)))]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("threshold", sorted(AT))
def test_near_duplicates_at_the_threshold(spark, threshold):
    found = near_dup.near_duplicates(documents(spark, threshold), width=1, threshold=threshold).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {0: 0, 1: 0, 2: 2, 3: 3}


@pytest.mark.parametrize("threshold", sorted(AT))
def test_similar_lines_at_the_threshold(spark, threshold):
    found = line_dedup.similar_lines(documents(spark, threshold), threshold=threshold).collect()
    equal = threshold == 1.0  # equal lines are one class, which has no links to others
    assert {r["doc_id"]: r["n_links"] for r in found} == {0: 0 if equal else 1, 1: 0 if equal else 1, 2: 0, 3: 0}


def test_fractions_are_those_of_the_digits():
    assert [words.as_fraction(x) for x in (0.8, 0.875, 0.855, 1 / 3, 1.0, 1)] == [(4, 5), (7, 8), (171, 200), (1, 3), (1, 1), (1, 1)]
