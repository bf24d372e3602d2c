"""English stemming by Porter's second algorithm, as a chain of plain SQL expressions.

A step is a ``CASE`` over the word ``w``, the start ``r1`` and ``r2`` of its two regions, and what
earlier steps have left; the expressions are in the SQL that Spark and other engines share.  The
chain is long, so it is meant for distinct words: ``stemmed`` takes a table of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the algorithm: vowels, doubles, endings and exceptions.
_V = "[aeiouy]"
_C = "[^aeiouy]"
_LI = "cdeghkmnrt"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = "inning outing canning herring earring proceed exceed succeed".split()
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _ends(word: str, end: str) -> str:
    return f"right({word}, {len(end)}) = '{end}'"


def _cut(word: str, n: int, add: str = "") -> str:
    cut = f"substr({word}, 1, length({word}) - {n})"
    return f"concat({cut}, '{add}')" if add else cut


def _matches(word: str, pattern: str) -> str:
    return f"length(regexp_replace({word}, '{pattern}', '')) < length({word})"


def _longest(word: str, endings: list[tuple[str, str, str]], otherwise: str) -> str:
    """The longest ending decides, even where its condition (over its region) then leaves the word as it is."""
    cases = [f"WHEN {_ends(word, e)} THEN CASE WHEN {condition} THEN {then} ELSE {word} END" for e, condition, then in sorted(endings, key=lambda x: -len(x[0]))]
    return f"CASE {' '.join(cases)} ELSE {otherwise} END"


def _in(region: str, word: str, n: int) -> str:
    return f"length({word}) - {n} >= {region}"


def steps() -> list[tuple[str, str]]:
    """(column, expression) of every step, in order; the last column is ``term``.  The first reads ``word``, in lower case."""
    short = f"^{_V}{_C}$|{_C}{_V}[^aeiouywxY]$"
    out = [
        # y is a consonant, written Y, at the start and after a vowel
        ("w0", "regexp_replace(regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiou])y', '\\1Y'), '([aeiou])y', '\\1Y')"),
        ("head", f"length(regexp_replace(w0, '^(gener|commun|arsen|{_C}*{_V}+{_C}).*$', '\\1'))"),
        ("r1", f"CASE WHEN {_matches('w0', f'^(gener|commun|arsen|{_C}*{_V}+{_C})')} THEN head ELSE length(w0) END"),
        ("rest", "substr(w0, r1 + 1)"),
        ("r2", f"CASE WHEN {_matches('rest', f'^{_C}*{_V}+{_C}')} THEN r1 + length(regexp_replace(rest, '^({_C}*{_V}+{_C}).*$', '\\1')) ELSE length(w0) END"),
        (
            "w1",
            f"CASE WHEN {_ends('w0', 'sses')} THEN {_cut('w0', 2)} WHEN {_ends('w0', 'ied')} OR {_ends('w0', 'ies')} THEN CASE WHEN length(w0) > 4 THEN {_cut('w0', 2)} ELSE {_cut('w0', 1)} END "
            f"WHEN {_ends('w0', 'us')} OR {_ends('w0', 'ss')} THEN w0 WHEN {_ends('w0', 's')} AND {_matches('w0', f'{_V}.+s$')} THEN {_cut('w0', 1)} ELSE w0 END",
        ),
        ("kept", "w1 IN (" + ", ".join(f"'{x}'" for x in _KEPT) + ")"),
    ]
    bare = _longest("w1", [(e, f"{_matches('w1', f'{_V}.*{e}$')}", _cut("w1", len(e))) for e in ("ed", "edly", "ing", "ingly")], "w1")
    out += [
        ("b", f"CASE WHEN {_ends('w1', 'eed')} THEN CASE WHEN {_in('r1', 'w1', 3)} THEN {_cut('w1', 1)} ELSE w1 END WHEN {_ends('w1', 'eedly')} THEN CASE WHEN {_in('r1', 'w1', 5)} THEN {_cut('w1', 3)} ELSE w1 END ELSE {bare} END"),
        ("lost", f"b <> w1 AND NOT {_ends('w1', 'eed')} AND NOT {_ends('w1', 'eedly')}"),
        (
            "w2",
            f"CASE WHEN NOT lost THEN b WHEN {_ends('b', 'at')} OR {_ends('b', 'bl')} OR {_ends('b', 'iz')} THEN concat(b, 'e') "
            f"WHEN {_matches('b', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {_cut('b', 1)} WHEN length(b) <= r1 AND {_matches('b', short)} THEN concat(b, 'e') ELSE b END",
        ),
        ("w3", f"CASE WHEN {_matches('w2', f'.{_C}[yY]$')} THEN {_cut('w2', 1, 'i')} ELSE w2 END"),
    ]
    second = [(e, _in("r1", "w3", len(e)), _cut("w3", len(e), to)) for e, to in _STEP2.items()]
    second += [("ogi", f"{_in('r1', 'w3', 3)} AND {_ends('w3', 'logi')}", _cut("w3", 1)), ("li", f"{_in('r1', 'w3', 2)} AND {_matches('w3', f'[{_LI}]li$')}", _cut("w3", 2))]
    third = [(e, _in("r1", "w4", len(e)), _cut("w4", len(e), to)) for e, to in _STEP3.items()] + [("ative", _in("r2", "w4", 5), _cut("w4", 5))]
    fourth = [(e, _in("r2", "w5", len(e)), _cut("w5", len(e))) for e in _STEP4] + [("ion", f"{_in('r2', 'w5', 3)} AND {_matches('w5', '[st]ion$')}", _cut("w5", 3))]
    e_goes = f"{_in('r2', 'w6', 1)} OR ({_in('r1', 'w6', 1)} AND NOT {_matches('substr(w6, 1, length(w6) - 1)', short)})"
    out += [
        ("w4", _longest("w3", second, "w3")),
        ("w5", _longest("w4", third, "w4")),
        ("w6", _longest("w5", fourth, "w5")),
        ("w7", f"CASE WHEN {_ends('w6', 'e')} AND ({e_goes}) THEN {_cut('w6', 1)} WHEN {_ends('w6', 'll')} AND {_in('r2', 'w6', 1)} THEN {_cut('w6', 1)} ELSE w6 END"),
        (
            "term",
            "CASE " + " ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in _WHOLE.items()) + " WHEN length(word) <= 2 OR " + _matches("word", "[^a-z]")
            + " THEN word WHEN kept THEN w1 ELSE replace(w7, 'Y', 'y') END",
        ),
    ]
    return out


def stemmed(words: DataFrame) -> DataFrame:
    """Adds ``term`` to a table of distinct lower-case words (``word``); a word with other than the letters a to z is its own.

    The steps are bound one inside the other, each computed once: as columns over columns, the optimizer would write
    out every step wherever a later one reads it.
    """
    *before, (_, last) = steps()
    for name, sql in reversed(before):
        last = f"element_at(transform(array({sql}), {name} -> {last}), 1)"
    return words.withColumn("term", F.expr(last.replace("\\1", "$1")))


def stems(spark: SparkSession, words: list[str]) -> dict[str, str]:
    """The terms of a few words, worked out where the plan is made."""
    if not words:
        return {}
    rows = stemmed(spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string"))
    return {r["word"]: r["term"] for r in rows.collect()}


def oracle_ctes(source: str) -> str:
    """The same chain as common table expressions over ``source`` (a table with ``word``); the last is ``stems``."""
    parts, before = [], source
    for k, (name, sql) in enumerate(steps()):
        parts.append(f"st{k} AS (SELECT *, {sql} AS {name} FROM {before})")
        before = f"st{k}"
    return ", ".join([*parts, f"stems AS MATERIALIZED (SELECT word, term FROM {before})"])
