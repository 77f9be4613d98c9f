"""The stemmer as SQL, for the checking engine: regexes over consonant and vowel runs decide the measure.

A leading y is written ``Y``, so that it counts as a consonant; a run of consonants begins with any letter
but a vowel and goes on without vowels and y, a run of vowels begins with a vowel or y.
"""

from __future__ import annotations

from threadline.functions.stem import STEP2, STEP3, STEP4

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _above(stem: str, measure: int) -> str:
    return f"regexp_matches({stem}, '^({_C})?{(_V + _C) * (measure + 1)}')"


def _one(stem: str) -> str:
    return f"regexp_matches({stem}, '^({_C})?{_V}{_C}({_V})?$')"


def _short_end(stem: str) -> str:
    """Consonant, vowel, consonant other than w, x, y at the end of a stem of measure one."""
    return f"regexp_matches({stem}, '^{_C}[aeiouy][^aeiouwxy]$')"


def _vowel(stem: str) -> str:
    return f"regexp_matches({stem}, '^({_C})?[aeiouy]')"


def _without(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _suffixes(table, measure: int) -> str:
    """The longest suffix decides: it is replaced if what is left is long enough."""
    cases = []
    for suffix, new in sorted(table, key=lambda e: -len(e[0])):
        stem = _without(len(suffix))
        allowed = f" AND regexp_matches({stem}, '[st]$')" if suffix == "ion" else ""
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {_above(stem, measure)}{allowed} THEN {stem} || '{new}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def _past(stem: str) -> str:
    """What is left of a word without its ``ed`` or ``ing``."""
    double = f"right({stem}, 1) = left(right({stem}, 2), 1) AND length({stem}) > 1 AND regexp_matches({stem}, '([^aeiouy]|[^aeiou]yy)$')"
    return (
        f"CASE WHEN regexp_matches({stem}, '(at|bl|iz)$') THEN {stem} || 'e' "
        f"WHEN {double} THEN CASE WHEN regexp_matches({stem}, '[lsz]$') THEN "
        f"CASE WHEN {_one(stem)} AND {_short_end(stem)} THEN {stem} || 'e' ELSE {stem} END ELSE left({stem}, length({stem}) - 1) END "
        f"WHEN {_one(stem)} AND {_short_end(stem)} THEN {stem} || 'e' ELSE {stem} END"
    )


STEPS = (
    "CASE WHEN starts_with(w, 'y') THEN 'Y' || substr(w, 2) ELSE w END",
    f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_without(2)} WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {_without(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_above(_without(3), 0)} THEN {_without(1)} ELSE w END "
    f"WHEN ends_with(w, 'ed') AND {_vowel(_without(2))} THEN {_past(_without(2))} "
    f"WHEN ends_with(w, 'ing') AND {_vowel(_without(3))} THEN {_past(_without(3))} ELSE w END",
    f"CASE WHEN ends_with(w, 'y') AND {_vowel(_without(1))} THEN {_without(1)} || 'i' ELSE w END",
    _suffixes(STEP2, 0),
    _suffixes(STEP3, 0),
    _suffixes([(s, "") for s in STEP4], 1),
    f"CASE WHEN ends_with(w, 'e') AND ({_above(_without(1), 1)} OR ({_one(_without(1))} AND NOT {_short_end(_without(1))})) THEN {_without(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'll') AND {_above('w', 1)} THEN {_without(1)} ELSE w END",
    "lower(w)",
)


def stems(table: str, term: str) -> str:
    """A query (term, stem) of the distinct terms of a table."""
    query = f"SELECT DISTINCT {term} AS term, {term} AS w FROM {table}"
    for step in STEPS:
        query = f"SELECT term, CASE WHEN length(term) <= 2 THEN w ELSE {step} END AS w FROM ({query})"
    return f"SELECT term, w AS stem FROM ({query})"
