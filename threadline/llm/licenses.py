"""License scans: ordered signature rules behind a keyword gate, all in Spark SQL functions.

A text becomes its lower-cased words, joined by single blanks. Rules are regexes over that; one is tried
only on texts that hold one of its keywords as a word. Every match is a detection: an interval of words
with a tier (how strong its rule is; rules of a tier are ordered). A detection that lies within another
of the same or a stronger tier is suppressed, of equal intervals the one whose rule comes first stays.
So "gpl version 2 or later" silences "gpl version 2", which silences "gpl". Base phrases are always kept.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates words once A-Z are lower-cased, and the case pairs.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Phrases that are always reported, and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

LICENSE = "licen[cs]e"
LICENSE_WORDS = ("license", "licence")
GRANT = "(?:licensed|released|distributed|available|published|provided|covered|redistributed|made available)"
VERSION = "(?:version|v|ver)"

# Labels, the wording of names, and words of which every match of the name holds one.
# Names that are everyday words are only told by templates that add a word of their own.
NAMES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", "(?:mit|expat|mit x11|x11)", ()),
    ("mit-0", "mit (?:0|no attribution)", ()),
    ("apache-1", "apache(?: software)? (?:licen[cs]e )?(?:version |v )?1 [01]", ("apache",)),
    ("apache-2", "apache(?: software)? (?:licen[cs]e )?(?:version |v )?(?:2 0|2|v2)", ("apache",)),
    ("bsd-0-clause", "(?:0 clause bsd|bsd 0 clause|zero clause bsd|0bsd)", ("bsd", "0bsd")),
    ("bsd-2-clause", "(?:2 clause bsd|bsd 2 clause|two clause bsd|simplified bsd|freebsd)", ("bsd", "freebsd")),
    ("bsd-3-clause", "(?:3 clause bsd|bsd 3 clause|three clause bsd|new bsd|modified bsd|revised bsd)", ("bsd",)),
    ("bsd-4-clause", "(?:4 clause bsd|bsd 4 clause|four clause bsd|original bsd)", ("bsd",)),
    ("isc", "(?:isc|internet systems consortium)", ()),
    ("gpl-1", "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? ?(?:1 0|1|v1)", ("gpl", "gnu")),
    ("gpl-2", "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? ?(?:2 0|2|v2)(?: only)?", ("gpl", "gnu", "gplv2")),
    ("gpl-2-or-later", "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? ?(?:2 0|2|v2) (?:or (?:any )?later|or newer|plus)", ("gpl", "gnu", "gplv2")),
    ("gpl-3", "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? ?(?:3 0|3|v3)(?: only)?", ("gpl", "gnu", "gplv3")),
    ("gpl-3-or-later", "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? ?(?:3 0|3|v3) (?:or (?:any )?later|or newer|plus)", ("gpl", "gnu", "gplv3")),
    ("lgpl-2", "(?:gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl)(?: version| v)? ?(?:2 0|2|v2)", ("lgpl", "gnu", "lgplv2")),
    ("lgpl-2.1", "(?:gnu lesser general public licen[cs]e|gnu lgpl|lgpl)(?: version| v)? ?(?:2 1|v2 1)", ("lgpl", "gnu", "lgplv2")),
    ("lgpl-3", "(?:gnu lesser general public licen[cs]e|gnu lgpl|lgpl)(?: version| v)? ?(?:3 0|3|v3)", ("lgpl", "gnu", "lgplv3")),
    ("agpl-3", "(?:gnu affero general public licen[cs]e|affero gpl|gnu agpl|agpl)(?: version| v)? ?(?:3 0|3|v3)", ("agpl", "affero", "agplv3")),
    ("gfdl-1", "(?:gnu free documentation licen[cs]e|gfdl)(?: version| v)? ?1 [123]", ("gnu", "gfdl")),
    ("mpl-1", "(?:mozilla public licen[cs]e|mpl)(?: version| v)? ?1 [01]", ("mozilla", "mpl")),
    ("mpl-2", "(?:mozilla public licen[cs]e|mpl)(?: version| v)? ?(?:2 0|2|v2)", ("mozilla", "mpl")),
    ("epl-1", "(?:eclipse public licen[cs]e|epl)(?: version| v)? ?(?:1 0|1|v1)", ("eclipse", "epl")),
    ("epl-2", "(?:eclipse public licen[cs]e|epl)(?: version| v)? ?(?:2 0|2|v2)", ("eclipse", "epl")),
    ("cddl-1", "(?:common development and distribution licen[cs]e|cddl)(?: version| v)? ?1 [01]", ("cddl", "distribution")),
    ("cpl-1", "common public licen[cs]e(?: version| v)? ?1 0", ("common",)),
    ("eupl-1", "(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 [012]", ("eupl", "european")),
    ("osl-3", "(?:open software licen[cs]e|osl)(?: version| v)? ?3 0", LICENSE_WORDS + ("osl",)),
    ("afl-3", "(?:academic free licen[cs]e|afl)(?: version| v)? ?3 0", ("academic", "afl")),
    ("artistic-1", "artistic licen[cs]e(?: version| v)? ?1 0", ("artistic",)),
    ("artistic-2", "artistic licen[cs]e(?: version| v)? ?2 0", ("artistic",)),
    ("bsl-1", "boost software licen[cs]e(?: version| v)? ?(?:1 0|1)", ("boost",)),
    ("zlib", "(?:zlib|zlib libpng)", ()),
    ("unlicense", "(?:the unlicense|unlicense)", ("unlicense",)),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public licen[cs]e)", ("wtfpl", "fuck")),
    ("cc0-1", "(?:cc0|cc zero|creative commons zero)(?: 1 0| universal)?", ("cc0", "cc", "commons")),
    ("ofl-1", "(?:sil open font licen[cs]e|ofl)(?: version| v)? ?1 [01]", ("sil", "ofl")),
    ("python-2", "(?:python software foundation licen[cs]e|psf licen[cs]e)(?: version| v)? ?2?", ("psf", "python")),
    ("php-3", "php licen[cs]e(?: version| v)? ?3 01?", ("php",)),
    ("postgresql", "postgresql", ()),
    ("openssl", "openssl", ()),
    ("ms-pl", "(?:microsoft public licen[cs]e|ms pl)", ("microsoft", "ms")),
    ("ms-rl", "(?:microsoft reciprocal licen[cs]e|ms rl)", ("microsoft", "ms")),
    ("odbl-1", "(?:open database licen[cs]e|odbl)(?: version| v)? ?(?:1 0)?", LICENSE_WORDS + ("odbl",)),
    ("odc-by-1", "(?:open data commons attribution licen[cs]e|odc by)", ("commons", "odc")),
    ("pddl-1", "(?:public domain dedication and licen[cs]e|pddl)", ("dedication", "pddl")),
    ("ncsa", "(?:university of illinois ncsa|ncsa open source)", ("ncsa",)),
    ("json", "json", ()),
    ("ruby", "ruby", ()),
    ("vim", "vim", ()),
    ("curl", "curl", ()),
    ("ftl", "freetype project", ("freetype",)),
    ("busl-1", "(?:business source licen[cs]e|busl)(?: version| v)? ?1 1", ("business", "busl")),
    ("sspl-1", "(?:server side public licen[cs]e|sspl)(?: version| v)? ?1?", ("sspl", "server")),
    ("elastic-2", "elastic licen[cs]e(?: version| v)? ?(?:2 0|2)", ("elastic",)),
)
# Names without version: weaker than any with one.
FAMILIES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("apache", "apache(?: software)? licen[cs]e", ("apache",)),
    ("bsd", "(?:bsd(?: style)? licen[cs]e|berkeley software distribution licen[cs]e)", ("bsd", "berkeley")),
    ("gpl", "(?:gnu general public licen[cs]e|gnu gpl|gpl)", ("gpl", "gnu")),
    ("lgpl", "(?:gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl)", ("lgpl", "gnu")),
    ("agpl", "(?:gnu affero general public licen[cs]e|gnu agpl|agpl)", ("agpl", "affero")),
    ("gfdl", "gnu free documentation licen[cs]e", ("gnu",)),
    ("mpl", "mozilla public licen[cs]e", ("mozilla",)),
    ("epl", "eclipse public licen[cs]e", ("eclipse",)),
    ("cddl", "common development and distribution licen[cs]e", ("distribution",)),
    ("artistic", "artistic licen[cs]e", ("artistic",)),
    ("cc", "creative commons(?: attribution)? licen[cs]e", ("commons",)),
    ("public-domain", "(?:released into|placed in|dedicated to) the public domain", ("domain",)),
    ("proprietary", "(?:all rights reserved|proprietary and confidential)", ("reserved", "proprietary")),
    ("gpl-linking-exception", "gpl with (?:a )?(?:linking|classpath) exception", ("gpl",)),
)
# Sentences of the licenses themselves.
SENTENCES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", ("copyright",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("hereby",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution",)),
    ("bsd-3-clause", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse", ("contributors",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", ("gnu",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e", ("gnu",)),
    ("gpl-2-or-later", "gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or (?:at your option )?any later version", ("gnu",)),
    ("gpl-3-or-later", "gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or (?:at your option )?any later version", ("gnu",)),
    ("apache-2", "licensed under the apache licen[cs]e version 2 0 the licen[cs]e", ("apache",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", ("mozilla",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("warranty",)),
    ("bsl-1", "boost software licen[cs]e version 1 0 august 17th 2003", ("boost",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",)),
)
#: Score of a document by the tier of its strongest detection that stays; tier 0 are the base phrases.
CONFIDENCE = (1.0, 0.95, 0.85, 0.6)


@dataclass(frozen=True)
class Signature:
    """One rule. ``extra`` is the length of a match in blanks beyond those its pattern consumes."""

    rule: str
    label: str
    tier: int
    pattern: str
    keywords: tuple[str, ...]
    extra: int = 0


def base_signatures(phrases: tuple[tuple[str, str], ...] = BASE_PHRASES) -> list[Signature]:
    """Phrases as rules; places may overlap, so the pattern only looks at the words."""
    return [Signature(f"base {p}", label, 0, f"(?={p} )", (max(p.split(), key=len),), p.count(" ")) for p, label in phrases]


def _creative_commons() -> list[tuple[str, str, tuple[str, ...]]]:
    """The licenses of the family by their elements, with and without version."""
    words = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    found = []
    for elements in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        long = " ".join(words[e] for e in elements.split())
        name = f"(?:cc {elements}|creative commons {long})"
        label = "cc-" + elements.replace(" ", "-")
        found.append((label, name, ("cc", "commons")))
        found += [(f"{label}-{v}", f"{name}(?: version| v)? {v} 0", ("cc", "commons")) for v in (1, 2, 3, 4)]
    return found


def default_signatures() -> list[Signature]:
    """Several hundred rules, strongest tier first; of equal intervals the earlier rule wins."""
    named = [*NAMES, *_creative_commons()]
    found: list[Signature] = []

    def add(kind: str, label: str, tier: int, pattern: str, keywords: tuple[str, ...]) -> None:
        found.append(Signature(f"{kind} {label} {len(found)}", label, tier, pattern, keywords))

    for label, pattern, keywords in SENTENCES:
        add("sentence", label, 1, pattern, keywords)
    for label, name, keywords in named:
        add("tag", label, 1, f"spdx licen[cs]e identifier {name}", ("spdx",))
        add("grant", label, 1, f"{GRANT} under (?:the )?(?:terms of )?(?:the )?{name}(?: {LICENSE})?", keywords or ("under",))
    for label, name, keywords in named:
        own = keywords or LICENSE_WORDS
        add("name", label, 2, f"(?:the )?{name} {LICENSE}", LICENSE_WORDS)
        add("field", label, 2, f"{LICENSE}d? (?:is )?(?:the )?{name}", (*LICENSE_WORDS, "licensed", "licenced"))
        if keywords:
            add("mention", label, 2, name, own)
        add("dual", label, 2, f"dual licensed under (?:the )?{name}", ("dual",))
    for label, name, keywords in FAMILIES:
        add("grant", label, 3, f"{GRANT} under (?:the )?(?:terms of )?(?:the )?{name}", keywords)
        add("family", label, 3, name, keywords)
    return found


SIGNATURES = (*base_signatures(), *default_signatures())
_RULE_TYPE = "array<struct<number int, rule string, label string, tier int, pattern string, keywords array<string>, extra int>>"
_SPAN = "struct<start int, back int, tier int, number int, rule string, label string>"
_KEPT = "struct<rule string, label string, tier int, start_word int, end_word int, kept boolean>"


def joined_words(text: Column) -> Column:
    """The lower-cased words of a text, joined by blanks; empty for a null text."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(low, SEPARATORS, " "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _spans(words: Column, rule: Column) -> Column:
    """The matches of one rule as intervals of words: what lies between matches tells where they start."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")"), F.when(rule["extra"] > 0, "").otherwise("(?= )"))
    hits = F.regexp_extract_all(words, pattern, F.lit(0))

    def places(hits: Column) -> Column:
        steps = F.zip_with(
            hits,
            F.slice(F.split(words, pattern), F.lit(1), F.size(hits)),
            lambda hit, before: F.struct(_blanks(before).alias("gap"), _blanks(hit).alias("inner")),
        )
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

        def place(seen: Column, step: Column) -> Column:
            start = seen["at"] + step["gap"] - 1
            end = start + step["inner"] + rule["extra"] + 1
            span = F.struct(
                start.alias("start"),
                (-end).alias("back"),
                rule["tier"].alias("tier"),
                rule["number"].alias("number"),
                rule["rule"].alias("rule"),
                rule["label"].alias("label"),
            )
            return F.struct((seen["at"] + step["gap"] + step["inner"]).alias("at"), F.concat(seen["spans"], F.array(span)).alias("spans"))

        return F.when(F.size(hits) > 0, F.aggregate(steps, nothing, place, lambda seen: seen["spans"])).otherwise(
            F.array().cast(f"array<{_SPAN}>")
        )

    return F.flatten(F.transform(F.array(hits), places))  # binds the matches, which are found once


def _resolve(spans: Column) -> Column:
    """Detections in text order with the verdict of suppression.

    Sorted by start, then longest first, an interval lies within an earlier one exactly if one of these
    ends at or behind its end: the furthest end of every tier is all there is to remember.
    """
    tiers = len(CONFIDENCE)
    furthest = F.array_repeat(F.lit(-1), tiers)
    nothing = F.struct(furthest.alias("far"), F.array().cast(f"array<{_KEPT}>").alias("found"))

    def judge(seen: Column, span: Column) -> Column:
        end = -span["back"]
        covered = F.exists(F.slice(seen["far"], F.lit(1), span["tier"] + 1), lambda far: far >= end)
        verdict = F.struct(
            span["rule"].alias("rule"),
            span["label"].alias("label"),
            span["tier"].alias("tier"),
            span["start"].alias("start_word"),
            end.alias("end_word"),
            ((span["tier"] == 0) | ~covered).alias("kept"),
        )
        far = F.transform(seen["far"], lambda f, i: F.when(i == span["tier"], F.greatest(f, end)).otherwise(f))
        return F.struct(far.alias("far"), F.concat(seen["found"], F.array(verdict)).alias("found"))

    return F.aggregate(F.array_sort(spans), nothing, judge, lambda seen: seen["found"])


def detections(
    docs: DataFrame, signatures: tuple[Signature, ...] = SIGNATURES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its id, n_words, and ``found``, all detections with their intervals of words.

    Null and empty texts have no words and no detections; repeated rows, and rows with a null id, are
    judged each on its own. An empty table gives no rows. Other columns are not read.
    """
    listed = [{"number": i, **asdict(s)} for i, s in enumerate(signatures)]
    rules = F.from_json(F.lit(json.dumps(listed)), _RULE_TYPE)  # folded to one literal
    keywords = F.array(*[F.lit(k) for k in sorted({k for s in signatures for k in s.keywords})])
    words = docs.select(F.col(id_col), joined_words(F.col(text_col)).alias("_words"))
    gated = words.select(
        id_col,
        F.when(F.col("_words") == "", F.lit(0)).otherwise(_blanks(F.col("_words")) + 1).cast("long").alias("n_words"),
        F.array_intersect(F.split("_words", " "), keywords).alias("_present"),
        F.concat(F.lit(" "), F.col("_words"), F.lit(" ")).alias("_padded"),
    )
    # Lambdas repeat what they mention, so the row's values are bound to a variable first.
    row = F.struct(F.col("_present").alias("present"), F.col("_padded").alias("words"))

    def scan(row: Column) -> Column:
        tried = F.filter(rules, lambda rule: F.arrays_overlap(rule["keywords"], row["present"]))
        return _resolve(F.flatten(F.transform(tried, lambda rule: _spans(row["words"], rule))))

    found = F.when(F.size("_present") > 0, F.element_at(F.transform(F.array(row), scan), 1))
    return gated.select(id_col, "n_words", F.coalesce(found, F.array().cast(f"array<{_KEPT}>")).alias("found"))


def labels(docs: DataFrame, signatures: tuple[Signature, ...] = SIGNATURES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of :func:`detections`: places and labels of the base phrases, all labels that stay, a score.

    The score is the confidence of the strongest detection that stays, 0 without any.
    """
    base = F.filter("found", lambda d: d["tier"] == 0)
    kept = F.filter("found", lambda d: d["kept"])
    names = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda d: d["label"]))), ",")
    confidence = F.array(*[F.lit(c) for c in CONFIDENCE])
    strongest = F.array_max(F.transform(kept, lambda d: F.element_at(confidence, d["tier"] + 1)))
    return detections(docs, signatures, id_col, text_col).select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start_word"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start_word"])).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(kept).alias("labels"),
        F.coalesce(strongest, F.lit(0.0)).alias("score"),
    )
