"""Licence scan by sentence rules.

A text is cut into sentences, each is normalised (lower case, other characters than letters, digits and the point
of a version to blanks, a plus after a version to "or later") and looked up in a table of known licence sentences, each with an
identifier. A table entry is a run of words; a sentence has its identifier if it holds the run at word
boundaries. Of entries that overlap the leftmost wins, of those that begin alike the longest. All entries
are found in one pass by an automaton, so every sentence is looked up and none is screened out before.
A version is one word ("2.1"), so a licence has the version that its sentence names, or none. A name that the
sentence denies ("we do not use the ...") doesn't count.

The sequence of identifiers is then matched against the licence rules in their order. A rule is a sequence of
identifiers; unknown sentences, prose and copyright lines may stand between them, another known sentence may not. A match uses its
identifiers up; the next rules see what is left.

Defined results: null or empty text, and text with neither a licence word nor a known sentence: no licence (null)
and no identifiers. Licences of a text are distinct and in alphabetical order.
Repeated rows are scanned once each. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import map_arrow

# Sentences of public licence texts, normalised, up to where the texts of their versions part.
TEXTS = {
    "apache-2-copy": ("you may obtain a copy of the license at",),
    "apache-2-asis": ("unless required by applicable law or agreed to in writing software",),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all",),
    "mit-asis": ("the software is provided as is without warranty of any kind express or implied",),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted",
    ),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice",),
    "bsd-endorse": ("may be used to endorse or promote products derived from",),
    "bsd-advert": ("all advertising materials mentioning features or use of this software must display",),
    "bsd-asis": ("as is and any express or implied warranties",),
    "isc-notice": ("provided that the above copyright notice and this permission notice appear in all copies",),
    "isc-asis": ("the software is provided as is and the author disclaims all warranties",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",),
    "bsl-grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",),
    "wtfpl-grant": ("you just do what the fuck you want to",),
    "later": ("or at your option any later version", "or any later version", "or later", "or newer"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "public-domain": tuple(f"{verb} {to} the public domain" for verb, to in product(("dedicated", "released", "placed"), ("to", "into", "in"))),
    "reserved": ("all rights reserved",),
}


def _versions(v: str) -> tuple[str, ...]:
    """How a version is written; "2.0" is also written "2"."""
    return tuple(f"{mark}{x}" for x in ((v, v[:-2]) if v.endswith(".0") else (v,)) for mark in ("version ", "v", "v ", ""))


_cc_terms = {
    "by": "attribution", "by-sa": "attribution share alike", "by-nd": "attribution no derivatives", "by-nc": "attribution non commercial",
    "by-nc-sa": "attribution non commercial share alike", "by-nc-nd": "attribution non commercial no derivatives",
}
_spelt = lambda x: {x, x.replace("share alike", "sharealike"), x.replace("non commercial", "noncommercial"), x.replace("share alike", "sharealike").replace("non commercial", "noncommercial"), x.replace("no derivatives", "noderivatives").replace("non commercial", "noncommercial")}

# Licences that come in versions: stem of the public identifier, full names, versions. A full name without a version gives the stem.
FAMILIES = {
    "AGPL": (("gnu affero general public license", "affero general public license"), ("1.0", "3.0")),
    "LGPL": (("gnu lesser general public license", "gnu library general public license"), ("2.0", "2.1", "3.0")),
    "GPL": (("gnu general public license",), ("1.0", "2.0", "3.0")),
    "AFL": (("academic free license",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "Apache": (("apache license", "apache software license"), ("1.0", "1.1", "2.0")),
    "APSL": (("apple public source license",), ("1.0", "1.1", "1.2", "2.0")),
    "Artistic": (("artistic license",), ("1.0", "2.0")),
    "BSL": (("boost software license",), ("1.0",)),
    "CDDL": (("common development and distribution license",), ("1.0", "1.1")),
    "CECILL": (("cecill free software license agreement", "cecill license"), ("1.0", "1.1", "2.0", "2.1")),
    "CPL": (("common public license",), ("1.0",)),
    "ECL": (("educational community license",), ("1.0", "2.0")),
    "EPL": (("eclipse public license",), ("1.0", "2.0")),
    "EUPL": (("european union public license",), ("1.0", "1.1", "1.2")),
    "GFDL": (("gnu free documentation license",), ("1.1", "1.2", "1.3")),
    "LPPL": (("latex project public license",), ("1.0", "1.1", "1.2", "1.3c")),
    "MPL": (("mozilla public license",), ("1.0", "1.1", "2.0")),
    "MulanPSL": (("mulan permissive software license",), ("1.0", "2.0")),
    "ODbL": (("open data commons open database license", "open database license"), ("1.0",)),
    "OFL": (("sil open font license", "open font license"), ("1.0", "1.1")),
    "OSL": (("open software license",), ("1.0", "1.1", "2.0", "2.1", "3.0")),
    "Python": (("python license",), ("2.0",)),
    "PSF": (("python software foundation license",), ("2.0",)),
    "Zend": (("zend license",), ("2.0",)),
    "ZPL": (("zope public license",), ("1.1", "2.0", "2.1")),
}

# Full names of the others, which need no introduction, by licence.
SINGLE = {
    "MIT": ("mit license", "expat license"),
    "ISC": ("isc license",),
    "0BSD": ("bsd zero clause license", "zero clause bsd license"),
    "BSD-2-Clause": ("simplified bsd license", "bsd 2 clause license", "2 clause bsd license"),
    "BSD-3-Clause": ("new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause license", "3 clause bsd license"),
    "BSD-4-Clause": ("original bsd license", "bsd 4 clause license", "4 clause bsd license"),
    "Zlib": ("zlib license",),
    "NCSA": ("university of illinois ncsa open source license", "ncsa open source license"),
    "MS-PL": ("microsoft public license", "ms pl license"),
    "MS-RL": ("microsoft reciprocal license",),
    "PostgreSQL": ("postgresql license",),
    "WTFPL": ("do what the fuck you want to public license",),
    "CC0-1.0": ("cc0 1.0", "creative commons zero", "cc0 1.0 universal"),
    "Unlicense": ("the unlicense",),
    **{f"CC-{k.upper()}": tuple(f"creative commons {x}{v}" for x in sorted(_spelt(terms)) for v in ("", " 1.0", " 2.0", " 2.5", " 3.0", " 4.0")) for k, terms in _cc_terms.items()},
}
# Public identifiers without a name above.
TAGS = (
    "AAL", "Adobe-2006", "ANTLR-PD", "BlueOak-1.0.0", "bzip2-1.0.6", "curl", "FTL", "HPND", "ICU", "IJG", "ImageMagick", "Info-ZIP", "Intel", "IPA", "IPL-1.0", "JSON", "Libpng",
    "libtiff", "MIT-0", "MirOS", "NAIST-2003", "NTP", "OpenSSL", "PHP-3.0", "PHP-3.01", "QPL-1.0", "Ruby", "Sleepycat", "TCL", "Unicode-DFS-2016", "UPL-1.0", "Vim", "W3C", "X11", "Xnet",
)
# Short names that aren't the public identifier.
OTHER_SHORT = {"MIT": ("expat",), "CC0-1.0": ("cc0",), "Apache-2.0": ("apache v2",)}

_GNU = ("AGPL", "LGPL", "GPL")
#: Every versioned identifier, with its stem and its version.
VERSIONED = {f"{stem}-{v}": (stem, v) for stem, (_, versions) in FAMILIES.items() for v in versions}


def _british(names: tuple[str, ...]) -> tuple[str, ...]:
    return names + tuple(x.replace("license", "licence") for x in names if "license" in x)


def _versioned(stem: str, v: str) -> tuple[str, ...]:
    by = ("", " as published by the free software foundation") if stem in _GNU else ("",)
    either = ("", " either") if stem in _GNU else ("",)
    return tuple(f"{title}{b}{e} {at}" for title, b, e, at in product(_british(FAMILIES[stem][0]), by, either, _versions(v)))


NAMES = {name: _versioned(*of) for name, of in VERSIONED.items()} | {stem: _british(titles) for stem, (titles, _) in FAMILIES.items()} | {k: _british(v) for k, v in SINGLE.items()}


def _short(name: str) -> tuple[str, ...]:
    """The public identifier as words, and shorter ways to write one with a version ("mpl v2", "gplv3 only")."""
    if name not in VERSIONED:
        return (name.lower().replace("-", " "), *OTHER_SHORT.get(name, ()))
    stem, v = VERSIONED[name]
    plain = {f"{stem.lower()}{at}{x}" for x in {v, v.removesuffix(".0")} for at in (" ", " v", "v", " version ")}
    return (*(f"{x}{only}" for x in sorted(plain) for only in (("", " only") if stem in _GNU else ("",))), *OTHER_SHORT.get(name, ()))


# Short names and public identifiers, which count only where a sentence introduces them, by licence.
SHORT = {name: _short(name) for name in (*VERSIONED, *(k for k in SINGLE if k not in {f"CC-{x.upper()}" for x in _cc_terms}), *TAGS)}
SHORT |= {f"CC-{k.upper()}": tuple(f"cc {k.replace('-', ' ')}{v}" for v in ("", " 1.0", " 2.0", " 2.5", " 3.0", " 4.0")) for k in _cc_terms}

# What introduces a short name, and what may follow one that has no introduction.
BEFORE = ("spdx license identifier", "license", "licence", *(f"{verb}under {the}".strip() for verb, the in product(("licensed ", "released ", "available ", "distributed ", ""), ("", "the", "the terms of the"))))
AFTER = ("licensed", "license", "licence")
# Licences whose version may be followed by "or any later version".
WITH_LATER = tuple(name for name, (stem, _) in VERSIONED.items() if stem in _GNU)

# Licence rules in the order in which they are tried.
RULES = (
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("MIT", "mit-grant")),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant", "isc-notice")),
    ("0BSD", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("WTFPL", ("wtfpl-grant",)),
    *((f"{name}-or-later", (name, "later")) for name in WITH_LATER),
    *((f"{name}-or-later", (f"{name}-or-later",)) for name in WITH_LATER),
    *((name, (name,)) for name in SHORT),
    *((stem, (stem,)) for stem in FAMILIES),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public-domain",)),
    ("All-Rights-Reserved", ("reserved",)),
)

UNKNOWN, COPYRIGHT = "unknown", "copyright"
#: A sentence without an identifier is reported as unknown if it has one of these.
_licence_word = re.compile(r"licen[sc]e|permission|redistribut|copyright|warrant|public domain|rights reserved", re.IGNORECASE)
_year = re.compile(r"  copyright  (?:c  )?\d{4}  ")
# The colon of a tag ends no sentence, nor does the point of "v. 2", nor what stands before a version.
_ends = re.compile(r"(?<=[.!?;:])(?<!(?i:identifier:))(?<!(?i:licen[sc]e:))(?<!\b[vV]\.)\s+(?!(?i:(?:either\s+)?version\s+\d))|\n\s*\n")
_other = re.compile(r"(?:[^a-z0-9.]|(?<![0-9])\.|\.(?![0-9]))+")
# What denies a name that follows within a few words.
_denied = re.compile(r"  (?:not|never|longer|isn  t|don  t|doesn  t)  (?:be  )?(?:use|using|used|licensed|released|available|distributed|covered|under)(?:  (?!except|unless|than|only|but)[a-z0-9.]+){0,4}$")
_later = re.compile(r"(?<=\d)\+")
#: Parts of an expression of public identifiers.
_joined = re.compile(r"  (?:and|or)(?=  (?!later  |at  |any  ))")


def normalise(sentence: str) -> str:
    """Words between two blanks each, with two at the ends, so that entries at word boundaries never share a blank."""
    words = _other.sub("  ", _later.sub(" or later", sentence.lower())).strip()
    return f"  {words}  "


def table() -> dict[str, str]:
    """Identifier of every known run of words."""
    out = {}
    for name, shorts in SHORT.items():
        for short, kind in product(shorts, ("", " or later") if name in WITH_LATER else ("",)):
            identifier = name + kind.replace(" ", "-")
            out |= {f"{before} {short}{kind}": identifier for before in BEFORE} | {f"{short}{kind} {after}": identifier for after in AFTER}
    for name, full in NAMES.items():
        out |= dict.fromkeys(full, name)
    for identifier, texts in TEXTS.items():
        out |= dict.fromkeys(texts, identifier)
    return out


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Finds the entries; built once by each Python worker."""
    out = ahocorasick.Automaton()
    for words, identifier in table().items():
        flat = f" {words.replace(' ', '  ')} "
        out.add_word(flat, (flat, identifier))
    out.make_automaton()
    return out


def sentence_identifiers(sentence: str) -> list[str]:
    """Identifiers of the known runs in one sentence, in order."""
    flat = normalise(sentence)
    # Every part of an expression of public identifiers is introduced like the first.
    if "  spdx  license  identifier  " in flat:
        flat = _joined.sub("  spdx  license  identifier", flat)
    found = [(end, words, identifier) for end, (words, identifier) in _automaton().iter_long(flat)]
    kept = [identifier for end, words, identifier in found if identifier in TEXTS or not _denied.search(flat[: end - len(words) + 1].rstrip())]
    return kept or ([COPYRIGHT] if not found and _year.search(flat) else [])


def identifiers(text: str | None) -> list[str]:
    """Identifiers of the text's licence sentences in order; ``unknown`` for one that only looks like licence text."""
    out: list[str] = []
    for sentence in _ends.split(text) if text else ():
        found = sentence_identifiers(sentence)
        out += found or ([UNKNOWN] if _licence_word.search(sentence) else [])
    return out


def licences(found: list[str]) -> list[str]:
    """Licences that the rules find in a sequence of identifiers."""
    left, out = [x for x in found if x not in (COPYRIGHT, UNKNOWN)], set()
    if not left:
        return []
    for name, rule in RULES:
        k = 0
        while k + len(rule) <= len(left):
            if tuple(left[k : k + len(rule)]) == rule:
                out.add(name)
                left[k : k + len(rule)] = [""] * len(rule)
                k += len(rule)
            else:
                k += 1
    return sorted(out)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, licences (joined by a bar, null if none), sentences (identifiers joined by a bar, null if none), n_unknown."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def find(batches):
        for batch in batches:
            found = [identifiers(text) for text in batch["text"].to_pylist()]
            columns = [
                batch["id"],
                pa.array(["|".join(licences(x)) or None for x in found], pa.string()),
                pa.array(["|".join(x) or None for x in found], pa.string()),
                pa.array([x.count(UNKNOWN) for x in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "licences", "sentences", "n_unknown"])

    id_type = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, find, f"id {id_type}, licences string, sentences string, n_unknown long").withColumnRenamed("id", id_col)
