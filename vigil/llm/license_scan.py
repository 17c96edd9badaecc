"""License scan: ordered signature rules over the words of a text, gated by keywords, overlaps resolved by containment.

Every rule is a regular expression over the text's words joined by one space. A block's bytes pass an Aho-Corasick automaton
of the rules' keywords once; only texts with a rule's keyword are tried against it. Of the detections, those of higher
priority (then the longer, then the earlier) come first, and one that lies within an accepted detection is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as bl
from .license_signatures import SIGNATURES
from .near_dedup import LOWER
from .rolling import words

#: Phrases whose places are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: (pattern of the name, keyword, versions). Names as words in lower case, as texts spell them.
FAMILIES = {
    "apache": (r"apache(?: software)?", "apache", ["1.0", "1.1", "2.0"]),
    "gpl": (r"(?:gnu )?(?:general public|gpl)", "g", ["1.0", "2.0", "3.0"]),
    "lgpl": (r"(?:gnu )?(?:lesser|library) general public|(?:gnu )?lgpl", "l", ["2.0", "2.1", "3.0"]),
    "agpl": (r"(?:gnu )?affero general public|(?:gnu )?agpl", "a", ["1.0", "3.0"]),
    "fdl": (r"(?:gnu )?free documentation|gfdl", "f", ["1.1", "1.2", "1.3"]),
    "mpl": (r"mozilla public|mpl", "m", ["1.0", "1.1", "2.0"]),
    "epl": (r"eclipse public|epl", "e", ["1.0", "2.0"]),
    "cddl": (r"common development and distribution|cddl", "c", ["1.0", "1.1"]),
    "cpl": (r"common public|cpl", "c", ["1.0"]),
    "eupl": (r"european union public|eupl", "e", ["1.0", "1.1", "1.2"]),
    "osl": (r"open software|osl", "o", ["1.0", "2.0", "2.1", "3.0"]),
    "afl": (r"academic free|afl", "a", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    "artistic": (r"artistic", "artistic", ["1.0", "2.0"]),
    "bsl": (r"boost software", "boost", ["1.0"]),
    "busl": (r"business source", "business", ["1.1"]),
    "ofl": (r"(?:sil )?open font|ofl", "o", ["1.0", "1.1"]),
    "odbl": (r"open database|odbl", "o", ["1.0"]),
    "pddl": (r"public domain dedication and|pddl", "p", ["1.0"]),
    "zpl": (r"zope public|zpl", "z", ["1.1", "2.0", "2.1"]),
    "lppl": (r"latex project public|lppl", "l", ["1.0", "1.1", "1.2", "1.3"]),
    "ms-pl": (r"microsoft public|ms pl", "m", []),
    "ms-rl": (r"microsoft reciprocal|ms rl", "m", []),
    "mit": (r"mit|expat", "m", []),
    "isc": (r"isc", "isc", []),
    "zlib": (r"zlib", "zlib", []),
    "ncsa": (r"ncsa|university of illinois", "n", []),
    "postgresql": (r"postgresql", "postgresql", []),
    "python": (r"python software foundation|psf", "p", ["2.0"]),
    "php": (r"php", "php", ["3.0", "3.01"]),
    "ruby": (r"ruby", "ruby", []),
    "openssl": (r"openssl", "openssl", []),
    "wtfpl": (r"do what the fuck you want to public|wtfpl", "w", []),
    "unlicense": (r"unlicense", "unlicense", []),
    "vim": (r"vim", "vim", []),
    "x11": (r"x11", "x11", []),
    "qpl": (r"q public|qpl", "q", ["1.0"]),
    "bsd-2-clause": (r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd", "b", []),
    "bsd-3-clause": (r"bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd", "b", []),
    "bsd-4-clause": (r"bsd 4 clause|4 clause bsd|original bsd", "b", []),
    "bsd": (r"bsd", "bsd", []),
    "0bsd": (r"zero clause bsd|0bsd", "b", []),
    "cc0": (r"cc0|cc zero|creative commons zero", "c", ["1.0"]),
}
#: Creative Commons: label: (short form, long form).
COMMONS = {
    "cc-by": ("by", "attribution"), "cc-by-sa": ("by sa", "attribution share ?alike"), "cc-by-nd": ("by nd", "attribution no ?deriv(?:ative)?s"),
    "cc-by-nc": ("by nc", "attribution non ?commercial"), "cc-by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "cc-by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
}
COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: label: (pattern, keyword) of sentences that name no license.
SENTENCES = {
    "mit": [("permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"), ("the software is provided as is without warranty of any kind", "warranty")],
    "bsd": [("redistribution and use in source and binary forms with or without modification are permitted", "redistribution")],
    "isc": [("permission to use copy modify and or distribute this software for any purpose", "permission to use")],
    "public-domain": [("(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain"), ("this work is in the public domain", "public domain")],
    "proprietary": [("all rights reserved", "all rights reserved"), ("unauthorized (?:copying|use|distribution) (?:is|of)", "unauthorized")],
}
LICENCE, GRANT = r"licen[sc]e", r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?"


def make_rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, pattern, gate), 1 being the highest: an identifier, a grant with version, a grant, a name."""
    out = []

    def add(label: str, name: str, keyword: str, versions: list[str]) -> None:
        name = f"(?:{name})"
        for v in versions:
            number = v.replace(".", " ?").replace(" ?0", "(?: ?0)?")
            sure = label + "-" + v
            identifier = f"{label} {v}".replace("-", " ").replace(".", " ")
            out.append((1, sure, f"spdx {LICENCE} identifier {identifier}(?: only| or later)?", "spdx"))
            out.append((2, sure, f"{GRANT}{name}(?: {LICENCE})?(?: version| v)? ?{number}", "grant"))
            out.append((3, sure, f"{name} {LICENCE}(?: version| v)? ?{number}", "licen"))
            out.append((3, sure, f"{name} (?:version |v)?{number} {LICENCE}", "licen"))
        out.append((1, label, f"spdx {LICENCE} identifier {label.replace('-', ' ')}", "spdx"))
        out.append((4, label, f"{GRANT}{name}(?: {LICENCE})?", "grant"))
        out.append((5, label, f"{name} {LICENCE}", "licen"))

    for label, (name, _, versions) in FAMILIES.items():
        add(label, name, "licen", versions)
    for label, (short, full) in COMMONS.items():
        add(label, f"cc {short}|creative commons {full}", "licen", COMMONS_VERSIONS)
    for label, rows in SENTENCES.items():
        out += [(2, label, pattern, keyword) for pattern, keyword in rows]
    out += [(2, label, pattern, keyword) for label, keyword, pattern in SIGNATURES]
    return sorted(out, key=lambda r: r[0])


#: How sure a detection of a priority is.
SURE = {1: 1.0, 2: 0.95, 3: 0.85, 4: 0.75, 5: 0.6}


#: Gates that are no plain keyword: (keywords of which a text must have one, pattern that then must occur).
GATES = {"grant": (["licens", "licenc", "released", "distributed", "available", "published", "provided"], GRANT), "licen": (["licens", "licenc"], LICENCE)}


@lru_cache(1)
def _compiled():
    """Rules by gate, as [(numbers of the keywords of which one must occur, gate pattern, [(priority, label, pattern)])], and the automaton of all keywords."""
    gates: dict[str, list] = {}
    for p, label, pattern, gate in make_rules():
        gates.setdefault(gate, []).append((p, label, re.compile(rf"(?<!\S)(?:{pattern})(?!\S)")))
    keywords: dict[str, int] = {}
    out = []
    for gate, rules in gates.items():
        # a keyword of several words may be broken by punctuation in the raw text, so its longest word stands for it there
        mine = GATES[gate][0] if gate in GATES else [max(gate.split(), key=len)]
        out.append(({keywords.setdefault(k, len(keywords)) for k in mine}, re.compile(GATES[gate][1] if gate in GATES else re.escape(gate)), rules))
    automaton = ahocorasick.Automaton()
    for k, number in keywords.items():
        automaton.add_word(k, number)
    automaton.make_automaton()
    return out, automaton


class _Reach:
    """The farthest end among intervals by their start, as a binary indexed tree of running maxima."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.far = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start) + 1
        while i < len(self.far):
            self.far[i] = max(self.far[i], end)
            i += i & -i

    def upto(self, start: int) -> int:
        """The farthest end of those that begin at ``start`` or before."""
        i, out = bisect_right(self.starts, start), -1
        while i:
            out = max(out, self.far[i])
            i -= i & -i
        return out


def resolve(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Detections (priority, start, end, label) that are kept: none lies within one that comes before it."""
    kept: list[tuple[int, int, int, str]] = []
    reach = _Reach([d[1] for d in found])
    for d in sorted(set(found), key=lambda d: (d[0], d[1] - d[2], d[1], d[3])):
        if reach.upto(d[1]) < d[2]:
            kept.append(d)
            reach.add(d[1], d[2])
    return sorted(kept, key=lambda d: d[1:])


def detect(joined: str, gates, seen: set[int] | None = None) -> list[tuple[int, int, int, str]]:
    """Detections in words joined by one space, as character ranges; seen: numbers of the keywords that the text holds (None: try all)."""
    return resolve([(p, m.start(), m.end(), label) for keywords, gate, rules in gates if (seen is None or not seen.isdisjoint(keywords)) and gate.search(joined) for p, label, pattern in rules for m in pattern.finditer(joined)])


WORD = np.zeros(256, bool)
WORD[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True
OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first_word:long,n_words:long,priority:int>>"


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words; places of the BASE phrases (n_base) and the first word of the first and last of them (else null); their
    labels and all labels (distinct, sorted, joined by commas; empty without any); score (the surest detection, 0 without any); detections.

    Null and empty texts have no words. Repeated rows are scanned alike. An empty table gives an empty result. Input columns
    with the names of results are replaced.
    """
    names = [c.split()[0] for c in OUT.split(", ")]
    rest = [c for c in docs.columns if c not in names]
    held = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.struct(*[f"`{c}`" for c in rest]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gates, automaton = _compiled()
        base = [(re.compile(rf"(?<!\S){p}(?!\S)"), label) for p, label in BASE.items()]
        for batch, data, starts in bl.blocks(batches):
            low = LOWER[data]
            begin, end, doc, _ = words(low, starts, keep=WORD)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            raw = low.tobytes()
            hits = np.array(list(automaton.iter(raw.decode("latin-1"))), np.int64).reshape(-1, 2)
            seen: dict[int, set[int]] = {}
            for i, k in np.unique(np.column_stack([np.searchsorted(starts, hits[:, 0], "right") - 1, hits[:, 1]]), axis=0).tolist():
                seen.setdefault(i, set()).add(k)
            out: dict[str, list] = {n: [] for n in names[1:]}
            for i in range(batch.num_rows):
                n_base, low_word, high_word, base_labels, labels, score, found = 0, None, None, set(), set(), 0.0, []
                if i in seen:
                    parts = [raw[a:b] for a, b in zip(begin[first[i]:first[i + 1]].tolist(), end[first[i]:first[i + 1]].tolist(), strict=True)]
                    joined = b" ".join(parts).decode("utf-8", "replace")
                    spaces = [m.start() for m in re.finditer(" ", joined)]
                    places = sorted((m.start(), label) for pattern, label in base for m in pattern.finditer(joined))
                    n_base, base_labels = len(places), {label for _, label in places}
                    if places:
                        low_word, high_word = (bisect_left(spaces, places[k][0]) for k in (0, -1))
                    found = [{"label": label, "first_word": bisect_left(spaces, a), "n_words": bisect_left(spaces, b) - bisect_left(spaces, a) + 1, "priority": p} for p, a, b, label in detect(joined, gates, seen[i])]
                    labels = base_labels | {f["label"] for f in found}
                    score = max([SURE[f["priority"]] for f in found] + [SURE[5]] * bool(places), default=0.0)
                for name, value in zip(names[1:], (n_base, low_word, high_word, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, found), strict=True):
                    out[name].append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
                     pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("priority", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(first)), *(pa.array(out[n], k) for n, k in zip(names[1:], kinds, strict=True))], names=["row", *names])

    return held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, {OUT}").select("row.*", *names)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    bl.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).drop("text", "detections")
