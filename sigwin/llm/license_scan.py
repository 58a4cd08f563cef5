"""Operator 8: license scans with ordered signature rules.

Rules (``license_rules``) are regular expressions over a document's words (joined by one space), each
with a keyword that every match holds, a label and a priority.  One pass of a keyword
automaton over the text says which rules can match at all; only those run.  Overlapping
detections are resolved in rule order: a detection goes if another of at least its
priority contains its span (the longer, then the earlier rule, stays).

The base phrases are rules too; their places are all counted and their labels always
stay.  Defined results: null and empty texts have no words, no labels and score 0;
texts are read whole; repeated rows are scanned one by one; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame

from sigwin.llm.common import map_rows
from sigwin.llm.license_rules import written_rules

#: A word, in UTF-8 bytes: letters, digits and every byte of a non-ASCII character.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Fixed values of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    pattern: str
    keyword: str
    label: str
    priority: int
    strength: float


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order; the base phrases come first and have the lowest priority."""
    return tuple([Rule(p, p, label, 10, 0.6) for p, label in BASE] + [Rule(*x) for x in written_rules()])


@cache
def _compiled() -> tuple[ahocorasick.Automaton, list[tuple[re.Pattern, Rule]]]:
    by_keyword: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        by_keyword.setdefault(rule.keyword, []).append(i)
    automaton = ahocorasick.Automaton()
    for keyword, own in by_keyword.items():
        automaton.add_word(keyword, own)
    automaton.make_automaton()
    return automaton, [(re.compile(rf"(?<![^ ]){r.pattern}(?![^ ])"), r) for r in rules()]


def resolve(found: list[tuple[int, int, int]], priority: list[int]) -> list[tuple[int, int, int]]:
    """Detections ``(start, end, rule)`` that no other of at least their priority contains.

    They are taken by priority, then length, then rule; one that lies within a span
    already taken goes.  Taken spans are kept as running maxima of their ends by start,
    so each test is one search.
    """
    taken, starts, reach = [], [], []
    for start, end, rule in sorted(found, key=lambda d: (-priority[d[2]], d[0] - d[1], d[2], d[0])):
        i = bisect.bisect_right(starts, start)
        if i and reach[i - 1] >= end:
            continue
        taken.append((start, end, rule))
        # Spans with a later start and no longer reach can contain nothing that this one does not.
        j = i
        while j < len(starts) and reach[j] <= end:
            j += 1
        if i and starts[i - 1] == start:
            i -= 1
        starts[i:j], reach[i:j] = [start], [end]
    return sorted(taken)


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Number of words, all base places, and the detections that stay.

    A base place is (first word, label); a detection (first word, end word, label, strength).
    """
    words = WORD.findall((text or "").encode("utf-8").lower())
    joined = b" ".join(words).decode("utf-8")
    automaton, compiled = _compiled()
    fetched = {i for _, own in automaton.iter(joined) for i in own} if words else ()
    found = [(m.start(), m.end(), i) for i in sorted(fetched) for m in compiled[i][0].finditer(joined)]
    if not found:
        return len(words), [], []
    kept = resolve(found, [r.priority for _, r in compiled])
    base = [(start, compiled[i][1].label) for start, _, i in found if i < len(BASE)]
    word_at, at, count = {}, 0, 0
    for place in sorted({p for s, e, _ in kept for p in (s, e)} | {p for p, _ in base}):
        count += joined.count(" ", at, place)
        at = place
        word_at[place] = count
    detections = [(word_at[s], word_at[e] + 1, compiled[i][1].label, compiled[i][1].strength) for s, e, i in kept]
    return len(words), sorted((word_at[p], label) for p, label in base), detections


def confidence(detections: list[tuple[int, int, str, float]]) -> float:
    """One minus the product of the labels' misses, each label by its strongest detection."""
    strongest: dict[str, float] = {}
    for _, _, label, strength in detections:
        strongest[label] = max(strength, strongest.get(label, 0.0))
    miss = 1.0
    for label in sorted(strongest):
        miss *= 1 - strongest[label]
    return 1 - miss


def _report(doc_id: list, text: list) -> dict:
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    out: dict[str, list] = {k: [] for k in columns}
    for value in text:
        n, base, kept = scan(value)
        own = {label for _, label in base}
        row = (n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)),
               ",".join(sorted(own | {d[2] for d in kept})), confidence(kept))
        for k, x in zip(columns, row, strict=True):
            out[k].append(x)
    return {"doc_id": doc_id, **out}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_words long, n_base long, first_word long, "
                    "last_word long, base_labels string, labels string, score double", _report)
