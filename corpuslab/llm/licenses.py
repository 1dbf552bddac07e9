"""Licence scan: Aho-Corasick finds notices and tags, a shunting-yard parser reads expressions.

A text is lowered in ASCII and reduced to its words with one space around each. One automaton run
over this string finds notice phrases (also those broken over lines or by punctuation) and
identifier tags. After a tag the original text is read as a licence expression: identifiers, ``and``,
``or``, ``with``, ``+`` and parentheses. The expression is put into postfix order by the
shunting-yard method and evaluated to the labels it names and to the least freedom that it grants.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases with their labels. The first three are the base.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "permission is hereby granted free of charge": "mit",
    "creative commons": "cc",
    "licensed under cc by": "cc-by",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc by nc sa": "cc-by-nc-sa",
    "licensed under cc by nc nd": "cc-by-nc-nd",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier", "license expression")
# Family of an identifier by its start, and how freely it may be used (0 to 1).
FAMILIES = {
    "agpl": 0.1, "apache": 1.0, "artistic": 0.8, "bsd": 1.0, "bsl": 1.0, "cc0": 1.0, "cc-by-nc": 0.3,
    "cc-by-nd": 0.3, "cc-by-sa": 0.5, "cc-by": 0.9, "epl": 0.5, "gpl": 0.2, "isc": 1.0, "lgpl": 0.4,
    "mit": 1.0, "mpl": 0.5, "unlicense": 1.0, "zlib": 1.0,
}
# Further identifiers that have no version number.
UNVERSIONED = {
    "0bsd", "beerware", "curl", "fsfap", "gfdl", "hpnd", "icu", "ijg", "intel", "json", "libpng", "ncsa", "ntp",
    "openssl", "postgresql", "qhull", "ruby", "sleepycat", "vim", "w3c", "wtfpl", "x11",
}
# Other identifiers: words with a version number, references of the user, and exceptions.
IDENTIFIER = regex.compile(
    r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*-[0-9]+(?:\.[0-9]+)*(?:-[a-z0-9.]+)*\+?|licenseref-[a-z0-9.\-]+"
    r"|[a-z0-9.\-]+-exception(?:-[0-9.]+)?"
)
TABLE = bytes(
    b if b in range(0x30, 0x3A) or b in range(0x61, 0x7B) or b >= 0x80
    else b + 32 if b in range(0x41, 0x5B) else 32
    for b in range(256)
)
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SYMBOL = regex.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.\-]*\+?))")
AFTER_TAG = regex.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")
BINDS = {"or": 1, "and": 2, "with": 3}


def is_identifier(name: str) -> bool:
    """Whether a lower-case word can name a licence or an exception; prose cannot."""
    plain = name.rstrip("+")
    return plain in UNVERSIONED or family(name) in FAMILIES or IDENTIFIER.fullmatch(name) is not None


class BadExpression(ValueError):
    pass


def postfix(symbols: list[str]) -> list[str]:
    """Shunting yard: operands in order, each operator after its operands."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for s in symbols:
        if s == "(":
            if not operand_next:
                raise BadExpression("two operands side by side")
            waiting.append(s)
        elif s == ")":
            if operand_next:
                raise BadExpression("an operand is missing")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise BadExpression("a parenthesis is not opened")
            waiting.pop()
        elif s in BINDS:
            if operand_next:
                raise BadExpression("an operand is missing")
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[s]:
                out.append(waiting.pop())
            waiting.append(s)
            operand_next = True
        else:
            if not operand_next:
                raise BadExpression("two operands side by side")
            out.append(s)
            operand_next = False
    if operand_next:
        raise BadExpression("an operand is missing")
    while waiting:
        s = waiting.pop()
        if s == "(":
            raise BadExpression("a parenthesis is not closed")
        out.append(s)
    return out


def family(identifier: str) -> str:
    """The longest known start of an identifier, or the identifier itself."""
    name = identifier.rstrip("+")
    known = [f for f in FAMILIES if name == f or name.startswith(f + "-")]
    return max(known, key=len) if known else name


def evaluate(symbols: list[str]) -> tuple[set[str], float]:
    """Labels of an expression, and how freely its terms can be used.

    With ``or`` the freer side is chosen, with ``and`` the stricter one binds, and an exception
    after ``with`` lifts half of a licence's restrictions. An unknown licence counts as 0.5.
    """
    stack: list[tuple[set[str], float, str]] = []
    for s in postfix(symbols):
        if s not in BINDS:
            name = family(s)
            stack.append(({name}, FAMILIES.get(name, 0.5), s))
            continue
        right, left = stack.pop(), stack.pop()
        if s == "with":
            stack.append((left[0], (1 + left[1]) / 2, ""))
        else:
            choose = max if s == "or" else min
            stack.append((left[0] | right[0], choose(left[1], right[1]), ""))
    return stack[0][0], stack[0][1]


def symbols_at(text: str, at: int) -> list[str]:
    """Longest run of expression symbols from ``at`` that is well formed.

    Stops at the end of the line or at the first thing that cannot go on the expression, such as a
    word that names no licence.
    """
    found: list[str] = []
    best: list[str] = []
    depth = 0
    operand_next = True
    while m := SYMBOL.match(text, at):
        s = (m.group(1) or m.group(2)).lower()
        if s in BINDS or s == ")":
            if operand_next or s == ")" and not depth:
                break
            depth -= s == ")"
            operand_next = s != ")"
        else:
            if not operand_next or s != "(" and not is_identifier(s.rstrip(".-")):
                break
            depth += s == "("
            operand_next = s == "("
        found.append(s.rstrip(".-") if s not in "()" else s)
        at = m.end()
        if not operand_next and not depth:
            best = list(found)
    return best


@functools.lru_cache(maxsize=1)
def _automaton():
    automaton = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        automaton.add_word(f" {phrase} ", (phrase, label, "base"))
    for phrase, label in NOTICES.items():
        automaton.add_word(f" {phrase} ", (phrase, label, "notice"))
    for phrase in TAGS:
        automaton.add_word(f" {phrase} ", (phrase, "", "tag"))
    automaton.make_automaton()
    return automaton


def scan_text(text: str | None) -> dict:
    """Words, matches and expressions of one text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.translate(TABLE).split()
    line = f" {b' '.join(words).decode('utf-8')} "
    found = {
        "n_words": len(words), "places": [], "base": set(), "labels": set(), "notices": set(),
        "expressions": [], "freedom": None,
    }
    hits = list(_automaton().iter(line))
    if not hits:
        return found
    if len(hits) > 8:
        spaces = [i for i, c in enumerate(line) if c == " "]
        place = lambda start: bisect_right(spaces, start) - 1
    else:
        place = lambda start: line.count(" ", 0, start)
    tags: set[int] = set()
    for end, (phrase, label, kind) in hits:
        first = place(end - len(phrase) - 1)
        if kind == "base":
            found["places"].append(first)
            found["base"].add(label)
        elif kind == "notice":
            found["notices"].add(label)
        else:
            tags.add(first + phrase.count(" "))
    if tags:
        ends = {i: m.end() for i, m in enumerate(WORD.finditer(text)) if i in tags}
        for at in ends.values():
            # A tag without a colon or an equals sign is prose.
            after = AFTER_TAG.match(text, at)
            symbols = symbols_at(text, after.end()) if after else []
            if symbols:
                labels, freedom = evaluate(symbols)
                found["expressions"].append(" ".join(symbols))
                found["labels"] |= labels
                found["freedom"] = min(freedom, found["freedom"] or 1.0)
    found["labels"] |= found["base"] | found["notices"]
    return found


def confidence(found: dict) -> float:
    """How surely the text states a licence: 1 minus the odds that every sign is an accident."""
    doubt = 0.1 if found["expressions"] else 1.0
    doubt *= 0.4 ** len(found["base"]) * 0.6 ** len(found["notices"])
    return round(1.0 - doubt, 6)


COLUMNS = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
        ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
        ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()),
        ("freedom", pa.float64()),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in COLUMNS]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            f = scan_text(text)
            row = (
                doc_id, f["n_words"], len(f["places"]), min(f["places"], default=None),
                max(f["places"], default=None), ",".join(sorted(f["base"])),
                ",".join(sorted(f["labels"])), confidence(f), "; ".join(f["expressions"]) or None,
                f["freedom"],
            )
            for column, value in zip(columns, row):
                column.append(value)
        yield pa.record_batch(
            [pa.array(c, f.type) for c, f in zip(columns, COLUMNS)], schema=COLUMNS
        )


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, base matches, labels, score, expressions and their freedom.

    A null or empty text has no words, no labels and score 0. Words are counted from 0. Base matches
    are all places where the words of a base phrase stand in a row, whatever separates them; a
    malformed expression counts up to its longest well-formed start. Repeated and missing doc_ids
    are rows of their own, an empty table gives no rows, other columns are not looked at.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(
        _scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, expressions string, freedom double",
    )
