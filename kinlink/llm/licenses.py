"""License scan of whole texts.

Two Aho-Corasick automata run over every text: one over its words, for notice phrases, and one over its lower-cased bytes, for
identifier tags. What follows a tag on its line is read as a license expression, up to the first word that cannot continue one:
a shunting-yard pass puts and / or / with into postfix order and an evaluation gives the obligation of the whole. An identifier
belongs to a family if it is its name, or its name and then a version (a digit, or v and a digit) or a further part after a dash,
dot or plus.

Defined cases: a null or empty text has no words, no places and score 0; phrases that overlap each count; a malformed
expression gives the labels of its known identifiers but no obligation; a text of any length is scanned whole; repeated rows
give repeated results; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches_of, small_batches, table, words

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases of well-known licenses, as words.
NOTICE_PHRASES = {
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons zero": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
# Tags that a license expression follows, in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:", "license identifier:")
# Families of license identifiers by name, longest first, with the obligation each carries: 0 none, 1 notice, 2 share changes
# to the files, 3 share the whole work, 4 no grant for every use.
FAMILIES = (
    ("public-domain", "public-domain", 0),
    ("cc-by-nc", "cc-by-nc", 4),
    ("cc-by-nd", "cc-by-nd", 4),
    ("cc-by-sa", "cc-by-sa", 3),
    ("unlicense", "unlicense", 0),
    ("apache", "apache", 1),
    ("cc-by", "cc-by", 1),
    ("agpl", "agpl", 3),
    ("lgpl", "lgpl", 2),
    ("0bsd", "0bsd", 0),
    ("zlib", "zlib", 1),
    ("gpl", "gpl", 3),
    ("mit", "mit", 1),
    ("bsd", "bsd", 1),
    ("isc", "isc", 1),
    ("bsl", "bsl", 1),
    ("mpl", "mpl", 2),
    ("epl", "epl", 2),
    ("cc0", "cc0", 0),
)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9.+-]+")
_LINE = re.compile(rb"[^\r\n]*")
#: What may follow a family's name in an identifier.
_FURTHER = re.compile(r"$|v?\d|[-.+]")


def family(identifier: str) -> tuple[str, int] | None:
    """The label and obligation of an identifier's family."""
    return next(((label, level) for name, label, level in FAMILIES if identifier.startswith(name) and _FURTHER.match(identifier, len(name))), None)


def leading(line: str) -> str:
    """The tokens at the start of a line that can be an expression: operands and operators in turn, brackets where they fit. A dot
    at a token's end ends it."""
    out: list[str] = []
    operand, depth, at = True, 0, 0  # whether an operand has to come next
    for found in _TOKEN.finditer(line):
        token = found[0]
        if line[at : found.start()].strip():  # something else stands between
            break
        at = found.end()
        plain = token.rstrip(".") if token not in "()" else token
        if not plain:
            break
        if operand:
            if plain == ")" or plain in _PRECEDENCE:
                break
            depth += plain == "("
            operand = plain == "("
        elif plain == ")":
            if not depth:
                break
            depth -= 1
        elif plain in _PRECEDENCE:
            operand = True
        else:
            break
        out.append(plain)
        if plain != token:
            break
    return " ".join(out)


def postfix(expression: str) -> list[str] | None:
    """Tokens in postfix order by the shunting-yard algorithm, or None if the expression is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether an operand has to come next
    for token in _TOKEN.findall(expression):
        if token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token in _PRECEDENCE:
            if operand:
                return None
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(tokens: list[str]) -> int | None:
    """Obligation of an expression: `and` binds to both sides, `or` leaves the lighter, `with` an exception lifts one level of
    a share-alike license. None if an identifier is unknown on every way to satisfy the expression."""
    unknown = 9
    stack: list[int] = []
    for i, token in enumerate(tokens):
        if token in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(min(left, right) if token == "or" else max(left, right) if token == "and" else left - (2 <= left <= 3))
        else:
            exception = i + 1 < len(tokens) and tokens[i + 1] == "with"
            known = family(token)
            stack.append(0 if exception else known[1] if known else unknown)
    return stack[0] if stack[0] != unknown else None


@cache
def _phrases():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in (BASE_PHRASES | NOTICE_PHRASES).items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE_PHRASES))
    found.make_automaton()
    return found


@cache
def _tags():
    import ahocorasick

    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, tag)
    found.make_automaton()
    return found


def expressions(text: bytes) -> list[str]:
    """The expressions that follow the tags of a text, in lower case."""
    low = text.lower()
    if b"license" not in low:
        return []
    out = []
    for end, _ in _tags().iter(low.decode("latin-1")):
        if run := leading(_LINE.match(low, end + 1)[0].decode("utf-8", "replace")):
            out.append(run)
    return out


def scan(text: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, expressions, obligation, score) of a text."""
    found = words(text)
    base: set[str] = set()
    labels: set[str] = set()
    n_base = places = 0
    first = last = None
    if found:
        line = " " + b" ".join(found).decode("latin-1") + " "
        at = word = 0  # the word that starts after the blank at `at`
        for start, label, is_base in sorted((end - size + 1, label, is_base) for end, (size, label, is_base) in _phrases().iter(line)):
            word += line.count(" ", at, start)
            at = start
            labels.add(label)
            places += 1
            if is_base:
                base.add(label)
                n_base += 1
                first = word if first is None else min(first, word)
                last = word if last is None else max(last, word)
    runs = expressions(text)
    levels: list[int] = []
    for run in runs:
        order = postfix(run)
        if order is not None and (level := evaluate(order)) is not None:
            levels.append(level)
        labels.update(known[0] for token in _TOKEN.findall(run) if (known := family(token)))
    score = 1.0 if levels else 1.0 - 0.5 ** min(places, 50)
    return len(found), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), runs, max(levels, default=None), score


_DDL = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "expressions array<string>, obligation int, score double"
)
_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("expressions", pa.list_(pa.string())), ("obligation", pa.int32()), ("score", pa.float64())]
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): counts and places of the base phrases, labels of phrases and expressions, the
    expressions read after tags, the heaviest obligation among them (null if none could be evaluated) and a score: 1 with an
    evaluated expression, else 1 - 2^-n for n notices."""
    small_batches(docs.sparkSession)

    def run(batches):
        rows = (
            (doc, *scan(text.as_buffer().to_pybytes() if text.is_valid else b""))
            for batch in batches
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True)
        )
        return batches_of(rows, _SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, _DDL)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
