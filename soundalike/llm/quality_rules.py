"""Line-first cleaning: rules per line, failing lines removed, documents that lose too much rejected.

A line fails on

* punctuation: no sentence ends in it, or its symbols or shouted marks are many for its words;
* navigation: separators between few words;
* boilerplate: a short line with a phrase of legal, cookie, script or account notices.

Lines without words are left where they are.  A document is rejected when it fails the base counts (fewer than
50 words, or more than half of its words in repeated three-word windows), or when the lines that failed hold
more than ``MOST_LOST_PERCENT`` of the code points of its words.

Defined results: a null text has no words and is rejected for being short; the cleaned text of a null is empty.
Repeated rows are judged each; very long texts are read whole in bounded blocks; an empty table gives no rows;
extra columns are carried along unless they have the name of an output column, which the output then takes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from soundalike.llm.common import bounded, need, query, table
from soundalike.llm.kernels import full_windows, text_blocks, word_hashes

MOST_LOST_PERCENT = 50
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50
BOILERPLATE_WORDS = 40

SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›•·]"
SHOUTED = r"[!?]{2,}"
#: Ends of sentences in Latin, Greek, Indic, Arabic, Ethiopic, Armenian, Khmer, Burmese and CJK texts.
SENTENCE_END = r"""[.!?…:;।॥؟۔؛።፧։។៕၊။。！？；：｡]["'”»)\]」』】）]*([\x20\x09-\x0D]|$)"""
BOILERPLATE = ("all rights reserved|privacy policy|terms of (use|service)|use of cookies|uses cookies"
               "|accept cookies|cookie settings|enable javascript|javascript is disabled|sign in to"
               "|log in to|subscribe to our|newsletter|copyright [0-9]{4}|licensed under|released under the"
               "|lorem ipsum|click here|share (this|on)|powered by|back to top")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS, _SEPARATORS, _SHOUTED = map(re.compile, (SYMBOLS, SEPARATORS, SHOUTED))
_END = re.compile(SENTENCE_END)
_BOILERPLATE = re.compile(BOILERPLATE, re.IGNORECASE | re.ASCII)
_GAPS = str.maketrans("", "", " \t\x0b\x0c\r")

RESULT = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, n_lines bigint, n_punctuation bigint, n_navigation bigint, "
          "n_boilerplate bigint, lost_chars bigint, clean_text string")
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def line_fault(line: str) -> str | None:
    """The first rule that a line with words fails."""
    words = len(_WORD.findall(line))
    if 2 * len(_SYMBOLS.findall(line)) >= words or 5 * len(_SHOUTED.findall(line)) >= words or not _END.search(line):
        fault = "punctuation"
    else:
        fault = None
    separators = len(_SEPARATORS.findall(line))
    if separators >= 2 and 5 * separators >= words:
        return "navigation"
    if words <= BOILERPLATE_WORDS and _BOILERPLATE.search(line):
        return "boilerplate"
    return fault


def clean(text: str) -> tuple[int, int, int, dict[str, int], int, str]:
    """Code points of words, lines with words, repeated lines, faults by rule, code points lost, clean text."""
    seen: set[str] = set()
    total = lines = repeated = lost = 0
    faults = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    left = []
    for line in text.split("\n"):
        chars = len(line.translate(_GAPS))
        if not chars:
            left.append(line)
            continue
        total += chars
        lines += 1
        if line in seen:
            repeated += 1
        else:
            seen.add(line)
        fault = line_fault(line)
        if fault:
            faults[fault] += 1
            lost += chars
        else:
            left.append(line)
    return total, lines, repeated, faults, lost, "\n".join(left)


def repeated_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: words that lie in three-word windows found twice or more in it."""
    window, first, text = full_windows(hashes, counts, 3)
    order = np.lexsort((window, text))
    same = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[first[again] + j] = True
    total = np.concatenate(([0], np.cumsum(covered)))
    return np.diff(total[np.cumsum(counts)], prepend=0)


def _judge(texts: list[str]) -> list[tuple]:
    hashes, counts = word_hashes(texts)
    rows = []
    for text, n, repeats in zip(texts, counts.tolist(), repeated_words(hashes, counts).tolist()):
        chars, lines, dup, faults, lost, left = clean(text)
        failed = n < FEWEST_WORDS or 100 * repeats > MOST_REPEATED_PERCENT * n
        rows.append((n, chars, len(_SYMBOLS.findall(text)), dup, repeats, failed,
                     not failed and 100 * lost <= MOST_LOST_PERCENT * chars, lines, faults["punctuation"],
                     faults["navigation"], faults["boilerplate"], lost, left))
    return rows


def apply_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base counts, line counts, the verdict ``kept`` and the cleaned text; nothing is shuffled."""
    need(docs, text_col)
    taken = [n for n in NAMES if n != text_col]
    base = docs.drop(*taken)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema]
    schema = ", ".join(kinds) + ", " + RESULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        for batch in batches:
            for part, texts in text_blocks(batch, text_col):
                columns = zip(*_judge([t or "" for t in texts]))
                made = [pa.array(c, kind[x.split()[1]]) for c, x in zip(columns, RESULT.split(", "))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *NAMES])
    return base.transform(bounded).mapInArrow(run, schema)


def _sql_count(pattern: str, column: str = "line") -> str:
    quoted = pattern.replace("'", "''")
    return f"len(regexp_extract_all({column}, '{quoted}'))"


_END_SQL = SENTENCE_END.replace("'", "''")


@query("op2_quality_rules", rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
v AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM v),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k)
      WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
m AS (SELECT doc_id, line, pos, {_sql_count(r'[^\x20\x09-\x0D]+')} AS n,
             length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
             {_sql_count(SYMBOLS)} AS symbols, {_sql_count(SEPARATORS)} AS separators, {_sql_count(SHOUTED)} AS marks,
             regexp_matches(line, '{_END_SQL}') AS ended, regexp_matches(line, '(?i){BOILERPLATE}') AS boiler FROM l),
f AS (SELECT doc_id, line, chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth,
             2 * symbols >= n OR 5 * marks >= n OR NOT ended OR (separators >= 2 AND 5 * separators >= n)
             OR (n <= {BOILERPLATE_WORDS} AND boiler) AS failed FROM m WHERE n > 0),
s AS (SELECT doc_id, sum(chars) AS word_chars, count(*) FILTER (WHERE nth > 1) AS n_dup_lines,
             coalesce(sum(chars) FILTER (WHERE failed), 0) AS lost FROM f GROUP BY doc_id),
a AS (SELECT w.doc_id, len(words) AS n_words, coalesce(word_chars, 0) AS word_chars,
             {_sql_count(SYMBOLS, 'text')} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_chars
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND 100 * lost_chars <= {MOST_LOST_PERCENT} * word_chars AS kept, lost_chars::BIGINT AS lost_chars
FROM a""")
def op2(spark, sf_dir):
    judged = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "lost_chars")
