"""Line-first cleaning: rules judge each line, failing lines go, then documents that lost too much text are rejected.

Defined cases: a null text counts as empty; a document without words has no lines to judge, all counts are 0 and it
fails the base rule; lines without words are neither judged nor counted, but stay in the cleaned text; equal rows give
equal results; an empty table gives an empty table. The id (any type, null included) is passed through, other columns
are not read. A text of any length is judged whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.common import WORD, column, pieces, texts, together

SYMBOLS = re.compile(r"[#*$%&|<>]")
SHOUTS = re.compile(r"[!?]{2,}")
#: What ends a sentence, and what may close after it.
ENDS, CLOSES = ".!?…:;", "\"'”’»)]"
#: Words that separate the entries of a menu or a table row.
SEPARATORS = frozenset("| > » • · / :: ← → ›".split())
#: Lower-case phrases of lines that are not part of a text.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "subscribe to our", "sign up for", "click here", "share this", "powered by", "skip to content",
)


def ends_sentence(word: str) -> bool:
    bare = word.rstrip(CLOSES)
    return bool(bare) and bare[-1] in ENDS


@dataclass(frozen=True)
class LineRules:
    """Limits in percent of a line's words, of words for short lines, and of a document's characters in words."""

    separators: int = 20
    symbols: int = 30
    shouts: int = 30
    menu_words: int = 3
    boilerplate_words: int = 30
    lost: int = 40
    least_words: int = 50
    repeats: int = 50

    def keeps(self, line: str, words: list[str], n_symbols: int) -> bool:
        """Whether a line with words passes the punctuation, navigation and boilerplate rules."""
        n = len(words)
        if not any(map(ends_sentence, reversed(words))):  # nearly always the last word does
            return False
        if n <= self.menu_words and not ends_sentence(words[-1]):
            return False
        if n_symbols * 100 > self.symbols * n or sum(map(SEPARATORS.__contains__, words)) * 100 > self.separators * n:
            return False
        if len(SHOUTS.findall(line)) * 100 > self.shouts * n:
            return False
        if n <= self.boilerplate_words:
            low = line.lower()
            return not any(phrase in low for phrase in BOILERPLATE)
        return True

    def judge(self, text: str) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, the cleaned text."""
        words: list[str] = []
        kept_lines: list[str] = []
        seen: set[str] = set()
        symbols = duplicates = chars = kept_chars = 0
        for line in text.split("\n"):
            own = WORD.findall(line)
            if not own:
                kept_lines.append(line)
                continue
            if line in seen:
                duplicates += 1
            seen.add(line)
            n_symbols, n_chars = len(SYMBOLS.findall(line)), sum(map(len, own))
            symbols += n_symbols
            chars += n_chars
            words += own
            if self.keeps(line, own, n_symbols):
                kept_chars += n_chars
                kept_lines.append(line)
        repeated = repeat_words(words)
        failed = len(words) < self.least_words or 100 * repeated > self.repeats * len(words)
        kept = not failed and (chars - kept_chars) * 100 <= self.lost * chars
        return len(words), chars, symbols, duplicates, repeated, failed, kept, "\n".join(kept_lines)


def repeat_words(words: list[str]) -> int:
    """Words in 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def clean_lines(df: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of df: id, the counts, base_failed, kept, text without the failing lines, and the columns to carry."""
    one = df.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"), together(list(carry)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "text"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = zip(*map(rules.judge, texts(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rest"), *(pa.array(x, k) for x, k in zip(found, kinds))], ["id", "rest", *names])

    schema = one.select("id", "rest").schema
    for name in names[:5]:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("text", "string")
    out = one.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *names, *(F.col("rest").getField(c).alias(c) for c in carry))


def judged(df: DataFrame) -> DataFrame:
    """The columns of op3."""
    return clean_lines(df).drop("text")


_PHRASES = " OR ".join(f"contains(lower(x.line), '{p}')" for p in BOILERPLATE)
_SEPARATORS = ", ".join(f"'{s}'" for s in sorted(SEPARATORS))

#: DuckDB SQL for ``judged`` over the table documents.
ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, i, line, w, len(w) AS n, list_sum(list_transform(w, lambda a: length(a))) AS chars,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols
  FROM (SELECT r, i, parts[i] AS line, regexp_extract_all(parts[i], '[^ 	-
]+') AS w
        FROM (SELECT r, string_split(text, chr(10)) AS parts FROM docs), unnest(range(1, len(parts) + 1)) AS u(i))
  WHERE len(w) > 0),
line_verdicts AS (
  SELECT r, line, n, chars, symbols, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS repeated,
    (len(list_filter(w, lambda a: regexp_matches(a, '[.!?…:;]["''”’»)\]]*$'))) > 0
     AND NOT (n <= 3 AND NOT regexp_matches(w[len(w)], '[.!?…:;]["''”’»)\]]*$'))
     AND symbols * 100 <= 30 * n
     AND len(list_filter(w, lambda a: a IN ({_SEPARATORS}))) * 100 <= 20 * n
     AND len(regexp_extract_all(line, '[!?]{{2,}}')) * 100 <= 30 * n
     AND NOT (n <= 30 AND ({_PHRASES}))) AS good
  FROM lines x),
by_doc AS (
  SELECT r, sum(n) AS n_words, sum(chars) AS word_chars, sum(symbols) AS n_symbols, count(*) FILTER (repeated) AS n_dup_lines,
         coalesce(sum(chars) FILTER (good), 0) AS kept_chars
  FROM line_verdicts GROUP BY r),
windows AS (
  SELECT r, p, concat_ws(' ', w[p], w[p + 1], w[p + 2]) AS k
  FROM (SELECT r, regexp_extract_all(text, '[^ 	-
]+') AS w FROM docs), unnest(range(1, len(w) - 1)) AS u(p)),
repeats AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT r, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT r, p AS q FROM repeats UNION ALL SELECT r, p + 1 FROM repeats UNION ALL SELECT r, p + 2 FROM repeats) GROUP BY r),
counts AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         coalesce(n_symbols, 0)::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
  FROM docs LEFT JOIN by_doc USING (r) LEFT JOIN covered USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (word_chars - kept_chars) * 100 <= 40 * word_chars AS kept
FROM failed"""
