"""Repetition rules on suffix arrays: maximal repeated substrings of each text, the part that they cover, the longest.

A text is its sequence of words (separated by ASCII white space). The suffix array of a group of texts and the longest
common prefixes of neighbouring suffixes give the LCP intervals; an interval is a maximal repeat if the words
before its occurrences differ (to the right they do by construction). The spans of all occurrences are united. A
text fails if the covered part of its characters or its longest repeat is over its limit.

Documents are worked through in groups of about ``group_chars`` characters inside Spark tasks; nothing is shuffled.
Memory: a group, or the longest document, times the doublings up to its longest repeat.

Null, empty or blank text: no words, nothing covered, not kept (fewer than ``min_words``). Null ids and repeated
rows: rows like others. Empty table: no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_groups
from .suffix import SuffixArray, Tokens

WINDOW = 5  # words; the base rule counts words in windows that occur twice


@dataclass(frozen=True)
class Limits:
    """A repeat counts from ``repeat_words`` words on. Kept: at least ``min_words`` words, at most
    ``window_percent`` of them in repeated five-word windows, at most ``covered_percent`` of the word characters in
    repeats, and no repeat longer than ``longest_words``."""

    min_words: int = 10
    window_percent: int = 20
    repeat_words: int = 8
    covered_percent: int = 25
    longest_words: int = 30


def repeats_of(sa: SuffixArray, lcp: np.ndarray, symbols: np.ndarray) -> list:
    """(first row, last row, length) of every maximal repeat among the LCP intervals of positive length."""
    n = len(lcp)
    before = np.where(sa.rows > 0, symbols[sa.rows - 1], -1)
    # differing neighbours up to each row: an interval with none has the same word before all its occurrences
    turns = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    at = np.nonzero(lcp)[0]
    out: list = []
    if not len(at):
        return out
    for block in np.split(at, np.nonzero(np.diff(at) > 1)[0] + 1):
        stack: list = []
        values = lcp[block].tolist()
        for row, value in zip([*block.tolist(), int(block[-1]) + 1], [*values, 0], strict=True):
            low = row - 1
            while stack and stack[-1][1] > value:
                low, length = stack.pop()
                if turns[row - 1] > turns[low]:
                    out.append((low, row - 1, length))
            if value and (not stack or stack[-1][1] < value):
                stack.append((low, value))
    assert block[-1] < n
    return out


def _covered(places: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + lengths, -1)
    return np.cumsum(change)[:n] > 0


class Group:
    """Suffix array and repeats of a group of texts."""

    def __init__(self, texts: pa.Array, repeat_words: int):
        self.tokens = Tokens(texts)
        self.sa = SuffixArray(self.tokens.symbol)
        least = min(WINDOW, repeat_words)
        self.lcp = self.sa.neighbour_lcp(least)
        self.repeats = repeats_of(self.sa, np.where(self.lcp >= repeat_words, self.lcp, 0), self.tokens.symbol)

    def _spans(self, least: int) -> np.ndarray:
        """Places covered by repeats of ``least`` words or more: each suffix reaches as far as the longest prefix
        that it shares with a neighbouring row, which is what the intervals that hold it reach."""
        reach = np.maximum(self.lcp, np.append(self.lcp[1:], 0))
        long = reach >= least
        return _covered(self.sa.rows[long], reach[long], len(self.lcp))

    def figures(self, repeat_words: int) -> dict:
        t, n = self.tokens, len(self.tokens.size)
        chars = np.zeros(len(t.word), np.int64)
        chars[t.word >= 0] = pc.utf8_length(t.words).to_numpy(zero_copy_only=False)
        total = lambda mask, weight=None: np.bincount(t.text_of[mask], None if weight is None else weight[mask],
                                                      minlength=n).astype(np.int64)
        reach = np.maximum(self.lcp, np.append(self.lcp[1:], 0))
        windows = reach >= WINDOW
        in_window = _covered(self.sa.rows[windows], np.full(windows.sum(), WINDOW), len(self.lcp))
        spans = self._spans(repeat_words)
        longest = np.zeros(n, np.int64)
        count = np.zeros(n, np.int64)
        if self.repeats:
            low, _, length = np.array(self.repeats, np.int64).T
            owner = t.text_of[self.sa.rows[low]]
            np.maximum.at(longest, owner, length)
            count = np.bincount(owner, minlength=n)
        return {"n_words": t.size, "word_chars": total(t.word >= 0, chars), "n_repeat_words": total(in_window),
                "n_repeats": count, "longest_repeat": longest, "covered_words": total(spans),
                "covered_chars": total(spans, chars)}


def _groups(batch: pa.RecordBatch, group_chars: int) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
    return text_groups([range(z) for z in sizes], group_chars)


MEASURED = ["n_words", "word_chars", "n_repeat_words", "n_repeats", "longest_repeat", "covered_words", "covered_chars"]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_words: int = 8,
            group_chars: int = 1 << 20) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols`` (characters of ``#*$%&|<>``),
    ``n_dup_lines`` (lines with a word that equal an earlier line), ``n_repeat_words`` (words in five-word windows found
    twice or more), ``n_repeats`` (maximal repeats of at least ``repeat_words`` words), ``longest_repeat``,
    ``covered_words`` and ``covered_chars`` (by them)."""
    if repeat_words < 1:
        raise ValueError("repeat_words must be positive")
    schema = pa.schema([("doc_id", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
                        *[(c, pa.int64()) for c in MEASURED]])

    def work(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in _groups(b, group_chars):
                found = Group(b.column(1).slice(s, e - s), repeat_words).figures(repeat_words)
                yield pa.RecordBatch.from_arrays(
                    [b.column(i).slice(s, e - s) for i in (0, 2, 3)] + [pa.array(found[c], pa.int64()) for c in MEASURED],
                    schema=schema)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                       (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))
    return rows.mapInArrow(work, ", ".join(f"{f.name} bigint" for f in schema))


def base_failed(limits: Limits) -> Column:
    return ((F.col("n_words") < limits.min_words)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.window_percent))


def repetitive(limits: Limits) -> Column:
    """The method's own verdict: too much covered by repeats, or too long a repeat."""
    return ((F.col("covered_chars") * 100 > F.col("word_chars") * limits.covered_percent)
            | (F.col("longest_repeat") > limits.longest_words))


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """``measure`` plus ``base_failed`` and ``kept``."""
    found = measure(docs, id_col, text_col, limits.repeat_words)
    return found.withColumns({"base_failed": base_failed(limits), "kept": ~base_failed(limits) & ~repetitive(limits)})


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_words: int = 8,
                    group_chars: int = 1 << 20) -> DataFrame:
    """One row per maximal repeat of at least ``repeat_words`` words: ``doc_id``, ``start`` (word number of its first
    occurrence), ``length`` (words), ``occurrences``, ``phrase`` (its words joined by a space)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("occurrences", pa.int64()), ("phrase", pa.string())])

    def work(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in _groups(b, group_chars):
                group = Group(b.column(1).slice(s, e - s), repeat_words)
                t = group.tokens
                for at in range(0, len(group.repeats), 1000):
                    part = group.repeats[at:at + 1000]
                    first = np.array([group.sa.rows[lo:hi + 1].min() for lo, hi, _ in part], np.int64)
                    owner = t.text_of[first]
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).slice(s, e - s).take(pa.array(owner)), pa.array(first - t.start[owner]),
                        pa.array([n for *_, n in part], pa.int64()), pa.array([hi - lo + 1 for lo, hi, _ in part], pa.int64()),
                        pa.array([" ".join(t.words.slice(t.word[p], n).to_pylist())
                                  for p, (*_, n) in zip(first.tolist(), part, strict=True)], pa.string())], schema=schema)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(work, "doc_id bigint, start bigint, length bigint, occurrences bigint, phrase string"))
