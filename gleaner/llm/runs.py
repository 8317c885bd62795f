"""Periodic runs in texts by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``least`` words and three
periods long, that no neighbouring word extends. Every such run holds an aligned block of 2**k words, 2**k at most q
(or the smallest block, where q is less), together with the block's next occurrence q words on. So each aligned
block is looked up in the windows where a period of its scale would put it again: the block's suffix-array interval
comes from its dyadic name, and a wavelet tree over the suffix array gives the count, the first and the last
occurrence in the window by range successor. Starts of one block in a window no longer than itself are one or two places
or an arithmetic progression whose step is the block's own period; then the block and its occurrences lie in
two stretches of that small period, and a longer period can only bring start on start or end on end. That leaves at
most three candidate periods a block, n / 2 in all. Each is confirmed by longest common extensions to both sides, and of
equal stretches the smallest period counts.

Documents are worked through in groups of about ``group_chars`` characters inside Spark tasks; nothing is shuffled.
Memory: a group, or the longest document, times the doublings up to its longest repeat.

Null, empty or blank text: no words, no runs. Null ids and repeated rows: rows like others. Empty table: no rows.
Columns other than id and text are ignored. Ties between runs of equal exponent: smallest start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_groups
from .suffix import SuffixArray, Tokens, WaveletTree

SMALLEST = 3  # blocks of 2**3 words and more


def candidates(sa: SuffixArray, tree: WaveletTree, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods among which those of all runs are. ``ends``: for every place, that of its text's
    separator; ``longest``: most words of a text."""
    n, found = len(sa.rows), []
    for k in range(SMALLEST, len(sa.names)):
        if 3 << k > longest and k > SMALLEST:
            break
        x = np.arange(0, n, 1 << k)
        x = x[x + (1 << k) <= ends[x]]
        low, high = sa.interval(x, k)
        again = high - low > 1
        x, low, high = x[again], low[again], high[again]
        for near, far in [(1, 1 << k), (1 << k, 2 << k)] if k == SMALLEST else [(1 << k, 2 << k)]:
            before = tree.count_below(low, high, np.minimum(x + near, n - 1))
            count = tree.count_below(low, high, np.minimum(x + far, n - 1)) - before
            some = count > 0
            b, lo, hi, c, skip = x[some], low[some], high[some], count[some], before[some]
            first = tree.smallest(lo, hi, skip)
            found.append((b, first - b))
            two = c == 2
            found.append((b[two], tree.smallest(lo[two], hi[two], skip[two] + 1) - b[two]))
            many = c > 2
            b, y = b[many], first[many]
            step = tree.smallest(lo[many], hi[many], skip[many] + 1) - y
            found.append((b, (y - sa.common_before(y, y + step)) - (b - sa.common_before(b, b + step))))
            found.append((b, (y + sa.common(y, y + step)) - (b + sa.common(b, b + step))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, period = (np.concatenate(c) for c in zip(*found, strict=True))
    good = (period > 0) & (place + period < ends[place])
    return place[good], period[good]


def runs_of(tokens: Tokens, least: int) -> np.ndarray:
    """Rows (first place, place after the last, period) of all runs, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    longest = int(tokens.size.max(initial=0))
    if longest < least:
        return none
    sa = SuffixArray(tokens.symbol)
    if len(sa.names) <= SMALLEST:
        return none
    ends = (tokens.start + tokens.size)[tokens.text_of]
    place, period = candidates(sa, WaveletTree(sa.rows), ends, longest)
    start = place - sa.common_before(place, place + period)
    end = place + period + sa.common(place, place + period)
    keep = end - start >= np.maximum(least, 3 * period)
    found = np.stack([start, end, period], axis=1)[keep]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):  # of equal stretches the smallest period
        found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _best(runs: list) -> tuple | None:
    best = None
    for start, length, period in runs:  # by start, then period: the earlier one stays on a tie
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                                                          ("period", pa.int64())]))),
    ("best", pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
    ("collapsed", pa.string())])


def _collapse(tokens: Tokens, runs: np.ndarray) -> pa.Array:
    """Each text's words joined by one space, without those that a run holds after its first period."""
    n = len(tokens.word)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = (np.cumsum(change)[:n] == 0) & (tokens.word >= 0)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(tokens.text_of[kept], minlength=len(tokens.size)))])
    words = tokens.words.take(pa.array(tokens.word[kept]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


def _in_texts(texts: pa.Array, least: int) -> tuple[list, list, pa.Array]:
    tokens = Tokens(texts)
    found = runs_of(tokens, least)
    owner = tokens.text_of[found[:, 0]]
    rows = np.stack([found[:, 0] - tokens.start[owner], found[:, 1] - found[:, 0], found[:, 2]], axis=1).tolist()
    of_text: list = [[] for _ in range(len(texts))]
    for o, r in zip(owner.tolist(), rows, strict=True):
        of_text[o].append(r)
    return of_text, [_best(r) for r in of_text], _collapse(tokens, found)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24,
              group_chars: int = 1 << 20) -> DataFrame:
    """One row per document: ``doc_id``, ``runs`` (all, by start, then period: start, length, period in words), ``best``
    (the run of greatest length/period; null without a run) and ``collapsed`` (the words that no run repeats)."""
    if least < 3 * (1 << SMALLEST):
        raise ValueError(f"least must be at least {3 * (1 << SMALLEST)}")
    name = {"start": 0, "length": 1, "period": 2}

    def work(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            for s, e in text_groups([range(z) for z in sizes], group_chars):
                of_text, best, collapsed = _in_texts(texts.slice(s, e - s), least)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(s, e - s),
                    pa.array([[{k: r[i] for k, i in name.items()} for r in x] for x in of_text], SCHEMA.field(1).type),
                    pa.array([x and {k: x[i] for k, i in name.items()} for x in best], SCHEMA.field(2).type),
                    collapsed], schema=SCHEMA)

    run = "struct<start: bigint, length: bigint, period: bigint>"
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(work, f"doc_id bigint, runs array<{run}>, best {run}, collapsed string"))


def words_of(text: Column) -> Column:
    """Words of a text as an array, as the operators here take them."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def repeat_from(words: Column, start: Column, period: Column) -> Column:
    """The words up to ``start``, then the ``period`` words from there, over and over, to the same length."""
    n = F.size(words)
    start, period, rest = start.cast("int"), period.cast("int"), (n - start).cast("int")
    unit = F.slice(words, start + 1, period)
    times = F.ceil(rest / F.greatest(period, F.lit(1))).cast("int")
    return F.concat(F.slice(words, F.lit(1), start), F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), rest))
