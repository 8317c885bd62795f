"""Suffix arrays of many token sequences at once, in numpy: names of dyadic blocks, longest common extensions and a
wavelet tree over the suffix array.

The sequences stand one after another, each followed by a separator that equals no other symbol, so nothing that is
equal in two places reaches past the end of a sequence. All work is done on whole arrays; memory is a few numbers a
token for every doubling up to the longest repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Tokens:
    """Words (separated by ASCII white space) of a batch of texts, joined into one sequence of symbols.

    ``word``: for every place the number of the word in ``words``, -1 at a separator; ``symbol``: equal at two places
    if and only if they hold the same word of the same text; ``start``: first place of each text, ``size``: its number
    of words (the separator is at ``start + size``); ``text_of``: the text of every place."""

    def __init__(self, texts: pa.Array):
        lists = pc.fill_null(pc.ascii_split_whitespace(pc.fill_null(texts, "")), [])
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        filled = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        self.words, owner = flat.filter(pa.array(filled)), owner[filled].astype(np.int64)
        n = len(texts)
        self.size = np.bincount(owner, minlength=n).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)])[:n].astype(np.int64)
        total = int(self.size.sum()) + n
        self.text_of = np.repeat(np.arange(n), self.size + 1)
        self.word = np.full(total, -1, np.int64)
        places = np.arange(len(owner)) + owner
        self.word[places] = np.arange(len(owner))
        self.symbol = self.text_of * 0
        if len(owner):
            coded = pc.dictionary_encode(self.words)
            kinds = len(coded.dictionary) + 1
            self.symbol = self.text_of * kinds
            self.symbol[places] += coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1


class SuffixArray:
    """Suffix array by prefix doubling. ``names[j]`` holds, for every place, the first row of the suffix array whose
    suffix agrees with it in 2**j symbols: equal names mean equal blocks. Only places whose block occurs again are
    sorted further."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable").astype(np.int64)
        in_order = symbols[order]
        head = np.append(True, in_order[1:] != in_order[:-1])[:n]
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        name = np.empty(n, np.int32)
        name[order] = first
        self.rows, self.names = order, [name]
        alone = head & np.append(head[1:], True)[:n]
        open_rows = np.nonzero(~alone)[0]
        width = 1
        while len(open_rows):
            places = order[open_rows]
            # a repeated block holds no separator, so a place `width` further on exists
            key = name[places].astype(np.int64) * n + name[places + width]
            by = np.argsort(key, kind="stable")
            places, key = places[by], key[by]
            order[open_rows] = places
            head = np.append(True, key[1:] != key[:-1])
            first = open_rows[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
            name = name.copy()
            name[places] = first
            self.names.append(name)
            open_rows = open_rows[~(head & np.append(head[1:], True))]
            width *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on (``a`` and ``b`` differ)."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for j in range(len(self.names) - 1, -1, -1):
            step = (self.names[j][a] == self.names[j][b]).astype(np.int64) << j
            a += step
            b += step
        return a - start

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols that end just before ``a`` equal those that end just before ``b``."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for j in range(len(self.names) - 1, -1, -1):
            far_a, far_b = a - (1 << j), b - (1 << j)
            inside = (far_a >= 0) & (far_b >= 0)
            same = self.names[j][np.where(inside, far_a, 0)] == self.names[j][np.where(inside, far_b, 0)]
            step = (inside & same).astype(np.int64) << j
            a -= step
            b -= step
        return start - a

    def neighbour_lcp(self, least: int) -> np.ndarray:
        """Longest common prefix of each row's suffix with that of the row before; 0 where below ``least``."""
        n = len(self.rows)
        lcp = np.zeros(n, np.int64)
        j = max(0, min(least.bit_length() - 1, len(self.names) - 1))
        near = self.names[j][self.rows]
        at = np.nonzero(near[1:] == near[:-1])[0] + 1
        if len(at):
            lcp[at] = self.common(self.rows[at - 1], self.rows[at])
            lcp[lcp < least] = 0
        return lcp

    def interval(self, places: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array (from, to) whose suffixes start with the block of 2**j symbols at each place."""
        name = self.names[j]
        count = np.bincount(name, minlength=len(name))
        low = name[places].astype(np.int64)
        return low, low + count[low]


class WaveletTree:
    """Wavelet tree (in matrix form) over a sequence of numbers below its length: counting and order statistics on any
    of its ranges in one step a bit, for many ranges at once. Count and order statistic together are the range
    successor."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        values = values.astype(np.int32)
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            zeros_before = np.concatenate([[0], np.cumsum(zero)]).astype(np.int32)
            self.levels.append((bit, zeros_before))
            values = np.concatenate([values[zero], values[~zero]])

    def count_below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in rows ``low`` to ``high`` (excluded) are less than ``bound``."""
        low, high = low.astype(np.int64), high.astype(np.int64)
        below = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            z_low, z_high = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = (bound >> bit) & 1 == 1
            below += np.where(one, z_high - z_low, 0)
            low = np.where(one, zeros[-1] + low - z_low, z_low)
            high = np.where(one, zeros[-1] + high - z_high, z_high)
        return np.where(bound >= 1 << self.bits, -1, below)

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest value (from 0) in rows ``low`` to ``high`` (excluded); there must be as many."""
        low, high, k = low.astype(np.int64), high.astype(np.int64), k.copy()
        value = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            z_low, z_high = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = k >= z_high - z_low
            value |= one.astype(np.int64) << bit
            k -= np.where(one, z_high - z_low, 0)
            low = np.where(one, zeros[-1] + low - z_low, z_low)
            high = np.where(one, zeros[-1] + high - z_high, z_high)
        return value
