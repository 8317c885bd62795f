"""Order-preserving packing of documents into fixed-length token sequences by dynamic programming.

Within each input partition the documents, in input order, form one token stream that is cut into windows of at
most ``length`` tokens. A window ends at a document's end (free), at a sentence's end (``sentence_penalty``) or,
where neither is near, inside a sentence (``hard_penalty``). The sum of padding and penalties is least possible
over all choices of those cut places: ``f[j] = pen[j] + min(f[i] + pad(pos[j] - pos[i]))``. Padding is linear in
the window, so the minimum over the sliding range comes from a monotone queue of ``f[i] + pos[i]``; windows whose
length is a power of two need no padding and are tried besides.

The stream is worked through in runs of ``run_tokens``; a run's last window is carried into the next, so only the
end of a partition is padded for want of text. No shuffle; memory is bounded by a run and the longest document.

Null or empty text: the document is its end token alone. Repeated rows and ids: each row is a document of its
own. Empty table: no rows. Extra columns are ignored. Very long texts span as many sequences as they need.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .tokenize import FileTokenizer

#: Window lengths below ``length`` that the packing tries to hit exactly, as they need no padding.
FREE_LENGTHS = (256, 512, 1024)


def padding(window: int, length: int) -> int:
    return 0 if window & (window - 1) == 0 else length - window


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, sentence_penalty: int,
               hard_penalty: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end (ascending, 0 and ``total`` among them) and what a cut there costs."""
    soft = np.union1d(np.union1d(sentence_ends, doc_ends), [0, total])
    gaps = np.nonzero(np.diff(soft) > 2 * grain)[0]
    hard = [np.arange(soft[g] + grain, soft[g + 1] - grain // 2, grain) for g in gaps]
    pos = np.union1d(soft, np.concatenate(hard)) if hard else soft
    pen = np.full(len(pos), hard_penalty, np.int64)
    pen[np.searchsorted(pos, soft)] = sentence_penalty
    pen[np.searchsorted(pos, doc_ends)] = 0
    pen[0] = pen[-1] = 0
    return pos.astype(np.int64), pen


def best_cuts(pos: np.ndarray, pen: np.ndarray, length: int) -> list:
    """Indices into ``pos`` of the window ends of least total cost, from 0 to the last place."""
    hops: dict = {}
    for free in FREE_LENGTHS:
        if free < length:
            at = np.searchsorted(pos, pos - free)
            hit = pos[at] == pos - free
            for j, i in zip(np.nonzero(hit)[0].tolist(), at[hit].tolist()):
                hops.setdefault(j, []).append(i)
    p, c = pos.tolist(), pen.tolist()
    m = len(p)
    cost, came = [0] * m, [0] * m
    queue, level = deque([0]), [0] * m  # level: cost + pos
    for j in range(1, m):
        here = p[j]
        oldest = here - length
        while p[queue[0]] < oldest:
            queue.popleft()
        i = queue[0]
        # a whole window of ``length`` (itself a power of two or not) has no padding either
        best = level[i] + length - here
        if j in hops:
            for h in hops[j]:
                if cost[h] < best:
                    best, i = cost[h], h
        best += c[j]
        cost[j], came[j] = best, i
        level[j] = g = best + here
        while queue and level[queue[-1]] > g:
            queue.pop()
        queue.append(j)
    path, j = [m - 1], m - 1
    while j:
        j = came[j]
        path.append(j)
    return path[::-1]


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", sentence_penalty: int = 4, hard_penalty: int = 32, grain: int = 16,
         run_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece of a document in a sequence: the id, ``start`` (tokens of the document before it),
    ``length``, ``doc_tokens`` (the document's tokens, its end token included), ``sequence_id``, ``offset``
    (place in the sequence) and ``ids`` (the piece's ids, little-endian unsigned 32-bit)."""
    source = docs.select(id_col, text_col)
    id_field = source.schema[0]
    names = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = StructType([StructField("doc_id", id_field.dataType),
                         *[StructField(n, LongType()) for n in names], StructField("ids", BinaryType())])

    def run(batches):
        tokenizer = FileTokenizer(tokenizer_path, special_as_text=False)
        ends_sentence = tokenizer.sentence_ends()
        base = TaskContext.get().partitionId() << 33
        made = 0
        held, starts, doc_ids, sizes = [], [], [], []  # token arrays; places of documents; their ids and tokens
        total, id_type = 0, None

        def emit(last: bool):
            nonlocal held, starts, doc_ids, sizes, total, made
            stream = np.concatenate(held)
            first = np.array(starts, np.int64)
            doc_end = first + np.array(sizes, np.int64)
            sentence = np.nonzero(ends_sentence[np.minimum(stream, len(ends_sentence) - 1)])[0] + 1
            pos, pen = cut_places(doc_end[doc_end <= total], sentence, total, sentence_penalty, hard_penalty, grain)
            cuts = pos[best_cuts(pos, pen, length)]
            if not last and len(cuts) > 2:
                cuts = cuts[:-1]  # the unfinished window goes on in the next run
            done = int(cuts[-1])
            edges = np.union1d(cuts, first[(first > 0) & (first < done)])
            begin, end = edges[:-1], edges[1:]
            doc = np.searchsorted(first, begin, side="right") - 1
            window = np.searchsorted(cuts, begin, side="right") - 1
            cols = [begin - first[doc], end - begin, np.array(sizes, np.int64)[doc], base + made + window,
                    begin - cuts[window]]
            ids = [stream[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc_ids[i] for i in doc.tolist()], id_type), *[pa.array(c) for c in cols],
                 pa.array(ids, pa.binary())], names=["doc_id", *names, "ids"])
            made += len(cuts) - 1
            keep = int(np.searchsorted(doc_end, done, side="right"))  # documents that end later
            held, starts = [stream[done:]], (first[keep:] - done).tolist()
            doc_ids, sizes, total = doc_ids[keep:], sizes[keep:], total - done

        for b in batches:
            id_type = b.schema.types[0]
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = tokenizer.encode(text.as_py() or "")
                held += [tokens, np.array([end_id], np.uint32)]
                starts.append(total)
                doc_ids.append(i)
                sizes.append(len(tokens) + 1)
                total += len(tokens) + 1
                if total >= run_tokens:
                    yield from emit(False)
        if total:
            yield from emit(True)

    return source.mapInArrow(run, schema)
