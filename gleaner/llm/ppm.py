"""Language-model scores by prediction by partial matching (PPM) over bytes, with a model learned in Spark.

The model is a trie of byte contexts up to ``ORDER`` bytes, learned from the training documents: for every context
the counts of the symbols seen after it. A symbol is predicted from the longest context that was seen in training.
If it was not seen there, the model escapes (method C: the weight of an escape is the number of different symbols
seen) to the context without its oldest byte, where the symbols already ruled out are excluded from the counts;
below the empty context all symbols that are left are equally likely. The end of a text is a symbol of its own, so
the scores are log-probabilities of whole texts. Texts are scored with A-Z lower-cased.

How the trie is spread: the documents of an input partition, hashed into parts of about ``chunk_bytes``, are a chunk.

1. Counts of orders 0 to 2 (at most 2**24 different grams at any size of input) are summed and broadcast.
2. Every chunk lists its different grams (context and symbol) with their training counts, dealt into buckets by the
   last three context bytes, so that a bucket holds whole subtrees from order 3 up; and its words, by checksum.
3. A bucket sums what the chunks sent, walks the escape chains of its grams, and answers each chunk with log10 P of
   the chunk's own grams and the corpus count of its own words, in the order in which they were asked.
4. Chunks and answers meet, and each text's symbols are added up.

So what moves are a chunk's different grams and words, never the whole model, and no task needs more than a chunk or
a bucket. The two scans of a file-based table must split it alike, as Spark's do; a difference raises an error.

Null or empty text: only its end is scored. Null id: counts as the empty id. Repeated rows: each is scored. No
training documents: every symbol is equally likely. Empty table: no rows. Very long texts: one chunk holds at least
one text, worked through in slices. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, mix64

ORDER = 5
LOW = 2  # orders up to this one are broadcast
END = b"\xff"  # no UTF-8 text holds this byte
START = b"\0" * ORDER
SYMBOLS = 256
SLICE = 1 << 20
MERGE = 1 << 20  # so many grams of slices are held at least before they are merged
TEXTS = 1 << 16  # of a slice at most: a gram and its text's number in the slice share 64 bits
GRAMS, WORDS, TOTALS = 0, 1, 2
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def words_of(text: str | None) -> list:
    """The words of one text; ``words`` finds those of a slice."""
    return text.encode().lower().split() if text else []


def slices(texts: list):
    """Ranges of texts of about SLICE bytes, with each text's bytes between START and END."""
    held, size, begin = [], 0, 0
    for i, t in enumerate(texts):
        held.append(START + (t.encode().lower() if t else b"") + END)
        size += len(held[-1])
        if size >= SLICE or len(held) == TEXTS or i == len(texts) - 1:
            yield begin, i + 1, held
            held, size, begin = [], 0, i + 1


def grams(parts: list, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram of order ``ORDER`` or ``LOW`` that ends at each symbol of the texts, oldest byte highest, and how many
    each text has."""
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int32)
    low = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
    key = low[LOW + 1:] if order == LOW else low[:-LOW - 1].astype(np.int64) << 24 | low[LOW + 1:]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    first = np.cumsum(lengths) - lengths  # of a text's START; its grams end ORDER symbols later and on
    keep = np.ones(len(key), bool)
    keep[np.add.outer(first[1:], np.arange(-ORDER, 0))] = False  # these straddle two texts
    return key[keep], lengths - ORDER


def words(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of the texts' words, their bytes without what is between them, and how many each text has."""
    flat = np.frombuffer(b"".join(parts), np.uint8)
    inside = ~SPACE[flat]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    inside[np.add.outer(ends[:-1], np.arange(ORDER))] = inside[:ORDER] = inside[ends - 1] = False  # START and END
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return ((edges[1::2] - edges[::2]).astype(np.int32), flat[inside],
            np.diff(np.searchsorted(edges[::2], ends), prepend=0))


def vocabulary(found: list) -> tuple[np.ndarray, pa.Array]:
    """From the slices' ``words``: every word's place in the list of different words, and that list."""
    lengths = np.concatenate([own for own, _, _ in found])
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = pa.py_buffer(np.concatenate([own for _, own, _ in found]))
    coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), data]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def distinct(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of an ordered array, and how often each occurs."""
    first = np.flatnonzero(np.append(len(ordered) > 0, ordered[1:] != ordered[:-1]))
    return ordered[first], np.diff(first, append=len(ordered))


def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
    """One ascending list of keys with the sums of their counts, from several."""
    keys = np.concatenate([own for own, _ in found])
    ascending = np.argsort(keys)
    keys, n = distinct(keys[ascending])
    return keys, np.add.reduceat(np.concatenate([own for _, own in found])[ascending], np.cumsum(n) - n)


class Slices:
    """Counts of the slices' grams, merged each time that the new ones outnumber those merged before."""

    def __init__(self):
        self.parts, self.new = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.parts.append((keys, counts))
        self.new += len(keys)
        if self.new > max(MERGE, len(self.parts[0][0])):
            self.parts, self.new = [merged(self.parts)], 0


def tail(gram: np.ndarray, bytes_: int) -> np.ndarray:
    return gram & np.int64((1 << 8 * bytes_) - 1)


def in_buckets(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by bucket, else as they were, and where each bucket begins and ends."""
    narrow = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # 16 bits are sorted in linear time
    return np.argsort(narrow, kind="stable"), np.append(0, np.cumsum(np.bincount(narrow, minlength=buckets)))


def gram_order(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending grams by bucket, dealt by the three bytes before the last."""
    return in_buckets(mix64(tail(gram >> 8, LOW + 1)) % np.uint64(buckets), buckets)


def word_order(different: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Ascending words by bucket, dealt by checksum, where each bucket begins and ends, and the words as a list."""
    whole = pa.LargeListArray.from_arrays([0, len(different)], different)
    listed = pc.binary_join(whole, pa.scalar(b" ", different.type))[0].as_py().split()
    ascending = pc.array_sort_indices(different).to_numpy()
    bucket = np.fromiter(map(zlib.crc32, listed), np.int64, len(listed)) % buckets
    order, edges = in_buckets(bucket[ascending], buckets)
    return ascending[order], edges, listed


class Sums:
    """Counts by key, looked up in arrays; 0 where there is none."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.keys))

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)


class Level:
    """One order of the trie: counts of grams and, by context, their sum, the number of different symbols, and what
    those symbols sum to one order lower (excluded there after an escape from here)."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray, lower: Level | None):
        self.order, self.n = order, Sums(keys, counts)
        context = self.n.keys >> 8
        self.total = Sums(context, self.n.counts)
        self.different = Sums(context, np.ones(len(context)))
        below = lower.n.get(tail(self.n.keys, order)) if lower else np.zeros(len(context))
        self.ruled_out = Sums(context, below)


def levels(keys: np.ndarray, counts: np.ndarray, lowest: int, highest: int, lower: Level | None) -> list:
    out = []
    for k in range(lowest, highest + 1):
        lower = Level(k, tail(keys, k + 1), counts, lower)
        out.append(lower)
    return out


def log_probability(gram: np.ndarray, trie: list) -> np.ndarray:
    """log10 P of each gram's last symbol after its context; ``trie``: the levels from order 0 up."""
    value = np.full(len(gram), 0.0)
    empty = trie[0].different.get(np.zeros(1, np.int64))[0]
    value -= math.log10(SYMBOLS - empty) if empty < SYMBOLS else 0.0
    above = trie[1:] + [None]
    with np.errstate(divide="ignore", invalid="ignore"):
        for level, upper in zip(trie, above):
            own = tail(gram, level.order + 1)
            context = own >> 8
            gone = (own if upper is None else tail(gram, upper.order + 1)) >> 8
            new = level.different.get(context) - (upper.different.get(gone) if upper else 0)
            weight = level.total.get(context) - (upper.ruled_out.get(gone) if upper else 0) + new
            n = level.n.get(own)
            escaped = np.where(new > 0, np.log10(new / weight) + value, value)
            value = np.where(n > 0, np.log10(n / weight), escaped)
    return value


def _chunk_requests(chunk: int, texts: list, training: np.ndarray, buckets: int):
    """What a chunk asks of the buckets: its different grams and words in order, with their training counts."""
    found, worded = Slices(), []
    for s, e, parts in slices(texts):
        key, sizes = grams(parts)
        marked, n = distinct(np.sort(key << 1 | np.repeat(training[s:e], sizes)))
        found.add(marked >> 1, n * (marked & 1))
        worded.append(words(parts))
    keys, counts = merged(found.parts)
    order, edges = gram_order(keys, buckets)
    keys, counts, rows = keys[order], counts[order], []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[b], edges[b + 1])
        rows.append((b, chunk, GRAMS, keys[own].tobytes(), counts[own].tobytes()))
    at, different = vocabulary(worded)
    learned = np.repeat(training, np.concatenate([sizes for _, _, sizes in worded]))
    counts = np.bincount(at[learned], minlength=len(different))
    order, edges, listed = word_order(different, buckets)
    counts, listed = counts[order], [listed[i] for i in order.tolist()]
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[b], edges[b + 1])
        rows.append((b, chunk, WORDS, b" ".join(listed[own]), counts[own].tobytes()))
    return rows


_ASKED = "bucket int, chunk bigint, kind int, keys binary, counts binary"
_ANSWERED = "bucket int, chunk bigint, kind int, answer binary, n bigint, v bigint"


def _table(rows: list, types: list, names: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _request(buckets: int):
    def run(batches):
        held: dict = {}
        for b in batches:
            for chunk, text, learn in zip(*(c.to_pylist() for c in b.columns)):
                own = held.setdefault(chunk, ([], []))
                own[0].append(text)
                own[1].append(learn)
        for chunk in list(held):
            texts, learn = held.pop(chunk)
            rows = _chunk_requests(chunk, texts, np.array(learn, bool), buckets)
            yield _table(rows, [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()],
                         ["bucket", "chunk", "kind", "keys", "counts"])
    return run


def _answer(low):
    """A bucket's answers to all chunks, and the totals of its words."""
    def run(table: pa.Table) -> pa.Table:
        bucket, rows = table.column("bucket")[0].as_py(), []
        asked = [r for r in table.to_pylist() if r["kind"] == GRAMS]
        if asked:
            keys = [np.frombuffer(r["keys"], np.int64) for r in asked]
            every, n = merged([(k, np.frombuffer(r["counts"], np.int64)) for k, r in zip(keys, asked)])
            bottom = low.value
            trie = bottom + levels(every[n > 0], n[n > 0], LOW + 1, ORDER, bottom[-1])
            value = log_probability(every, trie)
            for r, k in zip(asked, keys):
                rows.append((bucket, r["chunk"], GRAMS, value[np.searchsorted(every, k)].tobytes(), None, None))
        asked = [r for r in table.to_pylist() if r["kind"] == WORDS]
        total: dict = {}
        for r in asked:
            for w, c in zip(r["keys"].split(b" "), np.frombuffer(r["counts"], np.int64).tolist()):
                total[w] = total.get(w, 0) + c
        for r in asked:
            own = r["keys"].split(b" ")
            rows.append((bucket, r["chunk"], WORDS, np.fromiter(map(total.__getitem__, own), np.int64, len(own)).tobytes(),
                         None, None))
        rows.append((bucket, None, TOTALS, None, sum(total.values()), sum(c > 0 for c in total.values())))
        return pa.Table.from_batches([_table(
            rows, [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()],
            ["bucket", "chunk", "kind", "answer", "n", "v"])])
    return run


def _score_chunk(buckets: int, n: int, v: int, n_docs: int):
    whole = n + v + 1
    unknown, end = math.log10(1 / whole), math.log10((n_docs + 1) / whole)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        sent = sorted((r["kind"], r["bucket"], r["answer"]) for r in answers.to_pylist())
        of_gram = np.frombuffer(b"".join(a for k, _, a in sent if k == GRAMS))
        of_word = np.frombuffer(b"".join(a for k, _, a in sent if k == WORDS), np.int64)
        found, worded = [], []
        for _, _, parts in slices(texts):
            key, sizes = grams(parts)
            text = np.repeat(np.arange(len(parts), dtype=np.uint64), sizes)
            both = np.sort(key.astype(np.uint64) << 16 | text)  # a text's equal grams beside each other
            own, times = distinct((both >> 16).astype(np.int64))
            found.append((own, times.astype(np.int32), both.astype(np.uint16), len(parts)))
            worded.append(words(parts))
        keys = np.concatenate([own for own, *_ in found])
        keys.sort()
        keys, _ = distinct(keys)
        at, different = vocabulary(worded)
        if len(keys) != len(of_gram) or len(different) != len(of_word):
            raise RuntimeError("the documents of a chunk differ between two scans of the table")
        value = np.empty(len(keys))
        value[gram_order(keys, buckets)[0]] = of_gram
        scores = [np.bincount(text, np.repeat(value[np.searchsorted(keys, own)], times), count)
                  for own, times, text, count in found]
        counts = np.empty(len(different), np.int64)
        counts[word_order(different, buckets)[0]] = of_word
        value, begin = np.where(counts > 0, np.log10((counts + 1) / whole), 0.0), 0
        tokens, known, sums = [], [], []
        for _, _, sizes in worded:
            stop = np.cumsum(sizes)
            own = at[begin:begin + stop[-1]]
            begin += stop[-1]
            base = value[own].tolist()
            tokens.append(sizes + 1)
            known.append(np.diff(np.append(0, np.cumsum(counts[own] > 0))[stop], prepend=0))
            sums += [math.fsum(base[e - m:e]) + (m - k) * unknown + end
                     for e, m, k in zip(stop.tolist(), sizes.tolist(), known[-1].tolist())]
        return pa.table({"doc_id": table.column("doc_id"), "training": table.column("training"),
                         "n_tokens": np.concatenate(tokens), "n_known": np.concatenate(known) + (n_docs > 0),
                         "train_tokens": pa.array(np.full(len(texts), n, np.int64)),
                         "base_score": pa.array(sums, pa.float64()), "score": np.concatenate(scores)})
    return run


def low_orders(training_texts: DataFrame) -> tuple[list, int]:
    """Levels 0 to LOW over all training texts, and the number of those texts."""
    def count(batches):
        found, docs = Slices(), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            docs += len(texts)
            for _, _, parts in slices(texts):
                found.add(*distinct(np.sort(grams(parts, LOW)[0])))
        gram, n = merged([*found.parts, (np.array([-1]), np.array([docs]))])
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])

    got = training_texts.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    gram, n = got["gram"].to_numpy(np.int64), got["n"].to_numpy(float)
    return levels(gram[gram >= 0], n[gram >= 0], 0, LOW, None), int(n[gram < 0].sum())


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
          chunk_bytes: int = 1 << 24) -> DataFrame:
    """Per document: the id, ``training``, ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``,
    ``base_score`` (unigram words, add one) and ``score`` (PPM), both log10."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), training.alias("training"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splits = max(1, named.rdd.getNumPartitions())
    parts = max(1, math.ceil(size / splits / chunk_bytes))  # of an input partition
    chunk = F.spark_partition_id().cast("long") * parts + F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    tagged = named.withColumn("chunk", chunk)
    buckets = max(16, math.ceil(size / chunk_bytes) * 4)
    low, n_docs = low_orders(named.where("training").select("text"))
    asked = tagged.select("chunk", "text", "training").mapInArrow(_request(buckets), _ASKED)
    answered = materialize(asked.groupBy("bucket").applyInArrow(_answer(spark.sparkContext.broadcast(low)), _ANSWERED), "ppm")
    sums = answered.where(F.col("kind") == TOTALS).agg(F.sum("n"), F.sum("v")).first()
    n, v = (sums[0] or 0) + n_docs, (sums[1] or 0) + (n_docs > 0)
    answers = answered.where(F.col("kind") != TOTALS).select("chunk", "bucket", "kind", "answer")
    schema = StructType([named.schema["doc_id"]] + StructType.fromDDL(
        "training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields)
    return (tagged.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(_score_chunk(buckets, n, v, n_docs), schema))
