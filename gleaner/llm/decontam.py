"""Benchmark decontamination with a positional inverted index.

Words are runs of ASCII letters and digits and of all non-ASCII characters, after lower-casing A-Z. A window is
``window`` consecutive words of a benchmark item (a shorter item is one window). The work goes:

1. count, over the whole corpus, the words that occur in the benchmark;
2. in every window take its two rarest words as anchors; a window with a word that the corpus lacks cannot occur;
3. store the postings of the anchor words: one row per word and document with all positions (the index table);
4. intersect: postings of the rarest word, moved by its offset, with those of the second rarest; what remains are
   alignments (document, item, shift);
5. compare document and item at each alignment: both are cut into the same blocks of ``BLOCK`` document words, with a
   window's width around them, and joined by document and block; a block's hit words are the bits of one number, united
   by ``bit_or`` before and after the shuffle.

All of these are joins and aggregations keyed by word, then by text and block. Documents are known by 128 bits of their
text's SHA-256, so copies are indexed and compared once. What is gathered per document is its hit bits and the ids of the items found in it, no
more than its row returns. Python only splits texts and compares words. What goes to every task are bitmaps of 2**24 bits
(2 MB at any size) that tell which words and blocks matter; what they let through by chance finds no partner in the join.
A word or text that holds a large part of the rows is an ordinary skewed join side.

Null or empty text: no words. Null document id: kept, matched like any other. Null item id: the empty id. Repeated
item rows count once; repeated documents each get their row. No benchmark items: no hits. Extra columns: ignored, or kept if named in ``keep``. A phrase search takes nulls and
empty texts alike; rows that share an id are searched as one document there.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, text_groups

BITS = 24
BLOCK = 64
SALTS = 32
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def words_of(text: str | None) -> list:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def _bits(bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")


class _Wanted(dict):
    """Memo of whether a word's bit is set."""

    def __init__(self, bitmap: bytes):
        super().__init__()
        self.bits = _bits(bitmap)

    def __missing__(self, word: bytes) -> bool:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = bool(self.bits[zlib.crc32(word) & ((1 << BITS) - 1)])
        return found


def _bitmap(rows: DataFrame, slot: Column):
    """Broadcast bitmap of the slots (0 to 2**BITS - 1) of all rows; its size does not depend on their number."""
    bits = np.zeros(1 << BITS, np.uint8)
    bits[rows.select(slot.cast("int").alias("b")).distinct().toArrow()["b"].to_numpy()] = 1  # at most 2**BITS numbers
    return rows.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())


def _word_slot(col: str) -> Column:
    return F.crc32(col).bitwiseAND(F.lit((1 << BITS) - 1))


def item_words(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per different item: ``item`` (key), ``item_id`` (text) and ``words`` in order."""
    def split(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[w.decode() for w in words_of(t)] for t in b.column(1).to_pylist()],
                                       pa.list_(pa.string()))], names=["item_id", "words"])

    source = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), text_col)
    split_items = source.mapInArrow(split, "item_id string, words array<string>").where(F.size("words") > 0).distinct()
    return split_items.withColumn("item", F.concat_ws(":", "item_id", F.sha2(F.array_join("words", " "), 256)))


def corpus_counts(docs: DataFrame, text_col: str, wanted) -> DataFrame:
    """``word``, ``n``: occurrences in all documents of the words whose bit is set (and no wanted word missing)."""
    def count(batches):
        member, kept = _Wanted(wanted.value), Counter()

        def out():
            rows = list(kept.items())
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in rows], pa.string()),
                                               pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for s, e in text_groups(texts, 1 << 22):
                seen = Counter()
                for t in texts[s:e]:
                    seen.update(words_of(t))
                for w, n in seen.items():
                    if member[w]:
                        kept[w] += n
                if len(kept) > 200_000:
                    yield out()
        yield out()

    return docs.select(text_col).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """For every window that can occur, its two rarest words and their places in the item, each pair once:
    ``item``, ``word1``, ``at1``, ``word2``, ``at2`` (null for a window of one word)."""
    def choose(batches):
        for b in batches:
            rows = []
            for item, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                freq = [(p["n"], p["at"]) for p in places]
                size = min(window, len(freq))
                found = set()
                for s in range(len(freq) - size + 1):
                    two = sorted(freq[s:s + size])[:2]
                    if two[0][0] > 0:
                        found.add(tuple(at for _, at in two))
                for pair in found:
                    first, second = places[pair[0]], places[pair[1]] if len(pair) > 1 else {"word": None, "at": None}
                    rows.append((item, first["word"], first["at"], second["word"], second["at"]))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()))],
                names=["item", "word1", "at1", "word2", "at2"])

    places = items.select("item", F.posexplode("words").alias("at", "word")).join(counts, "word", "left")
    place = F.struct("at", "word", F.coalesce("n", F.lit(0)).alias("n"))
    return (places.groupBy("item").agg(F.sort_array(F.collect_list(place)).alias("places"))
            .mapInArrow(choose, "item string, word1 string, at1 int, word2 string, at2 int"))


def build_index(docs: DataFrame, key: Column, text_col: str, wanted) -> DataFrame:
    """The positional index: ``word``, ``doc`` (the key), ``positions`` for the words whose bit is set; rows that agree
    in key and text once."""
    keyed = docs.select(key.alias("k"), text_col)
    key_type = keyed.schema["k"].dataType

    def post(batches):
        member = _Wanted(wanted.value)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            words, docs_, places = [], [], []
            for i, t in zip(ids, texts):
                own: dict = {}
                for at, w in enumerate(words_of(t.as_py())):
                    if member[w]:
                        own.setdefault(w, []).append(at)
                for w, p in own.items():
                    words.append(w.decode())
                    docs_.append(i)
                    places.append(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(docs_, b.schema.field(0).type), pa.array(places, pa.list_(pa.int32()))],
                names=["word", "doc", "positions"])

    return keyed.mapInArrow(post, f"word string, doc {key_type.simpleString()}, positions array<int>").distinct()


def alignments(index: DataFrame, pairs: DataFrame, slop: int = 0) -> DataFrame:
    """Intersection of the offset-adjusted postings: ``doc``, ``item``, ``shift`` (the document's position of the
    item's first word, which may lie before its start). With ``slop`` the second anchor may be that far off."""
    postings = index.select("word", "doc", F.explode("positions").alias("at"))
    first = pairs.join(postings, pairs["word1"] == postings["word"]).select(
        "item", "doc", "word2", "at2", (F.col("at") - F.col("at1")).alias("shift"))
    lone = first.where(F.col("word2").isNull()).select("doc", "item", "shift")
    first = first.where(F.col("word2").isNotNull()).withColumn("expect", F.col("shift") + F.col("at2"))
    second = postings.select(F.col("word").alias("word2"), "doc", "at")
    if slop:
        near = first.join(second, ["word2", "doc"]).where(F.abs(F.col("at") - F.col("expect")) <= slop)
    else:
        near = first.join(second.withColumnRenamed("at", "expect"), ["word2", "doc", "expect"])
    return near.select("doc", "item", "shift").union(lone).distinct()


def _runs(words: list, item: list, size: int) -> list:
    """Runs [a, b) of at least ``size`` equal words at equal places."""
    runs, run, n = [], 0, min(len(words), len(item))
    for p in range(n + 1):
        if p < n and words[p] == item[p]:
            run += 1
        else:
            if run >= size:
                runs.append((p - run, p))
            run = 0
    return runs


def text_key(text_col: str) -> Column:
    """128 bits that name a text; null for null."""
    return F.substring(F.unhex(F.sha2(text_col, 256)), 1, 16)


def _block_slot(doc: Column, block: Column) -> Column:
    return F.xxhash64(doc, block).bitwiseAND(F.lit((1 << BITS) - 1))


def _doc_slot(doc: Column) -> Column:
    return F.crc32(doc).bitwiseAND(F.lit((1 << BITS) - 1))


def text_blocks(docs: DataFrame, text_col: str, wanted_docs, around: int) -> DataFrame:
    """``doc`` (name of the text), ``block``, ``doc_words`` (the block's words with ``around`` more on either side,
    one string) of the documents whose bit is set; copies once."""
    def cut(batches):
        bits = _bits(wanted_docs.value)
        for b in batches:
            rows = []
            for key, slot, text in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                if not bits[slot]:
                    continue
                words = words_of(text.as_py())
                rows += [(key.as_py(), k, b" ".join(words[max(0, k * BLOCK - around):(k + 1) * BLOCK + around]).decode())
                         for k in range(-(-len(words) // BLOCK))]
                if len(rows) > 20_000:
                    yield block_batch(rows)
                    rows = []
            yield block_batch(rows)

    def block_batch(rows):
        cols = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string()))],
                                          names=["doc", "block", "doc_words"])

    key = text_key(text_col)
    return (docs.where(F.col(text_col).isNotNull()).select(key.alias("doc"), _doc_slot(key).cast("int").alias("slot"), text_col)
            .mapInArrow(cut, "doc binary, block bigint, doc_words string"))


def verify(found: DataFrame, items: DataFrame, docs: DataFrame, text_col: str, window: int) -> DataFrame:
    """``doc``, ``block``, ``item_id``, ``hits`` (bit i: the block's i-th word lies in an occurring window) of the
    alignments that hold a window. A window that touches a block lies within ``window - 1`` words of it, so every block
    is judged by itself."""
    around = window - 1
    near = F.lit(around)
    size = F.size("words")
    # blocks that the item touches in the document; past the document's end there is no block to join
    first = F.floor(F.greatest(F.col("shift"), F.lit(0)) / BLOCK)
    last = F.floor((F.col("shift") + size - 1) / BLOCK)
    touched = (found.join(items, "item").where(F.col("shift") + size > 0)
               .select("doc", "item_id", "words", "shift", F.explode(F.sequence(first, last)).alias("block")))
    # both sides begin at the word `lo` of the document; the item's words start at `shift`
    lo = F.greatest(F.col("block") * BLOCK - near, F.lit(0))
    begin = F.greatest(lo, F.col("shift"))
    until = F.least((F.col("block") + 1) * BLOCK + near, F.col("shift") + size)
    asked = touched.select(
        "doc", "block", "item_id", (begin - lo).cast("int").alias("skip"), (lo - F.col("block") * BLOCK).cast("int").alias("lead"),
        F.least(F.lit(window), size).alias("size"),
        F.array_join(F.slice("words", (begin - F.col("shift") + 1).cast("int"), (until - begin).cast("int")), " ").alias("item_words"))
    wanted = _bitmap(found, _doc_slot(F.col("doc")))
    asked = materialize(asked, "asked")
    some = _bitmap(asked, _block_slot(F.col("doc"), F.col("block")))
    pairs = asked.join(_only(text_blocks(docs, text_col, wanted, around), some), ["doc", "block"])

    def compare(batches):
        for b in batches:
            rows = b.to_pylist()
            hits = np.zeros((len(rows), BLOCK), bool)
            for r, own in zip(rows, hits):
                words, item = r["doc_words"].split(" ")[r["skip"]:], r["item_words"].split(" ")
                start = r["lead"] + r["skip"]
                for x, y in _runs(words, item, r["size"]):
                    own[max(0, x + start):max(0, y + start)] = True
            bits = np.packbits(hits, axis=1, bitorder="little").view("<i8").ravel()
            out = [b.column(b.schema.names.index(c)) for c in ("doc", "block", "item_id")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(bits)], names=["doc", "block", "item_id", "hits"])

    return (pairs.select("doc", "block", "item_id", "skip", "lead", "size", "item_words", "doc_words")
            .mapInArrow(compare, "doc binary, block bigint, item_id string, hits bigint").where("hits != 0"))


def _only(blocks: DataFrame, wanted) -> DataFrame:
    """The blocks whose bit is set, each once."""
    slots = blocks.withColumn("slot", _block_slot(F.col("doc"), F.col("block")))

    def keep(batches):
        bits = _bits(wanted.value)
        for b in batches:
            yield b.filter(pa.array(bits[b.column(3).to_numpy()].astype(bool))).select([0, 1, 2])

    return slots.mapInArrow(keep, blocks.schema).dropDuplicates(["doc", "block"])


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       window: int = 13, keep: tuple = ()) -> DataFrame:
    """Per document row: the id, ``keep`` columns, ``n_words``, ``n_hit`` (words inside an occurring window),
    ``items`` (ids of the items with occurring windows, sorted) and ``spans`` (their word ranges, merged)."""
    own = materialize(item_words(items), "items")
    counts = corpus_counts(docs, text_col, _bitmap(own.select(F.explode("words").alias("w")), _word_slot("w")))
    pairs = materialize(anchors(own, counts, window), "anchors")
    words = pairs.select(F.col("word1").alias("w")).union(pairs.select("word2")).where(F.col("w").isNotNull())
    index = materialize(build_index(docs, text_key(text_col), text_col, _bitmap(words, _word_slot("w"))), "postings")
    found = materialize(alignments(index, pairs), "alignments")
    hits = materialize(verify(found, own, docs, text_col, window), "hits")
    marks = (hits.groupBy("doc", "block").agg(F.bit_or("hits").alias("hits"))
             .groupBy("doc").agg(F.collect_list(F.struct("block", "hits")).alias("_marks")))
    held = hits.groupBy("doc").agg(F.sort_array(F.collect_set("item_id")).alias("_items"))
    # copies are dealt over SALTS tasks; what was found in their text, a small row, goes to each
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    per_doc = marks.join(held, "doc").select(F.col("doc").alias("_doc"), salts.alias("_for"), "_marks", "_items")
    rows = docs.select(text_key(text_col).alias("_key"), (F.monotonically_increasing_id() % SALTS).alias("_salt"),
                       *dict.fromkeys([id_col, text_col, *keep]))
    met = (F.col("_key") == F.col("_doc")) & (F.col("_salt") == F.col("_for"))
    joined = rows.join(per_doc, met, "left").drop("_key", "_salt", "_doc", "_for")
    passed = [c for c in dict.fromkeys([id_col, *keep])]
    at_text, at_marks, at_items = (joined.columns.index(c) for c in (text_col, "_marks", "_items"))

    def spread(batches):
        for b in batches:
            n_words, n_hit, spans = [], [], []
            for t, marks in zip(b.column(at_text), b.column(at_marks)):
                n = len(words_of(t.as_py()))
                blocks = np.zeros(-(-n // BLOCK) + 1, np.int64)
                for m in marks.as_py() or ():
                    blocks[m["block"]] = m["hits"]
                hit = np.zeros(n + 2, bool)
                hit[1:-1] = np.unpackbits(blocks.astype("<i8").view(np.uint8), bitorder="little")[:n]
                edge = np.nonzero(np.diff(hit))[0]
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
            ids = [x or [] for x in b.column(at_items).to_pylist()]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [b.column(b.schema.names.index(c)) for c in passed]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(ids, pa.list_(pa.string())), pa.array(spans, span)],
                names=[*passed, "n_words", "n_hit", "items", "spans"])

    added = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
    schema = StructType([joined.schema[c] for c in passed] + StructType.fromDDL(added).fields)
    return joined.mapInArrow(spread, schema)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def proximity(docs: DataFrame, phrases: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold all words of a phrase close together: ``doc_id`` (text), ``item_id``, ``shift``. The two
    rarest words may be ``slop`` words off their distance in the phrase, and the others that far off their places."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    own = materialize(item_words(phrases), "items")
    counts = corpus_counts(docs, text_col, _bitmap(own.select(F.explode("words").alias("w")), _word_slot("w")))
    pairs = materialize(anchors(own, counts, 1 << 30), "anchors")
    every = own.join(pairs.select("item").distinct(), "item", "left_semi").select("item", F.posexplode("words").alias("place", "word"))
    index = materialize(build_index(docs, key, text_col, _bitmap(every, _word_slot("word"))), "postings")
    near = alignments(index, pairs, slop)
    asked = near.join(every, "item")
    held = index.select(F.col("doc"), F.col("word"), "positions")
    at = F.col("shift") + F.col("place")
    fits = asked.join(held, ["doc", "word"]).where(F.exists("positions", lambda p: F.abs(p - at) <= slop))
    found = fits.groupBy("doc", "item", "shift").agg(F.countDistinct("place").alias("n"))
    whole = found.join(own, "item").where(F.col("n") == F.size("words"))
    return whole.select(F.col("doc").alias("doc_id"), "item_id", "shift").distinct()
