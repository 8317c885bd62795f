"""Near-duplicate detection: MinHash bands, odd sketches, exact confirmation.

A document's set is its distinct 5-word shingles (words: runs without ASCII white space, A-Z lower-cased; fewer than
five words: the whole sequence is the one shingle). Sets are kept as 64-bit hashes of shingles. The work goes:

1. one pass over the texts: set size, a digest of the whole set, MinHash bands, and an odd sketch: every MinHash
   sample flips one bit of a parity bitmap, so the XOR of two sketches counts the samples that differ;
2. documents with equal sets collapse into one class, so exact copies never form pairs;
3. classes that share a band are a bucket. In each bucket the class that sits in the most and largest buckets is
   the hub, and the others are paired with it: a bucket yields as many pairs as members, never all pairs;
4. pairs whose XOR population count is out of reach of the threshold go. So do those whose sets, folded whole into a
   larger parity bitmap, differ in more bits than a link allows (sets never differ in fewer elements than bits, so
   no link goes here); the rest are confirmed on full sets;
5. links form components; where a bucket still holds several components, the members outside its largest one are
   compared with those of other components by both bitmaps inside the join, which so yields hardly more than links;
   no link that a bucket shows is lost.

Null or empty text, or no words: an empty set, linked with nothing. Ties: the smallest id names a component. Repeated
rows are equal documents. Null ids: such rows are linked, but name a component only if it has no other id. Very long
texts: sets grow with the text; MinHash works through them in blocks. Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import MIX_A, materialize, mix64
from .components import components

SHINGLE = 5
ROWS, BANDS = 4, 40
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
WORDS = SKETCH_BITS // 64
PARITY_BITS = 2048
PARITY_WORDS = PARITY_BITS // 64
_RNG = np.random.default_rng(20240229)
_MULT = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_C = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ROW = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 1024


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        total += h[j:len(h) - k + 1 + j] * _MULT[j]
    return np.unique(mix64(total))


def minhash(shingles: np.ndarray) -> np.ndarray:
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(low), BLOCK):
        v = low[s:s + BLOCK, None] * _A + high[s:s + BLOCK, None] * _C
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(best, v.min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    return mix64((rows * _ROW).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * MIX_A).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    at = mix64(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def set_parity(shingles: np.ndarray) -> np.ndarray:
    """The whole set folded into a parity bitmap; two sets differ in at least as many elements as bits."""
    at = (shingles >> np.uint64(5)) % np.uint64(PARITY_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


def estimate(differing_bits: int) -> float:
    """Similarity from the population count of two sketches' XOR."""
    left = 1 - 2 * differing_bits / SKETCH_BITS
    return 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(left) if left > 0 else 0.0


def reachable_bits(threshold: float, sigmas: float = 7.0) -> int:
    """The largest XOR population count that a pair at the threshold shows but for ``sigmas`` deviations of the
    number of differing samples."""
    differ = SAMPLES * (1 - threshold) + sigmas * math.sqrt(SAMPLES * threshold * (1 - threshold))
    differ = min(differ, SAMPLES)
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ)))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: the id, ``n_shingles``, ``node`` (digest of the set; null: empty), ``bands``, ``sketch``, ``parity``."""
    def sign(batches):
        memo = _WordHashes()
        for b in batches:
            n, node, bands, sketch, parity = [], [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), memo)
                n.append(len(s))
                if len(s):
                    m = minhash(s)
                    node.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(m))
                    sketch.append(odd_sketch(m))
                    parity.append(set_parity(s))
                else:
                    for column in (node, bands, sketch, parity):
                        column.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, longs),
                 pa.array(sketch, longs), pa.array(parity, longs)],
                names=["doc_id", "n_shingles", "node", "bands", "sketch", "parity"])

    source = docs.select(F.col(id_col).alias("doc_id"), text_col)
    schema = StructType([source.schema["doc_id"]] + StructType.fromDDL(
        "n_shingles bigint, node binary, bands array<bigint>, sketch array<bigint>, parity array<bigint>").fields)
    return source.mapInArrow(sign, schema)


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``node``, ``shingles`` of the wanted classes, from the text of the document that stands for each."""
    def hashes(batches):
        memo = _WordHashes()
        for b in batches:
            sets = [shingle_set(t.as_py(), memo) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(F.col(id_col).alias("doc_id"), text_col)
    texts = texts.join(wanted.select(F.col("rep")).distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    found = texts.select(text_col).mapInArrow(hashes, "node binary, shingles array<bigint>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _bitmaps(side: str) -> list:
    """A class's set size and the words of both bitmaps as columns of one side of a join."""
    return [F.col("n").alias(f"{side}n"), *[F.col("sketch")[i].alias(f"{side}s{i}") for i in range(WORDS)],
            *[F.col("parity")[i].alias(f"{side}p{i}") for i in range(PARITY_WORDS)]]


def _close(bits: int, percent: int) -> Column:
    """Whether the bitmaps of sides x and y leave room for a link."""
    def differing(kind: str, words: int) -> Column:
        return sum((F.bit_count(F.col(f"x{kind}{i}").bitwiseXOR(F.col(f"y{kind}{i}"))) for i in range(words)), F.lit(0))

    # similar enough: the sets' symmetric difference is at most (100 - percent) / (100 + percent) of their sizes' sum
    room = (F.col("xn") + F.col("yn")) * (100 - percent)
    return (differing("s", WORDS) <= bits) & (differing("p", PARITY_WORDS) * (100 + percent) <= room)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id that links reach), ``kept``."""
    bits = reachable_bits(percent / 100)
    signed = materialize(signatures(docs, id_col, text_col), "signatures")
    classes = materialize(signed.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
        *[F.first(c).alias(c) for c in ("bands", "sketch", "parity")]), "classes")
    slots = classes.select("node", F.explode("bands").alias("band"))
    shared = slots.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(slots.join(shared, "band"), "members")
    sketches = classes.select("node", "n", "sketch", "parity")

    reach = members.groupBy("node").agg(F.sum("size").alias("reach"))
    ranked = members.join(reach, "node")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("reach", "node"))["node"].alias("hub"))
    starred = (members.select("band", "node").join(hubs, "band").where("node <> hub")
               .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    tested = materialize(
        starred.join(sketches.select(F.col("node").alias("a"), *_bitmaps("x")), "a")
        .join(sketches.select(F.col("node").alias("b"), *_bitmaps("y")), "b")
        .where(_close(bits, percent)).select("a", "b"),
        "pairs")
    links = _confirm(tested, docs, id_col, text_col, classes, percent)
    labels = components(links, "first")

    # buckets that still hold several components: members outside the largest one against the other components
    labelled = members.select("band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_label = labelled.groupBy("band", "label").agg(F.count("*").alias("n"))
    divided = (per_label.groupBy("band").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label"))["label"].alias("main"))
               .where("labels > 1").select("band", "main"))
    rest = materialize(labelled.join(divided, "band").join(sketches, "node"), "divided")
    minor = rest.where("label <> main").select("band", F.col("node").alias("a"), F.col("label").alias("la"), *_bitmaps("x"))
    other = rest.select("band", F.col("node").alias("b"), F.col("label").alias("lb"), *_bitmaps("y"))
    crossing = (minor.join(other, (minor["band"] == other["band"]) & (F.col("la") != F.col("lb")) & _close(bits, percent))
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                .join(tested, ["a", "b"], "left_anti"))
    more = _confirm(materialize(crossing, "pairs"), docs, id_col, text_col, classes, percent)
    joined = materialize(links.union(more), "links")
    labels = components(joined, "last")

    named = classes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_node = named.join(names, "label").select("node", "component_id")
    return (signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose full sets are as similar as asked."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = materialize(_sets(docs, id_col, text_col, classes.select("node", "rep").join(nodes, "node", "left_semi")), "sets")
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    counted = both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("n"))
    return materialize(counted.where(F.col("c") * 100 >= (F.col("n") - F.col("c")) * percent).select("a", "b"), "links")
