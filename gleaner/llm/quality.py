"""Quality classifier by importance resampling.

Two generative models over hashed n-grams of ``GRAM`` bytes are learned: one of the target (documents labelled good),
one of raw text (all documents, labelled or not, but for the labelled ones that the cut is set on). Each is counted in
two ways, by occurrences and by documents; the log ratios of target to raw, two numbers per bucket, are broadcast (their
size is fixed). A bucket seen in neither has ratio one.

* ``log_weight``, what documents are drawn by: the mean over all n-grams of the log ratio of the occurrence models, the
  log of the importance ratio per n-gram. The n-grams of one document are no independent draws: were their ratios
  multiplied, a text of a kind that the target holds twice as often would weigh 2**length, not 2, and long texts would
  crowd out all others.
* ``log_passage``, what documents are accepted by: the smallest sum of log ratios of the document models, clipped, over
  any ``PASSAGE`` consecutive n-grams. A document is as good as its worst passage, so a few foreign words show in a text
  of any length.

The cut below which a document is rejected is set on labelled documents held out from the models, so that it rejects
as many bad ones as possible, a good one weighing ``GOOD_COST`` bad ones. Resampling draws ``k`` documents without
replacement with chances in proportion to their weights: the largest ``k`` of log weight plus Gumbel noise, which is
worked out from the id, so every run draws the same.

Target model and cut are fitted on at most ``max_labelled`` labelled documents, those whose ids hash lowest; to the raw
model, other documents are unlabelled. Null or empty text: both logs are 0. Null label: unlabelled; an
id that is labelled twice is good only if all its labels say so. No labels, or only one kind: nothing is rejected; no
good ones to learn from: every ratio is one. Null id: noise of the empty id. Repeated rows:
each is weighed and drawn on its own. Ties: the smaller id. Empty table: no rows. Long texts are worked through in
slices. Extra columns: kept by ``weigh``; the names that it adds are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import MIX_A, total_order

BITS = 20
GRAM = 6
PASSAGE = 32
SLICE = 1 << 20
LIMIT = 6.0
GOOD_COST = 5.0
NOTHING_REJECTED = float("-inf")


@dataclass
class QualityModel:
    importance: np.ndarray
    log_ratio: np.ndarray
    cut: float


def buckets(raw: bytes) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; a shorter text is padded with spaces to one n-gram."""
    raw = raw.ljust(GRAM)
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(b) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(257) + b[j:n + j]
    return ((h * MIX_A) >> np.uint64(64 - BITS)).astype(np.int64)


def _slices(raw: bytes):
    """Parts whose passages are together those of the text, each with the number of n-grams that no later part holds."""
    n = max(1, len(raw) - GRAM + 1)
    for s in range(0, max(1, n - PASSAGE + 1), SLICE):
        own = n - s if s + SLICE + PASSAGE > n else SLICE
        yield raw[s:s + SLICE + PASSAGE + GRAM - 2], own


def weights(text: str | None, model: QualityModel) -> tuple[float, float]:
    """``log_weight`` and ``log_passage`` of a text."""
    if not text:
        return 0.0, 0.0
    worst, total, n = np.inf, 0.0, 0
    for part, own in _slices(text.encode()):
        at = buckets(part)
        total += float(model.importance[at[:own]].sum(dtype=np.float64))
        n += own
        sums = np.concatenate([[0.0], np.cumsum(model.log_ratio[at], dtype=np.float64)])
        width = min(PASSAGE, len(sums) - 1)
        worst = min(worst, float((sums[width:] - sums[:-width]).min()))
    return total / n, worst


def _log_ratio(target: np.ndarray, raw: np.ndarray, pseudo: float) -> np.ndarray:
    """Log of the target's share of a bucket over the raw text's, both smoothed towards the raw shares."""
    if not target.any():
        return np.zeros(len(raw))
    share = target.sum() / raw.sum()
    return np.log(target + pseudo * share) - np.log(raw + pseudo) - np.log(share)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut that rejects the most bad documents, less GOOD_COST times the good ones, as shares of their kinds."""
    if not good.any() or good.all():
        return NOTHING_REJECTED
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    gain = np.cumsum(~g) / (~g).sum() - GOOD_COST * np.cumsum(g) / g.sum()
    gain[:-1][w[1:] == w[:-1]] = -np.inf  # no cut between equal weights
    at = int(gain.argmax())
    if gain[at] <= 0:
        return NOTHING_REJECTED
    return float((w[at] + w[min(at + 1, len(w) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: Column | None = None,
        max_labelled: int = 20_000, pseudo: float = 1.0) -> QualityModel:
    """Models and cut from labelled documents. ``good``: a condition on the labels (default: quality 1, not toxic)."""
    if good is None:
        good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    told = (labels.select(F.col("doc_id").alias("_id"), good.alias("_good")).where(F.col("_id").isNotNull() & F.col("_good").isNotNull())
            .groupBy("_id").agg(F.min("_good").alias("_good")))
    chosen = told.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(chosen), "_id", "left")  # at most max_labelled rows of two columns
    labelled = F.col("_good").isNotNull()
    held_out = F.crc32(F.col("_id").cast("string")) % 4 == 2
    size = 1 << BITS

    def count(batches):
        seen = np.zeros((4, size), np.int64)
        for b in batches:
            for text, is_good in zip(b.column(0), b.column(1).to_pylist()):
                own, times = np.unique(buckets((text.as_py() or "").encode()), return_counts=True)
                seen[2, own] += times
                seen[3, own] += 1
                if is_good:
                    seen[0, own] += times
                    seen[1, own] += 1
        at = np.nonzero(seen[3])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(row[at]) for row in seen)],
                                         names=["bucket", *counted])

    counted = ["target", "target_docs", "raw", "raw_docs"]
    learned = (rows.where(~labelled | ~held_out).select("_text", "_good")
               .mapInArrow(count, "bucket int, " + ", ".join(f"{c} bigint" for c in counted)))
    # at most 2**BITS rows of five numbers
    got = learned.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in counted]).toArrow()
    sums = {c: np.zeros(size) for c in counted}
    for c in counted:
        sums[c][got["bucket"].to_numpy()] = got[c].to_numpy()
    by_document = _log_ratio(sums["target_docs"], sums["raw_docs"], pseudo)
    model = QualityModel(_log_ratio(sums["target"], sums["raw"], pseudo).astype(np.float32),
                         np.clip(by_document, -LIMIT, LIMIT).astype(np.float32), NOTHING_REJECTED)
    checked = weigh(rows.where(labelled & held_out), model, "_text", "_weight", "_passage").select("_passage", "_good").toArrow()
    if checked.num_rows:
        model.cut = best_cut(checked["_passage"].to_numpy(), np.array(checked["_good"].to_pylist(), bool))
    return model


def weigh(docs: DataFrame, model: QualityModel, text_col: str = "text", weight_col: str = "log_weight",
          passage_col: str = "log_passage") -> DataFrame:
    """``docs`` with ``log_weight`` and ``log_passage`` added under names that it does not have yet."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            both = np.array([weights(t.as_py(), shared.value) for t in b.column(at)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(both[:, 0]), pa.array(both[:, 1])],
                                             names=[*b.schema.names, weight_col, passage_col])

    added = [StructField(c, DoubleType()) for c in (weight_col, passage_col)]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def gumbel_key(weight: Column, id_: Column, seed: int = 0) -> Column:
    """Log weight plus Gumbel noise that depends on the id and the seed only."""
    hashed = F.xxhash64(F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")))
    uniform = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / float(1 << 53)
    return weight - F.log(-F.log(uniform))


def resample(weighed: DataFrame, fraction: float, id_col: str = "doc_id", weight_col: str = "log_weight",
             seed: int = 0, keep: tuple = ()) -> DataFrame:
    """``doc_id``, ``log_weight``, ``gumbel_key``, ``sample_rank`` (from 1), ``sampled`` (among the first
    ``fraction`` of all rows, rounded up) and the ``keep`` columns."""
    keyed = weighed.select(F.col(id_col).alias("doc_id"), F.col(weight_col).alias("log_weight"),
                           gumbel_key(F.col(weight_col), F.col(id_col), seed).alias("gumbel_key"), F.lit(1).alias("one"), *keep)
    ranked = total_order(keyed, [F.col("gumbel_key").desc(), F.col("doc_id")], measure="one", name="gumbel")
    return ranked.select("doc_id", "log_weight", "gumbel_key", (F.col("_rank") + 1).alias("sample_rank"),
                         (F.col("_rank") < F.ceil(F.col("_total") * fraction)).alias("sampled"), *keep)
