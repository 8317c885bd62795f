"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features of a text: its lower-cased 1-, 2- and 3-grams of letters, where anything that is not a letter counts as
a space, hashed into ``2**bits`` buckets. Training sums bucket counts per language in Spark; the log-probability
matrix (languages x buckets, bounded by the set of languages, not by the rows) is broadcast; texts are scored in
numpy by summing matrix rows over a batch's features.

Null text, empty text, no letters: ``und`` with score 0. No language learned: every text is ``und``. Ties: the
language that sorts first. Very long texts are worked through in overlapping slices, with the same result.
Repeated rows are rows of their own; rows whose language is null are not learned from; extra columns are ignored.

The posterior of a whole text is near 1 for almost any text. Whether a text is in a learned language at all shows in
its fit, the mean log-probability of its n-grams under the best language; ``clear_fits`` learns from labelled rows how
low that may be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import batch_of, text_groups

MAX_N = 3
SLICE = 1 << 20
UNDETERMINED = "und"
_LETTER: list = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


@dataclass
class LanguageModel:
    languages: list
    log_prob: np.ndarray  # (buckets + 1) x languages; the last row is zero, for places that hold no n-gram
    log_prior: np.ndarray
    bits: int


def _slices(text: str) -> Iterator[str]:
    """Pieces whose n-grams, counted by where they start, are together those of the text."""
    for s in range(0, len(text), SLICE):
        yield text[s:s + SLICE + MAX_N - 1]


def features(pieces: list, continued: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram (``2**bits``: none there), n-grams by the place of their first character; each
    piece's first place; whether each piece has a letter. A piece longer than SLICE ends in an overlap, whose
    places start no n-gram; nor do those before a piece that continues a text."""
    pad = " " * MAX_N
    flat = np.frombuffer((pad + pad.join(pieces) + pad).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.concatenate([[0], np.cumsum(lengths + MAX_N)])[:-1].astype(np.int64)  # the pad before belongs to it
    letter = _is_letter()[flat]
    c = np.where(letter, flat, np.uint32(32)).astype(np.uint32)
    n = len(c) - MAX_N + 1
    h1 = (c[:n] + np.uint32(1)) * np.uint32(0x9E3779B1)
    h2 = (h1 ^ (h1 >> np.uint32(15))) + (c[1:n + 1] + np.uint32(7)) * np.uint32(0x85EBCA77)
    h3 = (h2 ^ (h2 >> np.uint32(13))) + (c[2:n + 2] + np.uint32(13)) * np.uint32(0xC2B2AE3D)
    l0, l1 = letter[:n], letter[1:n + 1]
    out = np.empty((n, MAX_N), np.int64)
    for k, (h, ok) in enumerate(((h1, l0), (h2, l0 | l1), (h3, l1))):
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F)
        out[:, k] = np.where(ok, (h >> np.uint32(32 - bits)).astype(np.int64), 1 << bits)
    for i in np.nonzero(lengths > SLICE)[0]:
        end = starts[i] + MAX_N + SLICE
        out[end:end + MAX_N, :] = 1 << bits
    for i in np.nonzero(continued)[0]:
        out[starts[i]:starts[i] + MAX_N, :] = 1 << bits
    has = np.add.reduceat(letter[:n].astype(np.int64), starts) > 0
    return out, starts, has


def _cut(texts: list) -> tuple[list, np.ndarray, np.ndarray]:
    """Lower-cased pieces of the texts, the number of the text each comes from, and whether it continues it."""
    pieces, owner = [], []
    for i, t in enumerate(texts):
        for p in _slices(t.lower()) if t else ():
            pieces.append(p)
            owner.append(i)
    owner = np.array(owner, np.int64)
    return pieces, owner, np.append(False, owner[1:] == owner[:-1])[:len(owner)]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = 16,
          alpha: float = 0.5, max_languages: int = 2048) -> LanguageModel:
    """Learn from all rows with a language. ``max_languages`` bounds the matrix: more raises an error."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    size = 1 << bits

    def count(batches):
        counts, docs = {}, {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                docs[lang] = docs.get(lang, 0) + len(own)
                total = counts.setdefault(lang, np.zeros(size, np.int64))
                for s, e in text_groups(own, SLICE):
                    pieces, _, continued = _cut(own[s:e])
                    for p, q in text_groups(pieces, SLICE // 2):
                        idx, _, _ = features(pieces[p:q], continued[p:q], bits)
                        total += np.bincount(idx.ravel(), minlength=size + 1)[:size]
        for lang, total in counts.items():
            at = np.nonzero(total)[0]
            yield batch_of(schema, {"lang": [lang] * (len(at) + 1), "bucket": np.append(at, -1).astype(np.int32),
                                    "n": np.append(total[at], docs[lang])})

    rows = labelled.select(text_col, lang_col).where(F.col(lang_col).isNotNull())
    summed = (rows.mapInArrow(count, "lang string, bucket int, n bigint")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    got = summed.toArrow()  # at most max_languages x 2**bits rows
    names = got["lang"].unique().to_pylist()
    languages = sorted(names)
    if len(languages) > max_languages:
        raise ValueError(f"{len(languages)} languages; max_languages is {max_languages}")
    matrix = np.zeros((size + 1, len(languages)))
    prior = np.zeros(len(languages))
    place = np.array([languages.index(x) for x in names], np.int64)
    code = pc.index_in(got["lang"], pa.array(names, got.schema.field("lang").type)).to_numpy()
    col, bucket, n = place[code], got["bucket"].to_numpy(), got["n"].to_numpy().astype(float)
    grams = bucket >= 0
    matrix[bucket[grams], col[grams]] = n[grams]
    prior[col[~grams]] = n[~grams]
    totals = matrix.sum(axis=0)
    matrix = np.log(matrix + alpha) - np.log(totals + alpha * size)
    matrix[size, :] = 0.0
    log_prior = np.log(np.maximum(prior, 1)) - np.log(max(prior.sum(), 1))
    return LanguageModel(languages, matrix.astype(np.float32), log_prior, bits)


def _score(model: LanguageModel, texts: list) -> tuple[list, np.ndarray]:
    return _judge(model, texts)[:2]


def _judge(model: LanguageModel, texts: list) -> tuple[list, np.ndarray, np.ndarray]:
    """Per text: the language, its posterior and its fit (NaN: undetermined)."""
    n_lang = len(model.languages)
    total, letters = np.zeros((len(texts), n_lang)), np.zeros(len(texts), bool)
    grams = np.zeros(len(texts))
    pieces, owner, continued = _cut(texts)
    for s, e in text_groups(pieces, SLICE // 2):
        idx, starts, has = features(pieces[s:e], continued[s:e], model.bits)
        own = owner[s:e]
        np.logical_or.at(letters, own, has)
        np.add.at(grams, own, np.add.reduceat((idx < 1 << model.bits).sum(axis=1), starts))
        for k in range(n_lang):
            per = model.log_prob[:, k][idx].sum(axis=1, dtype=np.float64)
            np.add.at(total[:, k], own, np.add.reduceat(per, starts))
    langs, scores, fits = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
    if n_lang:
        mean = total / np.maximum(grams, 1)[:, None]
        total += model.log_prior
        top = total.max(axis=1, keepdims=True)
        posterior = np.exp(total - top)
        posterior /= posterior.sum(axis=1, keepdims=True)
        best = posterior.argmax(axis=1)
        for i in np.nonzero(letters)[0]:
            langs[i], scores[i] = model.languages[best[i]], min(1.0, float(posterior[i, best[i]]))
            fits[i] = mean[i, best[i]]
    return langs, scores, fits


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score", fit_col: str | None = None) -> DataFrame:
    """``docs`` with the predicted language, its posterior and, if asked for, its fit (null: undetermined) added, under
    names that it does not have yet."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prob, model.log_prior, model.bits))
    at = docs.columns.index(text_col)
    added = [StructField(lang_col, StringType()), StructField(score_col, DoubleType())]
    schema = StructType([*docs.schema.fields, *added, *([StructField(fit_col, DoubleType())] if fit_col else [])])

    def apply(batches):
        own = LanguageModel(*shared.value)
        for b in batches:
            texts = b.column(at).to_pylist()
            langs, scores, fits = [], [np.zeros(0)], [np.zeros(0)]
            for s, e in text_groups(texts, SLICE):
                x, y, z = _judge(own, texts[s:e])
                langs += x
                scores.append(y)
                fits.append(z)
            arrays = [*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores))]
            if fit_col:
                arrays.append(pa.array(np.concatenate(fits), from_pandas=True))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(apply, schema)


def clear_fits(labelled: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang",
               share: float = 0.1, allowance: float = 2.0) -> dict:
    """Per predicted language the lowest fit of a clear text: ``allowance`` nats below what all but ``share`` of the
    labelled rows reach (all rows with a language count; fits are told apart to 0.01)."""
    texts = labelled.where(F.col(lang_col).isNotNull()).select(text_col)
    fitted = predict(texts, model, text_col, "_told", "_posterior", "_fit").where(F.col("_fit").isNotNull())
    # fits lie between the logarithms of 1 and of the smallest probability: a few thousand steps a language
    got = fitted.groupBy("_told", F.floor(F.col("_fit") * 100).alias("step")).agg(F.count("*").alias("n")).toArrow()
    steps: dict = {}
    for lang, step, n in zip(*(got[c].to_pylist() for c in got.column_names)):
        steps.setdefault(lang, []).append((step, n))
    lowest = {}
    for lang, own in steps.items():
        own.sort()
        below = np.cumsum([n for _, n in own])
        lowest[lang] = own[int(np.searchsorted(below, share * below[-1], side="right"))][0] / 100 - allowance
    return lowest
