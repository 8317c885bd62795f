import math
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import ppm, vptree
from gleaner.llm.queries import op1


class Brute:
    """PPM with escape method C and symbol exclusion, counted symbol by symbol."""

    def __init__(self, training):
        self.seen = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
        self.words = Counter()
        for t in training:
            s = self.padded(t)
            for p in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.seen[k][s[p - k:p]][s[p]] += 1
            self.words.update([*ppm.words_of(t), None])

    @staticmethod
    def padded(t):
        return ppm.START + (t or "").encode().lower() + ppm.END

    def symbol(self, s, p):
        out, excluded = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            counts = self.seen[k].get(s[p - k:p])
            left = {x: n for x, n in (counts or {}).items() if x not in excluded}
            if not left:
                continue
            weight = sum(left.values()) + len(left)
            if s[p] in left:
                return out + math.log10(left[s[p]] / weight)
            out += math.log10(len(left) / weight)
            excluded |= set(counts)
        return out - math.log10(ppm.SYMBOLS - len(excluded))

    def score(self, t):
        s = self.padded(t)
        return sum(self.symbol(s, p) for p in range(ppm.ORDER, len(s)))

    def base(self, t):
        n, v = sum(self.words.values()), len(self.words)
        return sum(math.log10((self.words[w] + 1) / (n + v + 1)) for w in [*ppm.words_of(t), None])


def _same(rows, brute, texts):
    n = sum(brute.words.values())
    by_key = {(d, t): t for d, t in texts}
    assert len(rows) == len(texts)
    want = Counter()
    for d, t in by_key:
        own = [*ppm.words_of(t), None]
        want[d] += 1
    for r in rows:
        fits = [t for d, t in texts if d == r["doc_id"]]
        assert any(
            r["n_tokens"] == len(ppm.words_of(t)) + 1 and r["n_known"] == sum(brute.words[w] > 0 for w in [*ppm.words_of(t), None])
            and r["train_tokens"] == n and math.isclose(r["base_score"], brute.base(t), rel_tol=1e-9, abs_tol=1e-9)
            and math.isclose(r["score"], brute.score(t), rel_tol=1e-9, abs_tol=1e-9) for t in fits)


@pytest.mark.parametrize("chunk_bytes,slice_bytes", [(1 << 25, 1 << 22), (900, 1 << 22)])
def test_scores_match_brute_force(spark, docs, doc_list, chunk_bytes, slice_bytes):
    training = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    named = docs.withColumn("chunk", F.lit("clash")).withColumn("training", F.lit(0))
    got = [r.asDict() for r in ppm.score(named, training, chunk_bytes=chunk_bytes).collect()]
    brute = Brute([r[1] for r in doc_list if (r[0] or 0) % 3 != 1])
    _same(got, brute, [r[:2] for r in doc_list])


def test_slices_change_nothing(monkeypatch):
    texts = ["abc", None, "", "the the", "x" * 50]
    whole = [ppm.grams([ppm.START + (t or "").encode() + ppm.END])[0].tolist() for t in texts]
    monkeypatch.setattr(ppm, "SLICE", 10)
    parts = [p for _, _, p in ppm.slices(texts)]
    assert len(parts) > 2
    keys = np.concatenate([ppm.grams(p)[0] for p in parts]).tolist()
    assert keys == [k for w in whole for k in w]


def _calls(run):
    """What ``run`` returns, and how many calls Python made meanwhile (of its own and of built-in functions)."""
    made = Counter()
    sys.setprofile(lambda frame, event, arg: made.update([event]))
    try:
        out = run()
    finally:
        sys.setprofile(None)
    return out, made["call"] + made["c_call"]


def test_no_call_per_word():
    texts = [" ".join(f"{t}w{i} the" for i in range(500)) for t in range(100)]
    training = np.arange(100) % 7 != 2
    asked, requested = _calls(lambda: ppm._chunk_requests(0, texts, training, 16))
    assert requested < 3000  # 50,001 different words
    brute = Brute([t for t, learn in zip(texts, training) if learn])
    answers = pa.Table.from_pylist([{"bucket": b, "kind": kind, "answer": n if kind == ppm.WORDS else bytes(len(n))}
                                    for b, _, kind, _, n in asked])
    run = ppm._score_chunk(16, sum(brute.words.values()), len(brute.words), brute.words[None])
    got, scored = _calls(lambda: run(pa.table({"doc_id": range(100), "text": texts, "training": training}), answers))
    assert scored < 3000
    assert np.allclose(got["base_score"], [brute.base(t) for t in texts], rtol=1e-12)


def test_words_of_a_slice_are_the_words_of_its_texts(monkeypatch):
    monkeypatch.setattr(ppm, "TEXTS", 3)
    texts = ["Ab  aB\x0bc", None, "", " \t\n\r\f ", "\x00 \x1cq\x85 É\u00a0é", "x" * 40, "end", "\x00", " lead"]
    found = [ppm.words(parts) for _, _, parts in ppm.slices(texts)]
    assert len(found) == 3
    at, different = ppm.vocabulary(found)
    order, edges, listed = ppm.word_order(different, 4)
    assert [listed[i] for i in at] == [w for t in texts for w in ppm.words_of(t)]
    assert np.concatenate([sizes for _, _, sizes in found]).tolist() == [len(ppm.words_of(t)) for t in texts]
    for b in range(4):
        own = [listed[i] for i in order[edges[b]:edges[b + 1]]]
        assert own == sorted(w for w in set(listed) if zlib.crc32(w) % 4 == b)


def test_merged_slices_change_nothing(monkeypatch):
    texts = [f"{i % 5} abc {i}" * 3 for i in range(40)] + [None, ""]
    training = np.arange(42) % 7 != 2
    whole = ppm._chunk_requests(0, texts, training, 16)
    monkeypatch.setattr(ppm, "SLICE", 50)
    monkeypatch.setattr(ppm, "MERGE", 70)
    assert len(list(ppm.slices(texts))) > 9 and ppm._chunk_requests(0, texts, training, 16) == whole


def test_texts_without_a_word(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id bigint, text string").repartition(1)
    brute = Brute([None, " \n"])
    for r, t in zip(sorted(ppm.score(rows, F.col("doc_id") != 2).collect()), [None, "", " \n"]):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (1, 1, 2)
        assert math.isclose(r.score, brute.score(t), rel_tol=1e-9) and math.isclose(r.base_score, brute.base(t), rel_tol=1e-9)


def test_more_texts_than_a_slice_can_number(spark):
    texts = [(0, "some text"), (1, "other text"), (2, "\x7f\u07ff some")] + [(i, "") for i in range(3, 66_000)] + [(-1, "a text")]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(1)
    found = {r.doc_id: r for r in ppm.score(rows, F.col("doc_id") != 1).collect()}
    brute = Brute([t for i, t in texts if i != 1])
    assert len(found) == len(texts)
    for i, t in texts[:5] + texts[-2:]:
        assert math.isclose(found[i].score, brute.score(t), rel_tol=1e-9)
        assert math.isclose(found[i].base_score, brute.base(t), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    brute = Brute(["banana bandana", "ananas", ""])
    keys, counts = np.unique(np.concatenate([ppm.grams([Brute.padded(t)])[0] for t in ("banana bandana", "ananas", "")]), return_counts=True)
    trie = ppm.levels(keys, counts.astype(float), 0, ppm.ORDER, None)
    for context in (b"\0\0\0\0\0", b"anana", b"zzzzz", b"zzban"):
        gram = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.int64)
        p = 10 ** ppm.log_probability(gram, trie)
        assert abs(p.sum() - 1) < 1e-9
        assert np.allclose(np.log10(p), [brute.symbol(context + bytes([s]), ppm.ORDER) for s in range(256)])


def test_nothing_to_learn_from(spark, docs, doc_list, empty_docs):
    got = ppm.score(docs, F.lit(False)).collect()
    for r in got:
        assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0)
    sizes = sorted(len((t or "").encode()) + 1 for _, t, *_ in doc_list)
    assert np.allclose(sorted(-r.score for r in got), [n * math.log10(256) for n in sizes])
    assert ppm.score(empty_docs, F.lit(True)).count() == 0


def test_op1_beats_chance_and_covers_all(spark):
    rows = op1(spark, "/root/testdata/sf0.001").toPandas()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs) and (rows["held_out"] == [zlib.crc32(str(i).encode()) % 7 == 2 for i in rows["doc_id"]]).all()
    size = sum(len(docs[i].encode()) + 1 for i in rows["doc_id"])
    assert -rows["score"].sum() / size < 0.6 * math.log10(256)


# ------------------------------------------------------------------------------------------------ nearest neighbours


def _exact(vectors, queries, k):
    out = []
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(v, float) - np.array(x, float)) ** 2).sum())), i) for i, x in vectors
                      if i != q and len(x) == len(v))[:k]
        out += [(q, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(near)]
    return sorted(out)


def _rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("tree_rows", [50, 8192])
def test_exact_search_matches_brute_force(spark, tree_rows):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(700)]
    vectors += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(400)]  # copies: ties by id, trees of equal points
    vectors += [(2000 + i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(30)]
    odd = [(5000, None), (5100, [0.0] * 6), (5200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5300, [float("nan")] * 6),
           (5400, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (5500, [])]
    df = spark.createDataFrame(vectors + odd, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as slot", "'a' as score")
    got = vptree.nearest(df.repartition(3), F.col("vec_id") % 100 == 0, tree_rows=tree_rows, block_rows=5)
    assert _rows(got) == _exact(vectors, [v for v in vectors if v[0] % 100 == 0], 10)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert _rows(vptree.nearest(df, F.col("vec_id") == 0)) == [(0, 1, 1, round(2 ** 0.5, 9))]
    assert vptree.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert vptree.nearest(df, F.lit(False)).count() == 0


def test_relaxed_pruning_keeps_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 8)) * 5
    vectors = [(i, (centres[i % 20] + rng.normal(size=8)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    exact = {(r[0], r[2]) for r in _exact(vectors, [v for v in vectors if v[0] % 100 == 0], 10)}
    loose = {(r[0], r[2]) for r in _rows(vptree.nearest(df, F.col("vec_id") % 100 == 0, factor=1.3))}
    assert len(exact & loose) >= 0.9 * len(exact)
    assert {(r[0], r[2]) for r in _rows(vptree.nearest(df, F.col("vec_id") % 100 == 0))} == exact
