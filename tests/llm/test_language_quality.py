import math
import struct
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import langid, quality
from gleaner.llm.queries import op7, op9

SF = "/root/testdata/sf0.01"


def _brute(texts, langs, alpha, bits, probe):
    """Naive Bayes with n-grams counted one by one."""
    def grams(t):
        idx, _, _ = langid.features([t.lower()], np.zeros(1, bool), bits)
        return [int(x) for x in idx.ravel() if x < 1 << bits]

    counts, prior = {}, {}
    for t, x in zip(texts, langs):
        prior[x] = prior.get(x, 0) + 1
        own = counts.setdefault(x, {})
        for g in grams(t or ""):
            own[g] = own.get(g, 0) + 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    score = {x: math.log(prior[x] / sum(prior.values())) + sum(
        math.log((counts[x].get(g, 0) + alpha) / (total[x] + alpha * (1 << bits))) for g in grams(probe)) for x in counts}
    top = max(score.values())
    best = min(x for x in score if score[x] == top)
    return best, 1 / sum(math.exp(v - top) for v in score.values())


def test_naive_bayes_matches_brute_force(spark, docs):
    model = langid.train(docs, bits=12)
    rows = docs.collect()
    learned = [r for r in rows if r.lang is not None]
    got = langid.predict(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(r.text) < 500:
            best, p = _brute([x.text for x in learned], [x.lang for x in learned], 0.5, 12, r.text)
            assert r.lang_pred == best and abs(r.score - p) < 1e-4


def test_ngrams_are_those_of_the_text():
    def hashes(text):
        idx, _, _ = langid.features([text], np.zeros(1, bool), 16)
        return sorted(x for x in idx.ravel().tolist() if x < 1 << 16)

    assert len(hashes("ab")) == 2 + 3 + 2  # a, b; " a", "ab", "b "; " ab", "ab "
    assert hashes("a-b") == hashes("a b") and hashes("...") == []


def test_long_text_in_slices(spark, monkeypatch):
    text = "der schnelle braune fuchs und the quick fox " * 40
    docs = spark.createDataFrame([(1, text, "de"), (2, text[:400], "en")], "doc_id int, text string, lang string")
    model = langid.train(docs, bits=12)
    whole = langid._score(model, [text])[1]
    monkeypatch.setattr(langid, "SLICE", 64)
    pieces, owner, continued = langid._cut([text])
    assert len(pieces) > 20 and continued.tolist() == [False] + [True] * (len(pieces) - 1)
    cut = np.bincount(np.concatenate([langid.features([p], c[None], 12)[0].ravel() for p, c in zip(pieces, continued)]), minlength=4097)[:4096]
    monkeypatch.setattr(langid, "SLICE", 1 << 20)
    once = np.bincount(langid.features([text.lower()], np.zeros(1, bool), 12)[0].ravel(), minlength=4097)[:4096]
    assert (cut == once).all() and np.isfinite(whole).all()


def test_no_language_learned(spark, docs, empty_docs):
    model = langid.train(empty_docs)
    assert {(r.lang_pred, r.score) for r in langid.predict(docs.select("text"), model).collect()} == {("und", 0.0)}
    assert langid.predict(empty_docs, model).count() == 0


def test_op7_is_right_on_held_out_documents(spark):
    got = op7(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got.count() == 1000 and held[1] > 200 and held[0] > 0.97


def _labelled(spark):
    good = [(i, f"a calm and clear sentence number {i} about the garden and the house", 1, 0) for i in range(300)]
    bad = [(1000 + i, f"a calm and clear sentence number {i} about zorgblat and the house", 1, 1) for i in range(150)]
    low = [(2000 + i, "$$$ ### %%% &&& " * 5 + str(i), 0, 0) for i in range(150)]
    rows = good + bad + low
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(None, "x"), (5000, None), (5001, ""), (5002, "ab")],
                                 "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(None, 1, 0), (1, None, None), (9999, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_quality_rejects_bad_and_keeps_good(spark):
    docs, labels = _labelled(spark)
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.log_passage for r in quality.weigh(docs, model).collect()}
    good = [w for i, w in got.items() if i is not None and i < 300]
    bad = [w for i, w in got.items() if i is not None and 1000 <= i < 3000]
    assert max(bad) < model.cut <= min(good)
    assert got[5000] == got[5001] == 0.0 and got[5002] >= model.cut


def _rebuilt(rows, good):
    """Model, passage scores of the held-out labelled rows, and occurrences in raw text, counted one text at a time."""
    size = 1 << quality.BITS
    target, raw, held = np.zeros((2, size)), np.zeros((2, size)), []
    for i, t in rows:
        if i in good and zlib.crc32(str(i).encode()) % 4 == 2:
            held.append((i, t))
            continue
        for b in quality.buckets((t or "").encode()).tolist():
            raw[0, b] += 1
            target[0, b] += bool(good.get(i))
        own = np.unique(quality.buckets((t or "").encode()))
        raw[1, own] += 1
        target[1, own] += bool(good.get(i))
    ratios = []
    for t, r in zip(target, raw):
        share = t.sum() / r.sum()
        ratios.append(np.log(t + share) - np.log(r + 1) - np.log(share))
    model = quality.QualityModel(ratios[0], np.clip(ratios[1], -quality.LIMIT, quality.LIMIT), 0.0)
    return model, held, raw[0]


def _mean_and_worst(text, model):
    at = quality.buckets(text.encode()) if text else None
    if at is None:
        return 0.0, 0.0
    v = np.concatenate([[0.0], np.cumsum(model.log_ratio[at])])
    w = min(quality.PASSAGE, len(at))
    return model.importance[at].mean(), (v[w:] - v[:-w]).min()


def test_raw_model_covers_unlabelled_documents(spark):
    texts = [(i, f"sentence {i} of the house", i < 40) for i in range(60)] + [(i, f"foreign {i} zorgblat", None) for i in range(100, 700)]
    docs = spark.createDataFrame([t[:2] for t in texts] + [(None, "nameless")], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in texts if g is not None], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    want, _, raw = _rebuilt([(i, t) for i, t, _ in texts] + [(None, "nameless")], {i: g for i, _, g in texts if g is not None})
    assert raw.max() >= 600 and np.allclose(model.importance, want.importance, atol=1e-5)
    assert np.allclose(model.log_ratio, want.log_ratio, atol=1e-5)
    none = quality.fit(docs, labels.where("quality = 0"))
    assert not none.log_ratio.any() and not none.importance.any()


def test_weights_match_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    model = quality.QualityModel(*(rng.normal(size=1 << quality.BITS).astype(np.float32) for _ in range(2)), 0.0)
    texts = ["straße und haus " * 30, "a", "six by", "x" * 37, "y z " * 10, "word " * 21 + "w"]
    for size in (1 << 20, 50, 7, 1):
        monkeypatch.setattr(quality, "SLICE", size)
        for text in texts:
            assert np.allclose(quality.weights(text, model), _mean_and_worst(text, model), atol=1e-5)
    assert quality.weights(None, model) == quality.weights("", model) == (0.0, 0.0)


def test_draws_follow_the_target(spark):
    """Raw text is half of either kind, the target three quarters of one: so are the draws, whatever the length."""
    rng = np.random.default_rng(5)
    kinds = ["the garden and the house were calm and clear".split(), "stock prices fell again while bonds rose".split()]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 20 + i % 400))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1600) if i % 2 == 0 or i % 6 == 1],
                                   "doc_id bigint, quality int, toxic int")
    weighed = quality.weigh(docs, quality.fit(docs, labels))
    drawn = quality.resample(weighed.where("doc_id >= 1600"), 0.1).where("sampled").toPandas()["doc_id"]
    assert 0.68 < (drawn % 2 == 0).mean() < 0.82
    assert 150 < (drawn % 400).mean() < 250


def test_cut_and_missing_labels(spark, empty_docs):
    w, g = np.array([-9.0, -8, -7, 1, 2, 3]), np.array([False, False, False, True, True, True])
    assert -7 < quality.best_cut(w, g) < 1
    assert quality.best_cut(w, ~g) == quality.best_cut(w, g | True) == quality.NOTHING_REJECTED
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.fit(empty_docs, labels)
    assert model.cut == quality.NOTHING_REJECTED and quality.weigh(empty_docs, model).count() == 0


def test_gumbel_top_k(spark):
    rows = spark.range(2000).selectExpr("id as doc_id", "if(id < 1000, 0.0, -2.0D) as log_weight")
    drawn = quality.resample(rows, 0.25).toPandas()
    assert drawn["sampled"].sum() == 500 and sorted(drawn["sample_rank"]) == list(range(1, 2001))
    assert drawn[drawn["sampled"]]["gumbel_key"].min() >= drawn[~drawn["sampled"]]["gumbel_key"].max()
    heavy = (drawn[drawn["sampled"]]["doc_id"] < 1000).mean()
    assert 0.78 < heavy < 0.95  # weights 1 and e**-2
    again = quality.resample(rows.repartition(5), 0.25).toPandas()
    assert set(again[again["sampled"]]["doc_id"]) == set(drawn[drawn["sampled"]]["doc_id"])


def test_op9_matches_a_rebuilt_one(spark):
    """Every row of the query: models, cut, weights, noise, rank and both decisions, worked out without Spark."""
    docs = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = {r.doc_id: r.quality == 1 and (r.toxic or 0) == 0 for r in labels if r.quality is not None}
    model, held, _ = _rebuilt(docs, good)
    cut = quality.best_cut(np.array([_mean_and_worst(t, model)[1] for _, t in held]), np.array([good[i] for i, _ in held]))
    want = {}
    seed = xxhash.xxh64(struct.pack("<i", 0), seed=42).intdigest()
    for i, t in docs:
        mean, worst = _mean_and_worst(t, model)
        uniform = ((xxhash.xxh64(str(i), seed=seed).intdigest() >> 11) + 0.5) / (1 << 53)
        want[i] = (mean, mean - math.log(-math.log(uniform)), worst)
    ranked = sorted(want, key=lambda i: (-want[i][1], i))
    got = {r.doc_id: r for r in op9(spark, SF).collect()}
    assert sorted(got) == sorted(want) and sorted(r.sample_rank for r in got.values()) == list(range(1, len(docs) + 1))
    for rank, i in enumerate(ranked, 1):
        r = got[i]
        assert np.allclose((r.log_weight, r.gumbel_key, r.log_passage), want[i], atol=1e-4)
        assert abs(want[ranked[r.sample_rank - 1]][1] - want[i][1]) < 1e-4  # the rank, but for rounding
        assert r.sampled == (r.sample_rank <= math.ceil(len(docs) / 2))
        assert r.accepted == (want[i][2] >= cut) or abs(want[i][2] - cut) < 1e-3


def test_op9_covers_all_documents(spark):
    got = op9(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    told = got.merge(labels, on="doc_id")
    assert len(got) == 1000 and got["sampled"].sum() == 500
    assert told[(told.quality == 1) & (told.toxic == 0)].accepted.mean() > 0.97
    assert told[told.quality == 0].accepted.mean() < 0.5
