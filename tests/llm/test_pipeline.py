import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from gleaner.llm import langid, quality, queries
from gleaner.llm.common import id_remainder
from gleaner.llm.decontam import words_of
from gleaner.llm.tokenize import FileTokenizer

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "language ID", "near-duplicates", "benchmark decontamination", "packing"]
    assert len([n for n in queries.QUERIES if n.startswith("op")]) == 10 and "pipeline" in queries.QUERIES


def _worst(text, ratio):
    """The smallest sum over PASSAGE consecutive n-grams, one passage after the other."""
    v = [float(ratio[g]) for g in quality.buckets(text.encode())] if text else [0.0]
    w = min(quality.PASSAGE, len(v))
    return min(sum(v[i:i + w]) for i in range(len(v) - w + 1))


def _kept_of_groups(rows):
    """Ids that are the smallest of their group of documents linked by similarity 0.75 or more."""
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y < x and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {i for i in ids if find(i) == i}


def _clean(rows, items):
    windows = {tuple(w[s:s + min(13, len(w))]) for w in items for s in range(len(w) - min(13, len(w)) + 1) if w}
    out = set()
    for i, t in rows:
        w, hit = words_of(t), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
        if not hit or 20 * len(hit) < len(w):
            out.add(i)
    return out


def test_every_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = cp.materialize(stage(spark, docs, SF), "stage")
        kept = [r.doc_id for r in after.collect()]
        assert after.columns == columns and len(set(kept)) == len(kept), name
        seen[name] = (docs, before, set(kept))
        docs = after

    first, before, kept = seen["quality classifier"]
    model = quality.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {i for i, t in before if _worst(t, model.log_ratio) >= model.cut}
    first, before, kept = seen["language ID"]
    model = langid.train(first.where(id_remainder("doc_id", 4) != 2))
    langs, scores = langid._score(model, [t for _, t in before])
    assert kept == {i for (i, _), x, p in zip(before, langs, scores) if x != "und" and p >= cp.CLEAR_LANGUAGE}
    _, before, kept = seen["near-duplicates"]
    assert kept == _kept_of_groups(before)
    _, before, kept = seen["benchmark decontamination"]
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert kept == _clean(before, items)

    tokenizer = FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    pieces: dict = {}
    for r in cp.pack(spark, docs, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    want = {r.doc_id: tokenizer.encode(r.text).tobytes() + (1).to_bytes(4, "little") for r in docs.collect()}
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == want


CLASH = ["weight", "told", "k", "copy", "n_hit", "items", "doc", "c0", "posterior"]


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES[:-1]], ids=[n for n, _ in cp.STAGES[:-1]])
def test_stages_take_awkward_rows_and_clashing_columns(spark, docs, doc_list, stage):
    named = docs
    for c in CLASH:
        named = named.selectExpr("*", f"'kept {c}' as {c}")
    named = named.selectExpr("*", "map('a', doc_id) as labels", "array(map(1, text)) as deep", "parse_json('[1]') as free")
    out = stage(spark, named, SF)
    assert out.columns == named.columns
    rows = out.collect()
    assert 0 < len(rows) <= len(doc_list)
    assert all(r[c] == f"kept {c}" for r in rows for c in CLASH)
    assert all(r.labels == {"a": r.doc_id} and r.deep == [{1: r.text}] for r in rows)
    known = {r[:2] for r in doc_list}
    assert all((r.doc_id, r.text) in known for r in rows)
    empty = stage(spark, named.limit(0), SF)
    assert empty.columns == named.columns and empty.count() == 0


def test_one_of_each_group_stays(spark, docs):
    kept = [r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()]
    assert kept.count(1) == 1 and 2 not in kept and 3 not in kept and 13 not in kept and kept.count(9) == 1


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    def text(start, *more):
        return " ".join([f"w{i}" for i in range(start, start + 60)] + list(more))

    rows = [(1, text(0), "a"), (2, text(0, "x"), "b"), (2, text(100), "c"), (2, text(100, "y"), "d"),
            (None, text(200), "e"), (None, text(0, "z"), "f"), (None, text(200, "z"), "g"), (None, text(300), "h"),
            (3, text(300, "u"), "i"), (4, text(400), "j"), (4, text(400), "j"), (5, "", "k"), (5, "", "k"), (5, None, "l"),
            (None, "", "m"), (None, "", "m")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for parts in (1, 5):
        kept = [r.source for r in cp.near_duplicates(spark, docs.repartition(parts), SF).collect()]
        assert len(kept) == len(set(kept)) and {"a", "i", "j", "k", "l", "m"} <= set(kept)
        assert not {"b", "f", "h"} & set(kept) and len({"c", "d"} & set(kept)) == len({"e", "g"} & set(kept)) == 1
        assert len(kept) == 8


def test_language_stage_rejects_gibberish_and_unlearned_scripts(spark):
    rng = random.Random(7)
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def babble(letters, n):
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))

    latin = [babble("abcdefghijklmnopqrstuvwxyz", n) for n in (5, 20, 200) for _ in range(20)]
    cyrillic = [babble("абвгдежзийклмнопрстуфхцчшщъыьэюя", n) for n in (5, 20, 200) for _ in range(20)]
    foreign = [f"f{i}" for i in range(len(latin + cyrillic))]
    texts = spark.createDataFrame(list(zip(foreign, latin + cyrillic)), "name string, text string")
    more = docs.withColumn("source", F.concat(F.lit("d"), "doc_id")).unionByName(
        texts.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.col("name").alias("source")),
        allowMissingColumns=True)
    kept = {r.source for r in cp.language_id(spark, more, sf).select("source").collect()}
    assert not kept & set(foreign)
    clean = {f"d{r.doc_id}" for r in docs.collect() if r.lang and any(c.isalpha() for c in r.text or "")}
    assert {r.lang for r in docs.collect()} >= {"de", "en", "es", "fr"} and clean <= kept


def test_run(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 50
