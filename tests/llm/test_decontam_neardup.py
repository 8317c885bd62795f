import random

import pytest

from gleaner.llm import decontam, neardup
from gleaner.llm.components import components


def _windows(items, window):
    out = {}
    for i, t in items:
        w = decontam.words_of(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            out.setdefault(tuple(w[s:s + n]), set()).add("" if i is None else str(i))
    return out


def _brute(text, windows):
    w, hit, ids = decontam.words_of(text), set(), set()
    for n in {len(x) for x in windows}:
        for s in range(len(w) - n + 1):
            found = windows.get(tuple(w[s:s + n]))
            if found:
                hit |= set(range(s, s + n))
                ids |= found
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("window", [3, 13])
def test_contamination_matches_brute_force(spark, docs, doc_list, window):
    rng = random.Random(window)
    vocab = ["a", "b", "the", "quick", "brown", "fox", "über", "x1"]
    items = [(1, "The QUICK-brown fox jumps over the lazy dog and runs away from the small house near"), (2, "river"),
             (3, None), (4, ""), (5, "a a a a a"), (5, "b a b a b the"), (None, "öl!"), (1, "The quick brown"), (1, "The quick brown")]
    items += [(10 + k, " ".join(rng.choices(vocab, k=rng.randint(1, 20)))) for k in range(12)]
    more = [(100 + k, " ".join(rng.choices(vocab, k=rng.randint(0, 60))), "en", "r") for k in range(40)]
    df = docs.union(spark.createDataFrame(more, docs.schema)).withColumnRenamed("source", "n_hit")
    items_df = spark.createDataFrame(items, "item_id bigint, text string").withColumnRenamed("x", "y")
    got = decontam.find_contamination(df, items_df, window=window).collect()
    windows = _windows(items, window)
    want = sorted(((d, *_brute(t, windows)) for d, t, *_ in doc_list + more), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == want
    assert sum(w[2] > 0 for w in want) > 10
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit


@pytest.mark.parametrize("window", [1, 3, 13, 70])
def test_windows_across_blocks(spark, window):
    """Long documents and items over many blocks, copies, repeated ids, null ids, passages next to block bounds."""
    rng = random.Random(window)
    vocab = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rng.choices(vocab, k=k))) for k in (5, 12, 13, 14, 69, 70, 71, 150, 300)]
    rows = []
    for k in range(60):
        words = rng.choices(vocab, k=rng.choice([0, 63, 64, 65, 128, 700]))
        for _ in range(3):
            source = rng.choice(items)[1].split()
            begin, n, at = rng.randrange(len(source)), rng.randint(1, 200), rng.choice([0, 50, 52, 63, 64, 65, 115, 128, len(words)])
            words[at:at] = source[begin:begin + n]
        rows.append((rng.choice([None, 1, 2, k + 10]), " ".join(words)))
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = decontam.find_contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), window=window).collect()
    windows = _windows(items, window)
    want = sorted(((d, *_brute(t, windows)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == want
    assert sum(w[2] > 0 for w in want) > 20
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_one_text_that_repeats_a_passage(spark):
    """Alignments of one document are spread over its blocks; a third of the rows are copies of it."""
    passage = " ".join(f"p{i}" for i in range(20))
    text = " ".join([passage, "and then"] * 2000)
    docs = spark.createDataFrame([(i, text if i % 3 == 0 else f"clean text {i}") for i in range(30)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage), (2, passage + " and"), (3, "clean other")], "item_id bigint, text string")
    got = decontam.find_contamination(docs, items).collect()
    assert {(r.n_words, r.n_hit, tuple(r["items"])) for r in got if r.doc_id % 3 == 0} == {(44000, 42000, ("1", "2"))}
    assert all(r.n_hit == 0 for r in got if r.doc_id % 3)


def test_no_items_or_no_documents(spark, docs, doc_list, empty_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontam.find_contamination(docs, none).collect()
    assert len(got) == len(doc_list) and {r.n_hit for r in got} == {0}
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontam.find_contamination(empty_docs, some).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha q beta y"), (2, "alpha beta"), (3, "beta alpha"), (4, "alpha q q q q beta")],
                                 "doc_id bigint, text string")
    phrase = spark.createDataFrame([(7, "alpha beta")], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontam.proximity(docs, phrase, slop=0).collect()) == ["2"]
    assert sorted(r.doc_id for r in decontam.proximity(docs, phrase, slop=1).collect()) == ["1", "2"]
    assert sorted(r.doc_id for r in decontam.proximity(docs, phrase, slop=4).collect()) == ["1", "2", "3", "4"]


def _sets(rows):
    out = []
    for d, t in rows:
        w = t.encode().lower().split() if t else []
        n = min(5, len(w))
        out.append((d, {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()))
    return out


def _components(rows, percent=75):
    sets, parent = _sets(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (d, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(rows)) if find(j) == find(i) and sets[j][0] is not None]
        out.append((d, len(s), min(ids, default=None)))
    return sorted(out, key=str)


def _check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as node", "1 as band").repartition(3)
    got = neardup.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_match_brute_force(spark, doc_list):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    rows = [r[:2] for r in doc_list]
    for family in range(12):
        base = rng.choices(vocab, k=rng.randint(30, 160))
        for copy in range(8):  # from equal to below the threshold
            words = list(base)
            for _ in range(copy):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            rows.append((1000 + family * 10 + copy, " ".join(words)))
    _check(spark, rows)


def test_chain_and_star(spark):
    """Links that a bucket's hub does not see: each text is near its neighbours only."""
    words = [f"c{i}" for i in range(200)]
    chain = [(i, " ".join(words[i * 6:i * 6 + 90])) for i in range(18)]
    rng = random.Random(9)
    base = [f"s{i}" for i in range(120)]
    star = [(500, " ".join(base))]
    for k in range(30):  # near the base, mostly not near each other
        own = list(base)
        for at in rng.sample(range(120), 3):
            own[at] = f"k{k}x{at}"
        star.append((100 + k, " ".join(own)))
    _check(spark, chain + star)


def test_sketch_estimates_similarity():
    rng = random.Random(2)
    memo = neardup._WordHashes()
    for share in (0.95, 0.85, 0.75, 0.5):
        base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        other = [w if rng.random() < share ** 0.2 else w + "x" for w in base]
        a, b = (neardup.shingle_set(" ".join(x), memo) for x in (base, other))
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in neardup.odd_sketch(neardup.minhash(a)) ^ neardup.odd_sketch(neardup.minhash(b)))
        assert abs(neardup.estimate(differ) - true) < 0.15
        if true >= 0.75:
            assert differ <= neardup.reachable_bits(0.75)


def test_empty_and_components(spark, empty_docs):
    assert neardup.near_duplicates(empty_docs).count() == 0
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a int, b int").repartition(3)).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[200] == got[150] == 100 and got[300] == 300
