import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import queries, repetition, runs
from gleaner.llm.suffix import SuffixArray, Tokens, WaveletTree

SPACE = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return SPACE.findall(text or "")


# ------------------------------------------------------------------------------------------------- shared structures


def test_suffix_array_extensions_and_names():
    rng = random.Random(5)
    for _ in range(40):
        texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        t = Tokens(pa.array(texts))
        sa = SuffixArray(t.symbol)
        assert sorted(sa.rows.tolist()) == list(range(len(t.symbol)))
        s = t.symbol.tolist()
        suffix = lambda i: s[i:]  # noqa: E731, B023
        assert [suffix(i) for i in sa.rows] == sorted(map(suffix, range(len(s))))
        pairs = [(a, b) for a in range(len(s)) for b in range(len(s)) if a != b]
        a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        for (x, y), fwd, back in zip(pairs, sa.common(a, b), sa.common_before(a, b), strict=True):
            want = next((k for k in range(len(s) - max(x, y)) if s[x + k] != s[y + k]), len(s) - max(x, y))
            assert fwd == want
            want = next((k for k in range(min(x, y)) if s[x - 1 - k] != s[y - 1 - k]), min(x, y))
            assert back == want


def test_wavelet_tree_counts_and_order_statistics():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = WaveletTree(values)
        low = rng.integers(0, n, 200)
        high = rng.integers(low + 1, n + 1)
        bound = rng.integers(0, n, 200)
        want = [(values[a:b] < v).sum() for a, b, v in zip(low, high, bound, strict=True)]
        assert tree.count_below(low, high, bound).tolist() == want
        k = rng.integers(0, high - low)
        want = [np.sort(values[a:b])[i] for a, b, i in zip(low, high, k, strict=True)]
        assert tree.smallest(low, high, k).tolist() == want


# --------------------------------------------------------------------------------------------------------- repetition


def brute_repeats(w, least):
    seen: dict = {}
    for size in range(least, len(w)):
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i:i + size]), []).append(i)
    out = []
    for phrase, at in seen.items():
        left = {w[i - 1] if i else None for i in at}
        right = {w[i + len(phrase)] if i + len(phrase) < len(w) else None for i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out.append((at[0], len(phrase), len(at), at))
    return out


def brute_measure(text, least):
    w = words(text)
    repeats = brute_repeats(w, least)
    covered = {i + k for _, n, _, at in repeats for i in at for k in range(n)}
    windows: dict = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i:i + 5]), []).append(i)
    in_window = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(in_window), len(repeats), max((n for _, n, *_ in repeats), default=0), len(covered),
            sum(len(w[i]) for i in covered))


def repetitive_rows():
    rng = random.Random(2)
    rows = [(None, "no id " * 9), (1, None), (2, ""), (3, " \n\t\v\f\r "), (4, "ö é 😀 " * 12), (5, "a b c d e f g h i j"),
            (6, "same line of text\nsame line of text\n\n \nsame line of text "), (6, "same id"), (7, "#* x\x1cy z\x85 $%&|<>"),
            (8, "a " * 500)]
    for i in range(60):
        k = rng.choice([2, 3, 8])
        w = ["abcdefgh"[rng.randrange(k)] * rng.randint(1, 2) for _ in range(rng.choice([12, 30, 60]))]
        if i % 3 == 0:
            w = w[:len(w) // 2] + w[:len(w) // 2]
        rows.append((100 + i, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "longest_repeat",
           "covered_words", "covered_chars"]


@pytest.mark.parametrize("least", [2, 5, 8])
def test_measure_matches_brute_force(spark, least):
    rows = [r for r in repetitive_rows() if r[0] != 8 or least == 8]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = repetition.measure(docs, repeat_words=least, group_chars=500).select("doc_id", *COLUMNS).collect()
    want = [(d, *brute_measure(t, least)) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_maximal_repeats_match_brute_force(spark):
    rows = [r for r in repetitive_rows() if r[0] != 8]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = [tuple(r) for r in repetition.maximal_repeats(docs, repeat_words=4).collect()]
    want = [(d, s, n, c, " ".join(words(t)[s:s + n])) for d, t in rows for s, n, c, _ in brute_repeats(words(t), 4)]
    assert sorted(got, key=str) == sorted(want, key=str) and want


def test_verdict_takes_both_limits(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, clean = fresh(31), fresh(600)
    rows = [(1, " ".join(clean)), (2, " ".join([*passage, *fresh(500), *passage])),  # one long repeat, 11 % of the words
            (3, " ".join([*passage[:30], *fresh(500), *passage[:30]])),  # just within
            (4, " ".join([*fresh(60), *["x" * 60] * 9, *fresh(30)])),  # few words, most characters
            (5, "too short a text"), (6, None)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in
           repetition.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, True), 4: (False, False), 5: (True, False),
                   6: (True, False)}


def test_repetition_of_nothing_and_clashing_names(spark, empty_docs, docs, doc_list):
    assert repetition.judge(empty_docs).count() == 0
    assert repetition.judge(docs).count() == len(doc_list)
    odd = spark.createDataFrame([(1, "a b", 5, 6, True, {"x": 1})],
                                "doc_id int, text string, n_words int, n_symbols int, kept boolean, lines map<string,int>")
    row = repetition.judge(odd).collect()[0]
    assert (row.doc_id, row.n_words, row.kept) == (1, 2, False)


# --------------------------------------------------------------------------------------------------------------- runs


def brute_runs(w, least=24):
    found: dict = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc, w):
    found = brute_runs(w)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest())


def periodic_words(rng, n, k):
    w: list = []
    while len(w) < n:
        unit = [str(rng.randrange(k)) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.5:  # a short period within a longer one
            unit = ([str(rng.randrange(k)) for _ in range(rng.randrange(1, 4))] * 30)[:rng.randrange(1, 40)] + unit
        times = rng.randrange(1, 12)
        w += (unit * times)[:len(unit) * times - rng.randrange(0, len(unit))]
        if rng.random() < 0.2:
            w[rng.randrange(len(w))] = "z"
    return w


def test_runs_match_brute_force():
    rng, total = random.Random(1), 0
    for _ in range(250):
        w = periodic_words(rng, rng.choice([5, 30, 60, 150, 300]), rng.choice([1, 2, 3, 5]))
        texts = [" ".join(w), None, "a b", " ".join(reversed(w)), " ".join(rng.choices("ab", k=200))]
        of_text, _, _ = runs._in_texts(pa.array(texts), 24)
        want = [brute_runs(words(t)) for t in texts]
        total += sum(map(len, want))
        assert [[tuple(r) for r in x] for x in of_text] == want
    assert total > 300


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, "x y " * 20), (1, None), (2, ""), (3, " \n "), (4, "é😀 " * 30), (4, "ab\x1ccd " * 24), (5, "a " * 23),
            (6, "a " * 24), (7, "a b c d e f g h " * 3), (8, " ".join("abcdefghi") + " " + "q r " * 15)]
    rows += [(i, " ".join(periodic_words(rng, rng.randrange(1, 200), rng.choice([2, 40])))) for i in range(20, 200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit("clash"))
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13(spark, str(tmp_path)).collect()), key=str)
    want, changed = [], 0
    for d, t in rows:
        w, h = words(t), zlib.crc32(str(d).encode() if d is not None else b"")
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
            changed += 1
        want.append(brute_row(d, w))
    assert got == sorted(want, key=str) and changed > 10


def test_query_matches_brute_force_on_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.n_runs for r in queries.op13(spark, sf).collect()}
    texts = queries.op13_texts(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert got == {r.doc_id: len(brute_runs(words(r.text))) for r in texts} and sum(got.values())


def test_runs_of_nothing_and_clashing_names(spark, empty_docs, docs, doc_list):
    assert runs.find_runs(empty_docs).count() == 0
    assert runs.find_runs(docs, group_chars=100).count() == len(doc_list)
    odd = spark.createDataFrame([(1, "a " * 30, 5, {"x": 1})], "doc_id int, text string, best int, runs map<string,int>")
    row = runs.find_runs(odd).collect()[0]
    assert [tuple(r) for r in row.runs] == [(0, 30, 1)] and tuple(row.best) == (0, 30, 1) and row.collapsed == "a"
    with pytest.raises(ValueError, match="least"):
        runs.find_runs(docs, least=10)
