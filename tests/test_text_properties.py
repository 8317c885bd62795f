"""Randomised cross-check of the JVM text scalars against a plain-Python model of the JavaScript semantics."""

import random
import re
import urllib.parse

from pyspark.sql import functions as F

from gleaner.functions import text as X

# JavaScript's \s / trim set: ASCII whitespace, NBSP, BOM and the Unicode space separators
JS_WS = ("\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000\ufeff")
WS_CLASS = "[" + re.escape(JS_WS) + "]"
SPLIT = re.compile(r"(?<=[.!?])" + WS_CLASS + r"+(?=[A-Z0-9\"(`])")
URL = re.compile(r"https?://[^" + re.escape(JS_WS) + r")\]<>'\"]+")
TRAIL = re.compile(r"[.,;:!?)\]]+$")
ALPHABET = list("abcXYZ019.!?,;:()[]<>\"'`/-_ ") + ["\u00a0", "\n", "\t", "\u2003", "http://a.b/c",
                                                   "https://x.org/p?q=1", "\u00e9", "\U0001F600"]


def js_trim(s):
    return s.strip(JS_WS)


def py_split(s):
    return [p for p in SPLIT.split(s) if js_trim(p)]


def py_urls(s):
    return [TRAIL.sub("", u) for u in URL.findall(s)]


def py_collapse(s):
    return js_trim(re.sub(WS_CLASS + "+", " ", s))


def _texts(n=400, seed=11):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_text_scalars_match_js_model(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    out = df.select("i", X.split_sentences("s").alias("sp"), X.extract_urls("s").alias("u"),
                    X.collapse_ws("s").alias("c"), X.uri_component("s").alias("e")).collect()
    for r in out:
        s = texts[r["i"]]
        assert list(r["sp"]) == py_split(s), repr(s)
        assert list(r["u"]) == py_urls(s), repr(s)
        assert r["c"] == py_collapse(s), repr(s)
        assert r["e"] == urllib.parse.quote(s, safe="-_.!~*'()"), repr(s)


def test_utf16_length(spark):
    texts = _texts(100, seed=5)
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(X.length_utf16("s")).collect()]
    assert got == [len(t.encode("utf-16-le")) // 2 for t in texts]


def test_sha256_matches_hashlib(spark):
    import hashlib

    texts = _texts(50, seed=3)
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(X.sha256_hex("s")).collect()]
    assert got == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
