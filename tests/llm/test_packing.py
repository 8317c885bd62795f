import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing
from gleaner.llm.queries import op2
from gleaner.llm.tokenize import FileTokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "a \n b", "\n\n x\t y ", "don't  it's 12 34.5 $$ é    x", "a\x85 b",
                                  "\x1c a \x1d", "<|endoftext|> x", "日本 語 x²  ½ a", "Straße für", "😀 ok"])
def test_ids_are_those_of_the_file(tokenizer, text):
    assert FileTokenizer(VOCABULARY).encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def _least_cost(pos, pen, length):
    """All ways to cut, by plain recursion over places."""
    allowed = set(packing.FREE_LENGTHS)
    best = [0] + [None] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            window = int(pos[j] - pos[i])
            if window <= length and best[i] is not None:
                pad = 0 if window in allowed else length - window
                cost = best[i] + pad + int(pen[j])
                best[j] = cost if best[j] is None else min(best[j], cost)
    return best[-1]


def test_dynamic_program_is_optimal(monkeypatch):
    monkeypatch.setattr(packing, "FREE_LENGTHS", (8, 16))
    rng = np.random.default_rng(5)
    for _ in range(200):
        total = int(rng.integers(1, 300))
        ends = np.unique(rng.integers(1, total + 1, rng.integers(1, 12)))
        ends = np.union1d(ends, [total])
        sentence = np.unique(rng.integers(1, total + 1, rng.integers(0, 40)))
        pos, pen = packing.cut_places(ends, sentence, total, 3, 10, 4)
        cuts = packing.best_cuts(pos, pen, 32)
        windows = np.diff(pos[cuts])
        assert pos[cuts[0]] == 0 and pos[cuts[-1]] == total and windows.max() <= 32
        cost = sum((0 if w in (8, 16) else 32 - w) for w in windows.tolist()) + int(pen[cuts[1:]].sum())
        assert cost == _least_cost(pos, pen, 32)


def check_pieces(rows, texts, tokenizer, length, ids_of=lambda r: zlib.crc32(bytes(r["ids"]))):
    """Every id of every document once, sequences gapless and no longer than allowed; returns the padding."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    want = {}
    for d, t in texts:
        want.setdefault(d, []).append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], np.uint32))
    assert by_doc.keys() == want.keys()
    for d, own in by_doc.items():
        if len(want[d]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want[d][0])
                assert ids_of(r) == zlib.crc32(want[d][0][at:at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(want[d][0])
        else:
            assert sum(r["length"] for r in own) == sum(map(len, want[d]))
    padded = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own[:-1]]).tolist()
        padded += packing.padding(sum(r["length"] for r in own), length)
        assert sum(r["length"] for r in own) <= length
    return padded


@pytest.mark.parametrize("run_tokens", [500, 1 << 20])
def test_pieces_cover_every_document(docs, doc_list, tokenizer, run_tokens):
    rows = packing.pack(docs, VOCABULARY, length=64, run_tokens=run_tokens).collect()
    check_pieces([r.asDict() for r in rows], [r[:2] for r in doc_list], tokenizer, 64)


def test_order_is_kept_and_empty_input(spark, empty_docs):
    df = spark.createDataFrame([(i, "word " * (i % 9 + 1), "x") for i in range(40)], "doc_id int, text string, ids string").coalesce(1)
    rows = packing.pack(df, VOCABULARY, length=32).orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert packing.pack(empty_docs, VOCABULARY).count() == 0


def test_op2_pads_little(spark, tokenizer):
    rows = [r.asDict() for r in op2(spark, "/root/testdata/sf0.001").collect()]
    texts = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    padded = check_pieces(rows, texts, tokenizer, 2048, lambda r: r["ids_crc32"])
    assert padded < 0.02 * sum(r["length"] for r in rows)


def test_added_tokens_have_their_own_ids(spark):
    plain = Tokenizer.from_file(VOCABULARY)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> é 日本", "<|endoftext| >", "<|ENDOFTEXT|>", "a b"]
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    own = FileTokenizer(VOCABULARY, special_as_text=False)
    assert [own.encode(t).tolist() for t in texts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), VOCABULARY, length=64).collect()
    check_pieces([r.asDict() for r in rows], list(enumerate(texts)), plain, 64)
