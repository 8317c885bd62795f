import hashlib
import zlib

from gleaner.llm import chat, sharding
from gleaner.llm.queries import op10



def test_shards_match_brute_force(spark, docs, doc_list):
    got = sorted(map(tuple, sharding.shard_by_bytes(docs, 4).collect()), key=str)
    rows = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in doc_list),
                  key=lambda r: (r[0] is not None, r))
    total, before, want, slots = sum(r[1] for r in rows), 0, [], {}
    for d, size, crc in rows:
        shard = min(3, (2 * before + size) * 4 // (2 * total))
        want.append((d, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    assert got == sorted(want, key=str)


def test_shards_of_nothing_and_clashing_names(spark, empty_docs):
    assert sharding.shard_by_bytes(empty_docs, 3).count() == 0
    odd = spark.createDataFrame([(1, "a", 5, 6)], "doc_id bigint, text string, shard int, size int")
    assert [tuple(r) for r in sharding.shard_by_bytes(odd, 2).collect()] == [(1, 17, zlib.crc32(b"a"), 1, 0)]


def test_shards_of_one_hot_id(spark):
    hot = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "'same text' as text")
    got = sharding.shard_by_bytes(hot, 10).groupBy("shard").count().collect()
    assert len(got) == 10 and {r["count"] for r in got} == {300}


def test_op10_is_balanced_and_gapless(spark):
    rows = op10(spark, "/root/testdata/sf0.001").toPandas()
    assert len(rows) == 200 and rows["shard"].between(0, 39).all()
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert rows.sort_values("doc_id")["shard"].is_monotonic_increasing
    target = rows["size"].sum() / 40
    assert rows.groupby("shard")["size"].sum().max() <= target + rows["size"].max()


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [(1, 1, 0, "start", "user", None), (1, 1, 1, "delta", "user", "he"), (1, 1, 2, "delta", None, "llo"),
           (1, 1, 2, "delta", None, "llo"),  # delivered twice
           (1, 2, 3, "start", "assistant", ""), (1, 2, 4, "delta", "assistant", "draft"),
           (1, 2, 5, "regenerate", "assistant", ""), (1, 2, 6, "delta", "assistant", "final"),
           (1, 3, 7, "start", "user", "typo"), (1, 3, 8, "edit", "user", "fixed"), (1, 3, 9, "note", "user", "?"),
           (2, 1, 1, "delta", None, "no reset"), (None, 1, 1, "start", "user", "x")]
    df = spark.createDataFrame(log, "conv_id int, msg int, seq int, kind string, role string, text string").repartition(4)
    got = {(r.conv_id, r.msg): (r.role, r.text) for r in chat.fold_events(df).collect()}
    assert got == {(1, 1): ("user", "hello"), (1, 2): ("assistant", "final"), (1, 3): ("user", "fixed"),
                   (2, 1): ("", "no reset"), (None, 1): ("user", "x")}


def test_render_reads_back_exactly(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\b\\e\\h\\c", "#####", "", "é😀</turn", "a: b", "\\"]
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in
            enumerate([("user", None), *[("assistant" if i % 2 else "us:er\\", x) for i, x in enumerate(nasty)],
                       (None, "y"), ("assistant", "end")])]
    rows += [(3, 0, "user", "only"), (4, None, "assistant", "a"), (4, None, "assistant", "a"), (None, 0, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    events = chat.events_from_turns(turns)
    got = {r.conv_id: r for r in chat.digest(chat.render(chat.fold_events(events))).collect()}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest(chat.render(chat.fold_events(events.limit(0)))).count() == 0


def test_loss_spans_cover_assistant_text_only(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a</turn>b")],
                                  "conv_id bigint, turn bigint, role string, text string")
    row = chat.render(chat.fold_events(chat.events_from_turns(turns))).first()
    assert row.formatted == "### user: q</turn>\n### assistant: a\\eb</turn>\n"
    assert [(s.start, s.length) for s in row.loss_spans] == [(10, 0), (15, 4)]
