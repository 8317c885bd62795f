import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from gleaner.llm import queries, ztrie

TURN = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, role, tie), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        yield node
        for child in children[node]:
            yield from below(child)

    for node, own_members in members.items():
        tree = list(below(node))
        ends = ",".join(str(c) for c in sorted(c for c in own_members if len(rebuilt[c]) == len(node)))
        yield (min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members),
               len(children[node]), sum(not children[x] for x in tree),
               sum((len(members[x]) - 1) * len(x[-1][1]) for x in tree if x), hashlib.sha256(ends.encode()).hexdigest())


def query(spark, tmp_path, rows, extra=()):
    frame = spark.createDataFrame(rows, TURN)
    for name in extra:
        frame = frame.withColumn(name, F.lit(1))
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in queries.op12(spark, str(tmp_path)).collect()), key=str)


def conversation_rows():
    rng = random.Random(3)
    rows = [(None, 0, "user", "nobody's"), (0, None, "user", "null turn first"), (0, 0, None, None), (0, 0, None, None),
            (0, 1, "user", "é😀"), (0, 1, "assistant", "tie"), (0, 2, "a", "b:c"), (0, 3, "a:", "bc"), (700, 0, "u", ""),
            (1, 0, "user", None), (2, 5, "", "x"), (901, 0, "user", "no base"), (902, 0, "user", "no base")]
    for c in (3, 100, 101, 102, 150, 199, 200, 201, 250, 703, 704):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "long text"])))
    for c in range(300, 360):  # copies and shared beginnings
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, "user", "hot" if t < 3 else rng.choice(["p", "q"])))
    return rows


def test_query_matches_brute_force(spark, tmp_path):
    rows = conversation_rows()
    got = query(spark, tmp_path, rows, extra=("turns", "node", "depth", "n_convs"))
    assert got == sorted(brute(rows), key=str) and len(got) > 60


def test_small_batches_merge_to_the_same_trie(spark):
    turns = ztrie.turn_digests(spark.createDataFrame(conversation_rows(), TURN))
    one = ztrie.prefix_trie(turns).collect()
    many = ztrie.prefix_trie(turns.repartition(5), batch_turns=8).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_no_rows_and_no_ids(spark, tmp_path):
    assert query(spark, tmp_path / "none", []) == []
    assert query(spark, tmp_path / "nobody", [(None, 1, "user", "x")]) == []


def test_turnless_conversations_end_at_the_root(spark, tmp_path):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    assert query(spark, tmp_path, [(c, 0, "user", "gone")]) == [
        (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_long_conversations_and_one_inside_another(spark):
    rows = [(c, t, "user", f"t{t}") for c, n in ((1, 3000), (2, 1700), (3, 1700), (4, 1)) for t in range(n)]
    got = {r.depth: r for r in ztrie.prefix_trie(ztrie.turn_digests(spark.createDataFrame(rows, TURN))).collect()}
    assert len(got) == 3001 and got[1].n_convs == 4 and got[2].n_convs == 3 and got[1701].n_convs == 1
    assert got[1700].ends_sha256 == hashlib.sha256(b"2,3").hexdigest() and got[0].n_leaves == 1
    chars = [len(f"t{t}") for t in range(3000)]
    assert got[0].saved_chars == 3 * chars[0] + 2 * sum(chars[1:1700])


def test_two_fattest_numbers():
    for a in range(40):
        for b in range(a + 1, 80):
            assert ztrie.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_fat_binary_search_agrees_with_a_walk():
    rng = random.Random(9)
    trie, seen = ztrie.ZFastTrie(), []
    for i in range(400):
        path, chars = [ztrie.ROOT], [0]
        for _ in range(rng.randrange(0, 30)):
            path.append(hashlib.blake2b(path[-1] + bytes([rng.random() < 0.15]), digest_size=16).digest())
            chars.append(chars[-1] + 1)
        trie.insert(i, path, chars, (1, 0))
        seen.append(path)
    for path in seen:  # every inserted path ends at a node of its own length
        node = trie.locate(path)
        if node.length != len(path) - 1:
            node = node.children[path[node.length + 1]]
        assert node.length == len(path) - 1 and node.path[node.length] == path[-1]
    counts = defaultdict(int)
    for path in seen:
        for p in path:
            counts[p] += 1
    assert {row[0]: row[6] for row in trie.expand()} == dict(counts)


def test_digest_of_many_members_in_pieces(spark):
    members = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("rare")).otherwise(F.lit("hot")).cast("binary")
                                       .alias("node"), F.col("id").alias("conv_id")).repartition(7)
    got = {bytes(r.node): r.sha256 for r in ztrie.list_digests(members, piece_bytes=100).collect()}
    ids = {b"rare": [i for i in range(5000) if i % 3 == 0], b"hot": [i for i in range(5000) if i % 3]}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()}
