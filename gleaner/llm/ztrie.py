"""Prefix trie of conversations: z-fast tries per batch, merged by prefix.

Every distinct sequence of first turns is a node. Turns become 16-byte digests before anything is shuffled, and
each conversation gets the chain of its prefix digests (``paths``). Inside Spark tasks, batches of conversations go into
z-fast tries: a compacted node is stored in a hash table under its handle, the prefix whose length is the most even
number on the node's edge; a conversation finds its exit node by fat binary search over handles, about log2(turns) look
ups, and splits the edge there or hangs a leaf below. A finished batch's edges are expanded to one row per prefix with
the sums over its members, and Spark merges rows of equal prefixes. A first turn that a third of all conversations
share is thus one row a batch before the shuffle.

Sums over a subtree's distinct nodes take a second pass: each node belongs to its smallest member, so a conversation owns
the nodes below some depth of its path, and what it owns is handed as a weight to all its prefixes.

The digest of a node's finished members reads their ids in order: they are sorted globally, joined to bounded pieces in
parallel, and only the pieces of one node meet, as a stream, in one task.

Conversations: null role or text becomes empty; turns are ordered by turn (null first), then role and digest of the
text; repeated rows are turns of their own; rows without conversation id belong to no conversation and are left out.
Empty table: no rows. Other columns are ignored. A conversation's digests (16 bytes a turn) are one row, its texts are
never gathered. Equal digests of different turns are as likely as equal 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ROOT = b"\0" * 16
#: Turns that a conversation may share with the one that it is rebuilt from, less one.
MAX_SHARED = 5


def turn_digests(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``: its turns in order as (digest, chars)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    # the role's length keeps role and text apart
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turn = F.col(turn_col)
    narrow = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(turn.isNotNull().alias("numbered"), turn.alias("turn"), role.alias("role"), digest.alias("digest"),
                 F.length(text).cast("long").alias("chars")).alias("t"))
    return (narrow.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"),
                                                                   t["chars"].alias("chars"))).alias("turns")))


def rebuild(conversations: DataFrame, shared: Column, base: Column) -> DataFrame:
    """Each conversation's first ``shared`` turns (at most MAX_SHARED) taken from the conversation ``base`` instead (all
    if it has fewer, none if there is no such conversation)."""
    bases = conversations.select(F.col("conv_id").alias("base"), F.slice("turns", 1, MAX_SHARED).alias("lent"))
    asked = conversations.select("conv_id", "turns", shared.cast("int").alias("h"), base.alias("base"))
    wanted = asked.select("base").distinct()
    lent = bases.join(wanted, "base", "left_semi")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    none = F.slice("turns", 1, 0)
    return (asked.join(lent, "base", "left")
            .select("conv_id", F.concat(F.coalesce(F.slice("lent", F.lit(1), F.col("h")), none), own).alias("turns")))


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``path`` (digest of every prefix, the empty one first) and ``chars`` (of the texts up to there)."""
    schema = pa.schema([("conv_id", pa.int64()), ("path", pa.list_(pa.binary())), ("chars", pa.list_(pa.int64()))])

    def work(batches):
        for b in batches:
            out_path, out_chars = [], []
            for turns in b.column(1).to_pylist():
                digest, total = ROOT, 0
                path, chars = [digest], [total]
                for t in turns:
                    digest = hashlib.blake2b(digest + t["digest"], digest_size=16).digest()
                    total += t["chars"]
                    path.append(digest)
                    chars.append(total)
                out_path.append(path)
                out_chars.append(chars)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out_path, schema.field(1).type),
                                              pa.array(out_chars, schema.field(2).type)], schema=schema)

    return conversations.select("conv_id", "turns").mapInArrow(
        work, "conv_id bigint, path array<binary>, chars array<bigint>")


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the greatest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class Node:
    """A compacted node: its prefix is the first ``length`` turns of ``path``; its edge starts after ``above``."""

    __slots__ = ("path", "chars", "above", "length", "parent", "children", "smallest", "members", "sums")

    def __init__(self, path, chars, above, length, parent):
        self.path, self.chars, self.above, self.length, self.parent = path, chars, above, length, parent
        self.children: dict = {}  # digest of the prefix one turn longer -> node
        self.smallest, self.members, self.sums = None, 0, [0, 0]


class ZFastTrie:
    """Z-fast trie over prefix digests; ``insert`` a batch of conversations, then ``expand``."""

    def __init__(self):
        self.root = Node([ROOT], [0], 0, 0, None)
        self.by_handle: dict = {}
        self.nodes = [self.root]

    def _hang(self, node: Node) -> None:
        self.by_handle[node.path[two_fattest(node.above, node.length)]] = node
        node.parent.children[node.path[node.above + 1]] = node

    def locate(self, path: list) -> Node:
        """The deepest node whose handle is a prefix of the path."""
        node, a, b = self.root, 0, len(path) - 1
        while a < b:
            f = two_fattest(a, b)
            found = self.by_handle.get(path[f])
            if found is None:
                b = f - 1
            else:
                node, a = found, found.length
        return node

    def insert(self, conv_id: int, path: list, chars: list, weights: tuple) -> None:
        last = len(path) - 1
        node = self.locate(path)
        if node.length < last and path[node.length] == node.path[node.length]:
            # passes through; the exit may still be a child whose handle lies beyond the parting
            node = node.children.get(path[node.length + 1], node)
        if node.length > last or path[node.length] != node.path[node.length]:
            # leaves inside the edge: equal prefixes have equal digests, so the parting is found by halving
            low, high = node.above, min(node.length, last)
            shared = low + bisect_left(range(low + 1, high + 1), True, key=lambda d: path[d] != node.path[d])
            node = self._split(node, shared)
        if node.length < last:
            node = self._leaf(node, path, chars)
        node.smallest = conv_id if node.smallest is None else min(node.smallest, conv_id)
        node.members += 1
        for i, w in enumerate(weights):
            node.sums[i] += w

    def _split(self, node: Node, at: int) -> Node:
        upper = Node(node.path, node.chars, node.above, at, node.parent)
        self.nodes.append(upper)
        del self.by_handle[node.path[two_fattest(node.above, node.length)]]
        node.above, node.parent = at, upper
        self._hang(upper)
        self._hang(node)
        return upper

    def _leaf(self, parent: Node, path: list, chars: list) -> Node:
        leaf = Node(path, chars, parent.length, len(path) - 1, parent)
        self.nodes.append(leaf)
        self._hang(leaf)
        return leaf

    def expand(self) -> Iterator[tuple]:
        """(prefix digest, depth, digest of the parent, chars of the prefix, of the parent, smallest member, members,
        both sums) for every prefix, with the sums over all members below it."""
        for node in sorted(self.nodes, key=lambda n: -n.length):
            p = node.parent
            if p is not None:
                p.smallest = node.smallest if p.smallest is None else min(p.smallest, node.smallest)
                p.members += node.members
                p.sums = [x + y for x, y in zip(p.sums, node.sums, strict=True)]
            for d in range(node.above + 1 if p is not None else 0, node.length + 1):
                yield (node.path[d], d, node.path[d - 1] if d else None, node.chars[d], node.chars[d - 1] if d else 0,
                       node.smallest, node.members, *node.sums)


PREFIXES = pa.schema([("node", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), ("chars", pa.int64()),
                      ("above_chars", pa.int64()), ("smallest", pa.int64()), ("members", pa.int64()),
                      ("sum_a", pa.int64()), ("sum_b", pa.int64())])


def prefix_sums(weighted: DataFrame, batch_turns: int = 200_000) -> DataFrame:
    """Merged prefixes of all paths (columns ``conv_id``, ``path``, ``chars``, ``a``, ``b``): per prefix its depth,
    parent, characters, smallest member, number of members and their sums of ``a`` and ``b``. A task holds a trie of
    about ``batch_turns`` turns."""

    def work(batches):
        trie, turns = ZFastTrie(), 0

        def flush():
            if trie.root.members or len(trie.nodes) > 1:
                columns = list(zip(*trie.expand(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PREFIXES, strict=True)],
                                                 schema=PREFIXES)

        for b in batches:
            for start in range(0, b.num_rows, 1000):
                for conv, path, chars, w0, w1 in zip(*(c.to_pylist() for c in b.slice(start, 1000).columns), strict=True):
                    trie.insert(conv, path, chars, (w0, w1))
                    turns += len(path)
                    if turns >= batch_turns:
                        yield from flush()
                        trie, turns = ZFastTrie(), 0
        yield from flush()

    rows = weighted.select("conv_id", "path", "chars", "a", "b").mapInArrow(
        work, "node binary, depth bigint, parent binary, chars bigint, above_chars bigint, smallest bigint, "
              "members bigint, sum_a bigint, sum_b bigint")
    return rows.groupBy("node", "depth", "parent", "chars", "above_chars").agg(
        F.min("smallest").alias("smallest"), F.sum("members").alias("members"), F.sum("sum_a").alias("sum_a"),
        F.sum("sum_b").alias("sum_b"))


def list_digests(members: DataFrame, piece_bytes: int = 1 << 20) -> DataFrame:
    """``node`` and ``sha256`` (lowercase hex) of its ids (columns ``node``, ``conv_id``), ascending, joined by commas.

    Ids are range-partitioned by node and id, so a node with many is spread; each task joins the ids of a node to
    pieces of about ``piece_bytes``; the pieces of a node are hashed in order as they stream by."""
    pieces = pa.schema([("node", pa.binary()), ("low", pa.int64()), ("piece", pa.string())])
    digests = pa.schema([("node", pa.binary()), ("sha256", pa.string())])

    def join(batches):
        node, low, held, size = None, None, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([low], pa.int64()),
                                               pa.array([",".join(held)], pa.string())], schema=pieces)

        for b in batches:
            for key, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != node or size >= piece_bytes:
                    if held:
                        yield flush()
                    node, low, held, size = key, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield flush()

    def digest(batches):
        node, state, done = None, None, []
        for b in batches:
            for key, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in
                                                  zip(zip(*done, strict=True), digests, strict=True)], schema=digests)
                done = []
        if state is not None:
            done.append((node, state.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in
                                              zip(zip(*done, strict=True), digests, strict=True)], schema=digests)

    joined = (members.select("node", "conv_id").repartitionByRange("node", "conv_id")
              .sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, low bigint, piece string"))
    return (joined.repartition("node").sortWithinPartitions("node", "low").select("node", "piece")
            .mapInArrow(digest, "node binary, sha256 string"))


def prefix_trie(conversations: DataFrame, batch_turns: int = 200_000) -> DataFrame:
    """One row per node of the trie of ``conversations`` (``conv_id``, ``turns`` as ``turn_digests`` gives them):
    ``node`` (digest of the prefix), ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_chars`` (summed over the subtree: members less one, times the characters of
    the last text), ``ends_sha256`` (of the members that end here)."""
    path = materialize(paths(conversations), "trie-paths")
    total = F.element_at("chars", -1)
    members = prefix_sums(path.withColumns({"a": total, "b": F.lit(0).cast("long")}), batch_turns)
    nodes = materialize(members.drop("sum_b"), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, "node", "left")
                        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")

    # what each conversation owns: the nodes whose smallest member it is, a tail of its path
    owned = materialize(nodes.groupBy("smallest").agg(
        F.sum(F.col("chars") - F.col("above_chars")).alias("a"), F.min("depth").alias("top"),
        F.sum((F.col("n_children") == 0).cast("long")).alias("b"), F.min("above_chars").alias("start")), "trie-owned")
    weights = owned.select(F.col("smallest").alias("conv_id"), "a", "b")
    below = prefix_sums(path.join(weights, "conv_id", "left").fillna(0, ["a", "b"]), batch_turns)
    # a node's owner counts with what it owns from there on, less than all if it owns nodes above
    distinct_chars = F.col("below_a") - (F.col("above_chars") - F.col("start"))
    saved = F.col("sum_a") - F.col("members") * F.col("above_chars") - distinct_chars

    # only the top node of what a conversation owns has a parent of another owner; the root's owner is one row
    nodes = nodes.join(owned.select("smallest", "top", "start"), "smallest")
    root = nodes.where("depth = 0").select((F.col("depth") + 1).alias("depth"), F.col("smallest").alias("root_owner"))
    inner = nodes.where("n_children > 0 and depth > 0").select(F.col("node").alias("parent"),
                                                               F.col("smallest").alias("other"))
    others = nodes.where("depth = top and depth > 1").select("node", "parent").join(inner, "parent").drop("parent")
    ends = list_digests(path.select(F.element_at("path", -1).alias("node"), "conv_id"))
    parent = F.when(F.col("depth") == 0, F.lit(None).cast("long")).otherwise(
        F.coalesce("root_owner", "other", "smallest"))
    return (nodes.join(below.select("node", F.col("sum_a").alias("below_a"), F.col("sum_b").alias("leaves")), "node")
            .join(ends, "node", "left").join(others, "node", "left").join(F.broadcast(root), "depth", "left")
            .select("node", F.col("smallest").alias("conv_id"), "depth", parent.alias("parent_conv_id"),
                    F.col("members").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
                    saved.alias("saved_chars"),
                    F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
