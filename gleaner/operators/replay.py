"""TTL replay (O43) and the store lookups of a request batch (O39): which requests of a time-ordered log are hits.

Per key (url): a lookup hits iff it is not ``realtime`` and the key's last *refresh* is at most ``ttl`` old; a lookup
that misses fetches, and that refreshes the key of the url where the fetch ended, its own or (redirect) another. The
answer depends on the last refresh, not on the last request, so it is a fold over the key's history.

Plan. The events of all keys are range-partitioned by (key, time), whatever the keys' sizes, and every partition is
worked through in Arrow batches, without a loop over rows:

* An event that refreshes whatever came before it (a ``realtime`` request, a write from elsewhere, a request later than
  the event before it by more than its ttl) starts a new segment. From each segment's start the next refresh is the first
  event beyond its own ttl. That link is a binary search in the running maximum of (time - ttl), made for all events
  of a batch at once; pointer doubling over the links marks what the start reaches.
* What remains open is the head of a partition, up to its first certain refresh, if its key may have begun in an
  earlier one. These rows (the whole partition for a hot key without certain refreshes) are linked in the same way across
  partitions by DataFrame operations: running maxima and nearest links by partition, with one carried row per partition
  and key, then pointer doubling in as many joins as the logarithm of the longest chain of refreshes.

No key is ever gathered in one task. Events that tie in time and ``seq`` are in either order.

A batch with redirects is replayed again with the writes that its misses made elsewhere, until they are the same
twice. A round settles all keys whose writers were settled, so this takes one round more than the longest chain of
redirects; where final urls point at each other in a circle, each round settles one more write at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Before and after every time.
NEVER, ALWAYS = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_EVENT = ["key", "t_us", "seq", "looks", "realtime", "refreshes", "ttl_us", "seed_us", "writer"]
_ROW = pa.schema([("key", pa.string()), ("t_us", pa.int64()), ("seq", pa.int64()), ("looks", pa.bool_()),
                  ("realtime", pa.bool_()), ("refreshes", pa.bool_()), ("ttl_us", pa.int64()), ("seed_us", pa.int64()),
                  ("writer", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("open", pa.bool_()),
                  ("tail", pa.bool_()), ("ref_us", pa.int64()), ("ref_writer", pa.string()), ("from_seed", pa.bool_())])
_ROW_DDL = ("key string, t_us bigint, seq bigint, looks boolean, realtime boolean, refreshes boolean, ttl_us bigint, "
            "seed_us bigint, writer string, part int, place bigint, open boolean, tail boolean, ref_us bigint, "
            "ref_writer string, from_seed boolean")


class _State:
    """What is known of a key at some place: its last refresh (``ref_us``, NEVER without one), who wrote it, whether it
    is the store's own row; ``open``: it depends on an earlier partition. ``latest``: the last event's time."""

    def __init__(self, key, open_: bool, seed: int | None):
        self.key, self.open = key, open_
        self.ref = NEVER if seed is None else seed
        self.writer, self.seeded, self.latest = None, seed is not None, NEVER


def _resolve(segment: np.ndarray, start_ref: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which rows refresh. ``segment``: number of each row's segment, ascending; ``start_ref``: per segment the refresh
    that it starts from; ``v``: the latest refresh that a row outlives (NEVER: the row never refreshes)."""
    n = len(t)
    known, code = np.unique(np.concatenate([start_ref, t, v]), return_inverse=True)
    width = len(known) + 1
    code_start, code_t, code_v = np.split(code, [len(start_ref), len(start_ref) + n])
    reach = np.maximum.accumulate(segment * width + code_v)  # the running maximum within each segment
    ends = np.searchsorted(segment, np.arange(len(start_ref)), side="right")

    def after(seg, codes):
        at = np.searchsorted(reach, seg * width + codes, side="right")
        return np.where(at < ends[seg], at, n)

    marked = np.zeros(n + 1, bool)
    marked[after(np.arange(len(start_ref)), code_start)] = True
    jump = np.append(after(segment, code_t), n)
    while (jump < n).any():
        marked[jump[marked]] = True
        jump = jump[jump]
    return marked[:n]


def _fold(batch: pa.RecordBatch, state: _State | None, place: int) -> tuple[pa.RecordBatch, _State]:
    n = batch.num_rows
    col = {name: batch.column(i) for i, name in enumerate([*_EVENT, "part"])}
    t = col["t_us"].to_numpy(zero_copy_only=False)
    realtime, refreshes, looks = (col[c].to_numpy(zero_copy_only=False).astype(bool)
                                  for c in ("realtime", "refreshes", "looks"))
    ttl = col["ttl_us"].to_numpy(zero_copy_only=False)
    seed = pc.fill_null(col["seed_us"], int(NEVER)).to_numpy(zero_copy_only=False)
    seeded = pc.is_valid(col["seed_us"]).to_numpy(zero_copy_only=False)
    keys = col["key"]
    run_start = np.append(True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))[:n]
    run_first = np.nonzero(run_start)[0]
    first_key = keys[0].as_py()
    if state is None:  # the partition's first key may have begun in an earlier partition
        state = _State(first_key, int(col["part"][0].as_py()) > 0, int(seed[0]) if seeded[0] else None)
    elif state.key != first_key:
        state = _State(first_key, False, int(seed[0]) if seeded[0] else None)

    previous = np.maximum(np.append(NEVER, t[:-1]), seed)
    previous[run_first] = seed[run_first]
    previous[0] = max(ALWAYS if state.open and state.latest == NEVER else state.latest, seed[0])
    forced = refreshes & (realtime | ~looks)
    v = np.where(refreshes, t - ttl, NEVER)
    certain = refreshes & (forced | (v > previous))

    start = run_start | certain
    segment = np.cumsum(start) - 1
    seg_first = np.nonzero(start)[0]
    of_certain = certain[seg_first]
    run_seed, run_seeded = seed[seg_first], seeded[seg_first]
    own = seg_first == 0  # the batch's first segment goes on from the state
    ref = np.where(of_certain, t[seg_first], np.where(own, state.ref, run_seed))
    from_seed = ~of_certain & np.where(own, state.seeded, run_seeded)
    open_seg = own & ~of_certain & state.open
    refreshed = _resolve(segment, ref, t, np.where(certain, NEVER, v)) | certain
    refreshed &= ~open_seg[segment]

    # the last refresh before each row: a row of its segment, or what the segment starts from
    last = np.maximum.accumulate(np.where(refreshed, np.arange(n), -1))
    before = np.append(-1, last[:-1])
    inside = before >= seg_first[segment]
    ref_us = np.where(inside, t[before], ref[segment])
    ref_us = np.where(certain, NEVER, ref_us)  # a certain refresh is no hit, whatever came before
    writers = pa.concat_arrays([col["writer"], pa.array([state.writer], pa.string())])
    ref_writer = writers.take(pa.array(np.where(inside, before, np.where(own[segment], n, 0))))
    is_seed = ~inside & from_seed[segment] & ~certain
    none = (ref_us == NEVER) | open_seg[segment]
    ref_writer = pc.if_else(pa.array(none | is_seed), pa.scalar(None, pa.string()), ref_writer)

    out = _State(keys[n - 1].as_py(), bool(open_seg[segment[-1]]), None)
    s, i = segment[-1], last[-1]
    if i >= seg_first[s]:
        out.ref, out.writer = int(t[i]), col["writer"][int(i)].as_py()
    else:
        out.ref, out.seeded = int(ref[s]), bool(from_seed[s])
        out.writer = state.writer if own[s] else None
    out.latest = int(t[-1])
    rows = pa.RecordBatch.from_arrays(
        [*[col[c] for c in _EVENT], col["part"], pa.array(np.arange(place, place + n)), pa.array(open_seg[segment]),
         pa.array(np.zeros(n, bool)), pa.array(ref_us, mask=none), ref_writer, pa.array(is_seed)], schema=_ROW)
    return rows, out


def _tail(state: _State, part: int, place: int) -> pa.RecordBatch:
    """What a partition leaves of its last key."""
    known = not state.open and state.ref != NEVER
    values = [state.key, state.latest, None, False, False, False, None, None, None, part, place, state.open, True,
              state.ref if known else None, state.writer, state.seeded and known]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _ROW, strict=True)], schema=_ROW)


def _fold_partitions(batches) -> Iterator[pa.RecordBatch]:
    state, place, part = None, 0, 0
    for batch in batches:
        if batch.num_rows:
            part = batch.column(len(_EVENT))[0].as_py()
            rows, state = _fold(batch, state, place)
            place += batch.num_rows
            yield rows
    if state is not None:
        yield _tail(state, part, place)


def _across(rows: DataFrame) -> DataFrame:
    """The open rows with ``ref_us``, ``ref_writer`` and ``from_seed``."""
    tails = rows.where("tail").select("key", "part", "open", "ref_us", "ref_writer", "from_seed")
    heads = rows.where("open and not tail").groupBy("key", "part").agg(F.first("seed_us").alias("seed_us"))
    # a head goes on from the nearest earlier partition whose end is known; one row per partition here
    by_part = Window.partitionBy("key").orderBy("part")
    ended = F.when(~F.col("open"), F.struct("part", "ref_us", "ref_writer", "from_seed"))
    parts = heads.join(tails, ["key", "part"], "full").withColumn("end", ended).withColumn(
        "from", F.last("end", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)))
    begun = F.col("from").isNotNull()
    parts = parts.select(
        "key", "part", F.coalesce("from.part", F.lit(-1)).alias("stretch"),
        F.when(begun, F.col("from.ref_us")).otherwise(F.col("seed_us")).alias("start_us"),
        F.when(begun, F.col("from.ref_writer")).alias("start_writer"),
        F.when(begun, F.col("from.from_seed")).otherwise(F.col("seed_us").isNotNull()).alias("start_seeded"))
    stretch = ["key", "stretch"]
    # heads of one stretch share its start; its first head knows the seed
    open_rows = materialize(rows.where("open and not tail").drop("ref_us", "ref_writer", "from_seed")
                            .join(parts, ["key", "part"]), "replay-open")

    inside = Window.partitionBy("key", "part").orderBy("place")
    up_to_here = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*stretch).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    v = F.when(F.col("refreshes"), F.col("t_us") - F.col("ttl_us"))
    tops = (open_rows.groupBy(*stretch, "part").agg(F.max(v).alias("top"))
            .select(*stretch, "part", F.max("top").over(earlier).alias("top_before")))
    records = open_rows.join(tops, [*stretch, "part"]).withColumn("v", v)
    records = records.withColumn("top", F.greatest(F.max("v").over(up_to_here), F.col("top_before"), F.lit(NEVER)))
    records = records.where("v > top")
    # links: from a start or a possible refresh to the first one that outlives it
    possible = records.select(*stretch, F.col("v").alias("at"), F.lit(0).alias("asks"), "v", F.lit(None).cast("long").alias("of"))
    asked = records.select(*stretch, F.col("t_us").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("v"),
                           F.col("v").alias("of"))
    starts = (open_rows.groupBy(*stretch).agg(F.max("start_us").alias("at"))
              .select(*stretch, F.coalesce("at", F.lit(NEVER)).alias("at"), F.lit(1).alias("asks"),
                      F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("of")))
    sought = materialize(possible.union(asked).union(starts).repartitionByRange(*stretch, "at", "asks")
                         .withColumn("dealt", F.spark_partition_id()), "replay-links")
    later = Window.partitionBy(*stretch).orderBy("dealt").rowsBetween(1, Window.unboundedFollowing)
    following = Window.partitionBy(*stretch, "dealt").orderBy("at", "asks").rowsBetween(1, Window.unboundedFollowing)
    firsts = (sought.groupBy(*stretch, "dealt").agg(F.min("v").alias("lowest"))
              .select(*stretch, "dealt", F.min("lowest").over(later).alias("lowest_later")))
    links = (sought.join(firsts, [*stretch, "dealt"])
             .withColumn("to", F.coalesce(F.first("v", ignorenulls=True).over(following), F.col("lowest_later")))
             .where("asks = 1 and to is not null").select(*stretch, "of", "to"))
    links = materialize(links, "replay-links")
    reached = links.where("of is null").select(*stretch, F.col("to").alias("v"))
    jumps = links.where("of is not null")
    while not jumps.isEmpty():
        hop = jumps.select(*stretch, F.col("of").alias("v"), F.col("to").alias("next"))
        reached = materialize(reached.union(reached.join(hop, [*stretch, "v"]).select(*stretch, F.col("next").alias("v")))
                              .distinct(), "replay-reached")
        jumps = materialize(jumps.join(hop.withColumnRenamed("v", "to"), [*stretch, "to"])
                            .select(*stretch, "of", F.col("next").alias("to")), "replay-jumps")

    # every row's last refresh: the first row of its partition's run with that running maximum refreshed
    hits = records.join(reached, [*stretch, "v"]).select(*stretch, "part", "place", F.struct("t_us", "writer").alias("mine"))
    marked = open_rows.join(hits, [*stretch, "part", "place"], "left")
    lasts = (marked.where("mine is not null").groupBy(*stretch, "part").agg(F.max_by("mine", "place").alias("end")))
    lasts = (open_rows.select(*stretch, "part").distinct().join(lasts, [*stretch, "part"], "left")
             .select(*stretch, "part", F.last("end", ignorenulls=True).over(earlier).alias("carried")))
    found = marked.join(lasts, [*stretch, "part"]).withColumn(
        "last", F.coalesce(F.last("mine", ignorenulls=True).over(up_to_here), F.col("carried")))
    return found.select(
        *[c for c in rows.columns if c not in ("ref_us", "ref_writer", "from_seed")],
        F.coalesce("last.t_us", "start_us").alias("ref_us"),
        F.when(F.col("last").isNotNull(), F.col("last.writer")).otherwise(F.col("start_writer")).alias("ref_writer"),
        (F.col("last").isNull() & F.coalesce("start_seeded", F.lit(False)) & F.col("start_us").isNotNull()).alias("from_seed"))


def replay(events: DataFrame) -> DataFrame:
    """``events``: ``key, t_us, seq, looks`` (a lookup, else a write from elsewhere), ``realtime, refreshes`` (a miss
    writes this key), ``ttl_us, seed_us`` (the store's own refresh of the key, or null), ``writer`` (what is kept of a
    refresh). Per lookup: ``key, t_us, seq, writer, hit, from_seed, ref_us`` and ``ref_writer`` (the refresh that it is
    served from)."""
    dealt = (events.select(*_EVENT).withColumn("__gl_tie", F.monotonically_increasing_id())
             .repartitionByRange("key", "t_us", "seq", "__gl_tie").sortWithinPartitions("key", "t_us", "seq", "__gl_tie")
             .select(*_EVENT, F.spark_partition_id().alias("part")))
    rows = materialize(dealt.mapInArrow(_fold_partitions, _ROW_DDL), "replay-rows")
    done = rows.where("not open and not tail")
    if not rows.where("open and not tail").isEmpty():
        done = done.unionByName(_across(rows))
    hit = (~F.col("realtime") & F.col("ref_us").isNotNull() & (F.col("t_us") - F.col("ref_us") <= F.col("ttl_us")))
    return done.where("looks").withColumn("hit", hit).select(
        "key", "t_us", "seq", "writer", "hit", (F.col("hit") & F.col("from_seed")).alias("from_seed"),
        F.when(F.col("hit"), F.col("ref_us")).otherwise(F.col("t_us")).alias("ref_us"),
        F.when(F.col("hit"), F.col("ref_writer")).otherwise(F.col("writer")).alias("ref_writer"))


def _lookups(requests: DataFrame, target: str, seed) -> DataFrame:
    """``requests``: url, t_us, seq, realtime, ttl (seconds) and the column named ``target``."""
    zero = F.lit(0).cast("long")
    return requests.select(
        F.coalesce("url", F.lit("")).alias("key"), F.coalesce("t_us", zero).alias("t_us"),
        F.col("seq").cast("long").alias("seq"), F.lit(True).alias("looks"),
        F.coalesce("realtime", F.lit(False)).alias("realtime"), F.col(target).eqNullSafe(F.col("url")).alias("refreshes"),
        (F.coalesce(F.col("ttl").cast("long"), zero) * 1_000_000).alias("ttl_us"), seed.alias("seed_us"),
        F.col("url").alias("writer"))


def ttl_replay(log: DataFrame, url_col: str = "url", ts_col: str = "ts", seq_col: str = "seq",
               realtime_col: str = "realtime", ttl_col: str = "ttl_seconds") -> DataFrame:
    """Input: one row per request with url, ts (timestamp), seq, realtime (bool), ttl_seconds.
    Output: ``seq, url, hit`` for every input row. Null urls are one url, a null time is the epoch, a null ttl 0."""
    asked = log.select(F.col(url_col).alias("url"), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("t_us"),
                       F.col(seq_col).cast("long").alias("seq"), F.col(realtime_col).alias("realtime"),
                       F.col(ttl_col).alias("ttl"))
    # range partitioning looks at its input twice: the events are computed once
    found = replay(materialize(_lookups(asked, "url", F.lit(None).cast("long")), "replay-events"))
    return found.select("seq", F.col("writer").alias("url"), "hit")


def store_replay(requests: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sequential store lookups of a request batch against a page store that the batch itself refreshes.

    requests: ``url, t_us, seq, realtime, ttl`` and ``target``, the url under which a fetch of ``url`` is stored
    (on-allowlist requests only); seeds: ``url, t_us``, the stored row's parsed ``fetched_at`` (unparsable rows are not
    seeds: they always miss). In (t_us, seq) order, a request hits iff it is not realtime and the row stored under its
    url is at most ttl old; a miss becomes the row of its target. Output per request: ``seq, hit, from_seed`` (served by
    the original snapshot row), ``ref_us`` (when the row it gets was fetched) and ``ref_writer`` (the url whose fetch
    wrote it)."""
    known = seeds.groupBy("url").agg(F.max("t_us").alias("seed_us"))
    seeded = materialize(requests.select("url", "t_us", "seq", "realtime", "ttl", "target").join(known, "url", "left"),
                         "replay-events")
    lookups = _lookups(seeded, "target", F.col("seed_us"))
    moved = seeded.where(~F.col("target").eqNullSafe(F.col("url")))
    out = ["seq", "hit", "from_seed", "ref_us", "ref_writer"]
    if moved.isEmpty():
        return replay(lookups).select(*out)
    moved = materialize(moved.select(F.col("seq").cast("long").alias("seq"), F.coalesce("target", F.lit("")).alias("target"),
                                     F.coalesce("t_us", F.lit(0).cast("long")).alias("t_us"), "url")
                        .join(known.withColumnRenamed("url", "target"), "target", "left"), "replay-moved")
    written = moved.limit(0)  # writes under other urls, as far as they are known
    while True:
        writes = written.select(
            F.col("target").alias("key"), "t_us", "seq", F.lit(False).alias("looks"), F.lit(False).alias("realtime"),
            F.lit(True).alias("refreshes"), F.lit(0).cast("long").alias("ttl_us"), "seed_us", F.col("url").alias("writer"))
        found = materialize(replay(lookups.unionByName(writes)), "replay-round")
        missed = materialize(moved.join(found.where("not hit").select("seq"), "seq", "left_semi"), "replay-written")
        changed = (missed.select("seq").withColumn("new", F.lit(1))
                   .join(written.select("seq").withColumn("old", F.lit(1)), "seq", "full").where("new is null or old is null"))
        if changed.isEmpty():
            return found.select(*out)
        written = missed
