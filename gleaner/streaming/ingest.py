"""Streaming ingest into the page store and the provenance log.

``readStream`` (file source) -> ``foreachBatch``, from crawl rows (triage, extraction, quality, fingerprint, then the page
row and, for usable pages, the provenance row) or from finished page rows. Crawl rows come with the stream, bodies and all, or
the stream brings who asked for which url, and every micro-batch takes the crawl rows of its urls from tables of heads and
bodies: a body is then stored once, not once per request.

The store is a base and the runs written since: every micro-batch adds one Parquet run with its last write per url
(``run=<batch>``), and reading merges the base with the runs, last write per url. When the runs weigh as much as
``merge_ratio`` of the base, the batch writes their merger as a new base (``base=<batch>``). So a batch writes what it
brought, and the merges write at most 1 + 1 / ``merge_ratio`` bytes for every byte that came in. Provenance rows go to
``batch=<batch>`` folders.

A folder is written once: a batch that is replayed after a failure finds it complete (``_SUCCESS``) and leaves it, or
writes it anew. So nothing is there twice, and readers ``as_of`` a batch are not disturbed by later ones. Old bases and runs
are never deleted here; give the folder a retention policy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from .. import schemas as S
from ..functions import text as X
from ..operators import allowlist as A
from ..operators import store as ST
from ..plans import fetch as FP

SNAPSHOT = StructType([*S.FETCHED_PAGES.fields, StructField("write_seq", LongType())])
#: A crawl row with who asked for it and when: what a stream of fetches brings.
FETCHED = StructType([*S.CRAWL.fields, StructField("crawl_seq", LongType()), StructField("fetched_at", TimestampType()),
                      StructField("requesting_agent_id", StringType()), StructField("task_id", StringType())])
#: The same without what the crawl table knows of the url: what a stream of requests brings.
REQUESTED = StructType([f for f in FETCHED.fields if f.name == "url" or f.name not in S.CRAWL.fieldNames()])
#: How many requests of a url share a copy of its crawl rows.
SHARE = 1000
#: The batch number of a store's first base, if it did not start empty.
FIRST = -1


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _complete(spark: SparkSession, root: str, kind: str, as_of: int | None = None) -> list[int]:
    """Batches whose ``<kind>=<batch>`` folder is complete, ascending."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in fs.listStatus(p)]
    found = [(int(n.split("=", 1)[1]), path) for path, n in names if n.startswith(f"{kind}=")]
    return sorted(b for b, path in found if (as_of is None or b <= as_of) and fs.exists(path.suffix("/_SUCCESS")))


def _bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def _write_once(rows: DataFrame, root: str, kind: str, batch_id: int) -> None:
    if batch_id not in _complete(rows.sparkSession, root, kind):
        rows.write.mode("overwrite").parquet(f"{root}/{kind}={batch_id}")


def _forget(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished query when the driver's garbage collection finds that nothing refers to it.
    Between two batches there may be no full collection, and the bodies moved by every batch would stay on the disks."""
    spark.sparkContext._jvm.System.gc()


def _parts(spark: SparkSession, root: str, as_of: int | None) -> tuple[list[str], list[str]]:
    """Paths of the newest base and of the runs since."""
    bases = _complete(spark, root, "base", as_of)[-1:]
    runs = [r for r in _complete(spark, root, "run", as_of) if not bases or r > bases[0]]
    return [f"{root}/base={b}" for b in bases], [f"{root}/run={r}" for r in runs]


def latest_snapshot(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame | None:
    """The page store after batch ``as_of`` (default: the last one); None when nothing was written yet."""
    base, runs = _parts(spark, root.rstrip("/"), as_of)
    if not base and not runs:
        return None
    pages = spark.read.schema(SNAPSHOT)
    empty = spark.createDataFrame([], SNAPSHOT)
    return ST.upsert(pages.parquet(*base) if base else empty, pages.parquet(*runs) if runs else empty)


def provenance_log(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame:
    """The provenance rows of all complete batches up to ``as_of``."""
    paths = [f"{root.rstrip('/')}/batch={b}" for b in _complete(spark, root.rstrip("/"), "batch", as_of)]
    return spark.read.schema(S.PROVENANCE).parquet(*paths) if paths else spark.createDataFrame([], S.PROVENANCE)


def shares(requests: DataFrame) -> DataFrame:
    """``url, __gl_shares`` of the urls asked for more than ``SHARE`` times: a row for every ``SHARE`` requests at most."""
    counts = requests.groupBy("url").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("__gl_shares"))
    return F.broadcast(counts.where("__gl_shares > 1"))


def with_crawl(requests: DataFrame, heads: DataFrame, bodies: DataFrame, many: DataFrame) -> DataFrame:
    """The requests with the crawl rows of their url: ``heads`` (no body; ``fetch_id``) joined first, then ``bodies`` (``fetch_id,
    url, body``), which are moved once. A url in ``many`` (``shares``) has a copy of its bodies for each of its shares, so that
    they are not all read by one task."""
    mine = [c for c in requests.columns if c != "url"]
    n = F.coalesce("__gl_shares", F.lit(1).cast("long"))
    dealt = (requests.join(heads, "url").join(many, "url", "left")
             .withColumn("__gl_share", F.pmod(F.xxhash64("crawl_seq"), n)).drop("__gl_shares"))
    copies = (bodies.select("fetch_id", "url", "body").join(many, "url", "left")
              .withColumn("__gl_share", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("url", "__gl_shares"))
    return dealt.join(copies, ["fetch_id", "__gl_share"], "left").select(*S.CRAWL.fieldNames(), *mine)


def page_rows(fetched: DataFrame, allowlist: DataFrame, max_bytes: int = S.MAX_BODY_BYTES,
              entries: DataFrame | None = None, crawl: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """What the service writes for each fetched row (``FETCHED``) whose url is on the list: the page row (``SNAPSHOT``), who
    asked (``requesting_agent_id``, ``task_id``) and ``kind`` ('fetch' for usable pages, which are the ones that leave
    provenance; else NULL). ``entries``: the allowlist's ``host_entries`` of these rows, if kept. ``crawl``: heads and
    bodies of the crawl rows (``with_crawl``), if the rows are requests (``REQUESTED``)."""
    on = A.lookup(fetched, "url", allowlist, entries=entries).filter(F.col("al_domain").isNotNull())
    kept = ["crawl_seq", "fetched_at", "requesting_agent_id", "task_id", "al_ttl_seconds"]
    if crawl is not None:
        heads, bodies = crawl  # bodies that no row of the batch can need are not moved
        listed = A.lookup(bodies, "url", allowlist, entries=entries).filter(F.col("al_domain").isNotNull())
        on = with_crawl(on, heads, listed, shares(fetched))
    return FP.crawl_pages(on, max_bytes, keep=kept).select(
        F.col("k_doc_url").alias("url"), F.col("k_origin").alias("origin"), F.col("k_sha").alias("content_sha256"),
        F.col("k_plaintext").alias("plaintext"), F.col("k_title").alias("title"), X.iso_ms("fetched_at").alias("fetched_at"),
        F.col("al_ttl_seconds").alias("ttl_seconds"), F.col("k_low").alias("low_signal"),
        F.col("k_byte_size").alias("byte_size"), F.col("crawl_seq").alias("write_seq"),
        "requesting_agent_id", "task_id", F.when(~F.col("k_low"), F.lit("fetch")).alias("kind"))


def make_batch_writer(snapshot_root: str, provenance_root: str, initial_snapshot: str | None = None,
                      merge_ratio: float = 0.5, rows_of: Callable[..., DataFrame] = lambda batch: batch,
                      keep: Callable[[DataFrame], DataFrame] | None = None):
    """The ``foreachBatch`` function. ``rows_of`` makes page rows (``SNAPSHOT``; with ``kind`` also provenance) of a batch and
    of what ``keep``, if given, makes of it: a small table that is computed and kept first."""
    root, log = snapshot_root.rstrip("/"), provenance_root.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _forget(spark)
        if initial_snapshot and not _complete(spark, root, "base"):
            _write_once(spark.read.parquet(initial_snapshot).select(*SNAPSHOT.fieldNames()), root, "base", FIRST)
        kept = keep(batch).persist() if keep else None
        if kept is not None:
            kept.count()
        rows = rows_of(batch) if kept is None else rows_of(batch, kept)
        if "kind" in rows.columns:
            rows = rows.persist()  # extracted once for the store and the log
            accepted = ST.provenance_rows(rows.select(*ST.PROV_COLS)).filter("accepted").drop("accepted")
            _write_once(accepted, log, "batch", batch_id)
        _write_once(ST.last_written(rows.select(*SNAPSHOT.fieldNames())), root, "run", batch_id)
        rows.unpersist()
        if kept is not None:
            kept.unpersist()
        base, runs = _parts(spark, root, batch_id)
        if runs and sum(_bytes(spark, r) for r in runs) >= merge_ratio * sum(_bytes(spark, b) for b in base):
            _write_once(latest_snapshot(spark, root, batch_id), root, "base", batch_id)

    return write


def _start(stream: DataFrame, write, checkpoint: str, available_now: bool):
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def ingest(stream: DataFrame, snapshot_root: str, provenance_root: str, checkpoint: str,
           initial_snapshot: str | None = None, available_now: bool = True):
    """Start the ingest of finished page rows; returns the StreamingQuery."""
    return _start(stream, make_batch_writer(snapshot_root, provenance_root, initial_snapshot), checkpoint, available_now)


def ingest_crawl(stream: DataFrame, allowlist: DataFrame, snapshot_root: str, provenance_root: str, checkpoint: str,
                 initial_snapshot: str | None = None, max_bytes: int = S.MAX_BODY_BYTES, available_now: bool = True,
                 crawl: tuple[DataFrame, DataFrame] | None = None):
    """Start the ingest of fetched rows (``FETCHED``), or of requests (``REQUESTED``) with the rows of ``crawl`` (heads, bodies);
    returns the StreamingQuery."""
    write = make_batch_writer(snapshot_root, provenance_root, initial_snapshot,
                              rows_of=lambda batch, entries: page_rows(batch, allowlist, max_bytes, entries, crawl),
                              keep=lambda batch: A.host_entries(batch, "url", allowlist))
    return _start(stream, write, checkpoint, available_now)
