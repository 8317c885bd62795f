"""The training-data pipeline: documents in, packed token sequences out.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame. Each works on all that its predecessor kept; its
result is written as Parquet and reread as the next one's documents. All but the last return the columns that they
were given, in the same order, whatever they are called:

1. quality classifier: documents whose worst passage is unlike the labelled good ones go;
2. language ID: documents without letters, or whose language is not clear, go: those that two languages suit alike,
   and those whose n-grams are far less likely under their language than those of labelled documents;
3. near-duplicates: of each group of linked documents, the one with the smallest id stays, whatever ids repeat;
4. benchmark decontamination: contaminated documents go;
5. packing: what is left becomes sequences of 2048 tokens; one row per piece.

Null texts pass the first stage and go at the second. Rows whose id is null are documents without a name: they are
judged like others. Equal rows count as copies of each other. Empty input: empty output of every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontam, langid, neardup, packing, quality
from gleaner.llm.common import id_remainder
from gleaner.session import materialize
from gleaner.sources.tables import read

#: Documents whose predicted language has a lower posterior than this are rejected.
CLEAR_LANGUAGE = 0.5

#: Not expressible in SQL: models, token ids and packing. Tests hold the stages against brute force.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, dict]:
    """The same table with columns c0, c1, ..., so that no name can clash, and where each name went."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), {n: f"c{i}" for i, n in enumerate(docs.columns)}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, at = _plain(docs)
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    model = quality.fit(plain, labels, at["doc_id"], at["text"])
    weighed = quality.weigh(plain, model, at["text"], "weight", "passage")
    return weighed.where(F.col("passage") >= F.lit(model.cut)).drop("weight", "passage").toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, at = _plain(docs)
    training = plain.where(id_remainder(at["doc_id"], 4) != 2)
    model = langid.train(training, at["text"], at["lang"])
    told = langid.predict(plain, model, at["text"], "told", "posterior", "fit")
    clear = (F.col("told") != langid.UNDETERMINED) & (F.col("posterior") >= CLEAR_LANGUAGE)
    lowest = langid.clear_fits(training, model, at["text"], at["lang"])
    if lowest:
        of_language = F.create_map(*[F.lit(x) for pair in sorted(lowest.items()) for x in pair])
        # no labelled row was told this language: the most that any language allows
        clear &= F.col("fit") >= F.coalesce(of_language[F.col("told")], F.lit(min(lowest.values())))
    return told.where(clear).drop("told", "posterior", "fit").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, at = _plain(docs)
    rows = materialize(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    id_ = F.col(at["doc_id"])
    kinds = dict(plain.dtypes)  # maps and variants have no hash of their own
    others = [F.to_json(F.struct(c)) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(c)
              for n, c in at.items() if n not in ("doc_id", "text")]
    # orders rows by id (those without one last), then by what they hold; the row number tells equal rows apart
    key = F.struct(id_.isNull().alias("nameless"), id_.alias("id"), F.xxhash64(at["text"]).alias("text"),
                   F.xxhash64(F.lit(0), *others).alias("others"), F.col("row"))
    found = neardup.near_duplicates(rows.select(key.alias("key"), at["text"]), "key", at["text"])
    kept = found.where("kept and n_shingles > 0").select(F.col("doc_id.row").alias("row"))
    # rows without words are linked with nothing; those equal in id and text are copies, too
    wordless = (found.where("n_shingles = 0").groupBy("doc_id.nameless", "doc_id.id", "doc_id.text")
                .agg(F.min("doc_id")["row"].alias("row")).select("row"))
    return rows.join(kept.union(wordless), "row", "left_semi").drop("row").toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, at = _plain(docs)
    items = read(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontam.find_contamination(plain, items, at["doc_id"], at["text"], keep=tuple(plain.columns))
    return found.where(~decontam.contaminated()).select(*plain.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_classifier), ("language ID", language_id),
          ("near-duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
