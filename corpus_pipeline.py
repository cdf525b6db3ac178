"""From ``documents`` to packed training sequences.

Five stages; each gets the rows that the one before kept, read again from its written table:

1. language_id: documents without letters (language ``und``) or of undecided language go.
2. quality_rules: documents that fail the base rule or a rule of the cascade go.
3. minhash_near_dedup: of each group of near duplicates (five-word shingles, similarity 0.8) the
   smallest id stays, and of rows with equal ids one; rows without an id stay.
4. pii: spans of personal data are replaced by their kind; n_chars follows the text.
5. best_fit_packing: the pieces of all documents with their places in sequences of 1024 tokens.

All but the last return the columns that they get, whatever their names. Null texts go in the
first stage. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, packing, pii, quality
from tessera.llm.common import Bloom, Scratch
from tessera.session import ship


def _named(docs: DataFrame) -> DataFrame:
    """All columns but those that operators read under names of their own, so that none can clash."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"__column{i}") for i, c in enumerate(docs.columns)])


def _restored(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    return df.select(*[changed.get(c, F.col(c if c in ("doc_id", "text") else f"__column{i}")).alias(c) for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = langid.identify(_named(docs), langid.train(docs))
    return _restored(out.where((F.col("language.lang") != "und") & ~F.col("language.ambiguous")), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _restored(quality.judge(_named(docs)).where("kept"), docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = Scratch(spark).save(minhash.near_duplicates(docs).select("id", "kept"))
    drop = found.where("not kept").select("id").distinct()
    bloom, named = Bloom(drop), _named(docs)
    # texts that surely stay are not shuffled; the others are held against the exact list
    rest = named.where(bloom.maybe("doc_id"))
    out = named.where(~bloom.maybe("doc_id")).union(rest.join(drop, rest["doc_id"] == drop["id"], "left_anti"))
    twice = Scratch(spark).save(found.where("kept and id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if not twice.isEmpty():  # rows of equal id: one stays
        turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
        many = out.join(twice, out["doc_id"] == twice["id"], "left_semi")
        out = out.join(twice, out["doc_id"] == twice["id"], "left_anti").union(many.withColumn("turn", turn).where("turn = 1").drop("turn"))
    return _restored(out, docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.find(_named(docs), pii.train(docs))
    new, changed = F.col("pii.redacted"), {"text": F.col("pii.redacted")}
    if "n_chars" in docs.columns:
        old = F.col(f"__column{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(new.isNull(), old).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return _restored(out, docs, **changed)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return packing.pack(docs, f.read())


def _ready(stage):
    """The stage, with this package on the executors and Arrow batches bounded."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return call


STAGES = [
    ("language_id", _ready(language_id)),
    ("quality_rules", _ready(quality_rules)),
    ("minhash_near_dedup", _ready(minhash_near_dedup)),
    ("pii", _ready(redact_pii)),
    ("best_fit_packing", _ready(best_fit_packing)),
]
#: The stages learn from data, so SQL can't express them; tests hold them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
