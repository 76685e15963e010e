"""The corpus pipeline: toxicity, quality, near duplicates, decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)``; all but the last keep rows of ``docs`` as they are, with the
columns of documents.  ``run`` writes the result of each stage as Parquet to the shared folder and reads
it again for the next, so a lost executor costs one stage at most; other tables are removed with their stage.  Labels and benchmark come
from ``sf_dir``; rows of ``docs`` without a label are judged like any other.  An empty table passes
through every stage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulant.llm import decontaminate, packing, quality, simhash, toxicity
from tabulant.sources.scratch import discard, materialize, new_path, scope
from tabulant.sources.tables import table


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not in ``rejected``, a table of ``(key, text_hash)``."""
    same = F.col("doc_id").eqNullSafe(F.col("rejected_key")) & (
        F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("rejected_hash")
    )
    names = {"key": "rejected_key", "text_hash": "rejected_hash"}
    return docs.join(rejected.select("key", "text_hash").withColumnsRenamed(names), same, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    A text is scored whole, however long; a null or empty one has the score of the model's bias, and without labels of
    both classes nothing is toxic.  Repeated rows score alike.  All columns are kept, whatever they are called.
    """
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects: as many as the share of good ones among the labelled.

    A null or empty text has log weight 0, null keys share their noise, repeated rows and ties at the last draw stay
    together.  Texts are read whole.  Without labels all stay.  All columns are kept, whatever they are called.
    """
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least by key and text, of each group linked by fingerprints within four bits.

    Fingerprints are those of shingles of four words over whole texts.  Null and empty texts have the fingerprint
    zero and are one group.  Null keys sort last.  Of rows that repeat key and text one stays.  All columns are kept.
    """
    found = simhash.near_duplicates(docs).withColumnRenamed("doc_id", "key")
    kept = _without(docs, found.where(~F.col("representative")))
    return simhash.first_of_repeated(kept, found.withColumnRenamed("key", "doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty stands in a benchmark window.

    Null and empty texts have no words and stay, as all do if the benchmark is empty.  Long texts are judged whole,
    repeated rows alike.  All columns are kept, whatever they are called.
    """
    matches = decontaminate.benchmark_matches(docs, table(spark, sf_dir, "benchmark"))
    judged = decontaminate.contamination(*matches, key="key")
    rejected, _ = materialize(judged.where("contaminated").select("key", "text_hash").distinct(), "contaminated")
    return _without(docs, rejected)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of byte-level tokens; see ``packing.pack``.

    A null text is empty and takes one place, a long text becomes several pieces, repeated rows are packed like
    any other, and ties go by key.  Other columns are not read.
    """
    return packing.pack(packing.measured(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The first two stages are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scope(spark):  # what a stage stored on its way goes when its result is stored
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
