"""A corpus pipeline over ``documents``: five stages, each one operator of ``overfly.llm``.

Each stage gets the rows that its predecessor kept, written as Parquet and read
again, and its decisions take effect. All but the last return the columns of
``documents``, under their names and with their values, whatever names an operator's
own columns have. An empty table gives none in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overfly.llm import bpe, langcrf, minhash, mixing, substring
from overfly.llm.common import removed, shared_folder, table
from overfly.llm.queries import vocabulary

#: A document's language must hold more than this expected share of its words.
LANGUAGE_SHARE = 0.5


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with every column but ``needed`` ones under a name that no operator uses, and the column of each own name."""
    own = {n: n if n in needed else f"_ov_c{i}" for i, n in enumerate(docs.columns)}
    return docs.toDF(*own.values()), {n: F.col(o).alias(n) for n, o in own.items()}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no language holds half of, go.

    Null and empty texts have no letter. Very long texts are read whole, repeated rows
    are decided alike.
    """
    rows, names = apart(docs, "text")
    found = langcrf.identify(rows, langcrf.fit(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") > LANGUAGE_SHARE)).select(*names.values())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the least doc_id.

    Rows of equal id and text are one document; an id with several texts, or a missing
    one (last in order), stands for a document per text. Texts without words are no one's
    duplicates and stay.
    """
    return minhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur twice are cut out; a document with nothing left goes.

    A text that loses nothing stays as it is, null and empty ones too; n_chars follows the
    text. Rows that repeat each count as a place of their passages.
    """
    rows, names = apart(docs, "doc_id", "text")
    d = substring.removals(rows)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    d = d.filter(~cut | (F.col("n_removed") < F.col("n_words"))).withColumn("text", text)
    if "n_chars" in names:
        names["n_chars"] = F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(names["n_chars"]).alias("n_chars")
    return d.select(*names.values())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A missing source is a source of its own; texts without words add nothing but may be
    taken; repeated rows are ranked each for itself.
    """
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of them and of the decoded text; a null text counts as empty."""
    d = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary(), decoded=True)
    return d.select(
        "doc_id", "lang", "source", "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: SQL expresses neither the trained model of the first stage nor its decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    What lies between two stages is written to the shared folder and deleted once the
    next stage is written, and all of it if a stage fails; the table that the last stage
    reads stays, as its rows are made when the result is used.
    """
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs.write.parquet(f"{at}/{k}")
                docs = spark.read.parquet(f"{at}/{k}")
                if k:
                    removed(spark, f"{at}/{k - 1}")
    except BaseException:
        removed(spark, at)
        raise
    return docs
