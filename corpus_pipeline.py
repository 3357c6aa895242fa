"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.llm import common, jaccard, langid, mixing, packing, queries, tokens, toxicity

#: Target of the mixing stage: this share of the largest entropy over sources, and no document more often than this.
TARGET_ENTROPY, MOST_REPEATS = 0.93, 4.0


@common.lean_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Null, empty and letterless texts are rejected and go. Long texts are read whole; repeated rows share a verdict; further columns stay. An empty
    table stays empty.
    """
    model = langid.fit(docs.filter(common.doc_remainder("doc_id", 5) != 0))
    kept = docs.columns
    names = common.free(docs, "lang_pred", "score", "rejected")
    return langid.identify(docs, model, kept, names).filter(~F.col(names[2])).select(*kept)


@common.lean_batches
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold.

    Null and empty texts score as what they are, texts without a word, and long ones as a whole; repeated rows share a verdict; a null doc_id has no label
    and is scored like any other. Further columns stay. Without labelled rows nothing is learnt and all stay. An empty table stays empty.
    """
    labels = common.table(spark, sf_dir, "labels").filter(common.doc_remainder("doc_id", 3) != 1)
    kept = docs.columns
    (name,) = common.free(docs, "score")
    return toxicity.score(docs, toxicity.fit(docs, labels), kept, name).filter(F.col(name) < toxicity.THRESHOLD).select(*kept)


@common.lean_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id.

    Null and empty texts are copies of each other; repeated rows are copies too, so one stays. Rows without a doc_id take no part and stay. Rows that share a
    doc_id but differ in text are told apart. Further columns stay. An empty table stays empty.
    """
    return jaccard.first_of_classes(docs)


@common.lean_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; every document stays at least once, those of small sources more often.

    A null source is a source of its own, ''. Texts without a word cost nothing and stay. Repeated rows are drawn alike. Further columns stay. An empty table
    stays empty.
    """
    rows, _ = mixing.mix(docs, TARGET_ENTROPY, MOST_REPEATS)
    return rows.select(*docs.columns)


@common.lean_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    A null or empty text is its end id alone; longer ones than a sequence are cut, so nothing is lost. Repeated rows are packed as often as they occur. Other columns are
    ignored. An empty table gives an empty result.
    """
    pieces = common.materialize(tokens.tokenized_pieces(docs, queries.tokenizer_path(), queries.SEQUENCE_TOKENS), "pieces")
    placed = packing.pack(pieces, queries.SEQUENCE_TOKENS)
    return pieces.join(placed, "item_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and packing have no SQL form; tests run the stages on odd rows and against their operators, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
