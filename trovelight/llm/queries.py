"""The registered queries of this subpackage, at production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.llm import ann, codes, common, html, jaccard, langid, linefreq, lm, mixing, neardup, packing, phrases, tokens, toxicity

TOKENIZER = "word_bpe_49k.json"
SEQUENCE_TOKENS = 4096


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for every row whose vec_id is divisible by 20."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as pieces of at most 4096 ids, with their place in a sequence."""
    docs = common.table(spark, sf_dir, "documents")
    pieces = common.materialize(tokens.tokenized_pieces(docs, tokenizer_path(), SEQUENCE_TOKENS), "pieces")
    placed = packing.pack(pieces, SEQUENCE_TOKENS)
    return pieces.join(placed, "item_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and cross-document line frequency of every document; its source is its host."""
    return linefreq.quality(common.table(spark, sf_dir, "documents"))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 0.93 of the largest entropy over sources, no source more than four times, at the budget of one epoch."""
    docs = common.table(spark, sf_dir, "documents")
    words = docs.select(F.sum(F.size(linefreq.words(F.coalesce("text", F.lit("")))))).first()[0]
    rows, _ = mixing.mix(docs, 0.93, 4.0, float(words or 0))
    return rows.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_order").alias("mix_order"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates (five words, 0.8), its copies and its number of links."""
    return jaccard.similarity_classes(common.table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from four of the five folds."""
    docs = common.table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(common.doc_remainder("doc_id", 5) != 0))
    found = langid.identify(docs, model, ["doc_id"])
    return found.select("doc_id", (common.doc_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of two of the three folds."""
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").filter(common.doc_remainder("doc_id", 3) != 1)
    found = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"])
    return found.select("doc_id", (common.doc_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document by the counts of all documents, to six places."""
    scores = lm.backoff_scores(common.table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded into flat files in doc_id order, and read back from them."""
    path = common.fresh_path(spark, "tokens")
    manifest = tokens.write_token_store(common.table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokens.read_token_store(manifest, path)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the winning paths of its host."""
    return html.extract_main_text(common.table(spark, sf_dir, "pages"))


def op11_pstable_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its links to others of its label at a cosine of 0.93 or more, and the component they make."""
    return neardup.link(common.table(spark, sf_dir, "embeddings"))


def op12_partial_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite embedding as a code of four bytes, with its error and that of its label."""
    return codes.compress(common.table(spark, sf_dir, "embeddings"))[0]


def op13_pivot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return phrases.collocations(common.table(spark, sf_dir, "documents"))


QUERIES = {
    query.__name__: common.lean_batches(query)
    for query in (
        op1_adaptive_scan, op2_best_fit_packing, op3_line_frequency, op4_temperature_mixing, op5_ngram_jaccard_join,
        op6_language_id, op7_toxicity, op8_stupid_backoff, op9_token_store, op10_html_extraction,
        op11_pstable_neardup, op12_partial_distance_codes, op13_pivot_phrases,
    )
}
ORACLES: dict[str, str] = {"op3_line_frequency": linefreq.ORACLE, "op8_stupid_backoff": lm.ORACLE, "op12_partial_distance_codes": codes.ORACLE, "op13_pivot_phrases": phrases.ORACLE}
