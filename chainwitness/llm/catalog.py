"""Registered queries of this folder: one per operator, and the SQL of those that SQL can state."""

from pyspark.sql import functions as F

from chainwitness.llm import alignment, bpe, decontamination, embedding_dedup, jaccard_join, language_id, license_rules, line_dedup, lm_scoring, phrases, sentence_pieces, substring_dedup, token_files
from chainwitness.llm.common import identified, table

END_ID = 2


def tokenizer_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_files(spark, sf_dir):
    folder, shards = token_files.write(identified(table(spark, sf_dir, "documents")), tokenizer_file(), END_ID)
    return token_files.read(folder, shards)


def op5_bpe_codec(spark, sf_dir):
    return bpe.digests(bpe.round_trip(identified(table(spark, sf_dir, "documents")), tokenizer_file()))


def op2_license_rules(spark, sf_dir):
    found = license_rules.scan(identified(table(spark, sf_dir, "documents")), wrapped=True)
    return found.select(F.col("_id").alias("doc_id"), "license", "n_found")


def op3_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeats(identified(table(spark, sf_dir, "documents")))
    return kept.select(
        F.col("_id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def op8_decontamination(spark, sf_dir):
    pairs = decontamination.overlaps(
        identified(table(spark, sf_dir, "documents")), identified(table(spark, sf_dir, "benchmark"), "item_id"), short=True
    )
    return pairs.drop("_hash").withColumnRenamed("_id", "doc_id")


def op9_line_dedup(spark, sf_dir):
    kept = line_dedup.remove_lines(identified(table(spark, sf_dir, "documents")))
    return kept.select(
        F.col("_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def op7_ngram_jaccard_join(spark, sf_dir):
    found = jaccard_join.linked(identified(table(spark, sf_dir, "documents")))
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


def op10_embedding_dedup(spark, sf_dir):
    return embedding_dedup.linked(table(spark, sf_dir, "embeddings"))


def op6_lm_scoring(spark, sf_dir):
    scored = lm_scoring.score(identified(table(spark, sf_dir, "documents")))
    return scored.drop("_hash").withColumnRenamed("_id", "doc_id")


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(identified(docs), language_id.sample(docs))
    held_out = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))
    return found.select(F.col("_id").alias("doc_id"), "lang_pred", "score").withColumn("held_out", held_out)


def op11_phrase_mining(spark, sf_dir):
    return phrases.best(phrases.mine(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_sentence_pieces(spark, sf_dir):
    return sentence_pieces.digests(sentence_pieces.round_trip(identified(table(spark, sf_dir, "documents")), piece_file()))


def op13_token_alignment(spark, sf_dir):
    found = alignment.summaries(identified(table(spark, sf_dir, "documents")), tokenizer_file(), piece_file())
    return found.drop("_hash").withColumnRenamed("_id", "doc_id")


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_license_rules, op3_substring_dedup, op4_language_id, op5_bpe_codec, op6_lm_scoring, op7_ngram_jaccard_join, op8_decontamination,
    op9_line_dedup, op10_embedding_dedup, op11_phrase_mining, op12_sentence_pieces, op13_token_alignment,
)}
ORACLES = {"op2_license_rules": license_rules.ORACLE, "op8_decontamination": decontamination.ORACLE, "op11_phrase_mining": phrases.ORACLE}
