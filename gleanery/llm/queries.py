"""The registered query of every operator, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import chats, decontamination, infilling, jaccard, licences, lines, negatives, neighbours, packing, pages, secrets, substrings, toxicity
from gleanery.session import table


def trained_toxicity(spark: SparkSession, sf_dir: str):
    """A net trained on the labelled documents of sf_dir outside the fold that is held out."""
    return toxicity.train(*toxicity.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, trained_toxicity(spark, sf_dir), keep_text=False)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(licences.sample_lines(docs)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicate_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), secrets.train(spark))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.judged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.deduplicate_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_examples(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.fill_in_middle(table(spark, sf_dir, "documents"), keep_output=False)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.relabelled(table(spark, sf_dir, "embeddings")))


#: Conversation -1, in another layout than the table's: both turns say control strings.
CONTROL_RECORD = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    one = spark.createDataFrame([(-1, CONTROL_RECORD)], "conv_id long, record string")
    turns = chats.canonical_turns(rows).unionByName(chats.canonical_turns(one, json_col="record"))
    return chats.read_back(chats.format_chats(turns))


QUERIES = {"op1_license_scan": op1_license_scan, "op2_toxicity": op2_toxicity, "op3_substring_dedup": op3_substring_dedup, "op4_nearest_neighbours": op4_nearest_neighbours, "op5_secret_scan": op5_secret_scan, "op6_decontamination": op6_decontamination, "op7_line_dedup": op7_line_dedup, "op8_ngram_jaccard": op8_ngram_jaccard, "op9_html_extraction": op9_html_extraction, "op10_packing": op10_packing, "op11_fill_in_middle": op11_fill_in_middle, "op12_hard_negatives": op12_hard_negatives, "op13_chat_formatting": op13_chat_formatting}
ORACLE_SQL = {"op3_substring_dedup": substrings.SQL, "op6_decontamination": decontamination.SQL, "op7_line_dedup": lines.SQL, "op8_ngram_jaccard": jaccard.SQL, "op11_fill_in_middle": infilling.SQL, "op12_hard_negatives": negatives.SQL, "op13_chat_formatting": chats.SQL}
