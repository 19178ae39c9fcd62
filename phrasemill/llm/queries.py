"""The registered queries of this package; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm import chat, lexical, quality, toxicity, warc
from phrasemill.llm.alignment import align
from phrasemill.llm.chat import format_chats, read_chats
from phrasemill.llm.common import table
from phrasemill.llm.kmeans_tree import search
from phrasemill.llm.lineblocks import extract_pages
from phrasemill.llm.mixing import mix
from phrasemill.llm.pieces import round_trip
from phrasemill.llm.quality import score_quality
from phrasemill.llm.simhash import hex_print, near_duplicates
from phrasemill.llm.templates import contaminated
from phrasemill.llm.token_files import ids_crc32, read_tokens, write_tokens
from phrasemill.llm.toxicity import score_toxicity
from phrasemill.llm.warc import archive_pages, page_rows, read_warc
from phrasemill.session import new_path, written

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, perhaps with other numbers or names."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Encode and decode every document; digests of ids and decoded texts."""
    return round_trip(table(spark, folder, "documents"), PIECES)


def op3_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, from the good ones among the labels of four folds of five."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    trusted = table(spark, folder, "labels").filter((F.col("quality") == 1) & ~held_out).select("doc_id")
    return score_quality(docs, trusted).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.SCORE_CUT).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archive every page and read the archives back."""
    place = new_path(spark, "warc")
    archive_pages(table(spark, folder, "pages"), place)
    return page_rows(read_warc(spark, place))


def op5_zstd_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, from labels of three folds of four."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = table(spark, folder, "labels").filter(~held_out)
    scored = score_toxicity(docs, toxicity.fit(docs, labels)).drop("text")
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= toxicity.SCORE_CUT).cast("int").alias("predicted"))


#: A conversation whose texts are made of the template's own control strings.
TRAP = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Format every conversation, write the pieces, and read them back."""
    names = ["conv_id", "turn", "role", "text"]
    turns = table(spark, folder, "conversations").select(*names).unionByName(
        spark.createDataFrame(TRAP, "conv_id long, turn long, role string, text string"))
    return read_chats(written(format_chats(turns), "chats"))


def op7_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Write the token ids of every document and read the files back."""
    place = new_path(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), place, WORDS, end=2)
    return ids_crc32(read_tokens(spark, place))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", hex_print("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, folder, "pages").select("page_id", "url", "html"))


def op11_entropy_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often a mix with weighted sources takes every document."""
    return mix(table(spark, folder, "documents"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every document, links weighed by counts over the corpus."""
    return align(table(spark, folder, "documents"), BYTES, PIECES).documents


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_templates, op2_sentencepiece, op3_pu_quality, op4_warc, op5_zstd_toxicity, op6_chat, op7_kmeans_tree, op8_token_files,
        op9_simhash, op10_line_blocks, op11_entropy_mix, op12_lexical_search, op13_alignment)}

#: The others need tokenizers, archives, models, trees or markup; tests hold them to brute force.
ORACLE: dict[str, str] = {"op4_warc": warc.SQL, "op6_chat": chat.SQL.format(conv=TRAP[0][0], trap=TRAP[0][3]), "op12_lexical_search": lexical.SQL}
