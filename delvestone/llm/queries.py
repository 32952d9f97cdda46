"""The queries of this subpackage.  None has SQL that could run on whole
tables; each is tested against brute force, a round trip or held-out labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, leaks, neardup, scans, similar, split, subjects
from .common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which one is among the 5 most similar to the other, with a cosine of at least 0.70."""
    near = similar.most_similar(table(spark, d, "knowledge_clusters"), "id", "embedding_vector", "embedding_model", 384, k=5, min_cos=0.70)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extraction_outputs").select("file_id", "content", langid.given_label(F.col("detected_languages")).alias("given"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs whose record has no language label or another one than theirs."""
    records = _labelled(spark, d)
    own = langid.label_paragraphs(records.withColumn("key", F.struct("file_id", "given")), "key", "content", langid.fit(records, "file_id", "content", "given"))
    wrong = F.col("key.given").isNull() | (F.col("key.given") != F.col("lang"))
    return own.where(wrong).select("key.file_id", "para_no", "lang").distinct()


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """The language, with a confidence, of each run of sentences of one language."""
    records = _labelled(spark, d)
    coder = langid.fit(records, "file_id", "content", "given")
    return langid.label_paragraphs(records, "file_id", "content", coder, segments=True).distinct()


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """The language of each record: the one that most of its letters are written in."""
    records = _labelled(spark, d)
    coder = langid.fit(records, "file_id", "content", "given")
    letters = (
        langid.label_paragraphs(records, "file_id", "content", coder, least_letters=1).distinct()
        .groupBy("file_id", "lang").agg(F.sum("letters").alias("n"), F.avg("confidence").alias("c"))
    )
    best = letters.groupBy("file_id").agg(F.max(F.struct("n", "lang", "c")).alias("b"), F.sum("n").alias("total"))
    return best.select("file_id", F.col("b.lang").alias("lang"), (F.col("b.c") * F.col("b.n") / F.col("total")).alias("confidence"))


def _cluster_text() -> Column:
    return F.concat_ws("\n", "name", "description", "content")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of near-duplicate records, copies included, as the case is defined."""
    links, members = neardup.near_duplicates(neardup.bags(table(spark, d, "knowledge_clusters"), "id", _cluster_text(), 40))
    left = members.select(F.col("bag").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("bag").alias("b"), F.col("id").alias("y"))
    between = links.join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    return between.union(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: its class of equal records, the class's size, and its links to other classes."""
    links, members = neardup.near_duplicates(neardup.bags(table(spark, d, "knowledge_clusters"), "id", _cluster_text(), 40))
    degree = links.select(F.explode(F.array("a", "b")).alias("bag")).groupBy("bag").agg(F.count("*").alias("n_links"))
    size = members.groupBy("bag").agg(F.count("*").alias("n_copies"))
    return members.join(size, "bag").join(degree, "bag", "left").select("id", F.col("bag").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    items = split.oversized_leaves(table(spark, d, "tree_nodes"), table(spark, d, "extraction_outputs"), 4000)
    return split.split_items(items)


def p4_cohesion(spark: SparkSession, d: str) -> DataFrame:
    items = split.oversized_leaves(table(spark, d, "tree_nodes"), table(spark, d, "extraction_outputs"), 4000)
    return split.split_items(items, rule="cohesion")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_contents")
    words, outer = scans.survey(pages)
    return scans.line_kinds(pages, scans.learn(words), outer)


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    """The repaired paragraphs of each page."""
    pages = table(spark, d, "page_contents")
    words, outer = scans.survey(pages)
    return scans.repaired(pages, scans.learn(words), outer)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text", bpe.read_ranks(TOKENIZER))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document with leaked passages: how many items, and the largest share of one."""
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max("share").alias("largest_share"))


def _subject_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = subjects.fit(docs, table(spark, d, "doc_labels"), table(spark, d, "subject_areas"))
    return subjects.label_documents(docs, model)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subject_shares(spark, d).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the corpus: documents and mean share of sentences of each subject."""
    return _subject_shares(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"), F.avg("share").alias("mean_share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
