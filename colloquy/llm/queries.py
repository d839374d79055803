"""Registry of the queries over training data and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, table
from . import conversations, encode, mixture, mojibake, neardup, pairs, personal, subjects


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "messages"), table(spark, d, "stores"))


def p1_states(spark: SparkSession, d: str) -> DataFrame:
    """Final state of the automaton for each session, kept or not."""
    rows = conversations.sequence(table(spark, d, "messages"), table(spark, d, "stores"))
    return conversations.verdicts(rows).select("session_id", "messages", "state", "whole")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(mojibake.records(table(spark, d, "messages"), table(spark, d, "text_sources")))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled records with their text restored where it can be."""
    return mojibake.repair(mojibake.records(table(spark, d, "messages"), table(spark, d, "text_sources")))


def _voted(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "external_candidates").where("external_candidate_id is not null")
    return materialize(pairs.label_votes(c.select(F.col("external_candidate_id").alias("id"), F.col("final_question").alias("question"), F.col("final_answer").alias("answer"))))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The first defect of each defective pair, in the order of ``pairs.DEFECTS``."""
    return pairs.defects(_voted(spark, d)).select(F.col("id").alias("external_candidate_id"), F.col("defects")[0].alias("defect"))


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    """All defects of each defective pair with their posteriors."""
    out = pairs.defects(_voted(spark, d))
    return out.select(F.col("id").alias("external_candidate_id"), F.explode(F.arrays_zip("defects", "posteriors")).alias("x")).select("external_candidate_id", F.col("x.defects").alias("defect"), F.round("x.posteriors", 4).alias("posterior"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    graphs = personal.proposals(personal.texts(table(spark, d, "messages"), table(spark, d, "external_candidates")))
    return personal.found(graphs, personal.fitted(graphs))


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders."""
    df = personal.texts(table(spark, d, "messages"), table(spark, d, "external_candidates"))
    return personal.masked(df, personal.fitted(personal.proposals(df)))


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, d, "external_candidates"), "external_candidate_id", F.col("final_question"), F.col("final_answer"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).record_pairs()


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a record: its class of equal text, the links of the class and its cluster."""
    return _near(spark, d).classes()


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class representatives with their similarity."""
    return _near(spark, d).class_pairs().withColumn("similarity", F.round("similarity", 9))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.ids(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixture.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).documents


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixture.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).report()


def _areas(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d).select("doc_id", "area_code")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences of the corpus by subject."""
    return _areas(spark, d).groupBy("area_code").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))


def p10_topics(spark: SparkSession, d: str) -> DataFrame:
    """The terms that stand out in each topic and the subject it stands for, for inspection."""
    documents = table(spark, d, "documents")
    return subjects.Topics(documents, table(spark, d, "subject_labels"), subjects.area_notes(table(spark, d, "subject_areas"))).top_terms(documents)


QUERIES = {
    "p1_found": p1_found,
    "p1_states": p1_states,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_labels": p3_labels,
    "p5_found": p5_found,
    "p5_masked": p5_masked,
    "p7_found": p7_found,
    "p7_classes": p7_classes,
    "p7_links": p7_links,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
    "p10_topics": p10_topics,
}
ORACLE: dict[str, str] = {}
