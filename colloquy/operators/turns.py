"""Turns and question/answer pairs of sessions: gaps and islands over ordered rows.

Rows of one session are read in order by a window that streams over a sorted partition and spills;
nothing is gathered into one object.  Sessions with null id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def number_turns(df: DataFrame, session: str, role: str, order: list[Column]) -> DataFrame:
    """Append ``turn_no`` LONG from 1: maximal runs of one role within a session (null is a role)."""
    w = Window.partitionBy(session).orderBy(*order)
    new = F.when(F.lag(F.lit(1)).over(w).isNull() | ~F.lag(role).over(w).eqNullSafe(F.col(role)), 1).otherwise(0)
    return df.where(F.col(session).isNotNull()).withColumn("_new", new).withColumn("turn_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def turns(df: DataFrame, session: str, role: str, order: list[Column]) -> DataFrame:
    """(session, turn_no, role, messages): one row a turn."""
    return number_turns(df, session, role, order).groupBy(session, "turn_no").agg(F.first(role).alias(role), F.count("*").alias("messages"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def qa_pairs(df: DataFrame, session: str, role: str, content: str, at: str, order: list[Column], customer: str = "customer", service: str = "service") -> DataFrame:
    """Each customer turn with the service turn right after it, or none.

    (session, qa_ordinal, question_time_start, question_time_end, merged_question, customer_messages,
    answer_time_end, merged_answer, service_messages); qa_ordinal counts all customer turns of a
    session.  Within a turn blank contents and repeats (by their comparison key) are left out; the
    rest is joined by '；' in order.
    """
    n = number_turns(df, session, role, order).withColumn("_pos", F.row_number().over(Window.partitionBy(session).orderBy(*order)))
    n = n.withColumn("_key", text.key(F.col(content)))
    good = keep_first(n.where("_key <> ''"), [session, "turn_no", "_key"], [F.col("_pos")])
    parts = F.array_sort(F.collect_list(F.struct("_pos", content)))
    merged = F.array_join(F.transform(parts, lambda x: x[content]), "；")
    text_of = good.groupBy(session, "turn_no").agg(merged.alias("merged"), F.count("*").alias("n"))
    t = n.groupBy(session, "turn_no").agg(F.first(role).alias("role"), F.min_by(at, "_pos").alias("t0"), F.max_by(at, "_pos").alias("t1"))
    t = t.join(text_of, [session, "turn_no"], "left").withColumns({"merged": F.coalesce("merged", F.lit("")), "n": F.coalesce("n", F.lit(0))})
    w = Window.partitionBy(session).orderBy("turn_no")
    nxt = lambda c: F.when(F.lead("role").over(w) == service, F.lead(c).over(w))
    t = t.withColumns({"a_text": nxt("merged"), "a_end": nxt("t1"), "a_n": nxt("n")})
    q = t.where(F.col("role") == customer)
    return q.select(
        session,
        F.row_number().over(w).alias("qa_ordinal"),
        F.col("t0").alias("question_time_start"),
        F.col("t1").alias("question_time_end"),
        F.col("merged").alias("merged_question"),
        F.col("n").alias("customer_messages"),
        F.col("a_end").alias("answer_time_end"),
        F.col("a_text").alias("merged_answer"),
        F.coalesce("a_n", F.lit(0)).alias("service_messages"),
    )


def with_context(df: DataFrame, session: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Append the previous row's columns in the session as previous_<name>."""
    w = Window.partitionBy(session).orderBy(*order)
    return df.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def session_summary(df: DataFrame, session: str, role: str, at: str) -> DataFrame:
    """(session, messages, customer_messages, service_messages, start_time, end_time)."""
    return df.where(F.col(session).isNotNull()).groupBy(session).agg(
        F.count("*").alias("messages"), F.count_if(F.col(role) == "customer").alias("customer_messages"), F.count_if(F.col(role) == "service").alias("service_messages"), F.min(at).alias("start_time"), F.max(at).alias("end_time")
    )


def infer_service_senders(df: DataFrame, session: str, sender: str, order: list[Column], share: float = 0.02, least: int = 3, last: float = 0.8, first: float = 0.2) -> DataFrame:
    """Senders that speak like a service: in enough sessions, often last, seldom first.

    (sender, sessions, first_ratio, last_ratio, threshold).  Sums per session and sender come first,
    so a sender in every session costs one row a session.
    """
    d = df.where(F.col(session).isNotNull() & F.col(sender).isNotNull())
    at = F.struct(*order)
    ends = d.groupBy(session).agg(F.min_by(sender, at).alias("f"), F.max_by(sender, at).alias("l"))
    total = ends.agg(F.greatest(F.lit(least), F.ceil(F.count("*") * F.lit(share))).cast("long").alias("threshold"))
    seen = d.select(session, sender).distinct().groupBy(sender).agg(F.count("*").alias("sessions"))
    f = ends.groupBy(F.col("f").alias(sender)).agg(F.count("*").alias("firsts"))
    la = ends.groupBy(F.col("l").alias(sender)).agg(F.count("*").alias("lasts"))
    out = seen.join(f, sender, "left").join(la, sender, "left").crossJoin(F.broadcast(total))  # one row
    out = out.withColumns({"first_ratio": F.coalesce("firsts", F.lit(0)) / F.col("sessions"), "last_ratio": F.coalesce("lasts", F.lit(0)) / F.col("sessions")})
    return out.where((F.col("sessions") >= F.col("threshold")) & (F.col("last_ratio") >= last) & (F.col("first_ratio") <= first)).select(sender, "sessions", "first_ratio", "last_ratio", "threshold")


def anomaly_fields(df: DataFrame, anomalies: DataFrame, session: str, kind: str) -> DataFrame:
    """Append anomaly_count and anomaly_types (sorted, '|'-joined) of each session."""
    a = anomalies.groupBy(session).agg(F.count("*").alias("anomaly_count"), F.array_join(F.array_sort(F.collect_set(kind)), "|").alias("anomaly_types"))
    return df.join(a, session, "left").withColumns({"anomaly_count": F.coalesce("anomaly_count", F.lit(0)), "anomaly_types": F.coalesce("anomaly_types", F.lit(""))})


def answer_lineage(df: DataFrame, by: list[str], method: str, sender: str, senders: DataFrame) -> DataFrame:
    """(by, method, inferred_senders, sessions, threshold, first_ratio, last_ratio): how the roles of
    the messages of a group came about.

    method holds 'legacy_keyword', 'statistical_sender_rule' or anything else for each message; a
    group of one of the two has it, of both 'mixed', with anything else 'unresolved'.  senders is the
    result of ``infer_service_senders``; the weakest figures of a group's inferred senders are kept.
    """
    figures = senders.select(F.col(sender).alias("_s"), "sessions", "threshold", "first_ratio", "last_ratio")
    own = F.when(F.col(method) == "statistical_sender_rule", F.col(sender))
    d = df.withColumn("_own", own).join(figures, F.col("_own") == F.col("_s"), "left")
    told, ruled = F.bool_or(F.col(method) == "legacy_keyword"), F.bool_or(F.col(method) == "statistical_sender_rule")
    other = F.bool_or(~F.coalesce(F.col(method).isin("legacy_keyword", "statistical_sender_rule"), F.lit(False)))
    kind = F.when(other, "unresolved").when(told & ruled, "mixed").when(told, "legacy_keyword").otherwise("statistical_sender_rule")
    return d.groupBy(*by).agg(
        kind.alias("method"), F.count_distinct("_s").alias("inferred_senders"), F.min("sessions").alias("sessions"), F.max("threshold").alias("threshold"), F.max("first_ratio").alias("first_ratio"), F.min("last_ratio").alias("last_ratio")
    )
