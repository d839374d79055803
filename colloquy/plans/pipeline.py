"""From chat messages to evaluation candidates, with an account of every pair and checked invariants.

Stages: question/answer pairs, masking, the pair gate, duplicates.  A pair is accepted or has exactly
one reason; nothing is dropped on the way.  Masked texts are tables in the
shared folder, as they are read more than once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, gates, masking_passes, rules
from ..runtime import materialize

Change = tuple[str, masking_passes.Change]


def candidates(pairs: DataFrame, store: Column, first: Sequence[Change] = (), stores: Sequence[str] = (), senders: Sequence[str] = (), business: Sequence[str] = tuple(rules.BUSINESS_WORDS)) -> DataFrame:
    """(candidate_id, session_id, qa_ordinal, question, answer, category, pii_types, reason): one row a pair.

    pairs: (session_id, qa_ordinal, merged_question, merged_answer); reason is null for an accepted
    pair, else 'missing_service_response', 'pii_residual', 'empty_question', 'invalid_short_input',
    'empty_answer', 'exact_duplicate' or 'normalized_duplicate'.  Of equal questions the first by
    session and place is kept; only pairs that pass the gate take part in that.
    """
    d = pairs.select("session_id", "qa_ordinal", "merged_question", "merged_answer", store.alias("_store"))
    clean = lambda df, c, out: masking_passes.run(df, c, _stages(first, stores, senders), out, f"{out}_types")
    # Tables between the long chains: each is planned alone, and read more than once below.
    d = materialize(clean(materialize(clean(d, "merged_question", "question")), "merged_answer", "answer"))
    left = masking_passes.residual_types(masking_passes.residual_types(d, "question", list(stores)).withColumnRenamed("residual", "_q"), "answer", list(stores)).withColumnRenamed("residual", "_a")
    left = materialize(left)
    category = rules.classify(F.col("question"), F.col("answer"))
    problem = gates.pair_problem(F.col("question"), F.col("answer"), category, (F.size("_q") > 0) | (F.size("_a") > 0), list(business))
    left = left.withColumn("category", category).withColumn("_problem", F.when(F.col("merged_answer").isNull(), "missing_service_response").otherwise(problem))
    passed = F.when(F.col("_problem").isNull(), text.key(F.col("question"))).otherwise("")
    marked = dedup.keep_first(left, "question", [F.col("session_id"), F.col("qa_ordinal")], passed)
    reason = F.coalesce("_problem", F.concat("dup_reason", F.lit("_duplicate")))
    types = F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce("question_types", F.array().cast("array<string>")), F.coalesce("answer_types", F.array().cast("array<string>"))))), ";")
    return marked.select(text.stable_id(20, F.col("_store"), F.col("session_id"), F.col("qa_ordinal")).alias("candidate_id"), "session_id", "qa_ordinal", "question", "answer", "category", types.alias("pii_types"), reason.alias("reason"))


def _stages(first: Sequence[Change], stores: Sequence[str], senders: Sequence[str]) -> list[Change]:
    m = masking_passes
    return [*m.marker_stages(list(stores), list(senders)), *m.supplement_stages(), *first, *m.second_stages(), ("", m.squeezed()), *m.final_stages(), ("", m.squeezed(m.FINAL.trims))]


def account(done: DataFrame) -> DataFrame:
    """(outcome, pairs): accepted pairs and each reason."""
    return done.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("pairs"))


def violations(pairs: DataFrame, done: DataFrame, stores: Sequence[str] = ()) -> DataFrame:
    """(invariant, violations): what must be 0 before the candidates may be published.

    'accounting': pairs without outcome; 'candidate_id': repeated ids; 'private_marker': accepted texts
    that hold a private name; 'residual': accepted texts that the passes would still change.
    """
    ok = done.where("reason is null")
    body = F.concat_ws("\n", "question", "answer")
    held = F.lit(False)
    for m in stores:
        held = held | body.contains(m) if len(m) >= 3 else held
    left = masking_passes.residual_types(ok.select(body.alias("_t")), "_t", list(stores))
    one = lambda name, n: n.select(F.lit(name).alias("invariant"), F.col("n").cast("long").alias("violations"))
    parts = [
        one("accounting", pairs.agg(F.count("*").alias("p")).join(done.agg(F.count("*").alias("q"))).select(F.abs(F.col("p") - F.col("q")).alias("n"))),  # one row each
        one("candidate_id", done.groupBy("candidate_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))),
        one("private_marker", ok.agg(F.count_if(held).alias("n"))),
        one("residual", left.agg(F.count_if(F.size("residual") > 0).alias("n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
