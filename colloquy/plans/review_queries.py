"""Queries for gates, staged samples, recovery decisions and paired analyses, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, gates, nested, review, rules, sampling, stats, turns
from ..runtime import table
from ..sources import files
from .core_queries import _INNER, _OUTER, _SENDERS, BLIND_KEY, LEVELS

BUSINESS = rules.BUSINESS_WORDS
_WS = r"[\t-\r\x{85}\pZ,，。.!！?？~～、；;：:…·\-—_（）()【】\[\]{}]+"
_BARE = lambda c: f"lower(regexp_replace(coalesce({c}, ''), '{_WS}', '', 'g'))"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_TEXT = lambda c: f"trim(coalesce({c}, ''))"


def _question_sql(c: str) -> str:
    t = _TEXT(c)
    links, signs = gates.ONLY_LINKS, gates.PRIVATE_SIGNS
    words = " or ".join(f"contains({t}, '{w}')" for w in BUSINESS)
    rest = f"regexp_replace(regexp_replace({t}, '{signs}', '', 'g'), '{_WS}', '', 'g')"
    return (
        f"case when length({_BARE(c)}) < 2 or {_BARE(c)} in ({_IN(gates.EMPTY_QUESTIONS)}) or regexp_matches({t}, '{links}') or {t} in ({_IN(gates.ONLY_PRIVATE)}) then 'empty_or_invalid_question'"
        f" when not ({words}) and length({rest}) <= 1 and regexp_matches({t}, '{signs}') then 'pii_only_question' end"
    )


_ANSWER_SQL = f"case when {_BARE('final_answer')} in ({_IN(gates.EMPTY_ANSWERS)}) then 'empty_or_invalid_answer' end"


def question_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "external_candidates").select("external_candidate_id", gates.question_problem(F.col("final_question"), BUSINESS).alias("problem"))


def message_gate(spark: SparkSession, d: str) -> DataFrame:
    """The question gate over all messages, many of them short or links."""
    return table(spark, d, "messages").select("message_id", gates.question_problem(F.col("message_content"), BUSINESS).alias("problem"), gates.bare_keyword(F.col("message_content")).alias("keyword"))


def answer_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "external_candidates").select("external_candidate_id", gates.answer_problem(F.col("final_answer")).alias("problem"))


def pair_gate(spark: SparkSession, d: str) -> DataFrame:
    """First problem of each candidate; the upstream flag stands for private data left."""
    c = table(spark, d, "external_candidates")
    return c.select("external_candidate_id", gates.pair_problem(F.col("final_question"), F.col("final_answer"), F.col("refined_category"), F.coalesce("pii_detected", F.lit(False)), BUSINESS).alias("problem"))


_PAIR_SQL = (
    f"case when coalesce(pii_detected, false) then 'pii_residual' when ({_question_sql('final_question')}) is not null then case when {_TEXT('final_question')} = '' then 'empty_question' else 'invalid_short_input' end"
    f" when ({_ANSWER_SQL}) is not null then 'empty_answer' when {_TEXT('refined_category')} = '' then 'missing_category' end"
)


def review_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample for review in stages: inferred roles, anomalies, near the threshold, the rest."""
    c = table(spark, d, "external_candidates")
    near = F.coalesce(review.decision_margin(F.col("role_inference_sender_session_count"), F.col("role_inference_threshold_sessions"), F.col("role_inference_first_ratio"), F.col("role_inference_last_ratio")) < 0.1, F.lit(False))
    stages = [
        sampling.Stage("special", F.coalesce("role_inference_used", F.lit(False)), 4, exact=False),
        sampling.Stage("anomaly", F.coalesce("session_has_parser_anomaly", F.lit(False)), 12, exact=False),
        sampling.Stage("near", near, 8, exact=False),
        sampling.Stage("representative", F.lit(True), 96, exact=False),
    ]
    return sampling.staged(c, "external_candidate_id", "external_session_id", stages)


_MARGIN = "least((role_inference_sender_session_count - role_inference_threshold_sessions) / role_inference_threshold_sessions, role_inference_last_ratio - 0.8::double, 0.2::double - role_inference_first_ratio)"
_STAGES = [("special", "coalesce(role_inference_used, false)", 4), ("anomaly", "coalesce(session_has_parser_anomaly, false)", 12), ("near", f"coalesce({_MARGIN} < 0.1, false)", 8), ("representative", "true", 96)]


def _staged_sql() -> str:
    parts, before = [], []
    for name, where, n in _STAGES:
        used = "".join(f" and external_candidate_id not in (select external_candidate_id from {b}) and external_session_id not in (select external_session_id from {b})" for b in before)
        h = f"sha256('{name}|' || external_candidate_id)"
        parts.append(
            f"s_{name} as (select '{name}' as stage, cast(row_number() over (order by h, external_candidate_id) as integer) as place, external_candidate_id, external_session_id from (select *, {h} as h, row_number() over (partition by external_session_id order by {h}, external_candidate_id) as rn"
            f" from external_candidates where {where} and external_candidate_id is not null and external_session_id is not null{used}) where rn = 1 order by h, external_candidate_id limit {n})"
        )
        before.append(f"s_{name}")
    return "with " + ", ".join(parts) + " " + " union all ".join(f"select * from {b}" for b in before)


def decision_margins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "external_candidates")
    m = review.decision_margin(F.col("role_inference_sender_session_count"), F.col("role_inference_threshold_sessions"), F.col("role_inference_first_ratio"), F.col("role_inference_last_ratio"))
    return c.select("external_candidate_id", F.round(m, 9).alias("margin"))


_STATE = "case event_type when 'purchase' then 'committed' when 'cart' then 'retryable_failed' when 'view' then 'prepared' else 'uncertain' end"


def recovery_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions for each customer, with the events as attempts and large orders as proof."""
    e = table(spark, d, "events").where("user_id is not null")
    state = F.when(F.col("event_type") == "purchase", "committed").when(F.col("event_type") == "cart", "retryable_failed").when(F.col("event_type") == "view", "prepared").otherwise("uncertain")
    j = e.select("user_id", state.alias("state"), "event_id")
    units = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("user_id"))
    proof = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").cast("long").alias("user_id"))
    return review.recovery(units, j, proof, "user_id", "state", "event_id", 10**12)


def next_journals(spark: SparkSession, d: str) -> DataFrame:
    return review.next_attempts(recovery_decisions(spark, d), "user_id")


_RECOVERY = (
    f"j as (select user_id, count(*) as journals, max(event_id) as attempt, arg_max({_STATE}, event_id) as state from events where user_id is not null group by user_id), p as (select distinct o_custkey as user_id from orders where o_totalprice > 400000),"
    " r as (select cast(c_custkey as bigint) as user_id, coalesce(journals, 0) as journals, case when p.user_id is not null and state is null then 'authoritative_success' when p.user_id is not null and state = 'committed' then 'confirmed' when p.user_id is not null then 'reconcile_committed'"
    " when state is null then 'begin' when state = 'prepared' then 'continue_before_provider' when state = 'retryable_failed' then 'retry' else 'fail_closed' end as decision from customer left join j on j.user_id = c_custkey left join p on p.user_id = c_custkey)"
)


def paired_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose first and second line are compared on outcomes."""
    o = stats.paired_outcomes(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", (1, 2), {"many": F.col("l_quantity") > 45, "cheap": F.col("l_discount") > 0.05, "returned": F.col("l_returnflag") == "R"})
    return o.select("outcome", "both", "first_only", "second_only", "neither", F.round("p_value", 8).alias("p_value"), F.round("adjusted", 8).alias("adjusted"))


_OUTCOMES = {"many": "l_quantity > 45", "cheap": "l_discount > 0.05", "returned": "l_returnflag = 'R'"}
_PAIRED = (
    "with x as (" + " union all ".join(f"select l_orderkey, '{n}' as outcome, bool_or({c}) filter (l_linenumber = 1) as a, bool_or({c}) filter (l_linenumber = 2) as b from lineitem where l_linenumber in (1, 2) group by l_orderkey" for n, c in _OUTCOMES.items()) + "),"
    " n as (select outcome, count(*) filter (a and b) as both, count(*) filter (a and not b) as first_only, count(*) filter (not a and b) as second_only, count(*) filter (not a and not b) as neither from x where a is not null and b is not null group by outcome),"
    " p as (select *, case when first_only + second_only = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(first_only + second_only + 1) - lgamma(k + 1) - lgamma(first_only + second_only - k + 1) - (first_only + second_only) * ln(2))) from range(0, least(first_only, second_only) + 1) r(k))) end as p from n),"
    " h as (select *, row_number() over (order by p, outcome) as k, (count(*) over () - row_number() over (order by p, outcome) + 1) * p as step from p)"
    ' select outcome, "both", first_only, second_only, neither, round(p, 8) as p_value, round(least(1.0, max(step) over (order by k rows unbounded preceding)), 8) as adjusted from h'
)


def paired_scores(spark: SparkSession, d: str) -> DataFrame:
    """Means and rank sums of the scores of first and second lines."""
    s = stats.paired_scores(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", (1, 2), ["l_quantity", "l_discount"])
    return s.select("dimension", "n", *[F.round(c, 6).alias(c) for c in ("mean_first", "mean_second", "mean_difference", "w_plus", "w_minus")])


_SCORES = (
    "with x as (" + " union all ".join(f"select '{c}' as dimension, avg({c}::double) filter (l_linenumber = 1) as a, avg({c}::double) filter (l_linenumber = 2) as b from lineitem where l_linenumber in (1, 2) group by l_orderkey" for c in ("l_quantity", "l_discount")) + "),"
    " y as (select dimension, a, b, b - a as d from x where a is not null and b is not null), z as (select dimension, d, (2 * rank() over w + count(*) over (partition by dimension, abs(d)) - 1) / 2 as r from y where d <> 0 window w as (partition by dimension order by abs(d))),"
    " s as (select dimension, sum(r) filter (d > 0) as w_plus, sum(r) filter (d < 0) as w_minus from z group by dimension)"
    " select y.dimension, count(*) as n, round(avg(a), 6) as mean_first, round(avg(b), 6) as mean_second, round(avg(d), 6) as mean_difference, round(any_value(w_plus), 6) as w_plus, round(any_value(w_minus), 6) as w_minus from y join s on s.dimension = y.dimension group by y.dimension"
)


def rater_reliability(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "external_candidates")
    flag = lambda x: F.when(x, "yes").otherwise("no")
    p = c.select("external_candidate_id", flag(F.col("pii_detected")).alias("private"), flag(F.col("role_inference_used")).alias("role"))
    s = c.where("customer_turn_message_count > 1").select("external_candidate_id", flag(F.coalesce("pii_types", F.lit("")) != "").alias("private"), flag(F.col("session_has_inferred_role")).alias("role"))
    k = stats.reliability(p, s, "external_candidate_id", ["private", "role"])
    return k.select("dimension", "n", *[F.round(x, 6).alias(x) for x in ("observed", "expected", "kappa")])


_YES = lambda c: f"case when {c} then 'yes' else 'no' end"
_KAPPA = " union all ".join(
    f"(with j as (select {_YES(a)} as a, {_YES(b)} as b from external_candidates where customer_turn_message_count > 1), o as (select count(*) as n, avg(case when a = b then 1.0 else 0.0 end) as po from j),"
    f" e as (select sum(x.c * y.c) as pe from (select a as l, count(*) as c from j group by a) x join (select b as l, count(*) as c from j group by b) y using (l))"
    f" select '{name}' as dimension, n, round(po, 6) as observed, round(pe / (n * n), 6) as expected, round(case when pe / (n * n) < 1 then (po - pe / (n * n)) / (1 - pe / (n * n)) end, 6) as kappa from o, e)"
    for name, a, b in (("private", "pii_detected", "coalesce(pii_types, '') <> ''"), ("role", "role_inference_used", "session_has_inferred_role"))
)


def part_chart_errors(spark: SparkSession, d: str) -> DataFrame:
    """The check of size charts over charts that have errors: brands, with their parts as lines."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_retailprice", "p_size"))).alias("x"))  # the fixed set of brands
    line = lambda x: F.struct(x["p_retailprice"].cast("double").alias("foot_length_cm"), x["p_size"].alias("recommended_size"))
    charts = p.select(F.col("p_brand").alias("product_id"), F.struct(F.transform(F.slice("x", 1, 3), line).alias("size_chart")).alias("sizing"))
    return catalog.chart_errors(charts)


_PART_CHARTS = (
    "with r as (select p_brand, p_retailprice::double as a, p_size as b, row_number() over (partition by p_brand order by p_partkey) as i from part), l as (select *, lag(a) over w as pa, lag(b) over w as pb from r where i <= 3 window w as (partition by p_brand order by i))"
    " select distinct p_brand as product_id, 'length_not_increasing' as problem from l where i > 1 and not a > pa union all select distinct p_brand, 'size_not_increasing' from l where i > 1 and not b > pb"
)

def unit_categories(spark: SparkSession, d: str) -> DataFrame:
    """Customers as units, events as attempts, large accounts as commits; each waits for the one before."""
    units = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), F.when(F.col("c_custkey") > 1, F.col("c_custkey").cast("long") - 1).alias("before"))
    state = F.when(F.col("event_type") == "purchase", "provider_returned").when(F.col("event_type") == "cart", "retryable_failed").when(F.col("event_type") == "view", "prepared").otherwise("uncertain")
    j = table(spark, d, "events").select("user_id", state.alias("state"), "event_id")
    done = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("long").alias("user_id"))
    return review.unit_category(units, j, done, "user_id", "state", "event_id", "before", 10**12)


_UNITS = (
    "j as (select user_id, arg_max(case event_type when 'purchase' then 'provider_returned' when 'cart' then 'retryable_failed' when 'view' then 'prepared' else 'uncertain' end, event_id) as state from events where user_id is not null group by user_id),"
    " c as (select c_custkey as user_id from customer where c_acctbal > 5000), u as (select cast(c_custkey as bigint) as user_id, case when c_custkey > 1 then c_custkey - 1 end as before from customer),"
    " k as (select u.user_id, before, case when c.user_id is not null then 'successful' when state is null then 'initial' when state in ('prepared', 'provider_returned') then 'continuable' when state = 'retryable_failed' then 'retryable' else 'permanent' end as category from u left join c on c.user_id = u.user_id left join j on j.user_id = u.user_id),"
    " r as (select user_id, case when before is not null and before not in (select user_id from c) and category in ('initial', 'continuable') then 'waiting' else category end as category from k)"
)


def plan_progress(spark: SparkSession, d: str) -> DataFrame:
    c = unit_categories(spark, d).withColumn("part", F.col("user_id") % 4)
    return review.progress(c, "part").select("part", "category", "units", F.col("level").cast("int").alias("level"))


def prefix_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id is not null")
    return review.prefix_gaps(e, "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") != "error")


SPECS = {"物流发货": (["物流发货"], ["快递", "发", "天"], ["退款"]), "尺码问题": (None, ["码"], []), "退货退款": (["退货退款", "换货"], [], ["不退"])}


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the candidates against the specification of their category by the question."""
    c = table(spark, d, "external_candidates").select("external_candidate_id", "external_session_id", "final_answer", rules.classify(F.col("final_question"), F.lit("")).alias("asked"), rules.classify(F.col("final_question"), F.col("final_answer")).alias("kind"))
    specs = spark.createDataFrame([(k, *v) for k, v in SPECS.items()], "asked string, kinds array<string>, any_of array<string>, none_of array<string>")
    return review.evaluate(c, specs, "asked", "final_answer", "kind")


def evaluation_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluation(spark, d).select("external_candidate_id", F.array_join("failed", "|").alias("failed"), "score")


def case_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return review.case_verdicts(evaluation(spark, d), "external_session_id", F.col("score") == 2)


def _first(c: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains({c}, '{w}')" for w in words) + f" then '{label}'" for label, words in rules.CATEGORIES) + " end"


def _spec(kind: str, which: int) -> str:
    def test(words) -> str:
        if which == 0:
            return "false" if words is None else f"kind not in ({_IN(words)})"
        hit = " or ".join(f"contains(said, '{w}')" for w in words) or "false"
        return f"not ({hit})" if which == 1 and words else hit if which == 2 else "false"

    return f"case asked {' '.join(f'when {chr(39)}{k}{chr(39)} then {test(v[which])}' for k, v in SPECS.items())} end"


_EVALUATED = (
    f"q as (select external_candidate_id, external_session_id, coalesce(final_answer, '') as said, coalesce({_first('final_question')}, '其他') as asked, coalesce({_first('final_question')}, {_first('final_answer')}, '其他') as kind from external_candidates),"
    f" f as (select *, concat_ws('|', case when {_spec('kind', 0)} then 'kind' end, case when {_spec('any_of', 1)} then 'missing' end, case when {_spec('none_of', 2)} then 'forbidden' end) as failed from q where asked in ({_IN(SPECS)})),"
    " r as (select *, case when failed = '' then 2 when failed = 'missing' then 1 else 0 end as score from f)"
)


def blinded_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for reviewers: blind ids, placed by them within their month."""
    from ..operators import masking

    return masking.blinded(table(spark, d, "external_candidates").select("source_month", "external_candidate_id", "final_question"), "source_month", "external_candidate_id", BLIND_KEY, "b_")[0]


_BLINDED = (
    "with b as (select source_month, final_question, 'b_' || substr(sha256('{outer}'::blob || unhex(sha256('{inner}'::blob || encode(coalesce(cast(source_month as varchar), '') || chr(0) || external_candidate_id)))), 1, 24) as blind_id from external_candidates where external_candidate_id is not null)"
    " select source_month, final_question, blind_id, cast(row_number() over (partition by source_month order by blind_id) as integer) as place from b"
).format(outer=_OUTER, inner=_INNER)


def catalog_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.latest(table(spark, d, "products"), "product_id", ["revision", "ingested_at"])
    return catalog.payload_errors(rows, list(LEVELS))


_V, _BLANK = "list_filter(variants, lambda x: x is not null)", lambda c: f"coalesce(trim({c}), '') = ''"
_IDS = f"list_filter(list_transform({_V}, lambda x: trim(x.variant_id)), lambda x: x is not null and x <> '')"
_ERRORS = {
    "missing_name": _BLANK("identity.name"),
    "missing_category": _BLANK("identity.category"),
    "price_not_positive": "not coalesce(pricing.display_price > 0, false)",
    "no_variants": f"not coalesce(len({_V}) > 0, false)",
    "missing_variant_id": f"coalesce(len({_IDS}) < len({_V}), false)",
    "duplicate_variant_id": f"coalesce(len(list_distinct({_IDS})) < len({_IDS}), false)",
    "variant_without_sizes": f"coalesce(len(list_filter({_V}, lambda x: not coalesce(len(list_filter(x.available_sizes, lambda s: s is not null)) > 0, false))) > 0, false)",
    "unsafe_reference": "coalesce(len(list_filter(media.gallery, lambda x: x is not null and x.asset_ref is not null and not regexp_matches(x.asset_ref, '^[A-Za-z0-9_\\-]+(?:/[A-Za-z0-9_\\-]+)*\\.(?:png|jpe?g|webp|svg)$'))) > 0, false)",
    "unknown_level": f"coalesce(len(list_filter(map_entries(functions), lambda e: not coalesce(lower(trim(e.value.level)) in ({_IN(LEVELS)}), false))) > 0, false)",
}
_CATALOG = "with p as (select * from (select *, row_number() over (partition by product_id order by revision desc nulls last, ingested_at desc nulls last) as rn from products where product_id is not null) where rn = 1) " + " union all ".join(f"select product_id, '{k}' as problem from p where {v}" for k, v in _ERRORS.items())

def _pipeline(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from ..operators import masking
    from ..runtime import materialize
    from . import pipeline
    from .core_queries import pairs_of

    pairs = materialize(pairs_of(spark, d))
    first = [(name, lambda t, pattern=pattern, to=to: F.regexp_replace(t, pattern, to)) for name, pattern, to in masking.CHAIN]
    return pairs, materialize(pipeline.candidates(pairs, F.lit("store"), first))


def candidate_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every question/answer pair of the messages with its outcome."""
    return _pipeline(spark, d)[1]


def candidate_account(spark: SparkSession, d: str) -> DataFrame:
    from . import pipeline

    return pipeline.account(_pipeline(spark, d)[1])


def candidate_invariants(spark: SparkSession, d: str) -> DataFrame:
    from . import pipeline

    return pipeline.violations(*_pipeline(spark, d))


def answer_lineage(spark: SparkSession, d: str) -> DataFrame:
    """How the roles of each session's messages came about: by the word in the sender's name for
    stores' service desks, else by the rule over senders, else not at all."""
    m = table(spark, d, "messages").where(F.col("sender").isNotNull() & (F.trim("session_id") != ""))
    m = m.withColumn("speaker", F.concat_ws("/", "external_store_id", F.when(F.contains("sender", F.lit("客服")), "service").otherwise("customer")))
    found = turns.infer_service_senders(m, "session_id", "speaker", [F.col("input_order"), F.col("message_id")], share=0.002, last=0.6, first=0.4)
    ruled = m.join(found.select("speaker", F.lit(True).alias("_ruled")), "speaker", "left")
    how = F.when(F.col("sender_type") == "service", "legacy_keyword").when(F.col("_ruled"), "statistical_sender_rule").otherwise("unresolved")
    out = turns.answer_lineage(ruled.withColumn("how", how), ["session_id"], "how", "speaker", found)
    return out.select("session_id", "method", "inferred_senders", "sessions", "threshold", F.round("first_ratio", 9).alias("first_ratio"), F.round("last_ratio", 9).alias("last_ratio"))


_LINEAGE = (
    f"with f as ({_SENDERS}), m as (select session_id, sender_type, case when contains(sender, '客服') then concat_ws('/', external_store_id, 'service') else concat_ws('/', external_store_id, 'customer') end as speaker from messages where trim(session_id) <> '' and sender is not null),"
    " h as (select session_id, speaker, case when sender_type = 'service' then 'legacy_keyword' when f.speaker is not null then 'statistical_sender_rule' else 'unresolved' end as how, f.speaker as s, f.sessions, f.threshold, f.first_ratio, f.last_ratio from m left join f using (speaker)),"
    " o as (select session_id, how, case when how = 'statistical_sender_rule' then s end as s, case when how = 'statistical_sender_rule' then sessions end as sessions, case when how = 'statistical_sender_rule' then threshold end as threshold, case when how = 'statistical_sender_rule' then first_ratio end as first_ratio, case when how = 'statistical_sender_rule' then last_ratio end as last_ratio from h)"
    " select session_id, case when bool_or(how = 'unresolved') then 'unresolved' when bool_or(how = 'legacy_keyword') and bool_or(how = 'statistical_sender_rule') then 'mixed' when bool_or(how = 'legacy_keyword') then 'legacy_keyword' else 'statistical_sender_rule' end as method,"
    " count(distinct s) as inferred_senders, min(sessions) as sessions, max(threshold) as threshold, round(max(first_ratio), 9) as first_ratio, round(min(last_ratio), 9) as last_ratio from o group by session_id"
)


def folded_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "external_candidates").select("external_candidate_id", text.folded_key(F.col("final_question")).alias("folded"), files.canonical_digest("question", [F.col("final_question"), F.col("source_month")]).alias("digest"))


QUERIES = {f.__name__: f for f in (question_gate, message_gate, answer_gate, pair_gate, review_sample, decision_margins, recovery_decisions, next_journals, paired_outcomes, paired_scores, rater_reliability, part_chart_errors, unit_categories, plan_progress, prefix_gaps, evaluation_scores, case_verdicts, blinded_sheet, catalog_errors, candidate_outcomes, candidate_account, candidate_invariants, answer_lineage, folded_questions)}
ORACLE = {
    "question_gate": f"select external_candidate_id, {_question_sql('final_question')} as problem from external_candidates",
    "message_gate": f"select message_id, {_question_sql('message_content')} as problem, case when {_BARE('message_content')} in ({_IN(gates.KEYWORDS)}) then {_BARE('message_content')} end as keyword from messages",
    "answer_gate": f"select external_candidate_id, {_ANSWER_SQL} as problem from external_candidates",
    "pair_gate": f"select external_candidate_id, {_PAIR_SQL} as problem from external_candidates",
    "review_sample": _staged_sql(),
    "decision_margins": f"select external_candidate_id, round({_MARGIN}, 9) as margin from external_candidates",
    "recovery_decisions": f"with {_RECOVERY} select * from r",
    "next_journals": f"with {_RECOVERY} select user_id, journals + 1 as attempt, 'prepared' as state from r where decision in ('begin', 'retry')",
    "paired_outcomes": _PAIRED,
    "paired_scores": _SCORES,
    "rater_reliability": _KAPPA,
    "part_chart_errors": _PART_CHARTS,
    "unit_categories": f"with {_UNITS} select * from r",
    "plan_progress": f"with {_UNITS} select part, category, count(*) as units, cast(grouping(part, category) as integer) as level from (select user_id % 4 as part, category from r) group by rollup (part, category)",
    "prefix_gaps": "with e as (select user_id, case when event_type <> 'error' then 1 else 0 end as ok, min(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from events where user_id is not null) select user_id, cast(sum(run) as bigint) as prefix, cast(sum(ok - run) as bigint) as after_gap from e group by user_id",
    "evaluation_scores": f"with {_EVALUATED} select external_candidate_id, failed, score from r",
    "case_verdicts": f"with {_EVALUATED} select external_session_id, count(*) as turns, bool_and(score = 2) as passed from r where external_session_id is not null group by external_session_id",
    "blinded_sheet": _BLINDED,
    "catalog_errors": _CATALOG,
    "answer_lineage": _LINEAGE,
}
