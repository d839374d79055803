"""Queries for the conversation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import roles, text
from ..operators import catalog, dedup, masking, masking_passes, nested, retrieval, review, rules, sampling, stats, turns
from ..runtime import table
from ..sources import chat, corpus
from ..streaming import sessions

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Lists that the gates need.
FOLLOWUPS = "怎么办 怎么办呀 怎么处理 咋处理 这咋办 可以吗 行吗 退吗 换吗 然后呢 什么意思 为什么 那呢 这个呢 还没发 无货了 不行 不可以".split()
BAD_ANSWERS = "可以的 可以 好的亲 好的 是的 是的亲 没有呢 没有 稍等 稍等亲 稍等一下 嗯嗯 嗯 不可以 不可以的".split()
TOPICS = [("退换", ["退货", "换货", "拒收", "维修"]), ("物流", ["快递", "运单", "包裹", "物流"]), ("尺码", ["尺码", "鞋码", "码数"]), ("return", ["refund", "return", "exchange"]), ("size", ["size", "instep", "half size"])]
RULES = {"topics": TOPICS, "follow": ["呢", "吗", "然后", "then", "and"], "reset": ["转接", "人工", "transfer"]}
ALLOWED = [("view", "click"), ("click", "cart"), ("cart", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view")]
CHART = [(0, 9, "S", 1), (10, 19, "M", 2), (15, 34, "L", 3), (35, 44, "XL", 4)]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """Messages of customers and services with a session; the role from any spelling of the type."""
    m = table(spark, d, "messages").withColumn("role", roles.role(F.col("sender_type")))
    return m.where(F.col("role").isin("customer", "service") & (F.trim("session_id") != ""))


SPOKEN = f"m as (select * from (select *, {roles.sql('sender_type')} as role from messages) where role in ('customer', 'service') and trim(session_id) <> '')"
ISLANDS = SPOKEN + ", g as (select *, case when lag(role) over w is distinct from role or lag(message_id) over w is null then 1 else 0 end as new from m window w as (partition by session_id order by input_order, message_id)), t as (select *, sum(new) over (partition by session_id order by input_order, message_id rows unbounded preceding) as turn_no, row_number() over (partition by session_id order by input_order, message_id) as pos from g)"
_SQL_KEY = "lower(regexp_replace(coalesce({0}, ''), '[\\t-\\r\\x{{85}}\\p{{Z}},，。.!！?？~～、；;：:…·\\-]+', '', 'g'))"


def sql_key(c: str) -> str:
    return _SQL_KEY.format(c)


def sql_any(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


def sql_first(c: str, pack) -> str:
    return "case " + " ".join(f"when {sql_any(c, w)} then '{label}'" for label, w in pack) + " end"


QA = ISLANDS + (
    f", k as (select *, {sql_key('message_content')} as k from t), u as (select * from (select *, row_number() over (partition by session_id, turn_no, k order by pos) as rn from k where k <> '') where rn = 1),"
    " x as (select session_id, turn_no, string_agg(message_content, '；' order by pos) as merged, count(*) as n from u group by all),"
    " y as (select session_id, turn_no, any_value(role) as role, arg_min(message_time, pos) as t0, arg_max(message_time, pos) as t1 from (select session_id, turn_no, role, pos, message_time from t) group by session_id, turn_no),"
    " z as (select y.*, coalesce(merged, '') as merged, coalesce(n, 0) as n from y left join x using (session_id, turn_no)),"
    " l as (select *, lead(role) over w as nrole, lead(merged) over w as nmerged, lead(n) over w as nn from z window w as (partition by session_id order by turn_no)),"
    " qa as (select session_id, row_number() over (partition by session_id order by turn_no) as qa_ordinal, merged as merged_question, n as customer_messages, case when nrole = 'service' then nmerged end as merged_answer, coalesce(case when nrole = 'service' then nn end, 0) as service_messages from l where role = 'customer')"
)


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    m = spoken(spark, d).select("session_id", "role", "message_content", "message_time", "input_order", "message_id")
    return turns.qa_pairs(m, "session_id", "role", "message_content", "message_time", [F.col("input_order"), F.col("message_id")])


@query("with " + QA + " select * from qa")
def qa_pairs(spark, d):
    return pairs_of(spark, d).drop("question_time_start", "question_time_end", "answer_time_end")


@query("with " + ISLANDS + " select session_id, cast(turn_no as bigint) as turn_no, any_value(role) as role, count(*) as messages from t group by session_id, turn_no")
def turn_islands(spark, d):
    return turns.turns(spoken(spark, d), "session_id", "role", [F.col("input_order"), F.col("message_id")])


@query("with " + QA + " select count(*) as turns, count(*) filter (merged_answer is null) as unanswered, count(*) filter (merged_question = '') as without_text from qa")
def unanswered_turns(spark, d):
    q = pairs_of(spark, d)
    return q.agg(F.count("*").alias("turns"), F.count_if(F.col("merged_answer").isNull()).alias("unanswered"), F.count_if(F.col("merged_question") == "").alias("without_text"))


@query("with " + QA + f", c as (select coalesce({sql_first('merged_question', rules.CATEGORIES)}, {sql_first('merged_answer', rules.CATEGORIES)}, '其他') as category from qa) select category, count(*) as n from c group by category")
def category_histogram(spark, d):
    q = pairs_of(spark, d).select(rules.classify(F.col("merged_question"), F.col("merged_answer")).alias("category"))
    return stats.distribution(q, "category")


_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_Q, _A = "coalesce(final_question, '')", "coalesce(final_answer, '')"


@query(
    f"select external_candidate_id, concat_ws('|', case when {_Q} = '' or {sql_key('final_question')} in {_LIST(FOLLOWUPS)} then 'context_missing' end, case when length({_Q}) < 6 and not {sql_any(_Q, rules.BUSINESS_WORDS)} then 'too_short_question' end,"
    f" case when length({_A}) < 10 or {sql_key('final_answer')} in {_LIST(BAD_ANSWERS)} then 'bad_answer' end) as reasons from external_candidates"
)
def quality_gate_reasons(spark, d):
    r = rules.rejections(F.col("final_question"), F.col("final_answer"), rules.BUSINESS_WORDS, FOLLOWUPS, BAD_ANSWERS)
    return table(spark, d, "external_candidates").select("external_candidate_id", F.array_join(r, "|").alias("reasons"))


@query("select refined_category, count(*) as n, count(*) filter (pii_detected) as flagged, grouping(refined_category) = 1 as is_total from external_candidates group by rollup(refined_category)")
def category_rollup(spark, d):
    return stats.with_total(table(spark, d, "external_candidates"), "refined_category", F.count("*").alias("n"), F.count_if("pii_detected").alias("flagged"))


@query(
    f"with k as (select external_candidate_id as id, final_question as q, {sql_key('final_question')} as k from external_candidates), f as (select *, row_number() over (partition by k order by id) as rn, first_value(q) over (partition by k order by id) as fq from k)"
    " select id as external_candidate_id, case when k = '' or rn = 1 then null when q = fq then 'exact' else 'normalized' end as dup_reason from f"
)
def dedup_reasons(spark, d):
    return dedup.keep_first(table(spark, d, "external_candidates").select("external_candidate_id", "final_question"), "final_question", [F.col("external_candidate_id")]).select("external_candidate_id", "dup_reason")


@query("with " + SPOKEN + " select session_id, count(*) as messages, count(*) filter (role = 'customer') as customer_messages, count(*) filter (role = 'service') as service_messages, min(message_time) as start_time, max(message_time) as end_time from m group by session_id")
def session_summary(spark, d):
    return turns.session_summary(spoken(spark, d), "session_id", "role", "message_time")


_SENDERS = (
    "with m as (select session_id, case when contains(sender, '客服') then external_store_id || '/service' else external_store_id || '/customer' end as speaker, input_order, message_id from messages where trim(session_id) <> '' and sender is not null),"
    " e as (select session_id, arg_min(speaker, struct_pack(a := input_order, b := message_id)) as f, arg_max(speaker, struct_pack(a := input_order, b := message_id)) as l from m group by session_id), s as (select speaker, count(distinct session_id) as sessions from m group by speaker),"
    " t as (select greatest(3, ceil(count(*) * 0.002)) as threshold from e) select s.speaker, sessions, coalesce(fn, 0) / sessions as first_ratio, coalesce(ln, 0) / sessions as last_ratio, cast(threshold as bigint) as threshold from s left join (select f, count(*) as fn from e group by f) a on a.f = s.speaker"
    " left join (select l, count(*) as ln from e group by l) b on b.l = s.speaker, t where sessions >= threshold and coalesce(ln, 0) / sessions >= 0.6 and coalesce(fn, 0) / sessions <= 0.4"
)


@query(_SENDERS)
def role_inference(spark, d):
    m = table(spark, d, "messages").where(F.col("sender").isNotNull() & (F.trim("session_id") != ""))
    m = m.withColumn("speaker", F.concat_ws("/", "external_store_id", F.when(F.contains("sender", F.lit("客服")), "service").otherwise("customer")))
    return turns.infer_service_senders(m, "session_id", "speaker", [F.col("input_order"), F.col("message_id")], share=0.002, last=0.6, first=0.4)


@query(
    "with " + SPOKEN + ", a as (select session_id, case when message_time is null then 'no_time' else 'odd_role' end as kind from messages where message_time is null or lower(trim(coalesce(sender_type, ''))) in ('', 'unknown', '?')), b as (select session_id, count(*) as n, string_agg(distinct kind, '|' order by kind) as kinds from a group by session_id)"
    " select s.session_id, s.messages, coalesce(n, 0) as anomaly_count, coalesce(kinds, '') as anomaly_types from (select session_id, count(*) as messages from m group by session_id) s left join b using (session_id)"
)
def lineage_anomaly_join(spark, d):
    m = table(spark, d, "messages")
    odd = m.where(F.col("message_time").isNull() | F.lower(F.trim(F.coalesce("sender_type", F.lit("")))).isin("", "unknown", "?"))
    odd = odd.select("session_id", F.when(F.col("message_time").isNull(), "no_time").otherwise("odd_role").alias("kind"))
    s = spoken(spark, d).groupBy("session_id").agg(F.count("*").alias("messages"))
    return turns.anomaly_fields(s, odd, "session_id", "kind")


@query("with " + SPOKEN + " select message_id, lag(role) over w as previous_role, lag(message_content) over w as previous_message_content from m window w as (partition by session_id order by input_order, message_id)")
def context_lag(spark, d):
    return turns.with_context(spoken(spark, d), "session_id", [F.col("input_order"), F.col("message_id")], ["role", "message_content"]).select("message_id", "previous_role", "previous_message_content")


@query("select content_kind, count(*) as n from (select case when regexp_matches(message_content, '(?i)(?:https?://|www\\.)\\S+') or regexp_matches(message_content, '(?i)\\.(?:jpe?g|png|gif|webp|bmp)(?:[?#]\\S*)?\\b') then 'image_or_link' else 'text' end as content_kind from messages) group by content_kind")
def content_kinds(spark, d):
    return stats.distribution(table(spark, d, "messages").select(text.content_kind(F.col("message_content")).alias("content_kind")), "content_kind")


@query(f"select external_candidate_id, len(list_filter([{', '.join(repr(w) for w in rules.BUSINESS_WORDS)}], lambda w: contains(coalesce(final_answer, ''), w))) as keywords, length(regexp_replace({sql_key('final_answer')}, '[^0-9]', '', 'g')) as digits, length({sql_key('final_answer')}) as key_length from external_candidates")
def answer_specificity(spark, d):
    s = text.specificity(F.col("final_answer"), rules.BUSINESS_WORDS)
    return table(spark, d, "external_candidates").select("external_candidate_id", s.alias("s")).select("external_candidate_id", F.col("s.keywords").cast("long").alias("keywords"), F.col("s.digits").cast("long").alias("digits"), F.col("s.length").cast("long").alias("key_length"))


@query("select external_candidate_id, concat_ws('|', " + ", ".join(f"case when {sql_any(_Q, w)} then '{label}' end" for label, w in rules.CATEGORIES) + ") as labels from external_candidates")
def multi_labels(spark, d):
    return table(spark, d, "external_candidates").select("external_candidate_id", F.array_join(rules.all_matches(F.coalesce("final_question", F.lit("")), rules.CATEGORIES), "|").alias("labels"))


NOISE = {"customer": ["你好", "在吗", "ok", "好的"], "service": ["稍等", "好的", "收到"]}
TEMPLATE = "聊天记录中暂不支持展示"
_U = r"[\s\pZ\x1c-\x1f\x{85}\x{0b}]"
_EDGES = r"regexp_replace(replace(message_content, chr(65279), ''), '^[ \t\r\n；;]+|[ \t\r\n；;]+$', '', 'g')"
_BARE = r"regexp_replace(regexp_replace(v, '(?i)#[\t-\r ]*E[\t-\r ]*[-_][\t-\r ]*[A-Z][\t-\r ]*[0-9]+', '', 'g'), '^[ \t，,。；;：:]+|[ \t，,。；;：:]+$', '', 'g')"
_PIECES = f"list_filter(regexp_split_to_array(v, '(?:{_U}|[；;])+'), lambda x: x <> '')"
_LINKS = f"(len({_PIECES}) > 0 and len(list_filter({_PIECES}, lambda x: not (regexp_matches(x, '^(?i)(?:https?://|www\\.)[^\\t-\\r ]+$') or regexp_matches(x, '(?i)^(?:\\[?图片\\]?|\\[?image\\]?|图片链接|查看图片|发送了一张图片)$')))) = 0)"
_SEEN = lambda c: f"regexp_matches({c}, '[㐀-鿿A-Za-z0-9]')"
_NOISY = lambda c, who: f"{sql_key(c)} in ('', {', '.join(repr(w) for w in NOISE[who])})"
_ONE_LINE = lambda c: f"regexp_replace({c}, '[\\t-\\r ]*\\r?\\n[\\t-\\r ]*', '；', 'g')"


@query(
    f"with {SPOKEN}, v as (select message_id, role, message_content, {_EDGES} as v from m), b as (select *, {_BARE} as b from v), c as (select message_id, case when message_content is null or v = '' or {_LINKS} then ''"
    f" when role = 'customer' then case when {_NOISY('v', 'customer')} or not {_SEEN('v')} then '' else {_ONE_LINE('v')} end else case when contains(v, '{TEMPLATE}') or {_NOISY('b', 'service')} or not {_SEEN('b')} then '' else {_ONE_LINE('b')} end end as cleaned from b) select * from c where cleaned <> ''"
)
def cleaned_turn_messages(spark, d):
    m = spoken(spark, d)
    c, s = text.clean_customer(F.col("message_content"), NOISE["customer"]), text.clean_service(F.col("message_content"), NOISE["service"], TEMPLATE)
    return m.select("message_id", F.when(F.col("role") == "customer", c).otherwise(s).alias("cleaned")).where("cleaned <> ''")


@query()
def incremental_questions(spark, d):
    q = pairs_of(spark, d).where("merged_question <> ''").select("session_id", "qa_ordinal", "merged_question", F.coalesce("merged_answer", F.lit("")).alias("answer"), rules.classify(F.col("merged_question"), F.col("merged_answer")).alias("category"), F.col("customer_messages").cast("int").alias("context_message_count"))
    return dedup.incremental(q, "session_id", ["qa_ordinal"], rules.BUSINESS_WORDS, rules.CATEGORIES, FOLLOWUPS)


# Masking.
def _sql_mask() -> tuple[str, list[str]]:
    out, now = [], "message_content"
    for name, pattern, to in masking.CHAIN:
        p = pattern.replace("\n", "\\n")
        out.append(f"len(regexp_extract_all({now}, '{p}')) as n_{name}")
        now = f"regexp_replace({now}, '{p}', '{to}', 'g')"
    return now, out


_MASKED, _COUNTS = _sql_mask()


@query(f"select message_id, {_MASKED} as masked from messages")
def pii_chain(spark, d):
    return masking.mask(table(spark, d, "messages"), "message_content").select("message_id", "masked")


@query("with c as (select " + ", ".join(_COUNTS) + " from messages where message_content is not null) " + " union all ".join(f"select '{n}' as pii_type, cast(coalesce(sum(n_{n}), 0) as bigint) as matches, count(*) filter (n_{n} > 0) as texts from c" for n, *_ in masking.CHAIN))
def pii_counts(spark, d):
    return masking.mask_counts(table(spark, d, "messages"), "message_content")


@query()
def second_pass(spark, d):
    return masking_passes.second_pass(masking.mask(table(spark, d, "messages"), "message_content").select("message_id", F.col("masked").alias("text")), "text").select("message_id", "masked", F.array_join("pii_types", ";").alias("types"))


@query()
def sanitized_candidates(spark, d):
    """Questions of the candidates through all passes, with what is left."""
    first = [(name, lambda t, pattern=pattern, to=to: F.regexp_replace(t, pattern, to)) for name, pattern, to in masking.CHAIN]
    c = masking_passes.sanitize(table(spark, d, "external_candidates").select("external_candidate_id", "final_question"), "final_question", first=first)
    return masking_passes.residual_types(c, "masked").select("external_candidate_id", "masked", F.array_join("pii_types", ";").alias("types"), F.array_join("residual", ";").alias("residual"))


@query("select message_id, replace(replace(message_content, '客服小禾', '[PRIVATE]'), '客服', '[PRIVATE]') as masked from messages")
def private_markers(spark, d):
    return table(spark, d, "messages").select("message_id", masking.replace_markers(F.col("message_content"), ["客服", "客服小禾", "x"]).alias("masked"))


@query("select message_id, substr(sha256(coalesce(external_store_id, '') || chr(0) || coalesce(session_id, '')), 1, 16) as stable_session from messages")
def stable_ids(spark, d):
    return table(spark, d, "messages").select("message_id", text.stable_id(16, F.col("external_store_id"), F.col("session_id")).alias("stable_session"))


BLIND_KEY = b"review"
# The keyed hash written out: hash of the outer key and the hash of the inner key and the message.
_INNER, _OUTER = ("".join(f"\\x{b ^ x:02X}" for b in BLIND_KEY.ljust(64, b"\0")) for x in (0x36, 0x5C))


@query(f"select external_candidate_id, 'r_' || substr(sha256('{_OUTER}'::blob || unhex(sha256('{_INNER}'::blob || encode(external_candidate_id)))), 1, 24) as blind from external_candidates")
def blind_ids(spark, d):
    return masking.blind_id(table(spark, d, "external_candidates").select("external_candidate_id"), ["external_candidate_id"], BLIND_KEY, "r_", "blind")


# Retrieval: every vector whose id is divisible by 50 asks, all answer.
def _top(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.top_k(e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10, "vec_id", "query_id")


_TOP = "top as (select * from (select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.embedding::double[], c.embedding::double[]) as similarity, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], c.embedding::double[]) desc, c.vec_id) as rank from embeddings q, embeddings c where q.vec_id % 50 = 0) where rank <= 10)"


@query("with " + _TOP + " select query_id, vec_id, round(similarity, 6) as similarity, cast(rank as integer) as rank from top")
def topk_cosine(spark, d):
    return _top(spark, d).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


_LABELED = ", r as (select top.*, e.label, q.label as query_label from top join embeddings e using (vec_id) join embeddings q on q.vec_id = top.query_id)"


def _labeled(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return _top(spark, d).join(e, "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


@query("with " + _TOP + _LABELED + ", s as (select *, similarity + case when label = query_label then 0.14 else -0.08 end as score from r) select query_id, vec_id, cast(row_number() over (partition by query_id order by score desc, similarity desc, rank) as integer) as new_rank, case when label = query_label then 'same' else 'other' end as reasons from s")
def rerank_label(spark, d):
    same = F.col("label") == F.col("query_label")
    out = retrieval.rerank(_labeled(spark, d), "query_id", "similarity", "rank", [("same", same, 0.14), ("other", ~same, -0.08)])
    return out.select("query_id", "vec_id", "new_rank", "reasons")


@query("with " + _TOP + _LABELED + " select query_id, vec_id from (select *, max(label = 3) over (partition by query_id) as any_ok from r) where label = 3 or not any_ok")
def soft_filter(spark, d):
    return retrieval.soft_filter(_labeled(spark, d), "query_id", F.col("label") == 3).select("query_id", "vec_id")


@query("with " + _TOP + " select query_id, max(similarity) < 0.55 as low from top where vec_id <> query_id group by query_id")
def low_confidence(spark, d):
    return retrieval.low_confidence(_top(spark, d).where("vec_id <> query_id"), "query_id", "similarity").select("query_id", "low")


@query("select doc_id from documents where not (doc_id % 97 = 0 and source = 'chat_log') or source is null")
def quarantine_anti_join(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.quarantine(docs, docs.where("doc_id % 97 = 0 and source = 'chat_log'"), ["source", "doc_id"]).select("doc_id")


# Sampling.
@query("select doc_id from documents order by sha256('s1|' || doc_id), doc_id limit 100")
def hash_sample(spark, d):
    return sampling.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, "s1")


@query("with h as (select doc_id, source, sha256('s2|' || doc_id) as h from documents), f as (select *, case when row_number() over (partition by source order by h, doc_id) = 1 and source is not null then 0 else 1 end as k from h) select doc_id, source from f order by k, h, doc_id limit 40")
def stratified_fill(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return sampling.one_each_then_fill(docs, "doc_id", "source", 40, "s2")


_APPORTION = "c as (select source, count(*) as n from documents where source is not null group by source), q as (select *, n * 100 / sum(n) over () as x from c), f as (select *, floor(x) as b, row_number() over (order by x - floor(x) desc, source) as r, 100 - sum(floor(x)) over () as l from q), a as (select source, n, cast(b + case when r <= l then 1 else 0 end as bigint) as seats from f)"


def _seats(spark, d):
    counts = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return stats.apportion(counts, "source", "n", 100)


@query("with " + _APPORTION + " select * from a")
def apportion(spark, d):
    return _seats(spark, d)


@query("with " + _APPORTION + " select doc_id, source from (select doc_id, source, seats, row_number() over (partition by source order by sha256('s3|' || doc_id), doc_id) as rn from documents join a using (source)) where rn <= seats")
def quota_sample(spark, d):
    return sampling.quotas(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", _seats(spark, d), "s3")


# Review tables: two raters from the flags of the candidates.
_RATERS = "p as (select external_candidate_id as id, case when pii_detected then 'yes' when pii_detected is null then 'uncertain' else 'no' end as label, candidate_status as status from external_candidates), s as (select external_candidate_id as id, case when coalesce(pii_types, '') <> '' then 'yes' else 'no' end as label, candidate_status as status from external_candidates where customer_turn_message_count > 1), a as (select id, 'no' as label, cast(null as varchar) as status from s where label = 'yes')"


def _raters(spark, d):
    c = table(spark, d, "external_candidates").withColumnRenamed("external_candidate_id", "id")
    p = c.select("id", F.when(F.col("pii_detected"), "yes").when(F.col("pii_detected").isNull(), "uncertain").otherwise("no").alias("label"), F.col("candidate_status").alias("status"))
    s = c.where("customer_turn_message_count > 1").select("id", F.when(F.coalesce("pii_types", F.lit("")) != "", "yes").otherwise("no").alias("label"), F.col("candidate_status").alias("status"))
    return p, s, s.where("label = 'yes'").select("id", F.lit("no").alias("label"), F.lit(None).cast("string").alias("status"))


@query("with " + _RATERS + " select p.id, coalesce(a.label, p.label) as label, coalesce(a.status, p.status) as status, case when a.id is not null then 'adjudicated' when s.id is not null then 'double' else 'single' end as decision_source from p left join s using (id) left join a using (id)")
def review_merge(spark, d):
    return review.merge(*_raters(spark, d), "id", ["label", "status"])


@query("with " + _RATERS + " select p.id, concat_ws('|', case when p.label is distinct from s.label then 'label' end, case when p.status is distinct from s.status then 'status' end) as disputed from p join s using (id) where p.label is distinct from s.label or p.status is distinct from s.status")
def disagreements(spark, d):
    p, s, _ = _raters(spark, d)
    return review.disagreements(p, s, "id", ["label", "status"]).select("id", F.array_join("disputed_fields", "|").alias("disputed"))


@query("with " + _RATERS + " select id, 'left' as side from p where id not in (select id from s) union all select id, 'right' from s where id not in (select id from p)")
def id_difference(spark, d):
    p, s, _ = _raters(spark, d)
    return review.difference(p, s, "id")


@query("with " + _RATERS + ", j as (select p.label as a, s.label as b from p join s using (id)), o as (select count(*) as n, avg(case when a = b then 1.0 else 0.0 end) as po from j), e as (select sum(x.c * y.c) as pe from (select a as l, count(*) as c from j group by a) x join (select b as l, count(*) as c from j group by b) y using (l)) select n, round(po, 6) as observed, round(pe / (n * n), 6) as expected, round((po - pe / (n * n)) / (1 - pe / (n * n)), 6) as kappa from o, e")
def cohen_kappa(spark, d):
    p, s, _ = _raters(spark, d)
    j = p.select("id", F.col("label").alias("a")).join(s.select("id", F.col("label").alias("b")), "id")
    k = stats.kappa(j, [], "a", "b")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query("with j as (select o_orderstatus as g, cast(substr(o_orderpriority, 1, 1) as integer) as a, cast(o_custkey % 5 + 1 as integer) as b from orders), n as (select g, count(*) as n, sum(1 - abs(a - b) / 4.0) as po from j group by g), e as (select x.g, sum(x.c * y.c * (1 - abs(x.a - y.b) / 4.0)) as pe from (select g, a, count(*) as c from j group by g, a) x join (select g, b, count(*) as c from j group by g, b) y on x.g = y.g group by x.g) select n.g as o_orderstatus, n, round((po / n - pe / (n * n)) / (1 - pe / (n * n)), 6) as kappa from n join e using (g)")
def weighted_kappa(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("a"), (F.col("o_custkey") % 5 + 1).cast("int").alias("b"))
    return stats.kappa(o, ["o_orderstatus"], "a", "b", [1, 2, 3, 4, 5], weighted=True).select("o_orderstatus", "n", F.round("kappa", 6).alias("kappa"))


# Statistics.
@query("select l_returnflag, count(l_quantity) as n, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as sd, median(l_quantity) as median, min(l_quantity) as low, max(l_quantity) as high from lineitem group by l_returnflag")
def numeric_summary(spark, d):
    s = stats.numeric_summary(table(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double")), ["l_returnflag"], "l_quantity")
    return s.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "median", "low", "high")


@query("select source_month, count(*) filter (pii_detected) as passed, count(*) filter (not pii_detected) as failed, round(count(*) filter (pii_detected) / count(pii_detected), 6) as rate from external_candidates group by source_month")
def binary_summary(spark, d):
    b = stats.binary_summary(table(spark, d, "external_candidates"), ["source_month"], F.col("pii_detected"))
    return b.withColumn("rate", F.round("rate", 6))


@query("select l_returnflag, quantile_disc(l_extendedprice, 0.9) as percentile from lineitem group by l_returnflag")
def nearest_rank(spark, d):
    return stats.nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9)


@query("select l_linestatus, round(quantile_cont(l_discount, 0.25), 6) as quantile from lineitem group by l_linestatus")
def linear_quantile(spark, d):
    return stats.linear_quantile(table(spark, d, "lineitem"), ["l_linestatus"], "l_discount", 0.25).withColumn("quantile", F.round("quantile", 6))


@query("select l_orderkey, l_linenumber, rank() over w + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as mid_rank from lineitem window w as (partition by l_returnflag order by l_quantity)")
def mid_ranks(spark, d):
    return stats.mid_ranks(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", "mid_rank")


_DIFF = "x as (select source_month, customer_turn_message_count - service_turn_message_count as diff from external_candidates where customer_turn_message_count <> service_turn_message_count), y as (select source_month, diff, rank() over (partition by source_month order by abs(diff)) + (count(*) over (partition by source_month, abs(diff)) - 1) / 2.0 as r from x)"


@query("with " + _DIFF + " select source_month, coalesce(sum(r) filter (diff > 0), 0) as w_plus, coalesce(sum(r) filter (diff < 0), 0) as w_minus from y group by source_month")
def wilcoxon_rank_sums(spark, d):
    c = table(spark, d, "external_candidates").withColumn("diff", F.col("customer_turn_message_count") - F.col("service_turn_message_count")).where("diff <> 0").select("source_month", "diff", F.abs("diff").alias("size"))
    r = stats.mid_ranks(c, ["source_month"], "size")
    plus = lambda w: F.coalesce(F.sum(F.when(w, F.col("mid_rank"))), F.lit(0.0))
    return r.groupBy("source_month").agg(plus(F.col("diff") > 0).alias("w_plus"), plus(F.col("diff") < 0).alias("w_minus"))


def paired(spark, d):
    """Differences of paired counts of the candidates."""
    return table(spark, d, "external_candidates").select("source_month", "external_candidate_id", (F.col("customer_turn_message_count") - F.col("service_turn_message_count")).alias("difference"))


@query()
def wilcoxon_exact(spark, d):
    return stats.wilcoxon(paired(spark, d), ["source_month"], "difference")


@query("select source_month, count(*) filter (a and b) as both, count(*) filter (a and not b) as first_only, count(*) filter (not a and b) as second_only, count(*) filter (not a and not b) as neither from (select source_month, pii_detected as a, coalesce(pii_types, '') <> '' as b from external_candidates) group by source_month")
def mcnemar_counts(spark, d):
    m = stats.mcnemar(table(spark, d, "external_candidates"), ["source_month"], F.col("pii_detected"), F.coalesce("pii_types", F.lit("")) != "")
    return m.drop("p_value")


@query("with c as (select source_month, count(*) filter (a and not b) as x, count(*) filter (not a and b) as y from (select source_month, pii_detected as a, coalesce(pii_types, '') <> '' as b from external_candidates) group by source_month) select source_month, round(case when x + y = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(x + y + 1) - lgamma(k + 1) - lgamma(x + y - k + 1) - (x + y) * ln(2))) from range(0, least(x, y) + 1) r(k))) end, 9) as p_value from c")
def mcnemar_exact(spark, d):
    m = stats.mcnemar(table(spark, d, "external_candidates"), ["source_month"], F.col("pii_detected"), F.coalesce("pii_types", F.lit("")) != "")
    return m.select("source_month", F.round("p_value", 9).alias("p_value"))


@query("with p as (select l_returnflag as family, l_shipmode_or_line as name, p from (select l_returnflag, l_linenumber as l_shipmode_or_line, avg(l_discount) / 10 as p from lineitem group by all)), r as (select *, (count(*) over (partition by family) - row_number() over (partition by family order by p, name) + 1) * p as step, row_number() over (partition by family order by p, name) as k from p) select family, name, round(least(1.0, max(step) over (partition by family order by k rows unbounded preceding)), 8) as adjusted from r")
def holm(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("name")).agg((F.avg(F.col("l_discount").cast("double")) / 10).alias("p"))
    return stats.holm(p, "family", "name", "p").select("family", "name", F.round("adjusted", 8).alias("adjusted"))


@query()
def bootstrap_interval(spark, d):
    return stats.bootstrap_interval(paired(spark, d), ["source_month"], "difference", ["external_candidate_id"])


@query("select d.source_month, coalesce(n, 0) as n from (select unnest(range(1, 13)) as source_month) d left join (select source_month, count(*) as n from external_candidates group by 1) using (source_month)")
def zero_filled_months(spark, d):
    return stats.distribution(table(spark, d, "external_candidates"), "source_month", list(range(1, 13))).withColumn("source_month", F.col("source_month").cast("long"))


# Lookups and journals.
@query("select p_partkey, case " + " ".join(f"when p_size between {a} and {b} then '{s}'" for a, b, s, _ in CHART) + " end as label from part")
def size_range_join(spark, d):
    chart = spark.createDataFrame(CHART, "low int, high int, label string, place int")
    return review.range_lookup(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", chart, "low", "high", "label", "place").select("p_partkey", "label")


@query("select s_suppkey, n_nationkey from supplier, nation where abs(s_acctbal / 400 - n_nationkey) < 0.5")
def nearest_equality(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal").cast("double") / 400).alias("a"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("double").alias("b"))
    return review.nearest_equal(s, n, "a", "b", 0.5).select("s_suppkey", "n_nationkey")


@query("with e as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) select event_id, p as previous_state, p is null or (p, event_type) in (" + ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED) + ") as legal from e")
def journal_transitions(spark, d):
    return review.transitions(table(spark, d, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")], ALLOWED).select("event_id", "previous_state", "legal")


@query("with e as (select user_id, min(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as ok from events) select user_id, cast(sum(ok) as bigint) as prefix from e group by user_id")
def contiguous_prefix(spark, d):
    return review.contiguous_prefix(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") != "error")


@query("select l_orderkey, count(*) as attempts, case when count(*) filter (l_returnflag = 'N') > 0 then 'done' when count(*) >= 3 then 'failed' else 'open' end as status from lineitem where l_linenumber <= 3 group by l_orderkey")
def first_success(spark, d):
    return review.first_success(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "N")


@query("with u as (select area_code, system, turn, sha256('plan|' || area_code || '|' || system) as h from subject_areas, (values ('a'), ('b')) s(system), (values (1), (2)) t(turn)) select area_code, system, turn, row_number() over (order by h, area_code, system, turn) as execution_order from u")
def eval_plan(spark, d):
    from pyspark.sql import Window

    units = table(spark, d, "subject_areas").select("area_code", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("system")).withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2))))
    units = units.withColumn("h", text.order_hash("plan", F.col("area_code"), F.col("system")))
    return units.withColumn("execution_order", F.row_number().over(Window.orderBy("h", "area_code", "system", "turn"))).drop("h")


@query("select external_candidate_id, concat_ws('|', case when not coalesce(source_month between 1 and 12, false) then 'month' end, case when not coalesce(candidate_status is not null, false) then 'status' end, case when not coalesce(role_inference_coverage_ratio between 0 and 1, false) then 'ratio' end) as violated from external_candidates where not (coalesce(source_month between 1 and 12, false) and candidate_status is not null and coalesce(role_inference_coverage_ratio between 0 and 1, false))")
def violations(spark, d):
    v = review.violations(table(spark, d, "external_candidates"), "external_candidate_id", {"month": F.col("source_month").between(1, 12), "status": F.col("candidate_status").isNotNull(), "ratio": F.col("role_inference_coverage_ratio").between(0, 1)})
    return v.select("external_candidate_id", F.array_join("violated", "|").alias("violated"))


# Sources and corpus.
@query()
def chat_messages(spark, d):
    return chat.messages(chat.parse(table(spark, d, "text_sources")))


@query()
def chat_sessions(spark, d):
    return chat.sessions(chat.parse(table(spark, d, "text_sources")))


@query()
def chat_errors(spark, d):
    return chat.errors(chat.parse(table(spark, d, "text_sources")))


_WS = "[\\t-\\r\\x{85}\\p{Z}]"
_STRIPPED = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


@query(f"select 'qa_' || external_session_id || '_' || external_candidate_id as doc_id, coalesce(nullif({_STRIPPED('refined_category')}, ''), '其他') as category, {_STRIPPED('final_question')} as text_for_embedding, {_STRIPPED('final_answer')} as answer_or_content from external_candidates where {_STRIPPED(_Q)} <> '' and {_STRIPPED(_A)} <> '' and external_session_id is not null")
def corpus_rows(spark, d):
    c = table(spark, d, "external_candidates").where("external_session_id is not null").select(F.col("external_session_id").alias("session_id"), F.col("external_candidate_id").alias("row_index"), F.col("final_question").alias("question"), F.col("final_answer").alias("answer"), F.col("refined_category").alias("category"), F.col("source_file_id").alias("source_file"))
    return corpus.from_pairs(c).select("doc_id", "category", "text_for_embedding", "answer_or_content")


@query("with r as (select doc_id, title, row_number() over (partition by title order by doc_id) as rn from documents where title is not null) select doc_id, case when rn = 1 then title else title || '__dup_' || rn end as title from r")
def unique_titles(spark, d):
    return corpus.unique_ids(table(spark, d, "documents").where("title is not null").select("doc_id", "title"), "title", ["doc_id"])


# Catalogue.
def _latest(spark, d):
    return nested.latest(table(spark, d, "products"), "product_id", ["revision", "ingested_at"])


_PRODUCTS = "with p as (select * from (select *, row_number() over (partition by product_id order by revision desc nulls last, ingested_at desc nulls last) as rn from products where product_id is not null) where rn = 1)"


@query(_PRODUCTS + ", c as (select product_id, unnest(list_filter(sizing.size_chart, lambda x: x is not null)) as x, generate_subscripts(list_filter(sizing.size_chart, lambda x: x is not null), 1) as i from p), l as (select product_id, i, x.foot_length_cm as a, x.recommended_size as b, lag(x.foot_length_cm) over w as pa, lag(x.recommended_size) over w as pb from c window w as (partition by product_id order by i)) select distinct product_id, 'length_not_increasing' as problem from l where i > 1 and not coalesce(a > pa, false) union all select distinct product_id, 'size_not_increasing' from l where i > 1 and not coalesce(b > pb, false)")
def size_chart_errors(spark, d):
    return catalog.chart_errors(_latest(spark, d))


_VARIANTS = "list_filter(variants, lambda x: x is not null)"
_COLOURS = f"list_sort(list_distinct(list_filter(list_transform({_VARIANTS}, lambda x: trim(x.color_name)), lambda c: c <> '')))"
_SIZES = f"list_sort(list_distinct(list_filter(flatten(list_transform({_VARIANTS}, lambda x: coalesce(x.available_sizes, []))), lambda s: s is not null)))"


@query(_PRODUCTS + f" select product_id, identity.name as name, identity.category as category, pricing.display_price as display_price, coalesce(array_to_string({_COLOURS}, '|'), '') as colours, coalesce(array_to_string({_SIZES}, '|'), '') as sizes from p")
def public_products(spark, d):
    return catalog.public_view(_latest(spark, d))


LEVELS = {"high": 3, "medium": 2, "low": 1, "高": 3, "中": 2, "低": 1}


@query(_PRODUCTS + ", e as (select product_id, unnest(map_entries(functions)) as e from p), r as (select product_id, e.key as k, row_number() over (partition by product_id order by case lower(trim(e.value.level)) " + " ".join(f"when '{w}' then {n}" for w, n in LEVELS.items()) + " else 0 end desc, e.key) as rn from e) select p.product_id, r.k as key_function from p left join r on r.product_id = p.product_id and r.rn = 1")
def key_functions(spark, d):
    return catalog.key_function(_latest(spark, d), LEVELS)


# State and event time.
@query()
def session_replay(spark, d):
    return sessions.replay(spoken(spark, d), "session_id", ["input_order", "message_id"], "message_content", RULES)


@query("select cast(epoch(time_bucket(interval '10 minutes', ts)) as bigint) as start_s, event_type, count(*) as n from events where ts is not null group by all")
def event_windows(spark, d):
    w = sessions.windowed_counts(table(spark, d, "events").withColumn("ts", F.expr("timestamp_micros(unix_micros(cast(ts as timestamp)))")), "ts", "event_type")
    return w.select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


@query("with e as (select user_id, ts, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, cast(floor(epoch(min(ts))) as bigint) as start_s, count(*) as n from s group by user_id, k")
def event_sessions(spark, d):
    w = sessions.session_windows(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")
    return w.select("user_id", F.unix_seconds("start").alias("start_s"), "n")


@query()
def measured_values(spark, d):
    from ..functions.measures import measured

    c = table(spark, d, "external_candidates").select("external_candidate_id", F.inline(measured("final_answer")))
    return c.select("external_candidate_id", "kind", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "unit")


@query()
def answer_claims(spark, d):
    from ..operators.claims import drop_claims

    c = table(spark, d, "external_candidates").select("external_candidate_id", "final_answer")
    families = {"promise": "保证|一定|肯定|绝对|guarantee", "refund": "已经退款|退款成功|refund (?:is|was) (?:done|sent)", "time": r"\d+小时内|\d+天内|within \d+ (?:hours|days)"}
    out = drop_claims(c, "final_answer", families, ["不", "无法", "大约", "预计", "around", "about"], "")
    return out.select("external_candidate_id", "answer", F.array_join("blocked", "|").alias("blocked")).where("blocked <> ''")


PLEASANTRIES = ["亲", "亲亲", "您好", "在的亲", "感谢咨询", "感谢理解"]
_PLEASANT = "|".join(sorted(PLEASANTRIES, key=len, reverse=True))


@query(f"select external_candidate_id, case when final_answer is null then null when len(kept) = 0 then '' else array_to_string(kept, '。') || '。' end as answer from (select external_candidate_id, final_answer, list_filter(list_transform(list_filter(regexp_split_to_array(final_answer, '[。！!？?\\n]+'), lambda s: trim(s) <> ''), lambda s: trim(regexp_replace(s, '^[\\t-\\r ]*(?:(?:{_PLEASANT})[，,、~～\\t-\\r ]*)+', ''))), lambda s: s <> '') as kept from external_candidates)")
def tidy_answers(spark, d):
    from ..operators.claims import tidy_answer

    return table(spark, d, "external_candidates").select("external_candidate_id", tidy_answer(F.col("final_answer"), PLEASANTRIES).alias("answer"))
