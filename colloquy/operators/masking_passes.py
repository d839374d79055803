"""Further masking passes over texts that the first chain has been through, natively.

A pass is a list of stages; a stage has a type and maps the text to the text, so the types found are
those of the stages that changed it.  Patterns come from rule packs (``SECOND``, ``FINAL``); what
depends on more than a pattern (how many marks of an address a clause holds, which words stand near a
number) is an expression over the pieces of the text.  ``sanitize`` runs passes one after the other.

A null text stays null and has no types; an empty one stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Change = Callable[[Column], Column]

# Fixed values of the second and of the final pass.
HAN = "\\u3400-\\u9fff"
STOPS = "。！？!?；;\\n"
CLAUSE_STOPS = "，,。；;！？!?\\n"
URL_SIGN = r"[^\s，。；;！？!?<>\]\[\"']"
LINK_HOSTS = (("item.jd.com", "PRODUCT_LINK"), ("dd-static.jd.com", "IMAGE_LINK"))
GEO = rf"([{HAN}]{{1,12}}?(?:省|市|区|县|镇|乡|村|街道|路))(?=((?s:.)?))"
GEO_NOT = ("地区", "小区", "在路", "上路")
UNITS = r"\d+(?:号|栋|单元|楼|室)"
CONTEXT = (("PRODUCT_ID", "商品"), ("ORDER_ID", "订单"), ("TRACKING_ID", "快递|物流|运单|单号|韵达|申通|圆通"))
NOT_NAME_START = "为|请|可|能|已|将|会|是|的|了|在|由|如|若|不|有|无|让|给|您|我|他|她|这|那"


@dataclass(frozen=True)
class Pack:
    """Rules of a pass: patterns in order, words, and how far a number looks around."""

    patterns: tuple[tuple[str, str, str], ...]
    places: str
    sight: int
    regions: str = ""
    labels: str = ""
    not_names: str = ""
    surnames: str = ""
    codes: str = ""
    trims: str = ""
    links: tuple[tuple[str, str], ...] = field(default=())


SECOND = Pack(
    links=LINK_HOSTS,
    patterns=(
        ("PRODUCT_ID", r"(?i)商品[^\d\n]{0,5}?(?:id|编号|号)\s*[:：#]?\s*\d{6,}", "商品ID：[PRODUCT_ID]"),
        ("ORDER_ID", r"(?i)(?:(?:订单)[^\d\n]{0,5}?(?:id|编号|号)|order\s*id)\s*[:：#]?\s*\d{6,}", "订单ID：[ORDER_ID]"),
        ("TRACKING_ID", r"(?i)((?:快递(?:单号)?|物流(?:单号)?|运单(?:号)?|单号|韵达|申通|圆通|京东快递)[^\n，。；;！？!?\d]{0,10}?[:：#]?\s*)(\d{10,})", "$1[TRACKING_ID]"),
    ),
    places="广场|小区|驿站|代收点|工厂|公司|门店",
    regions=r"(?:上海奉贤区青村镇|河南省|广西(?:壮族自治区)?|广东省)[^，,。；;！？!?\n]{2,}",
    labels=r"(?:(?:京东)?(?:代收点|驿站|收货)?地址)\s*[:：]\s*.+",
    not_names="发货|退款|尺码|质量|快递|鞋子|电话|手机|号码|联系",
    sight=10,
)
FINAL = Pack(
    patterns=(
        ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
        ("PHONE", r"(?<!\d)1[3-9]\d{9}(?!\d)", "[PHONE]"),
        ("PHONE", r"(?<!\d)(?:0\d{2,3}[-—－ ]?)\d{7,8}(?!\d)", "[PHONE]"),
    ),
    places="小区|广场|超市|学校|工厂|公司|门店|驿站|代收点|站点|菜鸟|京东站|营业部",
    regions="奉贤区|青村镇|中国移动|佳好佳超市",
    labels=r"(?:发到|寄到|收货地址|地址|送到|派送到|给我送到)\s*[:：]?\s*",
    not_names="亲亲|客服|商家|快递|仓库|鞋子|订单|商品|质量|尺码|发货|退款|电话|手机|号码|地址|平台|物流|售后|客户",
    surnames="赵钱孙李周吴郑王冯陈沈韩杨朱许何张曹金魏姜谢苏潘范彭马方袁唐薛雷贺罗郝常于傅康余顾孟黄萧姚汪毛戴宋熊纪项杜江郭梅林钟徐邱高夏蔡田胡霍卢丁邓洪石崔程陆叶黎龙段侯武刘",
    codes=r"(?i)(?:#\s*E\s*[-_][A-Za-z0-9_-]+|/:\d{3,})",
    trims=" \\t\\r\\n；;",
    sight=12,
)
SUPPLEMENT = (
    ("IDENTITY_ID", r"(?<!\d)\d{17}[0-9Xx](?!\d)", "[IDENTITY_ID]"),
    ("WECHAT_ID", r"((?:微信(?:号|ID)?|[Vv]信|[Vv][Xx]|[Ww][Xx])\s*[:：]?\s*)([A-Za-z][A-Za-z0-9_-]{4,})", "$1[WECHAT_ID]"),
    ("PAYMENT_INFO", r"((?:银行卡号|收款账号|支付宝账号|支付账号)\s*[:：]?\s*)([A-Za-z0-9_-]{6,})", "$1[PAYMENT_INFO]"),
    ("PAYMENT_INFO", r"(?:收款码|付款码)\s*[:：]\s*\S+", "[PAYMENT_INFO]"),
)
GENERIC_SENDERS = ("客服", "商家", "客户", "用户", "系统")


def each(text: Column, pattern: str, change: Change) -> Column:
    """``text`` with each match of a pattern (without look-around or groups) changed."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(?:{pattern})|.+?(?=(?:{pattern})|\z)"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(rf"(?s)^(?:{pattern})\z"), change(x)).otherwise(x)), "")


def address_marks(clause: Column, places: str) -> Column:
    """How many marks of an address a clause holds: regions with their suffix, numbered units, and
    different kinds of places.  Ranges ('偏远地区'), markets and the like are none."""
    names, after = (F.regexp_extract_all(clause, F.lit(GEO), F.lit(i)) for i in (1, 2))

    def counts(x: Column) -> Column:
        name, sign = x["names"], x["after"]
        no = (name.endswith("市") & (sign == "场")) | (name.endswith("区") & (sign == "别"))
        for end in GEO_NOT:
            no = no | name.endswith(end)
        return ~no

    geo = F.size(F.filter(F.arrays_zip(names.alias("names"), after.alias("after")), counts))
    return geo + F.regexp_count(clause, F.lit(UNITS)) + F.size(F.array_distinct(F.regexp_extract_all(clause, F.lit(f"({places})"), F.lit(1))))


def _numbers(pattern: str, sight: int, kind: str, words: str | None) -> Change:
    """Numbers with one of the two-character words at most ``sight`` characters away, or all."""
    to = f"[{kind}]"
    if words is None:
        return lambda t: F.regexp_replace(t, rf"(?<!\d){pattern}(?!\d)", to)
    near = rf"(?s)(?<!\d)(?:(?<=(?:{words}).{{0,{sight - 2}}}){pattern}(?!\d)|{pattern}(?!\d)(?=.{{0,{sight - 2}}}(?:{words})))"
    return lambda t: F.regexp_replace(t, near, to)


def _number_stages(pattern: str, sight: int) -> list[tuple[str, Change]]:
    return [(kind, _numbers(pattern, sight, kind, words)) for kind, words in (*CONTEXT, ("LONG_NUMBER", None))]


def _clauses(pack: Pack, whole: Change | None) -> Change:
    """Clauses between full stops that are addresses become one sign."""

    def one(x: Column) -> Column:
        marks = address_marks(x, pack.places) >= 2
        if whole is not None:
            marks = marks | x.rlike(pack.regions)
        out = F.when(marks, "[ADDRESS_RELATED_MESSAGE]").otherwise(x)
        if whole is not None:
            out = F.when(x.rlike(pack.labels), whole(x)).otherwise(out)
        return F.when(x.contains("[ADDRESS") | (F.trim(x) == ""), x).otherwise(out)

    return lambda t: each(t, f"[^{STOPS}]+", one)


def second_stages(pack: Pack = SECOND) -> list[tuple[str, Change]]:
    """Links by host, labelled numbers, what stands beside a telephone number, addresses, numbers."""
    out: list[tuple[str, Change]] = []
    for host, kind in pack.links:
        out.append((kind, lambda t, host=host, kind=kind: F.regexp_replace(t, rf"(?i)https?://(?={URL_SIGN}*{host.replace('.', '[.]')}){URL_SIGN}+", f"[{kind}]")))
    out.append(("URL", lambda t: F.regexp_replace(t, rf"(?i)https?://{URL_SIGN}+", "[URL]")))
    for kind, pattern, to in pack.patterns:
        out.append((kind, lambda t, pattern=pattern, to=to: F.regexp_replace(t, pattern, to)))
    beside = lambda x: F.when((F.length(x) >= 12) & (address_marks(F.substring(x, 8, 99), pack.places) >= 1), "[PHONE][ADDRESS]").otherwise(x)
    out.append(("ADDRESS", lambda t: each(t, rf"\[PHONE\][^{CLAUSE_STOPS}]{{2,80}}", beside)))
    no = rf"(?!{NOT_NAME_START})(?![{HAN}]*(?:{pack.not_names}))"
    out.append(("NAME", lambda t: F.regexp_replace(t, rf"(\[PHONE\]){no}([{HAN}]{{2,4}})(?=$|[，,。；;！？!?\s])", "$1[NAME]")))
    out.append(("NAME", lambda t: F.regexp_replace(t, rf"(?<![{HAN}]){no}([{HAN}]{{2,4}})(\s*[，,|]?\s*\[PHONE\])", "[NAME]$2")))
    out.append(("ADDRESS", _clauses(pack, lambda x: F.regexp_replace(x, pack.labels, "[ADDRESS]"))))
    return out + _number_stages(r"\d{10,}", pack.sight)


def final_stages(pack: Pack = FINAL) -> list[tuple[str, Change]]:
    """Patterns, numbers in one piece and in groups, names with a label or beside a telephone number,
    addresses after a label or a number, address-like clauses, codes of the platform."""
    out: list[tuple[str, Change]] = [(kind, lambda t, pattern=pattern, to=to: F.regexp_replace(t, pattern, to)) for kind, pattern, to in pack.patterns]
    out += _number_stages(r"\d{10,}", pack.sight)
    out += _number_stages(r"(?:\d{3}[ -]){2,}\d{3,}", pack.sight)
    out.append(("NAME", lambda t: F.regexp_replace(t, rf"((?:收件人|收货人|联系人|姓名|名字|客户|配送员)\s*[:：]\s*)([{HAN}]{{2,5}})", "$1[NAME]")))
    # A found name is set between two marks first, and the marks decide.
    a, z = "", ""
    name = rf"{a}(?!{NOT_NAME_START})(?![^{z}]*(?:{pack.not_names}))(?:(?=[{pack.surnames}])|(?=[^{z}]*(?:先生|女士){z}))[^{z}]*{z}"
    decide = lambda t: F.translate(F.regexp_replace(t, name, "[NAME]"), a + z, "")
    out.append(("NAME", lambda t: decide(F.regexp_replace(t, rf"(\[PHONE\])([^{CLAUSE_STOPS}]{{0,6}}?)([{HAN}]{{2,5}})(?=$|[，,。；;！？!?\s])", f"$1$2{a}$3{z}"))))
    out.append(("NAME", lambda t: decide(F.regexp_replace(t, rf"(?<![{HAN}])([{HAN}]{{2,5}})([^{HAN}]{{0,6}}\[PHONE\])", f"{a}$1{z}$2"))))
    place = lambda x: (address_marks(x, pack.places) >= 1) | x.rlike(pack.regions)
    out.append(("ADDRESS", lambda t: each(t, rf"\[PHONE\][^{CLAUSE_STOPS}]{{2,80}}", lambda x: F.when(place(F.substring(x, 8, 99)), "[PHONE][ADDRESS]").otherwise(x))))
    label = lambda x: F.regexp_extract(x, f"^({pack.labels})", 1)
    rest = lambda x: F.regexp_replace(x, f"^{pack.labels}", "")
    out.append(("ADDRESS", lambda t: each(t, rf"{pack.labels}[^{CLAUSE_STOPS}]{{2,100}}", lambda x: F.when(label(x).rlike("[:：]") | place(rest(x)), F.concat(label(x), F.lit("[ADDRESS]"))).otherwise(x))))
    out.append(("ADDRESS", _clauses(pack, None)))
    out.append(("PLATFORM_CODE", lambda t: F.when(t.rlike(pack.codes), F.regexp_replace(F.regexp_replace(t, pack.codes, ""), r"(?:；\s*){2,}", "；")).otherwise(t)))
    return out


def supplement_stages() -> list[tuple[str, Change]]:
    """Identity numbers, chat accounts and payment data."""
    return [(kind, lambda t, pattern=pattern, to=to: F.regexp_replace(t, pattern, to)) for kind, pattern, to in SUPPLEMENT]


def marker_stages(stores: list[str], senders: list[str]) -> list[tuple[str, Change]]:
    """Private names of stores (three characters at least) and of service senders (two, and not one
    of the generic words), longest first."""
    import re

    out = []
    for kind, to, words in (("STORE_IDENTITY", "[EXTERNAL_STORE]", [m for m in stores if len(m) >= 3]), ("SERVICE_AGENT", "[SERVICE_AGENT]", [m for m in senders if len(m) >= 2 and m not in GENERIC_SENDERS])):
        if words:
            any_ = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
            out.append((kind, lambda t, any_=any_, to=to: F.regexp_replace(t, any_, to)))
    return out


def squeezed(signs: str = "") -> Change:
    """One blank for several, none at the ends, nor any of ``signs`` there."""
    ends = rf"^[{signs}]+|[{signs}]+$" if signs else r"(?U)^\s+|\s+$"
    return lambda t: F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), ends, "")


def run(df: DataFrame, content: str, stages: list[tuple[str, Change]], masked: str = "masked", types: str = "pii_types") -> DataFrame:
    """Append the masked text and the sorted types of the stages that changed it."""
    d = df.withColumn("_t0", F.col(content))
    for i, (_, change) in enumerate(stages):
        # One column a stage: it is read by the next one and by the comparison, and computed once.
        d = d.withColumn(f"_t{i + 1}", change(F.col(f"_t{i}")))
    hit = F.array_compact(F.array(*[F.when(F.col(f"_t{i}") != F.col(f"_t{i + 1}"), kind) for i, (kind, _) in enumerate(stages) if kind]))
    keep = [c for c in df.columns if c not in (masked, types)]
    # The id is always >= 0; being non-deterministic it keeps filters on the results above the chain,
    # where they would otherwise be rewritten over all stages.
    fixed = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    return d.select(*keep, fixed(F.col(f"_t{len(stages)}")).alias(masked), fixed(F.array_sort(F.array_distinct(hit))).alias(types))


def second_pass(df: DataFrame, content: str, pack: Pack = SECOND) -> DataFrame:
    return run(df, content, [*second_stages(pack), ("", squeezed())])


def final_pass(df: DataFrame, content: str, pack: Pack = FINAL) -> DataFrame:
    return run(df, content, [*final_stages(pack), ("", squeezed(pack.trims))])


def sanitize(df: DataFrame, content: str, stores: list[str] = (), senders: list[str] = (), first: list[tuple[str, Change]] = ()) -> DataFrame:
    """Private names, supplement, the first chain (its stages are given), second and final pass."""
    stages = [*marker_stages(list(stores), list(senders)), *supplement_stages(), *first, *second_stages(), ("", squeezed()), *final_stages(), ("", squeezed(FINAL.trims))]
    return run(df, content, stages)


def residual_types(df: DataFrame, content: str, stores: list[str] = ()) -> DataFrame:
    """Append ``residual``: sorted types of what the passes would still change or that is left."""
    stages = [*marker_stages(list(stores), []), *supplement_stages(), *final_stages()]
    out = run(df, content, stages, "_masked", "residual")
    return out.drop("_masked")
