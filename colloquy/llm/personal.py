"""Personal data in free text: find it, replace it by typed placeholders.

Method: a skip-chain conditional random field.  Its nodes are the spans of a text that any of the
proposal patterns matches, and further mentions of a proposed name or of a part of it; a node's labels
are 'O' and the types it was proposed for.  Unary potentials come from the span's shape and the words
around it, chain edges join neighbours, and skip edges join each span to the next one of equal or
similar text (equal letters or digits, part of a name, number without its country code) however far
away, so that a mention with its cue carries one without.  Loopy message passing gives the marginals;
a chain without skip edges is exact.  Weights are log-odds with the priors below; ``fitted`` adapts
them by expectation-maximisation on the graphs of all texts: what the unary potentials alone would
say is drawn towards what the whole graph says.

Scale: a text's proposals are found once and kept as its graph, a short text without the words; equal
graphs are counted by a partial aggregate, and a round of the fit is a sum over the distinct ones, some
thirty numbers a task.  Only those sums reach the driver.

Order, parcel, ticket, contract and bar code numbers, hotlines, bare city names, staff nicknames and
placeholders are no personal data.  Null, empty and blank texts have none.  A text without any
proposal has no node, so it never leaves the JVM: the prefilter is a superset of the proposals.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

TYPES = ("EMAIL", "PHONE", "IDENTITY_ID", "ADDRESS", "NAME")
ROUNDS = 6

# Common Chinese surnames, words before and after spans.
SURNAMES = (
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
    "庞樊兰殷施陶洪翟安颜倪严牛温芦季俞章鲁葛伍韦申尤毕聂丛焦向柳邢路岳齐梅莫庄辛管祝左涂谷祁时舒耿牟卜詹关苗凌费纪靳盛童欧甄项曲成游阳裴席卫查屈鲍位覃霍翁隋植甘景薄单包司柏宁柯阮桂闵解强柴华车冉房边辜吉饶"
    "瞿戚古连容岑简褚"
)
COMPOUND = "欧阳|司马|上官|诸葛|东方|皇甫|尉迟|公孙|慕容|令狐|司徒|夏侯"
_HAN = "一-鿿"
_CN_DIGITS = "零一二三四五六七八九幺〇两"
_TO_DIGIT = str.maketrans(_CN_DIGITS, "0123456789102")
_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 32, 0xA0: 32}

EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]{0,62}[A-Za-z0-9_])?(?: ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?:(?: ?\. ?| dot |\(dot\))[A-Za-z0-9-]{1,63}){1,6}| at [A-Za-z0-9-]{1,63}(?:(?:\.| dot |\(dot\))[A-Za-z][A-Za-z0-9-]{1,62}){1,6})", re.ASCII)
#: Words that lead up to an address and are no part of it.
ADDRESS_LEAD = re.compile(r"^.*?(?:改送到?|收货在|我住在?|家住|家在|寄到|地址(?:是|：|:)?|住在|送到|发到)")
NUMBER = re.compile(rf"(?<![A-Za-z0-9])(?:\+ ?\d|\(\d|\d)(?:[ ().\-/]{{0,2}}\d){{5,22}}[Xx]?(?![A-Za-z0-9])|[{_CN_DIGITS}]{{7,20}}", re.ASCII)
ALNUM = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{1,2}\d{6,9}|[A-Z]\d{2}[A-Z]\d{4}[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![A-Za-z0-9])", re.ASCII)
ADDRESS_ZH = re.compile(rf"[{_HAN}]{{1,14}}(?:(?<=[路街巷道弄里])\d+[号弄]|(?<=[园苑区坊庄府城湾邸邨寓])\d+[幢栋座号]|(?<=[村组屯])\d+[组号队])(?:\d+[号栋幢座单元室楼层组弄]{{1,2}})*\d*", re.ASCII)
ADDRESS_EN = re.compile(
    r"(?:(?:Flat|Unit|Apt|Suite|Room|No)\.? ?\d+[A-Za-z]?[,/] ?)?(?<![\w-])\d{1,5}[A-Za-z]?(?:/\d+)? (?:[A-Z][a-z'-]+ ){1,3}(?:Street|St|Lane|Ln|Road|Rd|Row|Avenue|Ave|Close|Drive|Dr|Court|Ct|Way|Terrace|Place|Pl|Crescent|Square|Sq|Hill|Walk|Boulevard|Blvd|Parade)\b(?:\.? ?(?:Apt|Unit|Flat|Suite|#)\.? ?\d+\w?)?"
    r"|\b[A-ZÄÖÜ][\wäöüß-]{1,40}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm)\.? ?\d+[a-z]?\b"
    r"|\b(?:P\.? ?O\.? Box) \d+"
)
_ZH_NAME = rf"(?:(?:{COMPOUND})[{_HAN}]{{1,2}}|[{SURNAMES}][{_HAN}]{{1,2}}?)"
NAME_ZH = re.compile(
    rf"(?:我叫|我是|姓名(?:是|：|:)?|名字(?:是|叫)|收件人(?:是|：|:|改成|写)?|收货人(?:是|：|:|改成|写)?|联系人(?:是|：|:|写|改成)?|麻烦寄给|请寄给|寄给|签收的是|请备注|备注|户主|机主|本人)\s*(?P<a>{_ZH_NAME})(?=女士|先生|小姐|收|就行|会在家|不是我|[，。；;,.！!？?、\s）)]|是|的|$)"
    rf"|(?<![{_HAN}])(?P<b>{_ZH_NAME})(?=的那一单|的订单|女士|先生|小姐)"
    rf"|(?:是|找|给|叫|，)(?P<c>{_ZH_NAME})(?=女士|先生|小姐)"
)
NAME_EN = re.compile(
    r"(?:(?i:my name is|name is|name:|i am|this is|it is for|it's for|ship it to|send it to|addressed to|ask for|attn:?|attention:?|placed by|on behalf of|regards,|sincerely,|signed,|recipient:?|mein name ist|ich heiße|für frau|für herrn)|\b(?:Mr|Mrs|Ms|Dr|Frau|Herr|Herrn)\.?)\s+(?P<d>[A-ZÀ-Þ][\w'’]+(?:[ -][A-ZÀ-Þ][\w'’-]+){1,3})"
)
PLACEHOLDER = {"EMAIL": "[EMAIL]", "PHONE": "[PHONE]", "IDENTITY_ID": "[IDENTITY_ID]", "ADDRESS": "[ADDRESS]", "NAME": "[NAME]"}

_WIDE = "０-９Ａ-Ｚａ-ｚ"
_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CUES = "name is|name[:：]|i am|this is|for|it to|addressed to|attn[:：]?|attention[:：]?|placed by|behalf of|regards[,，]|sincerely[,，]|signed[,，]|recipient[:：]?|für frau|für herrn|name ist|heiße"
_STREETS = "straße|strasse|str|weg|gasse|platz|allee|ufer|ring|damm"
#: Java pattern that every text with a proposal matches, in its own forms: the first class rejects
#: most places of a text at once, and longer contexts are looked at from their last character.
PREFILTER = (
    rf"(?=[\p{{Nd}}{_WIDE}＠@(（\[A-Z{_CN_DIGITS}路街巷道弄里园苑区坊庄府城湾邸邨寓村组屯我姓名收联寄签备户机本的女先小]|{_SPACE})(?:"
    rf"[{_WIDE}＠\u3000\u00a0]|@|[(（\[]at[)）\]]|(?:[0-9][ ().\-/（）－．／]{{0,2}}){{6}}|[{_CN_DIGITS}]{{7}}|[A-Z][0-9]{{2}}[A-Z][0-9]{{4}}|[A-Z]{{2}} ?[0-9]{{2}} ?[0-9]{{2}}| at [A-Za-z0-9-]+(?: dot |\.|．|[(（]dot[)）])"
    rf"|[路街巷道弄里园苑区坊庄府城湾邸邨寓村组屯][0-9]+[号弄幢栋座组队]|\p{{Nd}}{{1,5}}[A-Za-z]?(?:[/／]\p{{Nd}}+)? [A-Z]|\p{{Nd}}(?<=(?i:{_STREETS})[.．]? ?\p{{Nd}})|Box"
    rf"|我叫|我是|姓名|名字|收件人|收货人|联系人|寄给|签收的是|备注|户主|机主|本人|的那一单|的订单|女士|先生|小姐"
    rf"|{_SPACE}(?={_SPACE}*[A-ZÀ-Þ])(?<=(?iu:{_CUES}){_SPACE})|(?:Mr|Mrs|Ms|Dr|Frau|Herr|Herrn)[.．]?{_SPACE})"
)

_ID_CUE = re.compile(r"(?i)身份证|证件号?|护照|实名|清关|号码是|报一下|passport|national id|id card|id number|\bssn\b|social security|ausweis|reisepass|steuer-?id")
_PHONE_CUE = re.compile(r"(?i)电话|手机|号码|短信|联系方式|可以加|加我|打$|打\s*$|call|phone|number is|text|reach|mobil|telefon|\btel\b|whatsapp|微信")
_PHONE_AFTER = re.compile(r"^\s*(?:找我|这个号|打得通|联系|when it arrives)")
_NOT_CUE = re.compile(r"(?i)订单号?[:：]?\s*$|单号[:：]?\s*(?:SD)?$|运单号?[:：]?\s*$|合同(?:编号|号)?[:：]?\s*$|编号[:：]?\s*$|条码[:：]?\s*$|批次\s*$|工单\s*$|barcode\s*$|order(?: no\.?| number)?\s*#?\s*$|tracking\s*\w*$|ticket\s*$|contract(?: no\.?)?\s*$|article(?: no\.?)?\s*$|invoice(?: no\.?)?\s*$|热线[:：]?\s*$|hotline\s*$|货号[:：]?\s*$|流水号?\s*$")
_HOTLINE = re.compile(r"^(?:400[- ]?\d|800[- ]?\d|0800|1[- ]?800|95\d{3}$|1010\d|12\d{3}$)")

# Log-odds of a label against 'O' by feature; adapted by ``fit``.
WEIGHTS = {
    "EMAIL": {"bias": 4.0},
    "PHONE": {"bias": -3.0, "mobile": 5.0, "international": 5.0, "landline": 3.5, "area": 4.5, "local": 0.5, "cue": 3.0, "after": 2.0, "not": -9.0, "hotline": -12.0, "identity_cue": -1.5},
    "IDENTITY_ID": {"bias": -3.0, "birth18": 5.0, "birth15": 1.0, "ssn": 1.0, "passport": 0.5, "card": 1.5, "cue": 4.5, "not": -9.0, "phone_cue": -0.5},
    "ADDRESS": {"bias": 3.0},
    "NAME": {"bias": -1.0, "cue": 3.5, "part": 0.0},
}
CHAIN, SKIP = 0.3, 3.0
#: Rounds of the fit, pseudo-counts of a weight, and length of a step.
FITS, PRIOR, STEP = 3, 50.0, 4.0


def _birth(digits: str) -> bool:
    return "1900" <= digits[6:10] <= "2030" and 1 <= int(digits[10:12]) <= 12 and 1 <= int(digits[12:14]) <= 31


def _number_features(span: str, before: str, after: str) -> dict[str, list[str]]:
    """Features of a number by the type it is proposed for."""
    raw = span.translate(_TO_DIGIT)
    d = re.sub(r"\D", "", raw)
    n, tail = len(d), span[-1] in "Xx"
    own = _ID_CUE.search(before) is not None
    call = _PHONE_CUE.search(before) is not None
    out: dict[str, list[str]] = {}
    common = ["not"] * (_NOT_CUE.search(before) is not None)
    phone = []
    m = d[2:] if d.startswith("86") and raw.lstrip().startswith("+") else d
    if len(m) == 11 and m[0] == "1" and m[1] in "3456789" and not tail:
        phone.append("mobile")
    elif raw.lstrip().startswith("+") and 8 <= n <= 15:
        phone.append("international")
    elif d[:1] == "0" and 9 <= n <= 12 and not tail:
        phone.append("landline")
    elif n == 10 and re.match(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}$", raw):
        phone.append("area")
    elif n == 7 and re.match(r"\d{3}[ -]\d{4}$", raw):
        phone.append("local")
    if phone:
        phone += ["cue"] * call + ["after"] * (_PHONE_AFTER.match(after) is not None) + ["hotline"] * (_HOTLINE.match(raw) is not None) + ["identity_cue"] * own
        out["PHONE"] = phone + common
    ident = []
    if n + tail == 18 and n >= 17 and _birth(d):
        ident.append("birth18")
    elif n == 15 and not phone:
        ident.append("birth15")
    elif n == 9 and re.match(r"\d{3}[ -]\d{2}[ -]\d{4}$", raw):
        ident.append("ssn")
    if ident:
        # The nearer cue counts where there are both.
        out["IDENTITY_ID"] = ident + ["cue"] * own + ["phone_cue"] * (call and not own) + common
    return out


def _numbers(run: str, at: int) -> list[tuple[int, int]]:
    """Spans of the numbers in a run: an identity number and another number may stand side by side."""
    digits = sum(c.isdigit() for c in run)
    if digits > 18 and " " in run:
        for m in re.finditer(" ", run):
            if sum(c.isdigit() or c in "Xx" for c in run[: m.start()]) in (11, 18):
                return [(at, at + m.start()), (at + m.end(), at + len(run))]
    return [(at, at + len(run))]


class Node:
    __slots__ = ("start", "end", "key", "features", "labels", "unary")

    def __init__(self, start: int, end: int, key: str, features: dict[str, list[str]]):
        """key: equal for spans that a skip edge may join."""
        self.start, self.end, self.key, self.features = start, end, key, features
        self.labels = ["O", *features]
        self.unary: list[float] = []


def _digits(span: str) -> str:
    """Digits of a number without the country code of a mobile one."""
    d = re.sub(r"\D", "", span.translate(_TO_DIGIT))
    return d[2:] if len(d) == 13 and d.startswith("86") else d


def _parts(name: str) -> list[str]:
    """Parts by which a name may be mentioned again: words of three letters, or a given name of two signs."""
    if name[0] >= "一":
        given = name[2:] if re.match(COMPOUND, name) else name[1:]
        return [given] if len(given) == 2 else []
    return [w for w in re.split(r"[ -]", name) if len(w) >= 3]


def nodes(text: str) -> list[Node]:
    """Proposed spans of a text (narrow forms), not overlapping, in order."""
    found: list[Node] = []

    def free(s: int, e: int) -> bool:
        return all(e <= n.start or s >= n.end for n in found)

    for m in EMAIL.finditer(text):
        found.append(Node(m.start(), m.end(), re.sub(r"\W", "", m[0].lower()), {"EMAIL": []}))
    for pattern in (ADDRESS_ZH, ADDRESS_EN):
        for m in pattern.finditer(text):
            if free(*m.span()):
                lead = ADDRESS_LEAD.match(m[0])
                s = m.start() + (lead.end() if lead and lead.end() < len(m[0]) else 0)
                found.append(Node(s, m.end(), text[s : m.end()].lower(), {"ADDRESS": []}))
    for m in NUMBER.finditer(text):
        for s, e in _numbers(m[0], m.start()):
            f = _number_features(text[s:e], text[max(0, s - 16) : s], text[e : e + 16]) if free(s, e) else None
            if f:
                found.append(Node(s, e, _digits(text[s:e]), f))
    for m in ALNUM.finditer(text):
        if free(*m.span()):
            before = text[max(0, m.start() - 16) : m.start()]
            shape = "card" if re.match(r"[A-Z]\d\d[A-Z]", m[0]) else "passport"
            found.append(Node(m.start(), m.end(), m[0], {"IDENTITY_ID": [shape, *["cue"] * (_ID_CUE.search(before) is not None), *["not"] * (_NOT_CUE.search(before) is not None)]}))
    names = set()
    for pattern in (NAME_ZH, NAME_EN):
        for m in pattern.finditer(text):
            group = m.lastgroup
            if free(*m.span(group)):
                found.append(Node(*m.span(group), m[group], {"NAME": ["cue"]}))
                names.add(m[group])
    # Further mentions of a proposed name or its parts: without cue, but joined to it by skip edges.
    for name in sorted(names):
        for mention in (name, *_parts(name)):
            for m in re.finditer(re.escape(mention) if name[0] >= "一" else rf"\b{re.escape(mention)}\b", text):
                if free(*m.span()):
                    found.append(Node(*m.span(), name, {"NAME": ["part"] if mention != name else []}))
    found.sort(key=lambda n: n.start)
    return found


def marginals(graph: list[Node], weights: dict = WEIGHTS, rounds: int = ROUNDS, skip: float = SKIP) -> list[list[float]]:
    """Marginal probabilities of each node's labels by loopy message passing."""
    for n in graph:
        n.unary = [1.0] + [math.exp(weights[t].get("bias", 0.0) + sum(weights[t].get(f, 0.0) for f in fs)) for t, fs in n.features.items()]
    # Neighbours of one key have one edge with both potentials.
    edges = {(i, i + 1): CHAIN for i in range(len(graph) - 1)}
    by: dict[str, list[int]] = {}
    for i, n in enumerate(graph):
        by.setdefault(n.key, []).append(i)
    # Each is joined to the next of its key only, so that edges are at most twice the nodes.
    for same in by.values():
        for a, b in zip(same, same[1:]):
            edges[a, b] = edges.get((a, b), 0.0) + skip
    if len(edges) == 0:
        return [[u / sum(n.unary) for u in n.unary] for n in graph]
    message: dict[tuple[int, int], list[float]] = {}
    near: dict[int, dict[int, float]] = {}
    for (a, b), w in edges.items():
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = math.exp(w)
            message[x, y] = [1.0] * len(graph[y].labels)
    for _ in range(rounds):
        for (x, y), old in message.items():
            into = list(graph[x].unary)
            for z in near[x]:
                if z != y:
                    into = [p * q for p, q in zip(into, message[z, x])]
            w = near[x][y]
            out = [sum(p * (w if lx == ly else 1.0) for p, lx in zip(into, graph[x].labels)) for ly in graph[y].labels]
            total = sum(out)
            old[:] = [v / total for v in out]
    result = []
    for i, n in enumerate(graph):
        p = list(n.unary)
        for z in near.get(i, ()):
            p = [a * b for a, b in zip(p, message[z, i])]
        total = sum(p)
        result.append([v / total for v in p])
    return result


def label(text: str | None, weights: dict = WEIGHTS, skip: float = SKIP) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal data of a text, in order."""
    if not text:
        return []
    graph = nodes(text.translate(_NARROW))
    if not graph:
        return []
    out = []
    for n, p in zip(graph, marginals(graph, weights, skip=skip)):
        best = max(range(len(p)), key=p.__getitem__)
        if best:
            out.append((n.start, n.end, n.labels[best]))
    return out


def mask(text: str | None, weights: dict = WEIGHTS, skip: float = SKIP) -> tuple[str | None, list[str]]:
    """(text with typed placeholders, sorted types found)."""
    found = label(text, weights, skip)
    if not found:
        return text, []
    parts, at = [], 0
    for s, e, t in found:
        parts += [text[at:s], PLACEHOLDER[t]]
        at = e
    return "".join([*parts, text[at:]]), sorted({t for _, _, t in found})


def encode(graph: list[Node]) -> str:
    """A graph as a text of keys' numbers, labels and features: what ``marginals`` depends on."""
    key: dict[str, int] = {}
    return ";".join("|".join([str(key.setdefault(n.key, len(key))), *[f"{t}:{','.join(f)}" for t, f in n.features.items()]]) for n in graph)


def decode(code: str) -> list[Node]:
    out = []
    for i, part in enumerate(code.split(";")):
        key, *labels = part.split("|")
        out.append(Node(i, i + 1, key, {t: f.split(",") if f else [] for t, f in (x.split(":") for x in labels)}))
    return out


def expected(code: str, n: int, weights: dict, into: dict[tuple[str, str], list[float]]) -> None:
    """Add (marginal minus unary probability, number) of each feature over n texts of this graph."""
    graph = decode(code)
    for node, p in zip(graph, marginals(graph, weights)):
        for k, (t, fs) in enumerate(node.features.items(), 1):
            score = weights[t].get("bias", 0.0) + sum(weights[t].get(f, 0.0) for f in fs)
            gap = p[k] - 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
            for f in ("bias", *fs):
                s = into.setdefault((t, f), [0.0, 0.0])
                s[0] += gap * n
                s[1] += n


def adapted(weights: dict, sums: dict[tuple[str, str], list[float]], prior: float = PRIOR) -> dict:
    """A damped step of each weight, with ``prior`` pseudo-counts at the present one."""
    out = {t: dict(w) for t, w in weights.items()}
    for (t, f), (gap, n) in sums.items():
        out[t][f] = out[t].get(f, 0.0) + gap / (prior + n) * STEP
    return out


def fit(texts: list[str]) -> dict:
    """``fitted`` for a list of texts."""
    codes = Counter(encode(g) for t in texts if t and (g := nodes(t.translate(_NARROW))))
    weights = WEIGHTS
    for _ in range(FITS):
        sums: dict[tuple[str, str], list[float]] = {}
        for code, n in codes.items():
            expected(code, n, weights, sums)
        weights = adapted(weights, sums)
    return weights


def texts(messages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(record_kind, record_key, field_name, text) of all three text fields."""
    m = messages.select(F.lit("message").alias("record_kind"), F.col("message_id").cast("string").alias("record_key"), F.lit("message_content").alias("field_name"), F.col("message_content").alias("text"))
    cell = lambda f: F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text"))
    c = candidates.select(F.lit("candidate").alias("record_kind"), F.col("external_candidate_id").alias("record_key"), F.inline(F.array(cell("final_question"), cell("final_answer"))))
    return m.unionByName(c)


def _proposing(text: Column) -> Column:
    return text.rlike(PREFILTER)


def proposals(df: DataFrame) -> DataFrame:
    """(record_kind, record_key, field_name, graph) of each text with a proposal, in the shared folder."""

    def work(batches):
        for pdf in batches:
            keep = [(k, r, f, encode(g)) for k, r, f, x in zip(pdf["record_kind"], pdf["record_key"], pdf["field_name"], pdf["text"]) if (g := nodes(x.translate(_NARROW)))]
            yield pd.DataFrame(keep, columns=["record_kind", "record_key", "field_name", "graph"])

    return materialize(df.where(_proposing(F.col("text"))).mapInPandas(work, "record_kind string, record_key string, field_name string, graph string"))


def fitted(graphs: DataFrame) -> dict:
    """Weights adapted to the graphs of all texts."""
    distinct = materialize(graphs.groupBy("graph").agg(F.count("*").alias("n")))
    weights = WEIGHTS
    for _ in range(FITS):

        def work(batches, weights=weights):
            sums: dict[tuple[str, str], list[float]] = {}
            for pdf in batches:
                for code, n in zip(pdf["graph"], pdf["n"]):
                    expected(code, n, weights, sums)
            yield pd.DataFrame([(t, f, *s) for (t, f), s in sums.items()], columns=["type", "feature", "gap", "n"])

        rows = distinct.mapInPandas(work, "type string, feature string, gap double, n double").groupBy("type", "feature").agg(F.sum("gap").alias("gap"), F.sum("n").alias("n")).orderBy("type", "feature").collect()  # one a feature
        weights = adapted(weights, {(r["type"], r["feature"]): [r["gap"], r["n"]] for r in rows})
    return weights


def found(graphs: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """(record_kind, record_key, field_name, pii_type): one row for each type in a text."""

    def work(batches):
        known: dict[str, list[str]] = {}
        for pdf in batches:
            keep = []
            for k, r, f, code in zip(pdf["record_kind"], pdf["record_key"], pdf["field_name"], pdf["graph"]):
                types = known.get(code)
                if types is None:
                    graph = decode(code)
                    best = [(n, max(range(len(p)), key=p.__getitem__)) for n, p in zip(graph, marginals(graph, weights))]
                    types = sorted({n.labels[b] for n, b in best if b})
                    if len(known) >= 100_000:
                        known.clear()
                    known[code] = types
                keep += [(k, r, f, t) for t in types]
            yield pd.DataFrame(keep, columns=["record_kind", "record_key", "field_name", "pii_type"])

    return graphs.mapInPandas(work, "record_kind string, record_key string, field_name string, pii_type string")


def masked(df: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """(record_kind, record_key, field_name, masked, pii_types): every text, masked where needed."""

    def work(batches):
        for pdf in batches:
            done = [mask(x, weights) for x in pdf["text"]]
            yield pd.DataFrame({"record_kind": pdf["record_kind"], "record_key": pdf["record_key"], "field_name": pdf["field_name"], "masked": [d[0] for d in done], "pii_types": [";".join(d[1]) for d in done]})

    hit = F.coalesce(_proposing(F.col("text")), F.lit(False))
    plain = df.where(~hit).select("record_kind", "record_key", "field_name", F.col("text").alias("masked"), F.lit("").alias("pii_types"))
    return df.where(hit).mapInPandas(work, "record_kind string, record_key string, field_name string, masked string, pii_types string").unionByName(plain)
