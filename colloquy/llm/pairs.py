"""Broken question/answer pairs: which defect does each have?

Method: several noisy labelling functions vote on every defect; a label model fitted by expectation-
maximisation on the counts of vote patterns (a few rows, however large the corpus) estimates how
often each function votes on defective and on sound pairs, and gives a posterior for each pattern.
The rates come out of the data: the first guesses only tell the fit where to begin.  A pair gets
every defect whose posterior exceeds the defect's cutoff, which is validated on held-out halves;
``p3_found`` keeps the first in the order of ``DEFECTS``, as a pair there has one at most.

For 'truncated_answer' one function is a statistic of the whole corpus: how often the last
characters of the answer stand at the end of a sentence elsewhere, against inside of one.

Defined results: null or blank answers are 'empty_answer'; a null question takes part in no
comparison; rows without id are left out; very long texts are read whole; an empty table has no
defects.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty_answer", "copied_question", "refusal", "other_language", "truncated_answer")

# Words for "none", pleasantries, refusals, words that can't end a sentence, stop words.
NONE = frozenset("无 没有 暂无 没 空 无内容 无回复 未回复 暂缺 none null nil na n/a nan nothing empty keine keiner nichts leer".split())
LONGEST_NONE = max(map(len, NONE))
CODE = re.compile(r"#E-?[a-z]?\d+|\[[^\[\]]{1,12}\]|【(?:图片|表情|视频|语音)】|<(?:img|image|emoji)[^<>]*>|/::\S{1,3}|[:;]-?[)(DPp]")
LETTERS = re.compile(r"[^\W_]+")
GREETING = frozenset(
    (
        "亲爱的顾客|亲亲|亲|您好|你好|在的亲|在的|嗨|抱歉让您久等|让您久等了|收到您的问题|感谢咨询|感谢您的咨询|不好意思刚看到|感谢理解|祝您生活愉快|还请您留意|辛苦您稍等|有其他问题随时联系|谢谢亲|谢谢|哈哈|好的|"
        "hi|hi there|hello|hello there|hi again|hey|dear customer|good question|thanks for waiting|thanks for writing|thanks for asking|thank you|thanks|sorry for the delay|have a nice day|we are happy to help|let us know if anything is unclear|regards|"
        "guten tag|hallo|vielen dank|danke|gerne|mit freundlichen grüßen"
    ).split("|")
)
REFUSAL_HAN = re.compile(
    r"(?:无法|不能|没有?办法|没法|没有权限|无权|不便|不方便|恕不|不予|暂不|不可以|难以|不给予|拒绝).{0,10}(?:回答|答复|回复|解答|解释|协助|帮助|帮您|帮到|提供|说明|评论|发表|受理|处理|讨论|透露|告知|回应|意见)"
    r"|答不了|帮不上忙|帮不了|回答不了|解答不了|回复不了|超出.{0,8}(?:范围|能力|权限)|不予解答|暂不受理|无可奉告|不清楚这个|我不知道"
)
#: For lower case.
REFUSAL_LATIN = re.compile(
    r"(?:can(?:no|')t|cannot|can not|won't be able to|unable to|not able to|not allowed to|not permitted to|may not|decline to|refuse to).{0,30}(?:answer|help|assist|comment|discuss|respond|provide|share|say|advise)"
    r"|outside (?:of )?(?:what|my|our)|beyond (?:what|my|our)|not something (?:i|we) can|i don't know|no comment"
    r"|(?:kann|können|darf|dürfen|möchte).{0,40}(?:nicht|keine|leider).{0,30}(?:beantworten|helfen|auskunft|äußern|antworten|sagen|geben|weiterhelfen|kommentieren|mitteilen)|leider.{0,40}(?:nicht helfen|keine auskunft)|außerhalb",
)


def ends_on(low: str, han: tuple[str, ...], latin: tuple[str, ...], before: str) -> bool:
    """Is the end of a text in lower case one of ``han``, or of ``latin`` after a sign of ``before``?"""
    if low.endswith(han):
        return True
    return low.endswith(latin) and any(low.endswith(w) and (low[-len(w) - 1 : -len(w)] or "^") in before for w in latin)


def declines(text: str) -> bool:
    return REFUSAL_HAN.search(text) is not None or REFUSAL_LATIN.search(text.lower()) is not None


CONNECTIVE_HAN = tuple("因为 所以 但是 而且 以及 并且 或者 另外还要 比如 例如 包括 由于 虽然 其中 以便 为了 分别是 步骤如下 如下".split())
CONNECTIVE_LATIN = ("because", "because the", "so if you", "if you", "as well as", "such as", "as follows", "for example", "in order to", "and the", "or the", "weil", "sodass", "damit", "sowie", "zum beispiel", "und zwar", "wie folgt")
DANGLING_HAN = tuple("但 如果 另外 还有 不过 同时 然后 首先 建议 建议您 建议先 建议您先 需要 可以先 的话 的话就".split())
DANGLING_LATIN = tuple("and or but so if the a an of to with for in on at by from as which when while we you your our is are will can und oder aber dass wenn der die das ein eine mit für von zu an auf bei ist sind".split())
END_SIGHT = 64
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: What is left of a word or a code that was cut off right after it began.
STUB = re.compile(r"(?:(?:^|\s|[一-鿿])[A-Z]|(?<=[。！？；!?;])[^\W\d_呢哦哈啊呀嘛亲]{1,3}|(?<=\w\. )[A-Za-z]{1,2})$")
OPEN_MARK = re.compile(r"(?:[:：、，,（(【《“「\-—]|\d+[、)）])\s*$")
OPEN_LAST = tuple(":：、，,（(【《“「-—)）")
ELLIPSIS = re.compile(r"(?:…|\.{3,}|。{3,})\s*$")
STOP = {
    "en": "the of and to is in for you your with on at be are this that it not after before when from please we our until".split(),
    "de": "der die das und ist in für sie mit auf bei wir ist nicht ein eine einen den dem noch bitte uns ihr ihren nach vor wird innerhalb unser unter hat lässt sich".split(),
    "fr": "le la les des et est pour vous votre dans une un du sur avec nous pas plus ce cette il de à au".split(),
    "es": "el la los las y es para usted su en una un del con no por se de que al más esta este".split(),
    "pt": "o a os as e é para você seu em uma um do da com não por se de que ao mais esta este".split(),
    "it": "il lo la gli le e è per lei suo in una un del della con non si di che al più questo questa".split(),
    "nl": "de het een en is voor u uw in van met niet op bij wij ons dit dat naar".split(),
    "id": "dan di yang untuk dengan ini itu anda kami dalam akan masih tersedia mohon kira per sisi tidak sudah bagian foto ukuran".split(),
    "vi": "là và của cho có trong không được với bạn này đã đang chưa còn ngày tới giá".split(),
    "tr": "ve bir bu için ile da de değil çok var olarak yaklaşık gün".split(),
    "pl": "i w na z do nie się jest to o po za od dla oraz około".split(),
    "sv": "och att det som en på är av för med inte den till vi ni".split(),
}
STOP_OF: dict[str, set[str]] = {}
for _lang, _words in STOP.items():
    for _w in _words:
        STOP_OF.setdefault(_w, set()).add(_lang)
SCRIPTS = [
    ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")),
    ("ar", re.compile(r"[؀-ۿ]")), ("th", re.compile(r"[฀-๿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("he", re.compile(r"[֐-׿]")), ("zh", re.compile(r"[一-鿿]")),
]
SCRIPT_NAMES = [name for name, _ in SCRIPTS]
HAN = re.compile(r"[一-鿿]")
RARE_SCRIPT = re.compile(r"[Ͱ-ӿ֐-ۿऀ-ॿ฀-๿぀-ヿ가-힯]")
LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏẠ-ỹ']+")
SPLIT = re.compile(r"[。！？!?；;\n~～]+|\.(?=\s|$)|(?<=[^\d])\.(?=\D)")
CLAUSE = re.compile(r"[。！？!?；;\n~～，,]+|\.(?=\s|$)")

#: Labelling functions of each defect, with their first guesses of P(vote | defect), P(vote | sound).
FUNCTIONS = {
    "empty_answer": (("no_letters", 0.8, 0.001), ("none_word", 0.3, 0.001), ("tiny", 0.95, 0.01)),
    "copied_question": (("equal", 0.7, 0.0005), ("contained", 0.95, 0.003), ("covers", 0.9, 0.01)),
    "refusal": (("phrase", 0.95, 0.01), ("nothing_else", 0.9, 0.01), ("short", 0.95, 0.05)),
    "other_language": (("script", 0.5, 0.001), ("words", 0.6, 0.003), ("language", 0.97, 0.004)),
    "truncated_answer": (("ellipsis", 0.2, 0.0003), ("open_mark", 0.2, 0.0003), ("dangling", 0.2, 0.003), ("rare_end", 0.8, 0.003), ("no_stop", 0.95, 0.3), ("connective", 0.2, 0.00005), ("stub", 0.08, 0.0001)),
}
#: Length of the tail looked up, in characters: with Chinese ones at the end, and else.
TAIL_HAN, TAIL_LATIN = 3, 7
RARE, SEEN = 0.08, 4


def language(text: str) -> tuple[str | None, str | None, float]:
    """(language, script, share of stop words): by script, for Latin letters by stop words."""
    if HAN.search(text) and not RARE_SCRIPT.search(text) and len(HAN.findall(text)) * 2 > len(text):
        return "zh", "zh", 1.0
    n = {name: len(p.findall(text)) for name, p in SCRIPTS} if not text.isascii() else dict.fromkeys(SCRIPT_NAMES, 0)
    words = [w.lower() for w in LATIN_WORD.findall(text)]
    if n["ja"] >= 2 and n["ja"] * 4 >= n["zh"]:
        return "ja", "ja", 1.0
    other = max(n, key=n.get)
    # A character of these scripts says about as much as half a word of Latin letters.
    if n[other] >= 2 and n[other] * 0.5 >= len([w for w in words if len(w) > 1]) * 0.5 and n[other] > 0:
        return other, other, 1.0
    score: Counter = Counter()
    for w in words:
        for lang in STOP_OF.get(w, ()):
            score[lang] += 1 / len(STOP_OF[w]) + 0.2
    if not score:
        return None, "latin" if words else None, 0.0
    (best, top), *rest = score.most_common(2)
    if top < 1 or rest and rest[0][1] > 0.8 * top:
        return None, "latin", top / len(words)
    return best, "latin", top / len(words)


def uncoded(text: str) -> str:
    """A text with a space for each code; most have none of their first characters."""
    return CODE.sub(" ", text) if any(c in text for c in "#[【</:;") else text


def core(text: str) -> str:
    """Letters and digits of a text without codes and pleasantries, in lower case."""
    parts = [p for p in CLAUSE.split(uncoded(text)) if p.strip().lower() not in GREETING]
    return "".join(LETTERS.findall(" ".join(parts))).lower()


def shape(text: str) -> str:
    """Text for the statistic of endings: codes and numbers as signs, particles before marks out."""
    t = CODE.sub("", text)
    t = re.sub(r"[A-Za-z]?\d[\dA-Za-z]*(?:[.\-]\d+)*", "0", t)
    t = re.sub(r"[呢哦哈啊呀嘛](?=[。！？；，~～!?;,\s]|$)", "", t)
    return re.sub(r"\s+", " ", t)


END = re.compile(r"[。！？；!?;~～\n]|\.(?=\s|$)|\.(?=[^\s\d])")


def tail_of(text: str) -> str:
    """The last characters of a text before its closing marks."""
    t = re.sub(r"[\s。.!！?？~～…;；，,、:：)）\]】\"”'👍😊🙏❤️🌹✨🎉\U0001F300-\U0001FAFF]+$", "", shape(text))
    return _gram(t)


def _gram(t: str) -> str:
    return t[-TAIL_HAN:] if t[-1:] >= "⺀" or t[-2:-1] >= "⺀" else t[-TAIL_LATIN:].lower()


def endings(texts) -> tuple[Counter, Counter]:
    """(grams at the end of a sentence, grams inside of one) of texts."""
    last: Counter = Counter()
    inner: Counter = Counter()
    for text in texts:
        if not text:
            continue
        s = shape(text)
        for part in END.split(s):
            part = part.strip()
            if len(part) < 3:
                continue
            last[_gram(part)] += 1
            low = part.lower()
            # Parts of one script go quicker.
            if low.isascii():
                inner.update([low[i - TAIL_LATIN : i] for i in range(TAIL_LATIN, len(part))])
                continue
            if min(part) >= "⺀":
                inner.update([part[i - TAIL_HAN : i] for i in range(TAIL_HAN, len(part))])
                continue
            for i in range(TAIL_HAN, len(part)):
                if part[i - 1] >= "⺀" or part[i - 2] >= "⺀":
                    inner[part[i - TAIL_HAN : i]] += 1
                elif i >= TAIL_LATIN:
                    inner[low[i - TAIL_LATIN : i]] += 1
    return last, inner


def votes(question: str | None, answer: str | None) -> dict[str, int]:
    """Votes of all functions but 'rare_end', as bits in the order of ``FUNCTIONS``; and the tail."""
    a = answer or ""
    bare = uncoded(a)
    letters = "".join(LETTERS.findall(bare))
    # A longer one can't be a word for "none".
    word = re.sub(r"[\s（()）\[\]。.，,!！?？~～\-_]+", "", bare).lower() if len(letters) <= LONGEST_NONE else ""
    none = word in NONE or word.replace("/", "") in NONE
    out = {"empty_answer": (not letters) | none << 1 | (len(letters) <= 3 and not re.search(r"\d", letters) or none) << 2}
    q, c = core(question or ""), core(a)
    copied = 0
    if q and c and len(c) >= 4:
        # A run of three signs is one of the answer's if it stands in it; the answer's own runs are
        # only counted if they may be few enough: they are at least its different signs but two.
        p = {q[i : i + 3] for i in range(max(1, len(q) - 2))}
        common = sum(g in c for g in p) if len(q) >= 3 else 0
        inside = common >= 0.85 * (len(set(c)) - 2) and common >= 0.85 * len({c[i : i + 3] for i in range(len(c) - 2)})
        copied = (q == c) | inside << 1 | (common >= 0.6 * len(p)) << 2
    out["copied_question"] = copied
    phrase = declines(a)
    left = 0
    if phrase:
        for part in SPLIT.split(bare):
            # A sentence that declines is no content, nor are pleasantries; what follows 'but' is.
            part = part.strip()
            if part and not declines(part):
                left += sum(len(x) for piece in CLAUSE.split(part) if piece.strip().lower() not in GREETING for x in LETTERS.findall(piece))
            elif part and re.search(r"不过|但是?|however|but |though|allerdings|aber ", part, re.I) and not re.search(r"but I can|but we can't|but i cannot", part, re.I):
                left += 12
    out["refusal"] = phrase | (phrase and left <= 10) << 1 | (0 < len(letters) <= (45 if re.search("[一-鿿]", a) else 90)) << 2
    other = 0
    if letters and question and not none and len(letters) >= 6:
        ql, qs, _ = language(question)
        al, ascript, _ = language(bare)
        script = qs is not None and ascript is not None and qs != ascript
        words = qs == "latin" and ascript == "latin" and ql is not None and al is not None and ql != al
        other = script | words << 1 | (script or words) << 2
    out["other_language"] = other
    t = CODE.sub("", a).rstrip(_WHITE + "~～") if bare is not a else a.rstrip(_WHITE + "~～")
    # Whatever these patterns match at the end is shorter than END_SIGHT.
    bareend = t.rstrip(_WHITE + "。.!！?？~～…;；，,、:：")[-END_SIGHT:]
    t, low = t[-END_SIGHT:], bareend.lower()
    out["truncated_answer"] = (
        (ELLIPSIS.search(t) is not None and len(letters) > 3)
        | (t[-1:] in OPEN_LAST and OPEN_MARK.search(t) is not None) << 1
        | ends_on(low, DANGLING_HAN, DANGLING_LATIN, _WHITE + "^") << 2
        | (re.search(r"[。.!！?？~～;；]\W*$", a) is None or ELLIPSIS.search(t) is not None) << 4
        | ends_on(low, CONNECTIVE_HAN, CONNECTIVE_LATIN, _WHITE + ",") << 5
        | (STUB.search(bareend[-8:]) is not None) << 6
    ) if letters and not none else 0
    return {k: int(v) for k, v in out.items()}


def fit(patterns: dict[int, int], first: tuple, rounds: int = 60, strength: float = 0.001, sound: float = 0.01) -> tuple[dict[int, float], list]:
    """EM of one defect: (posterior of each vote pattern, [(P(vote | defect), P(vote | sound))]).

    patterns: counts by the bits of the votes.  The first guesses are where the fit begins, and weigh
    no more than ``strength`` of all rows for the defective and ``sound`` of them for the sound pairs.
    """
    keys = np.array(sorted(patterns), dtype=np.int64)
    n = np.array([patterns[k] for k in keys], dtype=float)
    v = (keys[:, None] >> np.arange(len(first))) & 1
    yes0, no0 = np.array([f[1] for f in first]), np.array([f[2] for f in first])
    yes, no, share = yes0.copy(), no0.copy(), 0.02
    weight = max(10.0, strength * n.sum())
    post = np.zeros(len(keys))
    for _ in range(rounds):
        like_y = np.log(share) + (v * np.log(yes) + (1 - v) * np.log(1 - yes)).sum(axis=1)
        like_n = np.log(1 - share) + (v * np.log(no) + (1 - v) * np.log(1 - no)).sum(axis=1)
        post = 1 / (1 + np.exp(np.clip(like_n - like_y, -60, 60)))
        y, z = n * post, n * (1 - post)
        share = float(np.clip((y.sum() + 1) / (n.sum() + 50), 1e-4, 0.3))
        yes = np.clip((v.T @ y + weight * yes0) / (y.sum() + weight), 1e-4, 0.999)
        no = np.clip((v.T @ z + sound * n.sum() * no0) / (z.sum() + sound * n.sum()), 1e-5, 0.9)
    return dict(zip(keys.tolist(), post.tolist())), list(zip(yes.tolist(), no.tolist()))


def ending_statistics(answers: DataFrame) -> DataFrame:
    """(tail, ends, inside, row_ends, row_inside) over the distinct answers, and with each weighted by
    its copies; a batch of rows is summed before the shuffle.

    Answers alike but for numbers, case, spaces and closing marks are copies: among the distinct ones
    they can't vouch for each other's ending.
    """

    def work(batches):
        for pdf in batches:
            sums: dict[str, list[int]] = {}
            for text, n in zip(pdf["answer"], pdf["n"]):
                for k, grams in enumerate(endings([text])):
                    for g, c in grams.items():
                        s = sums.setdefault(g, [0, 0, 0, 0])
                        s[k] += c
                        s[k + 2] += c * n
            out = pd.DataFrame(list(sums.values()), columns=["ends", "inside", "row_ends", "row_inside"], dtype="int64")
            out.insert(0, "tail", pd.Series(list(sums), dtype=object))
            yield out

    same = F.regexp_replace(F.regexp_replace(F.lower("answer"), r"(?U)[\p{P}\p{S}\s]+$", ""), r"(?U)\d+|\s+", "0")
    answers = answers.where("answer <> ''").groupBy(F.md5(same).alias("same")).agg(F.min("answer").alias("answer"), F.count("*").alias("n")).select("answer", "n")
    counts = ["ends", "inside", "row_ends", "row_inside"]
    return answers.mapInPandas(work, "tail string, " + ", ".join(f"{c} long" for c in counts)).groupBy("tail").agg(*[F.sum(c).alias(c) for c in counts])


def label_votes(pairs: DataFrame) -> DataFrame:
    """pairs (id, question, answer) to (id, one column of vote bits a defect)."""

    def work(batches):
        for pdf in batches:
            got = [votes(q, a) for q, a in zip(pdf["question"], pdf["answer"])]
            out = pd.DataFrame({"id": pdf["id"].values, **{d: [g[d] for g in got] for d in DEFECTS}})
            out["tail"] = [tail_of(a) if a else "" for a in pdf["answer"]]
            yield out

    schema = "id string, " + ", ".join(f"{d} int" for d in DEFECTS) + ", tail string"
    voted = pairs.mapInPandas(work, schema)
    stats = ending_statistics(pairs.select("answer"))
    voted = voted.join(stats, "tail", "left")
    # The pair's own ending doesn't count, among distinct answers nor among rows; one not seen elsewhere gives no vote.
    rare = F.lit(False)
    for e, i in (("ends", "inside"), ("row_ends", "row_inside")):
        ends = F.coalesce(e, F.lit(0)) - 1
        seen = ends + F.coalesce(i, F.lit(0))
        rare = rare | ((F.col("tail") != "") & (seen >= SEEN) & (ends < RARE * seen))
    bits = F.when(rare, F.col("truncated_answer").bitwiseOR(8)).otherwise(F.col("truncated_answer"))
    return voted.withColumn("truncated_answer", bits.cast("int")).drop("tail", "ends", "inside", "row_ends", "row_inside")


def posterior(bits: int, rates: list, share: float) -> float:
    """Posterior of a vote pattern, also of one that the fit has not seen."""
    y, n = share, 1 - share
    for i, (yes, no) in enumerate(rates):
        y, n = (y * yes, n * no) if bits >> i & 1 else (y * (1 - yes), n * (1 - no))
    return y / (y + n)


def best_cutoff(counts: dict[int, int], post: dict[int, float]) -> float:
    """Cutoff of the best expected F1 over patterns with these posteriors; 0.5 where there are none."""
    order = sorted((b for b in counts if b in post), key=lambda b: -post[b])
    total = sum(counts[b] * post[b] for b in order)
    best, hit, taken, out = 0.0, 0.0, 0, 0.5
    for b, nxt in zip(order, [*order[1:], None]):
        hit, taken = hit + counts[b] * post[b], taken + counts[b]
        f1 = 2 * hit / (taken + total) if taken + total else 0.0
        if f1 > best:
            # Half way to the next pattern.
            best, out = f1, (post[b] + (post[nxt] if nxt is not None else 0.0)) / 2
    return min(0.95, max(0.05, out))


def vote_counts(voted: DataFrame) -> dict[str, list[dict[int, int]]]:
    """Counts of each vote pattern of each defect in two halves of the pairs: at most 256 rows a defect."""
    cell = [F.struct(F.lit(d).alias("defect"), F.col(d).alias("bits")) for d in DEFECTS]
    rows = voted.select(F.pmod(F.xxhash64("id"), F.lit(2)).alias("half"), F.inline(F.array(*cell))).groupBy("defect", "half", "bits").agg(F.count("*").alias("n")).collect()
    out: dict[str, list[dict[int, int]]] = {d: [{}, {}] for d in DEFECTS}
    for r in rows:
        out[r["defect"]][r["half"]][r["bits"]] = r["n"]
    return out


class LabelModel:
    """post: posterior by defect and vote pattern; cutoffs: by defect, validated; rates: of each function.

    A cutoff is chosen on one half of the pairs by the model fitted on the other, both ways, and
    averaged: so a pattern that only one half makes a defect doesn't set it.
    """

    def __init__(self, counts: dict[str, list[dict[int, int]]]):
        self.post, self.cutoffs, self.rates = {}, {}, {}
        for d, halves in counts.items():
            whole = {b: halves[0].get(b, 0) + halves[1].get(b, 0) for b in {*halves[0], *halves[1]}}
            self.post[d], self.rates[d] = fit(whole, FUNCTIONS[d]) if whole else ({}, [])
            cuts = []
            for own, other in (halves, halves[::-1]):
                if own and other:
                    post, rates = fit(own, FUNCTIONS[d])
                    share = sum(own[b] * post[b] for b in own) / sum(own.values())
                    cuts.append(best_cutoff(other, {b: posterior(b, rates, min(max(share, 1e-6), 1 - 1e-6)) for b in other}))
            self.cutoffs[d] = sum(cuts) / len(cuts) if cuts else 0.5


def defects(voted: DataFrame) -> DataFrame:
    """(id, defects ARRAY<STRING>, posteriors ARRAY<DOUBLE>): all defects beyond their cutoffs."""
    model = LabelModel(vote_counts(voted))
    columns = []
    for d in DEFECTS:
        value = F.lit(0.0)
        for bits, p in model.post[d].items():
            value = F.when(F.col(d) == bits, p).otherwise(value)
        columns.append(F.struct(F.lit(d).alias("defect"), value.alias("p"), F.lit(model.cutoffs[d]).alias("cutoff")))
    hit = F.filter(F.array(*columns), lambda x: x["p"] >= x["cutoff"])
    return voted.select("id", hit.alias("hit")).where(F.size("hit") > 0).select("id", F.col("hit.defect").alias("defects"), F.col("hit.p").alias("posteriors"))
