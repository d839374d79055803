"""Personal data: cases by type, decoys, masking, message passing against enumeration."""

import itertools
import math
import re

import pytest

from colloquy.llm import personal as P

CASES = [
    ("发票发到birch-home2348@example.org 想问下", {"EMAIL"}),
    ("邮箱tide.river6672 at mail dot example dot net 谢谢", {"EMAIL"}),
    ("请把资料寄到 qiu_river3884＠post.test 谢谢", {"EMAIL"}),
    ("手机号：134-1511-7678", {"PHONE"}),
    ("可以加１９７５５８３３９１５", {"PHONE"}),
    ("电话幺三三零幺九六三六三九", {"PHONE"}),
    ("call me on +44 20 7946 0131", {"PHONE"}),
    ("my number is 555-0183", {"PHONE"}),
    ("身份证162502 19690121 2080", {"IDENTITY_ID"}),
    ("号码是护照E42119372（实名用）", {"IDENTITY_ID"}),
    ("for customs: SSN 939-89-7714", {"IDENTITY_ID"}),
    ("my ID card L82K3841Z is needed?", {"IDENTITY_ID"}),
    ("我住南浦市桥南区望江北路244号2栋2147室", {"ADDRESS"}),
    ("寄到朔北镇柳湾村5组15号", {"ADDRESS"}),
    ("deliver to 210 Larkmoor Lane, Eastmere", {"ADDRESS"}),
    ("my address is Lindenquellstraße 85, Marchfield", {"ADDRESS"}),
    ("我叫沈怀瑾，看的是茧空", {"NAME"}),
    ("麻烦寄给霍予安，发票", {"NAME"}),
    ("my name is Maribel Halloran-Voss", {"NAME"}),
    ("户主沈听澜会在家，电话13165932620", {"NAME", "PHONE"}),
    # Decoys.
    ("订单号533041295251884909", set()),
    ("单号 202679586514 复制就行", set()),
    ("快递单号SD1778948153064", set()),
    ("合同编号626109448787536341", set()),
    ("条码6951097286251", set()),
    ("客服热线400-204-5011", set()),
    ("Anything else? ticket 297190", set()),
    ("我是客服小禾", set()),
    ("地址已隐藏为[ADDRESS]，联系方式见[PHONE]", set()),
    ("人在橘洲头，发到青屿一般几天", set()),
    ("Shipping to Lower Pell. Points are locked at checkout. Have a nice day", set()),
    ("预算876元，提示码732", set()),
    ("", set()),
    (None, set()),
]


@pytest.mark.parametrize(("text", "types"), CASES)
def test_types(text, types):
    assert {t for _, _, t in P.label(text)} == types


def test_mask():
    assert P.mask("我叫沈怀瑾，电话13165932620。沈怀瑾收") == ("我叫[NAME]，电话[PHONE]。[NAME]收", ["NAME", "PHONE"])
    assert P.mask(None) == (None, [])
    assert P.mask("好的") == ("好的", [])
    text, types = P.mask("x" * 200_000 + " 电话13165932620")
    assert types == ["PHONE"] and text.endswith("[PHONE]")


def test_skip_edges_decide():
    """Mentions without a cue are masked through the edges to the mention with one, and not without."""
    for text, with_, without in (
        ("my name is Maribel Halloran-Voss. Please ask Maribel or Halloran", "my name is [NAME]. Please ask [NAME] or [NAME]", "my name is [NAME]. Please ask Maribel or Halloran"),
        ("我叫沈怀瑾，" + "好的" * 5000 + "怀瑾收", "我叫[NAME]，" + "好的" * 5000 + "[NAME]收", "我叫[NAME]，" + "好的" * 5000 + "怀瑾收"),
        ("身份证330106850512345，再发一次：330106850512345", "身份证[IDENTITY_ID]，再发一次：[IDENTITY_ID]", "身份证[IDENTITY_ID]，再发一次：330106850512345"),
    ):
        assert P.mask(text)[0] == with_
        assert P.mask(text, skip=0.0)[0] == without


def test_fit_follows_the_graphs():
    """Weights move to what the graphs say: repeated numbers of one shape, half of them with a cue."""
    texts = ["身份证330106850512345，再发一次：330106850512345"] * 500
    w = P.fit(texts)
    assert w["IDENTITY_ID"]["birth15"] > P.WEIGHTS["IDENTITY_ID"]["birth15"] + 0.3
    graph = P.nodes(texts[0])
    assert P.marginals(P.decode(P.encode(graph)), w) == P.marginals(graph, w)


def test_message_passing_on_a_chain_is_exact():
    graph = P.nodes("我叫沈怀瑾，电话13165932620，邮箱a.b@example.org")
    assert len(graph) == 3
    got = P.marginals(graph)
    total = [[0.0] * len(n.labels) for n in graph]
    for choice in itertools.product(*[range(len(n.labels)) for n in graph]):
        w = math.prod(n.unary[c] for n, c in zip(graph, choice))
        for (a, x), (b, y) in zip(zip(graph, choice), zip(graph[1:], choice[1:])):
            w *= math.exp(P.CHAIN) if a.labels[x] == b.labels[y] else 1.0
        for i, c in enumerate(choice):
            total[i][c] += w
    for g, t in zip(got, total):
        assert g == pytest.approx([v / sum(t) for v in t], rel=1e-6)


def test_fit_keeps_signs():
    w = P.fit([t for t, _ in CASES if t])
    assert w["PHONE"]["not"] < -5 and w["PHONE"]["mobile"] > 2
    assert P.fit([]) == P.WEIGHTS


def test_operator(spark):
    m = spark.createDataFrame([(1, "电话13165932620"), (2, None), (3, ""), (4, "好的")], "message_id long, message_content string")
    c = spark.createDataFrame([("a", "我叫沈怀瑾，", None)], "external_candidate_id string, final_question string, final_answer string")
    df = P.texts(m, c)
    graphs = P.proposals(df)
    assert {tuple(r) for r in P.found(graphs).collect()} == {("message", "1", "message_content", "PHONE"), ("candidate", "a", "final_question", "NAME")}
    assert P.masked(df).count() == 6
    assert P.found(P.proposals(df.limit(0))).count() == 0
    assert P.fitted(graphs) == P.fit(["电话13165932620", "我叫沈怀瑾，"])


def test_prefilter_passes_every_proposal(spark):
    name = " John Smith"
    cues = ["my name is", "name:", "I am", "this is", "it is for", "it's for", "ship it to", "send it to", "addressed to", "ask for", "attn", "Attn:", "attention", "Attention:", "placed by", "on behalf of", "regards,", "sincerely,", "signed,", "recipient", "Recipient:", "mein name ist", "ich heiße", "für frau", "für herrn", "FÜR FRAU", "Mr", "Dr."]
    texts = [c + name for c in cues] + [c + "\u2003John Smith" for c in cues] + [c + "\xa0John Smith" for c in cues]
    texts += ["card Ｃ０１Ｘ０００６Ｔ", "write to a.b（at）mail.example", "at 12\xa0Baker Street", "Ａｔｔｎ：　John Smith", "P.O. Box 12"] + [t for t, types in CASES if types]
    proposed = [t for t in texts if P.nodes(t.translate(P._NARROW))]
    df = spark.createDataFrame([("message", str(i), "message_content", t) for i, t in enumerate(proposed)], "record_kind string, record_key string, field_name string, text string")
    assert len(proposed) > 80 and df.where(~P._proposing(df.text)).collect() == []
