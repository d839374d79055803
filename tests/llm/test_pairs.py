"""Defects of pairs: cases and the label model."""

import pytest

from colloquy.llm import pairs as P

ANSWER = "寄回时请把鞋盒和配件放齐，审核缺一样都会拖慢退货。质检通过后646小时内会生成售后单凭据。"
CASES = [
    ("鞋码偏大吗", None, "empty_answer"), ("鞋码偏大吗", " 　", "empty_answer"), ("鞋码偏大吗", "。。。", "empty_answer"), ("鞋码偏大吗", "#E-s12", "empty_answer"),
    ("鞋码偏大吗", "[图片]", "empty_answer"), ("鞋码偏大吗", "😊", "empty_answer"), ("鞋码偏大吗", "N/A", "empty_answer"), ("鞋码偏大吗", "（无）", "empty_answer"),
    ("鞋码偏大吗", "亲，您问的我帮不上忙~", "refusal"), ("Is it big?", "I won't be able to answer that, sorry!", "refusal"), ("Ist es groß?", "Dabei kann ich Ihnen leider nicht helfen.", "refusal"),
    ("鞋码偏大吗", "这个我真的答不了您，9号窗口也许知道", "refusal"), ("鞋码偏大吗", "抱歉暂时无法提前发货，不过" + ANSWER, None), ("鞋码偏大吗", "这款不能机洗，" + ANSWER, None),
    ("我的退货还卡在照片凭证，什么时候有结果", "亲，我的退货还卡在照片凭证，什么时候有结果。", "copied_question"), ("我的退货还卡在照片凭证", "您问的是我的退货还卡在照片凭证，" + ANSWER, None),
    ("我的退货还卡在照片凭证", "Bitte senden Sie ein Foto der Sohle, danach prüfen wir innerhalb von 117 Stunden.", "other_language"), ("When will the parcel be at the depot?", "Le colis devrait arriver dans 26 jours ouvrés, merci de nous envoyer une photo de la semelle.", "other_language"),
    ("我的退货还卡在照片凭证", "お荷物は10日ほどで届く予定です。", "other_language"), ("Is the Pelagi Loop 93 for running in the rain?", "The Pelagi Loop 93 is a shoe for you to run in the rain with.", None),
    ("我的退货还卡在照片凭证", ANSWER, None), ("我的退货还卡在照片凭证", ANSWER[:-1], None), (None, ANSWER, None),
    ("我的退货还卡在照片凭证", ANSWER + "步骤如下：", "truncated_answer"), ("我的退货还卡在照片凭证", "寄回时请把鞋盒和配件放……", "truncated_answer"), ("我的退货还卡在照片凭证", ANSWER + "质检通过后646小时内会生成售", "truncated_answer"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"c{i}", q, a) for i, (q, a, _) in enumerate(CASES)]
    rows += [(f"x{i}", f"第{i}次的退货进度在哪里看", f"您好，{ANSWER}") for i in range(900)]
    rows += [("long", "问" * 100_000, ANSWER * 2000), (None, "a", "b")]
    voted = P.label_votes(spark.createDataFrame(rows, "id string, question string, answer string").where("id is not null"))
    return {r.id: r.defects for r in P.defects(voted).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(found, i):
    want = CASES[i][2]
    assert found.get(f"c{i}", [None])[0] == want, (CASES[i], found.get(f"c{i}"))


def test_sound_pairs(found):
    assert not [k for k in found if k.startswith("x") or k == "long"]


def test_label_model_learns():
    counts = {0: 9000, 1: 200, 3: 300, 7: 500}
    post, rates = P.fit(counts, (("a", 0.6, 0.05), ("b", 0.6, 0.05), ("c", 0.6, 0.05)))
    assert post[7] > 0.9 > 0.1 > post[0] and post[7] >= post[3] >= post[1]
    assert all(y > n for y, n in rates)


def test_the_fit_decides():
    """Rates far from the data give way: without the fit they would call other patterns defective."""
    counts = {0: 9000, 1: 30, 2: 2500, 4: 40, 5: 400, 7: 420}
    good, bad = [P.fit(counts, tuple((n, y, z) for n, (y, z) in zip("abc", rates)))[0] for rates in (((0.9, 0.01), (0.5, 0.2), (0.9, 0.01)), ((0.5, 0.1), (0.5, 0.1), (0.5, 0.1)))]
    defective = lambda post: {b for b in post if post[b] >= 0.5}
    assert defective(good) == defective(bad) == {5, 7}
    unfitted = {b: P.posterior(b, [(0.5, 0.1)] * 3, 0.02) for b in counts}
    assert defective(unfitted) != defective(bad)


def test_cutoffs_are_validated():
    model = P.LabelModel({"empty_answer": [{0: 900, 5: 50, 6: 20}, {0: 900, 5: 50, 6: 20}], "refusal": [{}, {}]})
    assert 0.05 <= model.cutoffs["empty_answer"] <= 0.95 and model.cutoffs["refusal"] == 0.5
    assert P.best_cutoff({0: 90, 1: 10}, {0: 0.1, 1: 0.8}) == pytest.approx(0.45)


def test_empty(spark):
    voted = P.label_votes(spark.createDataFrame([], "id string, question string, answer string"))
    assert P.defects(voted).count() == 0


def test_copies_do_not_vouch_for_their_ending(spark):
    cut = "包裹到站后请凭取件码领取，质检通过后646小时内会生成售"
    rows = [(f"c{i}", "鞋码偏大吗", cut.replace("646", str(600 + i % 3)) + " " * (i % 2)) for i in range(50)]
    rows += [(f"x{i}", "鞋码偏大吗", f"{a}质检通过后646小时内会生成售后单凭据。") for i, a in enumerate("甲乙丙丁戊己庚辛")]
    got = {r.id: r.truncated_answer for r in P.label_votes(spark.createDataFrame(rows, "id string, question string, answer string")).collect()}
    assert all(bool(got[k] & 8) == k.startswith("c") for k in got)
