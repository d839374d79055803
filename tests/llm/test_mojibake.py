"""Garbled text: made by hand from known text, found and restored; sound text untouched."""

import random

import pytest

from colloquy.llm import mojibake as mj

ZH = "麻烦问问，昨天下午签的合同解除那一段有效吗，等你回复"
DE = "Gibt es für Größe 45 noch schöne Schuhe über dreißig Euro?"
SOUND = [
    ZH, DE, "PROMOÇÃO ainda válida? São dois pares, não um", "Ångström-Serie in Grün – wieviel kostet’s?", "El tamaño 41 está agotado, ¿cuándo volverá?",
    "請問這雙鞋還有貨嗎，我想買給家裡長輩", "收到之後發現鞋帶顏色不對，麻煩幫我看一下", "Ещё есть чёрный цвет сорок второго размера?", "Υπάρχει το μπλε σε νούμερο 38;",
    "★☆限定款☆★ 还有吗 →→ ™正品®", "两双会从同一个网点���面单要不要分开收", "Cost ±5 £, see § 3 © shop, 20 °C wash ok?", "１７２６０４１８０２４", "？？？？", "", None, "#E-s07",
    "囍字禮盒包裝還可以加嗎，龘字那張卡也要", "Le café près du dépôt garde mon colis, ça va?",
]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_is_left_alone(text):
    assert mj.restore(text) == (text, False)


@pytest.mark.parametrize(("true", "wrong"), [("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("gb18030", "latin-1"), ("gb18030", "mac_roman")])
@pytest.mark.parametrize("text", [ZH, DE])
def test_round_trip(true, wrong, text):
    if true == "gb18030" and text == DE:
        return
    codec = mj.Codec(wrong)
    garbled = codec.decode(text.encode(true))
    assert mj.restore(garbled) == (text, True)
    mixed = "你好，" + garbled + "，谢谢"
    assert mj.restore(mixed) == ("你好，" + text + "，谢谢", True)


def test_twice():
    once = ZH.encode().decode("latin-1")
    assert mj.restore(once.encode().decode("latin-1")) == (ZH, True)


@pytest.mark.parametrize(("true", "wrong"), [("utf-8", "gb18030"), ("gb18030", "big5hkscs")])
def test_two_byte_pairs_are_found(true, wrong):
    rng = random.Random(3)
    words = "昨天下午 麻烦问问 合同解除 那一段有效吗 等你回复 转运中心 快递柜里 换货进度".split()
    for _ in range(40):
        text = "，".join(rng.sample(words, 4))
        garbled = text.encode(true).decode(wrong, "replace")
        assert mj.spans(garbled), (text, garbled)


def test_very_long():
    text = ZH * 20_000
    assert mj.restore(text) == (text, False)
    garbled = text.encode().decode("latin-1")
    assert mj.restore(garbled + text) == (text + text, True)


def test_bytes():
    assert mj.read_bytes(None) == (None, "none")
    assert mj.read_bytes(b"") == ("", "utf-8")
    for name in ("utf-8", "utf-8-sig", "gb18030", "utf-16"):
        assert mj.read_bytes(ZH.encode(name))[0] == ZH
    assert mj.read_bytes(ZH.encode("utf-16-le"))[0] == ZH
    assert mj.read_bytes(ZH.encode() + b"\xff" + ZH.encode())[1] == "utf-8"


def test_operator(spark):
    m = spark.createDataFrame([(1, ZH), (2, ZH.encode().decode("latin-1")), (3, None), (4, "")], "message_id long, message_content string")
    s = spark.createDataFrame([("a", ZH.encode("gb18030")), ("b", ZH.encode().decode("cp437").encode()), ("c", None), ("d", b"")], "source_name string, data binary")
    records = mj.records(m, s)
    assert {tuple(r) for r in mj.found(records).collect()} == {("message", "2"), ("text_source", "b")}
    assert {tuple(r) for r in mj.repair(records).collect()} == {("message", "2", ZH), ("text_source", "b", ZH)}
    assert mj.found(records.limit(0)).count() == 0


def test_as_often_as_garbled():
    right = "鞋子很好，下次再来买"
    text = right
    for _ in range(5):
        text = text.encode().decode("latin-1")
        assert mj.restore(text) == (right, True)


def test_kana_hangul_and_emoji():
    for right in ("こんにちは", "안녕하세요", "好的😊谢谢"):
        assert mj.restore(right) == (right, False)
        assert mj.restore(right.encode().decode("cp437")) == (right, True)


def test_many_spans_in_one_text():
    text, was = mj.restore("ok Ã© " * 100_000)
    assert was and text == "ok é " * 100_000
