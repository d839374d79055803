"""Second and final masking pass and their composition."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import masking_passes as mp


def passed(spark, f, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [(r.masked, r.pii_types) for r in f(df, "t", **kw).orderBy("i").collect()]


SECOND = [
    ("见https://item.jd.com/1.html和HTTPS://x.example/a，好", "见[PRODUCT_LINK]", None),
    ("商品编号：12345678", "商品ID：[PRODUCT_ID]", ["PRODUCT_ID"]),
    ("order id 1234567", "订单ID：[ORDER_ID]", ["ORDER_ID"]),
    ("圆通 单号：1234567890123", "圆通 单号：[TRACKING_ID]", ["TRACKING_ID"]),
    ("[PHONE]河西区南浦路3号，谢谢", "[PHONE][ADDRESS]，谢谢", ["ADDRESS"]),
    ("[PHONE]王小明，谢谢", "[PHONE][NAME]，谢谢", ["NAME"]),
    ("[PHONE]请发货，谢谢", "[PHONE]请发货，谢谢", []),
    ("王小明 [PHONE]", "[NAME] [PHONE]", ["NAME"]),
    ("联系电话 [PHONE]", "联系电话 [PHONE]", []),
    ("收货地址：南浦3幢。好", "[ADDRESS]。好", ["ADDRESS"]),
    ("我在河西区南浦路。好", "[ADDRESS_RELATED_MESSAGE]。好", ["ADDRESS"]),
    ("偏远地区的市场价格，其他地区不发", "偏远地区的市场价格，其他地区不发", []),
    ("订单号是 1234567890", "订单号是 [TRACKING_ID]", ["TRACKING_ID"]),
    ("订单里的 1234567890", "订单里的 [ORDER_ID]", ["ORDER_ID"]),
    ("1234567890 这个快递", "[TRACKING_ID] 这个快递", ["TRACKING_ID"]),
    ("商品很好，我等了很久很久很久1234567890", "商品很好，我等了很久很久很久[LONG_NUMBER]", ["LONG_NUMBER"]),
    ("a  b ", "a b", []),
    ("", "", []),
    (None, None, []),
]


def test_second_pass(spark):
    got = passed(spark, mp.second_pass, [t for t, _, _ in SECOND])
    for (text, want, types), (masked, found) in zip(SECOND[1:], got[1:]):
        assert (masked, found) == (want, types), text
    assert got[0] == ("见[PRODUCT_LINK]，好", ["PRODUCT_LINK"])  # a link ends at a mark of Chinese text only


FINAL = [
    ("a.b@x.example", "[EMAIL]", ["EMAIL"]),
    ("打13812345678或021-61234567", "打[PHONE]或[PHONE]", ["PHONE"]),
    ("商品 123 456 789 012", "商品 [PRODUCT_ID]", ["PRODUCT_ID"]),
    ("联系人：王小明", "联系人：[NAME]", ["NAME"]),
    ("[PHONE] 王小明", "[PHONE] [NAME]", ["NAME"]),
    ("[PHONE] 仓库小哥", "[PHONE] 仓库小哥", []),
    ("陈先生 [PHONE]", "[NAME] [PHONE]", ["NAME"]),
    ("请寄到南浦大楼", "请寄到南浦大楼", []),
    ("寄到：南浦大楼", "寄到：[ADDRESS]", ["ADDRESS"]),
    ("送到河西区", "送到[ADDRESS]", ["ADDRESS"]),
    ("我在河西区南浦路。好", "[ADDRESS_RELATED_MESSAGE]。好", ["ADDRESS"]),
    ("好的#E-s12；；谢谢；", "好的；谢谢", ["PLATFORM_CODE"]),
]


@pytest.mark.parametrize("k", range(len(FINAL)))
def test_final_pass(spark, k):
    text, want, types = FINAL[k]
    assert passed(spark, mp.final_pass, [text]) == [(want, types)]


def test_composition_and_residue(spark):
    text = "南浦旗舰店的小禾说，身份证11010119900307123X，微信abc_123，收款码：xyz 陈先生 13812345678"
    (masked, types), = passed(spark, mp.sanitize, [text], stores=["南浦旗舰店", "南浦"], senders=["小禾", "客服"], first=[("PHONE", lambda t: F.regexp_replace(t, r"(?<!\d)1[3-9]\d{9}(?!\d)", "[PHONE]"))])
    assert masked == "[EXTERNAL_STORE]的[SERVICE_AGENT]说，身份证[IDENTITY_ID]，微信[WECHAT_ID]，[PAYMENT_INFO] [NAME] [PHONE]"
    assert {"STORE_IDENTITY", "SERVICE_AGENT", "IDENTITY_ID", "WECHAT_ID", "PAYMENT_INFO", "PHONE", "NAME"} <= set(types)
    df = spark.createDataFrame([(text,), (masked,), (None,), ("",)], "t string")
    left = [r.residual for r in mp.residual_types(df, "t", ["南浦旗舰店"]).collect()]
    assert left[0] and not left[1] and left[2:] == [[], []]
    extra = df.selectExpr("t", "'x' as masked", "'y' as _t0")
    assert mp.final_pass(extra, "t").count() == 4 and mp.final_pass(df.limit(0), "t").count() == 0
