"""Speaker roles from the spellings of sender types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the roles, in lower case.
CUSTOMER = "customer buyer client user consumer shopper guest visitor 客户 顾客 买家 用户 消费者 访客 会员 kunde kundin käufer käuferin 顧客 客戶 買家 cliente acheteur".split()
SERVICE = "service agent seller staff support merchant operator representative assistant shop cs 客服 坐席 卖家 商家 店员 人工客服 在线客服 店铺 kundendienst kundenservice mitarbeiter verkäufer berater 客服人员 座席 賣家 vendeur".split()
SYSTEM = "system sys robot bot notice 系统 系统消息 系統 机器人 通知".split()
#: White space as Unicode knows it, at both ends.
ENDS = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"


def role(sender_type: Column) -> Column:
    """'customer', 'service', 'system', or null for a type that is null, blank or not known."""
    word = F.lower(F.regexp_replace(sender_type, ENDS, ""))
    return F.when(word.isin(CUSTOMER), "customer").when(word.isin(SERVICE), "service").when(word.isin(SYSTEM), "system")


def sql(sender_type: str) -> str:
    """The same as DuckDB SQL."""
    word = f"lower(regexp_replace({sender_type}, '^[\\s\\pZ\\x1c-\\x1f\\x{{85}}]+|[\\s\\pZ\\x1c-\\x1f\\x{{85}}]+$', '', 'g'))"
    of = lambda words: ", ".join(f"'{w}'" for w in words)
    return f"case when {word} in ({of(CUSTOMER)}) then 'customer' when {word} in ({of(SERVICE)}) then 'service' when {word} in ({of(SYSTEM)}) then 'system' end"
