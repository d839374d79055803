"""Timestamp texts against an independent reading in plain Python."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from colloquy.operators import timestamps

ZONES = {"Z": 0, "UTC": 0, "GMT": 0, "BST": 60, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "PST": -480, "PDT": -420, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780}
MONTH = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}


def plain(text, zone, order):
    """Milliseconds of a text or None, by one pattern a form."""
    if text is None:
        return None
    t = text.translate(str.maketrans("０１２３４５６７８９：－　\xa0", "0123456789:-  ")).strip()
    t = re.sub(r"\s+", " ", t)
    if re.fullmatch(r"\d{10}", t):
        return int(t) * 1000
    if re.fullmatch(r"\d{13}", t):
        return int(t)
    offset = None
    if "北京时间" in t:
        t, offset = re.sub(r"（?北京时间）?", "", t).strip(), 480
    m = re.fullmatch(r"(.*?:\d\d(?:\.\d+)?) ?([A-Z]+)?(?:([+-])(\d{1,2}):?(\d\d)?)?", t)
    if m and (m[2] not in (None, "AM", "PM") or m[3]):
        t = m[1]
        offset = ZONES[m[2]] if m[2] else 0
        if m[3]:
            offset += (1 if m[3] == "+" else -1) * (int(m[4]) * 60 + int(m[5] or 0))
    clock = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:\.(\d+))?)?(?: ([AaPp][Mm]))?"
    word = None
    if m := re.fullmatch(r"(\d{4})年(\d+)月(\d+)日 ?(上午|下午|晚上|凌晨|中午)?(\d+)(?::|时)(\d+)(?:(?::|分)(\d+)秒?)?", t):
        y, mo, d, word, h, mi, s, fr, half = *map(int, m.group(1, 2, 3)), m[4], m[5], m[6], m[7], None, None
    elif m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)", t):
        y, mo, d, h, mi, s, fr, half = *map(int, m.group(1, 2, 3)), m[4], m[5], m[6], None, None
    elif m := re.fullmatch(r"(\d{4})[-/](\d+)[-/](\d+)[ T]" + clock, t):
        y, mo, d, h, mi, s, fr, half = *map(int, m.group(1, 2, 3)), *m.group(4, 5, 6, 7, 8)
    elif m := re.fullmatch(r"(\d+)\.(\d+)\.(\d{4}) " + clock, t):
        d, mo, y, h, mi, s, fr, half = *map(int, m.group(1, 2, 3)), *m.group(4, 5, 6, 7, 8)
    elif m := re.fullmatch(r"(\d+)/(\d+)/(\d{4}) " + clock, t):
        a, b, y, h, mi, s, fr, half = *map(int, m.group(1, 2, 3)), *m.group(4, 5, 6, 7, 8)
        d, mo = (a, b) if order == "DMY" else (b, a)
    elif m := re.fullmatch(r"(?:\w{3} )?(\w{3}) (\d+),? (\d{4}) " + clock, t):
        mo, d, y, h, mi, s, fr, half = MONTH[m[1]], int(m[2]), int(m[3]), *m.group(4, 5, 6, 7, 8)
    elif m := re.fullmatch(r"\w{3}, (\d+) (\w{3}) (\d{4}) " + clock, t):
        d, mo, y, h, mi, s, fr, half = int(m[1]), MONTH[m[2]], int(m[3]), *m.group(4, 5, 6, 7, 8)
    else:
        return None
    h = int(h)
    if half:
        h = h % 12 + (12 if half.lower() == "pm" else 0)
    if word in ("下午", "晚上") and h < 12:
        h += 12
    try:
        local = datetime(y, mo, d, h, int(mi), int(s or 0), int((fr or "0").ljust(6, "0")[:6]))
    except ValueError:
        return None
    tz = timezone(timedelta(minutes=offset)) if offset is not None else ZoneInfo(zone)
    whole = local.replace(tzinfo=tz)  # fold=0: the earlier one; in a gap the offset before it
    return (whole.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


@pytest.fixture(scope="module")
def real(spark):
    from colloquy.plans.data_queries import time_values

    d = "/root/testdata/sf0.01"
    stores = {r.external_store_id: r for r in spark.read.parquet(f"{d}/stores.parquet").collect()}
    values = time_values(spark, d)
    got = timestamps.to_instants(values, timestamps.store_sources(spark.read.parquet(f"{d}/stores.parquet")))
    return stores, got.select("source_id", "text", "epoch_ms", "time_status").distinct().collect()


def test_all_test_values(real):
    stores, rows = real
    wrong = [(r.text, stores[r.source_id].zone_id, r.epoch_ms, e) for r in rows if r.epoch_ms != (e := plain(r.text, stores[r.source_id].zone_id, stores[r.source_id].date_order))]
    assert not wrong, wrong[:20]
    assert len(rows) > 8000


CASES = [
    ("2026-03-08 02:30:00", "America/New_York", "MDY", "2026-03-08T07:30:00+00:00"),  # skipped
    ("2026-11-01 01:30:00", "America/New_York", "MDY", "2026-11-01T05:30:00+00:00"),  # twice
    ("03/04/2026 10:05:53 PM", "Asia/Shanghai", "DMY", "2026-04-03T14:05:53+00:00"),
    ("03/04/2026 10:05:53 PM", "Asia/Shanghai", "MDY", "2026-03-04T14:05:53+00:00"),
    ("13/05/2026 10:05", "Asia/Shanghai", "MDY", None),
    ("30.02.2026 10:05", "Asia/Shanghai", "DMY", None),
    ("2026-05-12 25:10:00", "Asia/Shanghai", "DMY", None),
    ("2026-05-12 24:00:00", "Asia/Shanghai", "DMY", None),
    ("2026年5月9日 下午1:05", "Asia/Shanghai", "DMY", "2026-05-09T05:05:00+00:00"),
    ("2026年05月09日13时05分", "Asia/Shanghai", "DMY", "2026-05-09T05:05:00+00:00"),
    ("2026年5月9日 凌晨12:05", "Asia/Shanghai", "DMY", "2026-05-08T16:05:00+00:00"),
    ("12:05", "Asia/Shanghai", "DMY", None),
    ("2026-05-09", "Asia/Shanghai", "DMY", None),
    ("2026-05-09 12:05:00 QQQ", "Asia/Shanghai", "DMY", None),
    ("2026-05-09 12:05:00 EDT", "Asia/Shanghai", "DMY", "2026-05-09T16:05:00+00:00"),
    ("2026-05-09 12:05:00.999999", "Asia/Shanghai", "DMY", "2026-05-09T04:05:00.999+00:00"),
    ("Jan 5, 2026 12:00:01 AM", "Europe/Berlin", "DMY", "2026-01-04T23:00:01+00:00"),
    ("", "Asia/Shanghai", "DMY", None),
    ("x" * 100_000, "Asia/Shanghai", "DMY", None),
    (None, "Asia/Shanghai", "DMY", None),
]


def test_cases(spark):
    values = spark.createDataFrame([(i, f"{z}|{o}", t) for i, (t, z, o, _) in enumerate(CASES)], "epoch int, source_id string, text string")
    keys = sorted({(f"{z}|{o}", z, o) for _, z, o, _ in CASES})
    sources = spark.createDataFrame(keys, "source_id string, zone_id string, declared string")
    got = {r["epoch"]: r for r in timestamps.to_instants(values, sources).collect()}
    for i, (t, _, _, want) in enumerate(CASES):
        ms = None if want is None else (datetime.fromisoformat(want) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)
        assert got[i].epoch_ms == ms, (t, got[i])


def test_unknown_order_is_fitted_or_ambiguous(spark):
    rows = [("a", f"{d:02d}/03/2026 10:00:00") for d in range(13, 29)] + [("a", "05/03/2026 10:00:00")]
    rows += [("b", f"03/{d:02d}/2026 10:00:00") for d in range(13, 29)] + [("b", "03/05/2026 10:00:00")]
    rows += [("c", "05/03/2026 10:00:00"), ("c", "07/07/2026 10:00:00"), (None, "2026-01-01 00:00:00"), (None, None)]
    values = spark.createDataFrame(rows, "source_id string, text string")
    sources = spark.createDataFrame([(s, "UTC", None) for s in "abc"], "source_id string, zone_id string, declared string")
    got = {(r.source_id, r.text): r for r in timestamps.to_instants(values, sources).collect()}
    march5 = 1772704800000
    assert got["a", "05/03/2026 10:00:00"].epoch_ms == march5
    assert got["b", "03/05/2026 10:00:00"].epoch_ms == march5
    assert got["c", "05/03/2026 10:00:00"].time_status == "ambiguous"
    assert got["c", "07/07/2026 10:00:00"].time_status == "local"
    assert got[None, "2026-01-01 00:00:00"].time_status == "unreadable"
    assert got[None, None].time_status == "null"


def test_empty(spark):
    values = spark.createDataFrame([], "source_id string, text string")
    sources = spark.createDataFrame([], "source_id string, zone_id string, declared string")
    assert timestamps.to_instants(values, sources).count() == 0


def test_em_weights():
    w, months = timestamps.fit_order([(13, 3, 20), (5, 3, 4)], None)
    assert w > 0.9 and months[2] == max(months)
    assert timestamps.fit_order([], None) == (0.5, [1 / 12] * 12)
    assert timestamps.fit_order([(13, 3, 20)], 0.0)[0] == 0.0


def test_other_columns_may_have_any_name(spark):
    rows = [("a", "2026-01-01 00:00:00", 1, "x", 5, "z")]
    values = spark.createDataFrame(rows, "source_id string, text string, _s int, _zone_id string, epoch_ms int, `a.b` string")
    sources = spark.createDataFrame([("a", "UTC", None)], "source_id string, zone_id string, declared string")
    got = timestamps.to_instants(values, sources)
    assert got.columns == ["source_id", "text", "_s", "_zone_id", "a.b", "epoch_ms", "time_status", "day_first_posterior"]
    assert tuple(got.first())[:6] == ("a", "2026-01-01 00:00:00", 1, "x", "z", 1767225600000)
