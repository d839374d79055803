"""Raw chat exports to messages, sessions and parse errors.

An export is decoded by a vectorized function, cut into sessions at its start marks by array
expressions, and from there on every line is a row: what a line is follows from its pattern and from
counts of marks and headers before it in its session.  So an export of any number of sessions is
spread over tasks, and each of the outputs, tagged by ``kind``, is an aggregate of the lines; a query
that reads one kind plans only that.  Sessions are numbered within their export and carry its name,
so they never collide.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import decode

# The marks of the export format.
START, END = "以下为一通会话", "会话结束"
HEADER = r"^\s*(.+?)\s+(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})\s*$"
END_TIME = r"会话结束_时间\s*[:：]\s*(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})"
LINK = r"(?i)(?:https?://|www\.)\S+|\.(?:jpe?g|png|gif|webp|bmp)(?:[?#]\S*)?\b"
SERVICE_WORDS = ("客服",)
FORMAT = "yyyy-MM-dd HH:mm:ss"

_BLANK = r"(?U)^[\s\x1c-\x1f]*$"
_KEY = ["source_file", "session_no"]
SCHEMA = "kind string, source_file string, line_number int, session_no int, sender string, sender_type string, at string, end_at string, content string, content_type string, messages int, customer_messages int, service_messages int, error_type string"


def _moment(found: Column) -> Column:
    """A time text with a space for 'T', null if there is no such time."""
    t = F.translate(found, "T", " ")
    return F.when(F.try_to_timestamp(t, F.lit(FORMAT)).isNotNull() & ~t.startswith("0000"), t)


def _decoded(data: Column) -> Column:
    def work(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(None if d is None else bytes(d)) for d in values], columns=["text", "encoding"])

    return F.pandas_udf(work, "struct<text:string,encoding:string>")(data)


def _lines(exports: DataFrame) -> DataFrame:
    """One row a line: its place, session, total lines of the export and what it is.

    session_no counts the start marks so far; 0 is what stands before the first.
    """
    text_lines = F.split("text", "\r\n|\r|\n", -1)
    d = exports.where("text is not null").select("source_file", text_lines.alias("lines"))
    marks = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at("lines", i.cast("int")).contains(START))
    d = d.withColumn("cuts", F.concat(F.array(F.lit(1)), marks, F.array(F.size("lines") + 1)))
    part = lambda i: F.struct(i.alias("session_no"), F.element_at("cuts", i + 1).alias("first"), F.slice("lines", F.element_at("cuts", i + 1), F.element_at("cuts", i + 2) - F.element_at("cuts", i + 1)).alias("lines"))
    d = d.select("source_file", F.size("lines").alias("total"), F.inline(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), part)))
    d = d.select("source_file", "session_no", "total", "first", F.posexplode("lines").alias("at_line", "raw"))
    d = d.select(*_KEY, "total", (F.col("first") + F.col("at_line")).alias("n"), F.regexp_replace("raw", "\t+$", "").alias("line"))
    header = ~F.col("line").contains(START) & ~F.col("line").contains(END) & F.col("line").rlike(HEADER)
    d = d.withColumns(
        {
            "mark": F.when(F.col("line").contains(START), "start").when(F.col("line").contains(END), "end"),
            "sender": F.when(header, F.regexp_extract("line", HEADER, 1)),
            "time": F.when(header, _moment(F.regexp_extract("line", HEADER, 2))),
            "blank": F.col("line").rlike(_BLANK),
        }
    )
    before = Window.partitionBy(*_KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*_KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("open", (F.col("session_no") > 0) & (F.coalesce(F.count_if(F.col("mark") == "end").over(before), F.lit(0)) == 0))
    return d.withColumn("head", F.count_if(F.col("open") & F.col("time").isNotNull()).over(through))


def _message_rows(lines: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """One row a message; the line of its header, and that line itself, for the errors."""
    own = lines.where(F.col("open") & (F.col("head") > 0) & F.col("mark").isNull())
    is_head = F.col("time").isNotNull()
    only = lambda c: F.max(F.when(is_head, F.col(c))).alias(c)
    body = F.transform(F.array_sort(F.collect_list(F.when(~is_head, F.struct("n", "line")))), lambda x: x["line"])  # the lines of one message
    g = own.groupBy(*_KEY, "head").agg(only("n"), only("sender"), only("time"), only("line"), F.array_join(body, "\n").alias("body"))
    inner = F.regexp_replace(F.regexp_replace("body", r"(?U)^[\s\x1c-\x1f]*\n", ""), r"(?U)\n[\s\x1c-\x1f]*$", "")
    content = F.when(F.col("body").rlike(_BLANK), "").otherwise(inner)
    service = F.lit(False)
    for w in words:
        service = service | F.col("sender").contains(w)
    return g.select(*_KEY, "n", F.trim("sender").alias("sender"), F.when(service, "service").otherwise("customer").alias("sender_type"), F.col("time").alias("at"), content.alias("content"), "line")


def _session_rows(lines: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """One row a session: counts, times, the line that closes it, and whether an end mark does."""
    service = F.lit(False)
    for w in words:
        service = service | F.col("sender").contains(w)
    headed = F.col("open") & F.col("time").isNotNull()
    ending = F.col("open") & (F.col("mark") == "end")
    told = _moment(F.regexp_extract("line", END_TIME, 1))
    g = lines.where("session_no > 0").groupBy(*_KEY).agg(
        F.count_if(headed).cast("int").alias("messages"),
        F.count_if(headed & service).cast("int").alias("service_messages"),
        F.min(F.when(headed, F.col("time"))).alias("at"),
        F.max(F.when(headed, F.col("time"))).alias("last"),
        F.max(F.when(ending, told)).alias("told"),
        F.max(F.when(ending, F.col("n"))).alias("end_line"),
        # Without an end mark the next start closes the session, or the end of the export.
        F.least(F.max("n") + 1, F.max("total")).alias("closed"),
    )
    return g.withColumns({"end_at": F.coalesce("told", "last"), "customer_messages": F.col("messages") - F.col("service_messages")})


def parse(sources: DataFrame, name: str = "source_name", data: str = "data", service_words: tuple[str, ...] = SERVICE_WORDS) -> DataFrame:
    """All rows of the exports, tagged by ``kind`` ('message', 'session' or 'error').

    Null data gives an 'unreadable' error, empty data and empty tables nothing.  A message without
    content is kept, with an error; a header of no existing time is an error and part of the message
    before it.  Exports of one name are read as one more session each of that name's numbers, so
    names should be unique.
    """
    exports = sources.select(F.col(name).alias("source_file"), _decoded(F.col(data)).alias("d")).select("source_file", "d.text", "d.encoding")
    lines = _lines(exports)
    told = _message_rows(lines, service_words)
    closed = _session_rows(lines, service_words)
    kinds = [f.split() for f in SCHEMA.split(", ")]

    def rows(df: DataFrame, kind: str, **values: Column) -> DataFrame:
        values["kind"] = F.lit(kind)
        own = {c: F.col(c) for c in _KEY if c in df.columns} | values
        return df.select(*[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds])

    col = F.col
    link = F.when(col("content").rlike(LINK), "image_or_link").otherwise("text")
    messages_ = rows(told, "message", line_number=col("n"), sender=col("sender"), sender_type=col("sender_type"), at=col("at"), content=col("content"), content_type=link)
    sessions_ = rows(closed, "session", at=col("at"), end_at=col("end_at"), messages=col("messages"), customer_messages=col("customer_messages"), service_messages=col("service_messages"))

    is_end = F.coalesce(col("mark") == "end", F.lit(False))
    plain, header = col("mark").isNull(), col("sender").isNotNull()
    wrong = (
        F.when(is_end & ~col("open"), "end_without_start")
        .when(is_end & _moment(F.regexp_extract("line", END_TIME, 1)).isNull(), "invalid_session_end_time")
        .when(plain & ~col("open") & ~col("blank"), "line_outside_session")
        .when(plain & col("open") & header & col("time").isNull(), "invalid_message_time")
        .when(plain & col("open") & ~header & (col("head") == 0) & ~col("blank"), "content_without_header")
    )
    number = F.when(col("open"), col("session_no"))
    errors_ = rows(lines.withColumn("wrong", wrong).where("wrong is not null"), "error", session_no=number, line_number=col("n"), content=col("line"), error_type=col("wrong"))
    empty = rows(told.where("content = ''"), "error", line_number=col("n"), content=col("line"), error_type=F.lit("missing_message_content"))
    at_close = F.array_compact(F.array(F.when(col("end_line").isNull(), F.lit("missing_session_end")), F.when(col("messages") == 0, F.lit("empty_session"))))
    ends = rows(closed.select("*", F.explode(at_close).alias("wrong")), "error", line_number=F.coalesce("end_line", "closed"), content=F.lit(""), error_type=col("wrong"))
    unread = F.when(col("text").isNull(), "unreadable").when(col("encoding") == "utf-8-replace", "decode_replacement")
    whole = rows(exports.withColumn("wrong", unread).where("wrong is not null"), "error", line_number=F.lit(0), content=F.lit(""), error_type=col("wrong"))
    out = messages_
    for part in (sessions_, errors_, empty, ends, whole):
        out = out.unionByName(part)
    return out


def messages(parsed: DataFrame) -> DataFrame:
    sid = F.concat_ws("#", "source_file", F.format_string("%09d", "session_no"))
    return parsed.where("kind = 'message'").select(sid.alias("session_id"), "source_file", "line_number", "sender", "sender_type", F.col("at").alias("message_time"), F.col("content").alias("message_content"), "content_type")


def sessions(parsed: DataFrame) -> DataFrame:
    sid = F.concat_ws("#", "source_file", F.format_string("%09d", "session_no"))
    return parsed.where("kind = 'session'").select(sid.alias("session_id"), "source_file", F.col("messages").alias("message_count"), F.col("customer_messages").alias("customer_message_count"), F.col("service_messages").alias("service_message_count"), F.col("at").alias("start_time"), F.col("end_at").alias("end_time"))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'error'").select("source_file", "line_number", "session_no", "error_type", F.col("content").alias("raw_line"))


def snippets(files: DataFrame, name: str = "source_name", data: str = "data") -> DataFrame:
    """(source_file, original_group, original_key, n, content) of script files.

    'key,n = value' begins a snippet, following lines belong to it; a line followed by such a line
    is the heading of a group.
    """
    entry = re.compile(r"^\s*([^=\s,][^=,]*)\s*,\s*(\d+)\s*=\s*(.*)$")

    def work(batches):
        for pdf in batches:
            out = []
            for file, raw in zip(pdf[name], pdf[data]):
                text, _ = decode(None if raw is None else bytes(raw))
                lines = [x.rstrip("\r") for x in (text or "").split("\n")]
                filled = [i for i, x in enumerate(lines) if x.strip()]
                after = dict(zip(filled, filled[1:]))
                group, current = "", None
                for i, line in enumerate(lines):
                    if m := entry.match(line):
                        current = [file, group, m[1].strip(), int(m[2]), m[3].strip()]
                        out.append(current)
                    elif line.strip() and i in after and entry.match(lines[after[i]]) and (current is None or not lines[i - 1].strip()):
                        group, current = line.strip(), None
                    elif current is not None:
                        current[4] = f"{current[4]}\n{line}".strip("\n") if line.strip() else current[4]
            yield pd.DataFrame(out, columns=["source_file", "original_group", "original_key", "n", "content"])

    return files.select(name, data).mapInPandas(work, "source_file string, original_group string, original_key string, n int, content string")
