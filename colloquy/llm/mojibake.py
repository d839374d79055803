"""Text decoded with the wrong character encoding: find the spans, restore the original.

Method: for every pair (true encoding, wrong encoding) the garbled sequence of each character of an
inventory is computed once a worker and put into one Aho-Corasick automaton.  A text is scanned
once; adjacent matches of one pair join to spans, a span needs the evidence of its pair (below),
and only the span is encoded and decoded again, so text that is right stays as it is.  Spans are
searched again in the restored text, as often as it was garbled.

Evidence: three or more garbled characters that stand for one character are enough alone; a pair
whose sequences have two characters (a legacy two-byte encoding read as one-byte) needs two
adjacent matches, as accented capitals side by side are ordinary text ("PROMOÇÃO").  UTF-8 read as
a two-byte encoding is matched by lead-byte pairs, and the restored span must read better than the
garbled one.

Lost characters (U+FFFD, question marks, stray bytes) are no evidence.  Null and empty texts are
not garbled.  Whole texts are scanned; nothing is sampled or cut.
"""

from __future__ import annotations

import codecs
import re
from bisect import bisect, bisect_left
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings that a text may be read in by mistake, one byte a character.
ONE_BYTE = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "cp1250", "mac_roman", "koi8_r", "cp866", "iso8859_15")
# Letters and signs outside ASCII that ordinary text has; hanzi are those of GB2312.
TYPOGRAPHY = "‘’“”„‚–—…•·‰‹›«»€™®©°±²³½¼¾×÷§¶¡¿№→←↑↓★☆●○■□▲△◆◇※℃～￥"
LATIN = "".join(chr(i) for i in range(0xA0, 0x180) if i != 0xAD)
#: Kana, full-width forms and emoji; their UTF-8 sequences have three or four characters.
KANA = "".join(map(chr, [*range(0x3041, 0x3097), *range(0x30A1, 0x30FF), *range(0xFF01, 0xFF5F)]))
EMOJI = "".join(map(chr, [*range(0x2600, 0x27C0), 0xFE0F, 0x200D, *range(0x1F300, 0x1F650), *range(0x1F680, 0x1F700), *range(0x1F900, 0x1FA00), *range(0x1FA70, 0x1FB00)]))


def _table(name: str) -> list[str]:
    """Characters of the 256 bytes; bytes without character count as their C1 control."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache(maxsize=1)
def hanzi() -> tuple[frozenset, frozenset]:
    """(common, all) hanzi of GB2312: the first level is sorted by sound, the second rarer."""
    common, every = set(), set()
    for lead in range(0xB0, 0xF8):
        for trail in range(0xA1, 0xFF):
            try:
                c = bytes([lead, trail]).decode("gb2312")
            except UnicodeDecodeError:
                continue
            every.add(c)
            if lead < 0xD8:
                common.add(c)
    return frozenset(common), frozenset(every)


def _hangul() -> str:
    """The syllables of the Korean standard, by its rows."""
    return "".join(bytes([lead, trail]).decode("euc_kr") for lead in range(0xB0, 0xC9) for trail in range(0xA1, 0xFF))


def _cjk_marks() -> str:
    out = []
    for lead in (0xA1, 0xA3):
        for trail in range(0xA1, 0xFF):
            try:
                out.append(bytes([lead, trail]).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    return "".join(out)


PLAIN = frozenset(map(chr, range(32, 127))) | frozenset("\n\r\t") | frozenset("，。？！；：、（）～“”‘’《》【】…—·　")


def odd(text: str) -> float:
    """Share of characters that ordinary text of the corpus' languages rarely has."""
    common, every = hanzi()
    n = sum(1 if c in common or c in PLAIN else 0.7 if c in every else 0 for c in text)
    return 1 - n / max(1, len(text))


class Codec:
    """A one-byte encoding in which every byte has a character.  cp1252 and latin-1 are one family:
    text read in either may have the marks of the one and the C1 controls of the other."""

    def __init__(self, name: str):
        self.chars = _table(name)
        self.bytes = {c: b for b, c in reversed(list(enumerate(self.chars)))}
        if name == "cp1252":
            self.bytes = {chr(b): b for b in range(0x80, 0xA0)} | self.bytes

    def decode(self, data: bytes) -> str:
        return "".join(map(self.chars.__getitem__, data))

    def encode(self, text: str) -> bytes | None:
        try:
            return bytes(map(self.bytes.__getitem__, text))
        except KeyError:
            return None


@lru_cache(maxsize=1)
def automaton():
    """(automaton of the one-byte pairs, codecs, patterns of the two-byte pairs).

    The words' values are (pairs, length).  The sequences of UTF-8 read as a two-byte encoding are
    all products of two sets, (lead byte, byte) and (byte, lead byte of the next character); they
    are matched as a two-state automaton over the two sets instead of half a million words.
    """
    _, every = hanzi()
    marks = _cjk_marks()
    known: dict[str, set[tuple[str, str]]] = {}
    tables = {name: Codec(name) for name in ONE_BYTE if name != "latin-1"}
    for name in ONE_BYTE:
        family = "cp1252" if name == "latin-1" else name
        chars = _table(name)
        # The encoding's own characters are what a text garbled twice has been through.
        for c in (*every, *marks, *LATIN, *TYPOGRAPHY, *KANA, *_hangul(), *EMOJI, *chars[128:], *map(chr, range(0x80, 0xA0))):
            known.setdefault("".join(map(chars.__getitem__, c.encode("utf-8"))), set()).add(("utf-8", family))
    for name in ONE_BYTE:
        chars = _table(name)
        for c in (*every, *marks):
            g = "".join(map(chars.__getitem__, c.encode("gb18030")))
            if len(g) == 2 and not g[0].isascii() and not g[1].isascii():
                known.setdefault(g, set()).add(("gb18030", "cp1252" if name == "latin-1" else name))
    a = ahocorasick.Automaton()
    for g, pairs in known.items():
        if len(g) > 1:
            a.add_word(g, (tuple(sorted(pairs)), len(g)))
    a.make_automaton()
    leads, tails, patterns = [0xC2, 0xC3, *range(0xE2, 0xEA), 0xEF], range(0x80, 0xC0), {}
    for name in ("gb18030", "big5hkscs"):
        first = {c for x in range(0xE2, 0xF0) for y in tails if (c := _one(bytes([x, y]), name))}
        second = {c for x in tails for y in leads if (c := _one(bytes([x, y]), name))}
        patterns["utf-8", name] = re.compile(f"[{re.escape(''.join(sorted(first)))}][{re.escape(''.join(sorted(second)))}]")
    # GB18030 read as Big5 has one character for one; runs of such rare characters are tried.
    usual = "".join(sorted(every | set(marks) | set(LATIN) | set(TYPOGRAPHY)))
    patterns["gb18030", "big5hkscs"] = re.compile(rf"[^\x00-\xff\ufffd\u0370-\u04ff{re.escape(usual)}]")
    return a, tables, patterns


def _one(data: bytes, name: str) -> str:
    try:
        c = data.decode(name)
    except UnicodeDecodeError:
        return ""
    return c if len(c) == 1 else ""


_RUN = re.compile(r"[^\x00-\x7f]+")
_CLAUSE = re.compile(r"[^\x00-\x7f，。！？；：、～]+")


def _again(text: str, true: str, wrong: str, tables: dict) -> tuple[str, int, int]:
    """(restored, good, bad) of a span: characters decoded well, and signs of loss."""
    if wrong in tables:
        data = tables[wrong].encode(text)
        if data is None:
            return text, 0, 1
    else:
        data = text.replace("�", "?").encode(wrong, "replace")
    out = data.decode(true, "replace")
    bad = out.count("�")
    return out, len(out) - bad - data.count(b"?"), bad


def spans(text: str, only: set | None = None) -> list[tuple[int, int, str, tuple]]:
    """(start, end, restored, pair) of the garbled spans of a text, in order, not overlapping.

    only: the pairs to look for; all by default.
    """
    if not text or text.isascii():
        return []
    a, tables, patterns = automaton()
    by: dict = {}
    for end, (pairs, n) in a.iter(text):
        for pair in pairs:
            if only is None or pair in only:
                by.setdefault(pair, []).append((end + 1 - n, end + 1))
    found = []
    for pair, got in by.items():
        found += [((0, s - e, odd(r)), s, e, r, pair) for s, e, r in _one_byte_spans(text, *pair, got, tables)]
    for pair, pattern in patterns.items():
        if only is None or pair in only:
            got = [m.span() for m in pattern.finditer(text)]
            if got and (pair[0] == "utf-8" or len(got) >= 2):
                found += [((1, odd(r), s - e), s, e, r, pair) for s, e, r in _two_byte_spans(text, *pair, got, tables)]
    out: list[tuple[int, int, str, tuple]] = []
    for _, s, e, r, pair in sorted(found):
        # In order and apart, so that only the neighbours can overlap.
        k = bisect(out, s, key=lambda x: x[0])
        if (k == 0 or out[k - 1][1] <= s) and (k == len(out) or e <= out[k][0]):
            out.insert(k, (s, e, r, pair))
    return out


def _one_byte_spans(text, true, wrong, got, tables):
    out = []
    joined: list[list[int]] = []
    for s, e in sorted(got):
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    for s, e in joined:
        restored, good, bad = _again(text[s:e], true, wrong, tables)
        if true == "gb18030":
            # Two hanzi at least, mostly common ones, and no letters around: accents inside a word,
            # and words of another alphabet, are ordinary.
            near = text[max(0, s - 1) : s] + text[e : e + 1]
            if text[s:e].isalpha() and text[s + 1 : e].islower():
                continue
            if e - s < 4 or bad or odd(restored) > 0.2 or e - s < 6 and any(c.isalpha() and ord(c) < 0x2000 for c in near):
                continue
        elif bad or not good:
            continue
        out.append((s, e, restored))
    return out


def _two_byte_spans(text, true, wrong, got, tables):
    out = []
    starts = [s for s, _ in got]
    for run in (_RUN if true == "utf-8" else _CLAUSE).finditer(text):
        inside = [x for x in got[bisect_left(starts, run.start()) : bisect_left(starts, run.end())] if x[1] <= run.end()]
        if not inside or len(inside) < 2 and true != "utf-8":
            continue
        s = inside[0][0] if true == "utf-8" else run.start()
        # The end of the span: the run's end, else near the last match, before right text.
        ends = [run.end(), *(min(run.end(), inside[-1][1] + k) for k in (2, 1, 0))] if true == "utf-8" else [run.end()]
        for end in dict.fromkeys(ends):
            piece = text[s:end]
            if "\ufffd" in piece and true == "utf-8":
                # After a lost character the bytes may be out of step; each part starts anew.
                parts = [_again(x, true, wrong, tables) for x in piece.split("\ufffd")]
                restored = "\ufffd".join(p[0] for p in parts)
                good, bad = sum(p[1] for p in parts), sum(p[2] for p in parts)
            else:
                restored, good, bad = _again(piece, true, wrong, tables)
            clean = restored.replace("\ufffd", "").replace("?", "")
            better = good >= (2 if true == "utf-8" else 3) and (true == "utf-8" or odd(clean) < 0.12) and bad <= max(1, 0.34 * good) and odd(clean) + 0.2 < odd(piece.replace("\ufffd", ""))
            lossy = "\ufffd" in piece and good >= 2 and bad <= good and odd(clean) < 0.1 and odd(piece.replace("\ufffd", "")) > 0.3
            twice = true == "utf-8" and len(inside) >= 2 and good >= 3 and bad <= 0.5 * good
            if better or twice or lossy or true == "utf-8" and len(inside) >= 3:
                out.append((s, end, restored))
                break
    return out


def restore(text: str | None) -> tuple[str | None, bool]:
    """(text with its garbled spans restored, whether there were any)."""
    if not text:
        return text, False
    now = spans(text)
    if not now:
        return text, False
    while now:
        before, parts, at = len(text), [], 0
        for s, e, r, _pair in now:
            parts += [text[at:s], r]
            at = e
        text = "".join([*parts, text[at:]])
        # What is left was garbled more than once in the same way; each restoring makes it shorter.
        now = spans(text, {x[3] for x in now if x[3][0] == "utf-8"}) if len(text) < before else []
    return text, True


def read_bytes(data: bytes | None) -> tuple[str | None, str]:
    """(text, encoding) of raw data: by its mark, else UTF-8 if it is valid, else the one of GB18030,
    UTF-16 and Big5 that loses least and reads best; with stray bytes UTF-8 may still win."""
    if data is None:
        return None, "none"
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), name
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    best = None
    for name in ("utf-8", "gb18030", "utf-16-le", "utf-16-be", "big5"):
        text = data.decode(name, "replace")
        loss = text.count("\ufffd") / max(1, len(text)) * 4 + odd(text)
        if name == "gb18030" and loss < 0.1:
            return text, name
        if best is None or loss < best[0]:
            best = (loss, text, name)
    return best[1], best[2]


def records(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_kind, record_key, text, data): one row for each message and raw export."""
    none = F.lit(None)
    m = messages.select(F.lit("message").alias("record_kind"), F.col("message_id").cast("string").alias("record_key"), F.col("message_content").alias("text"), none.cast("binary").alias("data"))
    s = sources.select(F.lit("text_source").alias("record_kind"), F.col("source_name").alias("record_key"), none.cast("string").alias("text"), F.col("data"))
    # Text of ASCII characters only can't be garbled, so it needn't leave the JVM.
    return m.where(F.col("text").rlike(r"[^\x00-\x7f]")).unionByName(s)


def repair(df: DataFrame) -> DataFrame:
    """(record_kind, record_key, restored) of the garbled ones of ``records``."""

    def work(batches):
        for pdf in batches:
            keep = []
            for kind, key, text, data in zip(pdf["record_kind"], pdf["record_key"], pdf["text"], pdf["data"]):
                if kind == "text_source":
                    text, _ = read_bytes(data)
                fixed, was = restore(text)
                if was:
                    keep.append((kind, key, fixed))
            yield pd.DataFrame(keep, columns=["record_kind", "record_key", "restored"])

    return df.mapInPandas(work, "record_kind string, record_key string, restored string")


def found(df: DataFrame) -> DataFrame:
    """(record_kind, record_key) of the garbled ones of ``records``."""

    def work(batches):
        for pdf in batches:
            keep = []
            for kind, key, text, data in zip(pdf["record_kind"], pdf["record_key"], pdf["text"], pdf["data"]):
                if kind == "text_source":
                    text, _ = read_bytes(data)
                if text and spans(text):
                    keep.append((kind, key))
            yield pd.DataFrame(keep, columns=["record_kind", "record_key"])

    return df.mapInPandas(work, "record_kind string, record_key string")
