"""Caption files: SRT by column expressions, TTML by a parser in ``mapInArrow``."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: a clock time of SRT, and entities that cue text may hold
_SRT_CLOCK = r"^([0-9]{1,10}):([0-5]?[0-9]):([0-5]?[0-9])[,.]([0-9]{1,3})$"
_ENTITY = r"&(?!(amp|lt|gt|nbsp|lrm|rlm|#[0-9]+|#[xX][0-9A-Fa-f]+);)"


def srt_time(c: Column) -> Column:
    """H:MM:SS,mmm in milliseconds, null where unreadable; ',5' is half a second."""
    part = [F.regexp_extract(c, _SRT_CLOCK, i) for i in range(1, 5)]
    h, m, s = (p.cast("bigint") for p in part[:3])
    return F.when(c.rlike(_SRT_CLOCK), h * 3_600_000 + m * 60_000 + s * 1000 + F.rpad(part[3], 3, "0").cast("bigint"))


def srt_text(c: Column) -> Column:
    """b, i and u stay; font tags and {\\...} blocks go; the rest is escaped, known entities as they are."""
    c = F.regexp_replace(c, r"\{\\[^}]*\}", "")
    c = F.regexp_replace(c, r"(?i)<\s*(/?font|font\s[^>]{0,64})\s*>", "")
    for tag in "biu":
        c = F.regexp_replace(c, rf"(?i)<\s*(/?){tag}\s*>", f"\x01$1{tag}\x02")
    c = F.replace(F.replace(F.regexp_replace(c, _ENTITY, "&amp;"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.translate(c, "\x01\x02", "<>")


def srt_cues(files: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, cue, start_ms, end_ms, text) of each file.  A file with an unreadable timing line, or with none, gives one row of nulls."""
    body = F.regexp_replace(F.regexp_replace(body_col, "\r\n?", "\n"), r"^\x{FEFF}", "")
    blocks = F.filter(F.split(body, r"\n[ \t]*(?=\n)"), lambda b: b.rlike(r"\S"))

    def cue(b):
        lines = F.split(F.regexp_replace(b, r"^\s+|\s+$", ""), "\n")
        lines = F.when(F.get(lines, F.lit(0)).rlike(r"^\s*[0-9]+\s*$"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
        timing = F.split(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), "-->")
        end = F.regexp_extract(F.coalesce(F.get(timing, F.lit(1)), F.lit("")), r"^\s*(\S+)", 1)
        text = F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.rtrim(x)), "\n")
        return F.struct(srt_time(F.trim(F.get(timing, F.lit(0)))).alias("start_ms"), srt_time(end).alias("end_ms"), srt_text(text).alias("text"))

    cues = files.select(id_col, F.transform(blocks, cue).alias("c"))
    bad = (F.size("c") == 0) | F.exists("c", lambda x: x["start_ms"].isNull() | x["end_ms"].isNull())
    kept = F.filter("c", lambda x: (x["end_ms"] > x["start_ms"]) & x["text"].rlike(r"\S"))
    nothing = F.array(F.lit(None).cast("struct<start_ms:bigint,end_ms:bigint,text:string>"))
    # a stable sort by start: the place in the file is the second key
    placed = F.when(bad, nothing).otherwise(F.transform(F.array_sort(F.transform(kept, lambda x, i: F.struct(x["start_ms"].alias("s"), i.alias("i"), x.alias("x")))), lambda y: y["x"]))
    return cues.select(id_col, F.posexplode(placed).alias("cue", "x")).select(id_col, F.col("cue").cast("bigint"), "x.*")


# fixed values: namespaces of TTML
_TT, _PARAM, _STYLE, _XML = "{http://www.w3.org/ns/ttml}", "{http://www.w3.org/ns/ttml#parameter}", "{http://www.w3.org/ns/ttml#styling}", "{http://www.w3.org/XML/1998/namespace}"
MAX_DEPTH, STYLE_DEPTH = 64, 8
_CLOCK = re.compile(r"([0-9]{2,10}):([0-5][0-9]):([0-5][0-9])(?:\.([0-9]+)|:([0-9]{2,10})(?:\.[0-9]+)?)?")
_OFFSET = re.compile(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ms|h|m|s|f|t)")


class CaptionError(ValueError):
    """A caption file that can't be read."""


def _nearest(x: Fraction) -> int:
    return (2 * x.numerator + x.denominator) // (2 * x.denominator)


def ttml_time(text: str, frame_rate: Fraction = Fraction(30), tick_rate: int = 1) -> int:
    """A clock time, one with frames, or an offset, in whole milliseconds; exact until the last rounding."""
    text = text.strip()
    if m := _CLOCK.fullmatch(text):
        h, mi, s, fraction, frames = m.groups()
        ms = int(h) * 3_600_000 + int(mi) * 60_000 + int(s) * 1000
        return ms + (_nearest(Fraction(f"0.{fraction}") * 1000) if fraction else 0) + (_nearest(int(frames) * 1000 / frame_rate) if frames else 0)
    if m := _OFFSET.fullmatch(text):
        n = Fraction(("0" + m[1]).rstrip("."))
        return _nearest({"h": n * 3_600_000, "m": n * 60_000, "s": n * 1000, "ms": n, "f": n * 1000 / frame_rate, "t": n * 1000 / tick_rate}[m[2]])
    raise CaptionError(f"the time {text!r} can't be read")


def ttml_cues(body: str) -> list[tuple[int, int, str]]:
    """(start, end, text) in milliseconds by start.  Times count from the parent's start; a missing end is the parent's."""
    if "<!DOCTYPE" in body or "<!ENTITY" in body:
        raise CaptionError("document types are refused")
    try:
        root = ET.fromstring(body)
    except ET.ParseError as e:
        raise CaptionError(str(e)) from e
    if root.tag != f"{_TT}tt":
        raise CaptionError("not a TTML document")
    if root.get(f"{_PARAM}timeBase", "media") != "media":
        raise CaptionError("only media time can be read")
    multiplier = (root.get(f"{_PARAM}frameRateMultiplier") or "1 1").split()
    own_rate = root.get(f"{_PARAM}frameRate")
    rate = Fraction(int(own_rate or 30)) * Fraction(int(multiplier[0]), int(multiplier[1]))
    if rate <= 0:
        raise CaptionError("the frame rate is not positive")
    ticks = int(root.get(f"{_PARAM}tickRate") or (_nearest(rate) if own_rate else 1))
    styles = {s.get(f"{_XML}id"): s for s in root.iter(f"{_TT}style")}

    def looks(e, depth=0) -> set[str]:
        out: set[str] = set()
        if depth < STYLE_DEPTH:
            for ref in (e.get("style") or "").split():
                out |= looks(styles[ref], depth + 1) if ref in styles else set()
        for name, value, tag in (("fontWeight", "bold", "b"), ("fontStyle", "italic", "i"), ("textDecoration", "underline", "u")):
            given = e.get(_STYLE + name)
            if given is not None:
                out = out | {tag} if given == value else out - {tag}
        return out

    def escaped(s: str) -> str:
        return re.sub(r"\s+", " ", s or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def content(e, depth) -> str:
        if depth > MAX_DEPTH:
            raise CaptionError("elements are nested too deep")
        if e.tag == f"{_TT}br":
            inner = "\n"
        else:
            inner = escaped(e.text) + "".join((content(c, depth + 1) if c.tag in (f"{_TT}span", f"{_TT}br") else "") + escaped(c.tail) for c in e)
            if inner.strip():
                for tag in sorted(looks(e)):
                    inner = f"<{tag}>{inner}</{tag}>"
        return inner

    def timed(e, start, end, depth):
        if depth > MAX_DEPTH:
            raise CaptionError("elements are nested too deep")
        begin = start + (ttml_time(e.get("begin"), rate, ticks) if e.get("begin") else 0)
        stops = [x for x in (start + ttml_time(e.get("end"), rate, ticks) if e.get("end") else None, begin + ttml_time(e.get("dur"), rate, ticks) if e.get("dur") else None, end) if x is not None]
        stop = min(stops) if stops else None
        if e.tag == f"{_TT}p":
            text = "\n".join(line.strip() for line in content(e, depth).split("\n")).strip()
            if text and stop is not None and stop > begin:
                yield begin, stop, text
            return
        for c in e:
            if c.tag in (f"{_TT}body", f"{_TT}div", f"{_TT}p"):
                yield from timed(c, begin, stop, depth + 1)

    return sorted(timed(root, 0, None, 0), key=lambda c: c[0])


def ttml_files(files: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, cue, start_ms, end_ms, text); a file that can't be read gives one row of nulls."""
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                try:
                    found = [(k, *c) for k, c in enumerate(ttml_cues(body or ""))]
                except (CaptionError, ValueError):
                    found = [(0, None, None, None)]
                at += [i] * len(found)
                rows += found
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], [id_col, "cue", "start_ms", "end_ms", "text"])

    return files.select(id_col, F.col(body_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, cue long, start_ms long, end_ms long, text string")


def caption_kind(body: Column) -> Column:
    """webvtt, ttml or srt by the first characters; null for none of them."""
    head = F.regexp_replace(body, r"^\x{FEFF}?\s*", "")
    return F.when(head.rlike(r"^WEBVTT($|[ \t\n\r])"), "webvtt").when(head.rlike(r"^(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<([a-zA-Z0-9]+:)?tt[\s>]"), "ttml").when(head.rlike(r"^([0-9]+\s*\n)?[0-9:]+[,.][0-9]{1,3}\s*-->"), "srt")
