"""Money on lines with boxes: by words where they have boxes, else by the place of the match in the line.

Lines are rows with `text`, `box` (struct<x,y,w,h>) and `words` (array of struct<text,x,y,w,h>). Hits are structs (cents, x, y, w, h) in the
order of the line; null words count as none, a null box gives hits without one. Lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.money import LIMIT, parse_cents
from tallyweave.operators.extract import LENIENT_MONEY, MONEY

HIT = "struct<cents:bigint,x:double,y:double,w:double,h:double>"
WORDS = "array<struct<text:string,x:double,y:double,w:double,h:double>>"
#: Stands before and after a match while a line is cut at its matches.
MARK = "\x01"


def bound(value: Column, body) -> Column:
    """body of a value that is worked out once: lambdas would work it out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut(text: Column, pattern: str) -> Column:
    """The text cut before and after each match: every second piece is one."""
    return F.split(F.regexp_replace(F.translate(text, MARK, " "), f"({pattern})", f"{MARK}$1{MARK}"), MARK)


def or_else(other: Column):
    return lambda hits: F.when(F.size(hits) > 0, hits).otherwise(other)


def hit(cents: Column, box: Column) -> Column:
    return F.struct(cents.alias("cents"), *[box[c].cast("double").alias(c) for c in "xywh"]).cast(HIT)


def slice_box(box: Column, length: Column, start: Column, end: Column) -> Column:
    """The part of a line's box that characters from start to end take, all being equally wide; a box without width stays whole."""
    n = F.greatest(F.lit(1), length)
    x = box["x"] + box["w"] * F.greatest(F.lit(0), start) / n
    w = F.least(box["w"] * F.greatest(F.lit(1), end - start) / n, box["x"] + box["w"] - x)
    part = F.struct(x.alias("x"), box["y"].alias("y"), w.alias("w"), box["h"].alias("h"))
    whole = F.struct(*[box[c].cast("double").alias(c) for c in "xywh"])
    return F.when(box["w"] <= 0, whole).otherwise(part.cast("struct<x:double,y:double,w:double,h:double>"))


def placed(text: Column, pattern: str) -> Column:
    """(raw, start) of all matches: the text is cut before and after each, and starts are lengths of what comes before."""
    before = lambda pieces, i: F.length(F.array_join(F.slice(pieces, F.lit(1), i), ""))
    each = lambda pieces: F.transform(pieces, lambda p, i: F.struct(p.alias("raw"), before(pieces, i).alias("start"), (i % 2 == 1).alias("match")))
    return F.filter(bound(cut(text, pattern), each), lambda p: p["match"])


def hits_of_line(text: Column, box: Column, width: Column, pattern: str, limit: int = LIMIT) -> Column:
    """Hits with their parts of the line's box; width is the length of the line as printed."""
    found = F.transform(placed(text, pattern), lambda m: hit(parse_cents(m["raw"], limit=limit), slice_box(box, width, m["start"], m["start"] + F.length(m["raw"]))))
    return F.filter(found, lambda h: h["cents"].isNotNull())


def blanked(text: Column) -> Column:
    """Dates and times made blanks of the same length: by pieces, as the blanks depend on the match."""
    for pattern in (r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\b"):
        text = F.array_join(F.transform(cut(text, pattern), lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")
    return text


def money_hits(text: Column, box: Column, words: Column, lenient: bool = False, limit: int = LIMIT) -> Column:
    """The first money of each word; if no word has any, all money of the line; of the line with blanks about separators closed;
    if lenient, any numbers but dates and times. Amounts over the limit are none."""
    width = F.length(text)
    first = F.transform(F.coalesce(words.cast(WORDS), F.array().cast(WORDS)), lambda w: hit(parse_cents(F.nullif(F.regexp_extract(w["text"], f"({MONEY})", 1), F.lit("")), limit=limit), w))
    by_word = F.filter(first, lambda h: h["cents"].isNotNull())
    closed = F.regexp_replace(F.regexp_replace(text, r"(\d)\s+([.,])\s*(\d{2})(?!\d)", "$1$2$3"), r"(\d)([.,])\s+(\d{2})(?!\d)", "$1$2$3")
    stages = [by_word, hits_of_line(text, box, width, MONEY, limit), hits_of_line(closed, box, width, MONEY, limit)]
    if lenient:
        stages.append(hits_of_line(blanked(text), box, width, LENIENT_MONEY, limit))
    # Later stages are only looked at where all before are empty, and each is worked out once.
    found = stages[0]
    for stage in stages[1:]:
        found = bound(found, or_else(stage))
    return F.coalesce(found, F.array().cast(f"array<{HIT}>"))


def rightmost(hits: Column) -> Column:
    """The hit of 0 or more that begins furthest right, of equals the last. One without a box is taken after any, and gives way to any."""
    right = lambda best, h: F.when(best.isNull() | (F.coalesce(h["x"], F.lit(1.0)) >= F.coalesce(best["x"], F.lit(0.0))), h).otherwise(best)
    return F.aggregate(F.filter(hits, lambda h: h["cents"] >= 0), F.lit(None).cast(HIT), right)
