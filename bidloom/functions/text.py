"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions import fixed


def tokens(text: Column, bigrams: bool = False) -> Column:
    """Distinct lower-case runs of letters and numbers of two characters or more; with ``bigrams``, runs of Chinese characters as their pairs instead."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if bigrams:
        words = F.regexp_extract_all(F.lower(text), F.lit(r"[一-龥]+|[\p{L}\p{N}&&[^一-龥]]+"), F.lit(0))
        pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
        words = F.flatten(F.transform(words, lambda w: F.when(w.rlike("^[一-龥]{2,}$"), pairs(w)).otherwise(F.array(w))))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def template_text(text: Column) -> Column:
    """A text with what varies between documents made equal: blanks out, e-mails, phones and numbers replaced; 500 characters."""
    x = compact(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.+-]+", "EMAIL")
    x = F.regexp_replace(x, fixed.MOBILE, "PHONE")
    return F.substring(F.regexp_replace(x, r"\d+(?:\.\d+)?", "#"), 1, 500)


def boilerplate_ratio(text: Column) -> Column:
    """The share of a text's characters in boilerplate terms; 0 for null and empty texts."""
    hits = F.regexp_extract_all(text, F.lit("|".join(fixed.BOILERPLATE)), F.lit(0))
    total = F.aggregate(F.transform(hits, lambda h: F.length(h)), F.lit(0), lambda a, n: a + n)
    return F.coalesce(F.when(F.length(text) > 0, F.least(F.lit(1.0), total / F.length(text))), F.lit(0.0))


def informativeness(text: Column, words: Column, boilerplate: Column) -> Column:
    """0 to 1: how specific a text is, from its distinct words, long words, numbers, marker terms and length, less its boilerplate."""
    x = compact(text)
    long = F.size(F.filter(words, lambda w: F.length(w) >= 4))
    numbers = F.size(F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    markers = sum((F.when(F.contains(x, F.lit(m)), 1).otherwise(0) for m in fixed.MARKERS[1:]), F.when(F.contains(x, F.lit(fixed.MARKERS[0])), 1).otherwise(0))
    part = lambda most, value, by: F.least(F.lit(most), value / by)
    score = part(0.25, F.size(words), 40) + part(0.20, long, 25) + part(0.20, numbers, 20) + part(0.25, markers, 12) + part(0.10, F.length(x), 800) - F.least(F.lit(0.35), boilerplate * 0.35)
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0)


def is_title(line: Column) -> Column:
    return (F.length(line) <= 100) & line.rlike(fixed.TITLE)


def is_list_item(line: Column) -> Column:
    return line.rlike(fixed.LIST_ITEM)


def is_toc_line(text: Column) -> Column:
    t = F.trim(text)
    chapter, number, chinese, heading = fixed.TOC_LINE
    return (F.length(t) >= 2) & (t.rlike(chapter) | (t.rlike(number) & (F.length(t) < 70)) | (t.rlike(chinese) & (F.length(t) < 40)) | t.rlike(heading))


def software_fingerprint(creator: Column, producer: Column) -> Column:
    """Creator and producer without version numbers, lower-cased; null if both are blank, so that documents without metadata don't match."""
    strip = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), fixed.VERSION, ""))
    a, b = strip(creator), strip(producer)
    return F.when((a != "") | (b != ""), F.lower(F.concat(a, F.lit(" + "), b)))


def money(text: Column) -> Column:
    """Distinct amounts of yuan in a text, in yuan, ascending. A currency sign or name may stand before the amount; the unit decides."""
    whole = F.regexp_extract_all(text, F.lit(fixed.MONEY), F.lit(1))
    unit = F.regexp_extract_all(text, F.lit(fixed.MONEY), F.lit(2))
    value = F.zip_with(whole, unit, lambda a, u: F.regexp_replace(a, ",", "").try_cast("double") * F.when(u == "万", 10000.0).otherwise(1.0))
    return F.array_sort(F.array_distinct(F.filter(value, lambda v: v.isNotNull())))


def term_count(text: Column, terms: list[str]) -> Column:
    """How often all terms together are in a text, overlapping terms each counting."""
    x = compact(text)
    n = [(F.length(x) - F.length(F.replace(x, F.lit(t), F.lit("")))) / len(t) for t in terms]
    return sum(n[1:], n[0]).cast("long")


def pdf_date(raw: Column) -> Column:
    """The timestamp of ``D:YYYYMMDDhhmmss``, its zone left out; null for anything else."""
    return F.try_to_timestamp(F.regexp_extract(raw, r"^D:(\d{14})", 1), F.lit("yyyyMMddHHmmss"))


def hash_parts(source: Column) -> Column:
    """Page, type and hex digits of an image hash such as ``page_3:p00ff…``; a bare hash is of type p."""
    page = F.regexp_extract(source, r"^page_(\d+):", 1)
    kind = F.regexp_extract(source, r"(?:^|:)([pdw]):?[0-9a-f]{16}$", 1)
    return F.struct(F.when(page != "", page.cast("int")).alias("page"), F.when(kind != "", kind).otherwise("p").alias("type"), F.regexp_extract(source, r"([0-9a-f]{16})$", 1).alias("hash"))


def file_name(raw: Column) -> Column:
    return F.substring(F.regexp_replace(raw, r'[\\/:*?"<>|\s]+', "_"), 1, 80)


def data_uri(image: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.base64(image))
