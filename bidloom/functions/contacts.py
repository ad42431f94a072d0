"""Contact entities: extraction from text, and the long table of fingerprints."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.functions import fixed

KINDS = {"company": "company_names", "contact": "contact_names", "mobile": "mobile_phones", "landline": "landline_phones", "email": "emails", "credit_code": "credit_codes"}


def extracted(text: Column) -> dict[str, Column]:
    """Arrays of the distinct mobiles, landlines, e-mails and credit codes in a text."""
    found = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))))
    return {"mobile": found(fixed.MOBILE), "landline": found(fixed.LANDLINE), "email": found(fixed.EMAIL), "credit_code": found(fixed.CREDIT_CODE)}


def latest(fingerprints: DataFrame) -> DataFrame:
    """One fingerprint for each document, the last written; equal times are settled by the contents."""
    order = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("updated_at"), F.to_json(F.struct(*KINDS.values())))
    return fingerprints.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def entities(fingerprints: DataFrame) -> DataFrame:
    """(doc_id, kind, value): the trimmed, distinct values of each document's last fingerprint; e-mails in lower case, blank ones left out."""
    last = latest(fingerprints)
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("values")) for k, c in KINDS.items()])
    rows = last.select("doc_id", F.inline(pairs)).select("doc_id", "kind", F.explode("values").alias("value"))
    clean = F.when(F.col("kind") == "email", F.lower(F.trim("value"))).otherwise(F.trim("value"))
    return rows.select("doc_id", "kind", clean.alias("value")).filter("value <> ''").distinct()


_COMPANY = re.compile(fixed.COMPANY)
_TO = re.compile(r"致[：: \t]")


def company_names(text: str | None) -> list[str]:
    """Company names in a text, without those that the 20 characters before them on the line give to the tendering side."""
    out = {}
    for m in _COMPANY.finditer(text or ""):
        before = text[max(0, m.start() - 20) : m.start()].rpartition("\n")[2]
        plain = re.sub(r"[ 　]", "", before)
        if not any(w in plain for w in fixed.TENDERING) and not _TO.search(before):
            out[m.group()] = None
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def companies_in(text: pd.Series) -> pd.Series:
    return text.map(company_names)


def contact_names(text: Column) -> Column:
    """Distinct names of persons after a role, or before one in a table row, in the order roles then rows; what follows a name without being part of it is cut off, two characters stay."""
    after = F.regexp_extract_all(text, F.lit(fixed.CONTACT_NAME), F.lit(1))
    rows = F.regexp_extract_all(text, F.lit(fixed.CONTACT_TABLE), F.lit(1))
    return F.array_distinct(F.transform(F.concat(after, rows), lambda n: F.regexp_replace(n, f"^(.{{2,}}?)[{fixed.NAME_TAIL}]+$", "$1")))


_NEAR_NAMES = re.compile(rf"[^。\n]{{0,80}}(?:{'|'.join(fixed.NAME_PLACES)}|{fixed.MOBILE})[^。\n]{{0,80}}")
_HAN = re.compile(r"[一-鿿]+")


def merged_surnames(words: list[str]) -> list[str]:
    """The words with each single frequent surname put before the next word, if that has one to three Chinese characters."""
    out, held = [], ""
    for w in words:
        if held and 1 <= len(w) <= 3 and _HAN.fullmatch(w):
            out.append(held + w)
            held = ""
            continue
        if held:
            out.append(held)
        held = w if len(w) == 1 and w in fixed.SURNAMES else ""
        if not held:
            out.append(w)
    return [*out, held] if held else out


def words_of(text: str) -> list[str]:
    """Runs of letters, of digits and of other characters; the tokenizer where none is given."""
    return re.findall(r"[一-鿿]+|[^\W\d_一-鿿]+|\d+", text)


def potential_names(text: str | None, tokenizer=words_of) -> list[str]:
    """Words of two to four Chinese characters near words about contacts or a mobile number that could be names; two characters need a frequent surname."""
    found = set()
    for m in _NEAR_NAMES.finditer(text or ""):
        for w in merged_surnames([x.strip() for x in tokenizer(m[0]) if x.strip()]):
            if 2 <= len(w) <= 4 and _HAN.fullmatch(w) and w not in fixed.NO_NAMES and not any(k in w for k in ("联系", "电话", "手机", "邮箱", "项目")):
                if len(w) > 2 or w[0] in fixed.SURNAMES:
                    found.add(w)
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def potential_names_in(text: pd.Series) -> pd.Series:
    return text.map(potential_names)
