"""Sections of documents: which pages are technical and which commercial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions import fixed, text


def page_texts(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, page, text): the paragraphs of each page in order; pages below 1 or unknown are left out, repeated rows count once."""
    rows = paragraphs.filter("page_num >= 1 and text is not null").dropDuplicates(["para_id"])
    items = F.array_sort(F.collect_list(F.struct("para_index", "para_id", "text")))
    return rows.groupBy("doc_id", F.col("page_num").alias("page")).agg(items.alias("p")).select("doc_id", "page", F.array_join(F.col("p.text"), "\n").alias("text"))


def page_terms(pages: DataFrame) -> DataFrame:
    """(doc_id, page, technical, commercial): counts of the terms of either part."""
    t, c = text.term_count(F.col("text"), fixed.TECHNICAL_TERMS), text.term_count(F.col("text"), fixed.COMMERCIAL_TERMS)
    return pages.select("doc_id", "page", t.alias("technical"), c.alias("commercial"))


def page_labels(pages: DataFrame, without_titles: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, label, method, both): by titles in the text, else by density of terms, else unknown; ``both``: the document has both parts.

    The part that starts first goes up to the page where the other starts. Titles on
    the pages ``without_titles`` (doc_id, page) don't count.
    """
    head = F.substring(text.compact(F.substring("text", 1, 120)), 1, 120)
    short = (F.length(head) <= 80) | head.rlike("^(?:第|[一二三四五六七八九十]+、)")
    has = lambda terms: short & head.rlike("|".join(terms))
    marked = page_terms(pages).join(pages, ["doc_id", "page"]).select(
        "doc_id",
        "page",
        F.when(has(fixed.COMMERCIAL_TITLES), "c").when(has(fixed.TECHNICAL_TITLES), "t").alias("title"),
        F.when(F.col("commercial") > F.col("technical"), "c").when(F.col("technical") > F.col("commercial"), "t").alias("dense"),
    )
    if without_titles is not None:
        bare = without_titles.select("doc_id", "page", F.lit(True).alias("bare"))
        marked = marked.join(bare, ["doc_id", "page"], "left").withColumn("title", F.when(F.col("bare").isNull(), F.col("title")))
    first = lambda c, v: F.min(F.when(F.col(c) == v, F.col("page")))
    starts = marked.groupBy("doc_id").agg(first("title", "t").alias("tt"), first("title", "c").alias("tc"), first("dense", "t").alias("dt"), first("dense", "c").alias("dc"))
    by = F.col("tt").isNotNull() | F.col("tc").isNotNull()
    starts = starts.select("doc_id", F.when(by, F.col("tt")).otherwise(F.col("dt")).alias("t"), F.when(by, F.col("tc")).otherwise(F.col("dc")).alias("c"), F.when(by, "title").when(F.col("dt").isNotNull() | F.col("dc").isNotNull(), "density").otherwise("none").alias("method"))
    rows = pages.select("doc_id", "page").join(starts, "doc_id")
    label = (
        F.when(F.col("t").isNull() & F.col("c").isNull(), "unknown")
        .when(F.col("c").isNull(), "technical")
        .when(F.col("t").isNull(), "commercial")
        .when(F.col("t") < F.col("c"), F.when(F.col("page") < F.col("c"), "technical").otherwise("commercial"))
        .when(F.col("c") < F.col("t"), F.when(F.col("page") < F.col("t"), "commercial").otherwise("technical"))
        .otherwise("unknown")
    )
    return rows.select("doc_id", "page", label.alias("label"), "method", (F.col("t").isNotNull() & F.col("c").isNotNull()).alias("both"))


def _contents(pages: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of front pages, marked as entries, and (doc_id, page) of those that look like a table of contents."""
    size = documents.groupBy("doc_id").agg(F.max("page_count").alias("pages"))
    front = pages.join(size, "doc_id").filter(F.col("page") <= F.greatest(F.lit(8), F.floor(F.col("pages") * 0.12)))
    lines = front.select("doc_id", "page", "pages", F.contains(F.substring("text", 1, 200), F.lit("目录")).alias("says"), F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.regexp_replace("line", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).filter("line <> ''")
    # most lines don't end in a number; only the others are looked at closely
    entry = F.col("line").rlike(r"\d\s*页?\s*$") & F.col("line").rlike(fixed.TOC_ENTRY)
    marked = lines.withColumn("entry", entry).withColumn("like", entry | F.col("line").rlike(fixed.TOC_FILL))
    own = marked.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.count_if("like").alias("k"), F.max("says").alias("said"))
    return marked, own.filter((F.col("k") >= F.greatest(F.lit(2), F.floor(F.col("n") / 4))) | F.col("said")).select("doc_id", "page")


def contents_entries(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, page, title, printed, label): lines with a trailing page number on front pages that look like a table of contents.

    Front pages are the first eight, or the first 12 % of a longer document. A page
    looks so if it says it near its top, or if a quarter of its lines, two at least,
    are entries or filled with dots. Commercial terms go before technical ones.
    """
    marked, toc = _contents(pages, documents)
    title = F.trim(F.regexp_extract("line", fixed.TOC_ENTRY, 1))
    rows = marked.filter("entry").join(toc, ["doc_id", "page"]).select("doc_id", "page", "pages", title.alias("title"), F.regexp_extract("line", fixed.TOC_ENTRY, 2).cast("int").alias("printed"))
    label = F.when(F.col("title").rlike("|".join(fixed.COMMERCIAL_TERMS)), "commercial").when(F.col("title").rlike("|".join(fixed.TECHNICAL_TERMS)), "technical")
    return rows.filter((F.col("printed") >= 1) & (F.col("printed") <= F.col("pages") + 50)).select("doc_id", "page", "title", "printed", label.alias("label")).distinct()


def page_classes(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, page, label, method, confidence): ``page_labels`` with what told it and how sure that is.

    Titles in the text, tables of contents left out, tell where a part begins; a
    table of contents that names a part makes that surer. Without titles the
    density of terms tells.
    """
    entries, toc = contents_entries(pages, documents), _contents(pages, documents)[1]
    listed = entries.filter("label is not null").select("doc_id", F.lit(True).alias("listed")).distinct()
    rows = page_labels(pages, toc).join(listed, "doc_id", "left")
    sure = lambda two, one: F.when(F.col("both"), two).otherwise(one)
    by_title, is_listed = F.col("method") == "title", F.coalesce("listed", F.lit(False))
    method = F.when(by_title & is_listed, "toc_entries").when(by_title, "body_anchors").when(F.col("method") == "density", "keyword_density").otherwise("none")
    confidence = F.when(by_title & is_listed, sure(0.92, 0.72)).when(by_title, sure(0.84, 0.70)).when(F.col("method") == "density", sure(0.58, 0.55)).otherwise(0.0)
    return rows.select("doc_id", "page", "label", method.alias("method"), confidence.alias("confidence"))


def in_dimension(paragraphs: DataFrame, labels: DataFrame, dimension: str) -> DataFrame:
    """Paragraphs on pages of one label; none of a document without such a page."""
    own = labels.filter(F.col("label") == dimension).select("doc_id", F.col("page").alias("page_num"))
    return paragraphs.join(own, ["doc_id", "page_num"], "left_semi")


def body_paragraphs(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """Paragraphs without the table of contents: lines that look like its entries, on the first fifth of the pages."""
    pages = documents.select("doc_id", "page_count").dropDuplicates(["doc_id"])
    front = F.coalesce(F.col("page_num") / F.col("page_count") < fixed.TOC_SHARE, F.lit(False))
    return paragraphs.join(pages, "doc_id", "left").filter(~(F.coalesce(text.is_toc_line(F.col("text")), F.lit(False)) & front)).drop("page_count")
