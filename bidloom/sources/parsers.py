"""Files to pages, pictures and texts: what parses them is a parameter, and the engine only carries it to the executors.

A parser, a reader of text in pictures, a tokenizer and an encoder are objects
with one method. Readers of text in pictures are registered by name, with an
order in which they are tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@runtime_checkable
class Tokenizer(Protocol):
    def tokens(self, text: str) -> list[str]: ...


@runtime_checkable
class Embedder(Protocol):
    def vectors(self, texts: list[str]) -> list[list[float]]: ...


@runtime_checkable
class PageParser(Protocol):
    def pages(self, content: bytes) -> list[dict]:
        """A dict for each page: text, and pictures (a list of dicts with w, h, pixels)."""


@runtime_checkable
class ImageText(Protocol):
    def available(self) -> bool: ...

    def read(self, pixels: bytes, w: int, h: int) -> tuple[str, float]:
        """Text and confidence."""


class PlainPages:
    """Pages of plain text: parts between form feeds, without pictures."""

    def pages(self, content: bytes) -> list[dict]:
        return [{"text": p, "pictures": []} for p in content.decode("utf-8", "replace").split("\f")]


class Readers:
    """Readers of text in pictures by name; ``choose`` gives the first available, or the one asked for."""

    def __init__(self) -> None:
        self.known: dict[str, ImageText] = {}

    def register(self, name: str, reader: ImageText) -> None:
        self.known[name] = reader

    def choose(self, name: str | None = None) -> ImageText | None:
        if name is not None and name not in self.known:
            raise ValueError(f"unknown reader: {name}")
        names = [name] if name else list(self.known)
        return next((self.known[n] for n in names if self.known[n].available()), None)


def pages(files: DataFrame, parser: PageParser, chunk: int = 50) -> DataFrame:
    """(path, chunk, page, text, pictures, error): the pages of files (path, content), ``chunk`` of them in a chunk. A file that can't be parsed gives one row with the error, and the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, i // chunk, i + 1, p.get("text") or "", len(p.get("pictures") or ()), None) for i, p in enumerate(parser.pages(bytes(content)))]
                except Exception as e:  # noqa: BLE001 - whatever a parser raises is the file's error
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            out = pd.DataFrame(rows, columns=["path", "chunk", "page", "text", "pictures", "error"])
            yield out.astype({"chunk": "Int32", "page": "Int32", "pictures": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, chunk int, page int, text string, pictures int, error string")


def picture_texts(pictures: DataFrame, reader: ImageText | None) -> DataFrame:
    """(picture_id, text, confidence) of pictures (picture_id, pixels, w, h); null where there is no reader or it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, p, w, h in zip(batch["picture_id"], batch["pixels"], batch["w"], batch["h"], strict=True):
                try:
                    rows.append((i, *reader.read(bytes(p), int(w), int(h))) if reader is not None and p is not None else (i, None, None))
                except Exception:  # noqa: BLE001 - a picture that can't be read has no text
                    rows.append((i, None, None))
            yield pd.DataFrame(rows, columns=["picture_id", "text", "confidence"])

    return pictures.select("picture_id", "pixels", "w", "h").mapInPandas(run, "picture_id long, text string, confidence double")


def embedded(texts: DataFrame, embedder: Embedder, size: int = 512) -> DataFrame:
    """(text_hash, embedding) of the distinct texts (text), ``size`` at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), size):
                part = batch.iloc[k : k + size]
                yield pd.DataFrame({"text_hash": part["text_hash"], "embedding": embedder.vectors(part["text"].tolist())})

    once = texts.filter("text is not null").select(F.md5("text").alias("text_hash"), "text").dropDuplicates(["text_hash"])
    return once.mapInPandas(run, "text_hash string, embedding array<float>")


_INFO = {k: rf"/{v}\s*\(((?:[^()\\]|\\.)*)\)" for k, v in (("author", "Author"), ("creator", "Creator"), ("producer", "Producer"), ("created", "CreationDate"))}


def pdf_metadata(files: DataFrame) -> DataFrame:
    """(path, author, creator, producer, created, file_id, pages) as the files' bytes say it in the open; null for what is missing or packed."""
    raw = F.decode("content", "ISO-8859-1")
    found = lambda p: F.nullif(F.regexp_extract(raw, p, 1), F.lit(""))
    pages_ = F.size(F.regexp_extract_all(raw, F.lit(r"/Type\s*/Page(?![a-zA-Z])"), F.lit(0)))
    return files.select("path", *[found(p).alias(k) for k, p in _INFO.items()], F.lower(found(r"/ID\s*\[\s*<([0-9A-Fa-f]+)>")).alias("file_id"), pages_.alias("pages"))
