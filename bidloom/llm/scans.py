"""Problem 4: noise in text from scanned pages.

Two averaged perceptrons. One tells furniture (running titles, page numbers) from
body lines by the line's place on the page, its pattern, and how many pages of
the document carry the same line there. The other is a character editor, which
predicts keep, replace, delete, insert or join for a character. At the last
character of each body line it decides whether the line is joined with the next,
from the characters around and the lengths of the word's parts. Inside a word it
decides at each character that could be a misreading, from the character, its
neighbours, what it could be, and how often the word and its repaired form are
written in the whole corpus; an edit is made if the operation that the repair
needs is the one predicted. Both are trained here, on pages, line ends and words
made from a bounded sample of body lines by adding furniture, splitting words at
line ends and misreading characters.

Scale: pages are grouped by document, the unit the rules speak of. The corpus'
word counts stay distributed: distinct words and their repairs are joined with
them, and only words judged misread are joined back to the lines.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions import fixed
from bidloom.llm.perceptron import Perceptron, train
from bidloom.llm.sampling import sampled
from bidloom.session import materialise

#: Bounds of the samples: pages that training pages and line ends are made from, of at most so many characters; words that misread ones are made from.
TRAIN_PAGES, TRAIN_LETTERS, TRAIN_WORDS = 400, 20_000, 20_000
HYPHENS = "-‐‑\xad¬"
#: What is read for what, in Latin script.
CONFUSIONS = {"c": "e", "l": "i", "1": "l", "5": "s", "0": "o", "ii": "u", "cl": "d", "9": "g", "rn": "m", "li": "h", "6": "b", "vv": "w", "8": "b", "m": "rn", "e": "c", "i": "l"}
#: Pairs of Chinese characters that look alike, beside those that make words confusable.
ALIKE = fixed.CONFUSABLE + "大太 材村 标杯 质盾 设没 施旋 待侍 治冶 微徽 天夫 问间 刀力 目且 田由 比此 右石 处外 住往 今令 准淮 洒酒 折拆 休体 师帅 载栽 料科 电申 管菅 网冈 检险 桥侨 梯悌 机杌 泵汞 图囹 验脸 保俣 证怔 监临 项顶 服眼 仓仑 输轮 沥历 道遒 基墓 础拙".split()
_ALIKE: dict[str, str] = {}
for _p in ALIKE:
    _ALIKE[_p[0]] = _ALIKE.get(_p[0], "") + _p[1]
    _ALIKE[_p[1]] = _ALIKE.get(_p[1], "") + _p[0]
_CJK = re.compile(r"[一-鿿]")
_WORD = re.compile(r"[^\W_一-鿿]+")
_TAIL = re.compile(r"[^\W_一-鿿]+$")
_NUMBER = r"[\dlIOo|]{1,4}"
_PAGE_NO = re.compile(
    rf"^[\s\-–—\[\](){{}}|.·]*(?:(page|seite|pág|pag|página|blatt|p|s|第)\.?\s*)?{_NUMBER}\s*(页)?\s*(?:,?\s*(of|von|de|sur|/|共|aus)\s*{_NUMBER}\s*(?:页)?)?[\s\-–—\[\](){{}}|.·]*$", re.I
)
KEEP, REPLACE, DELETE, INSERT, JOIN = range(5)
BODY, HEADER, PAGE_NO = range(3)
EDGE = 3


def folded(line: str) -> str:
    """A line with what is often confused made equal, without digits and blanks."""
    x = re.sub(r"\s+", "", line.lower())
    x = re.sub(r"[|·–\-]*(?:[sp]\.)?[\dlo]*\W*$", "", x)
    for a, b in (("rn", "m"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("vv", "w")):
        x = x.replace(a, b)
    x = "".join(min(c, *_ALIKE.get(c, c)) for c in x).translate(str.maketrans({"0": "o", "1": "i", "l": "i", "5": "s", "9": "g", "6": "b", "c": "e", "h": "i", "8": "b"}))
    return re.sub(r"[\d\W_]+", "", x)


def _line_features(lines: list[str], pages: int, at: int, place: int, same: int, run: bool) -> list[int]:
    """Feature ids of the line ``place`` (index among the page's lines with text)."""
    n, x = len(lines), lines[at].strip()
    top, foot = place, n - 1 - place
    m = _PAGE_NO.match(x)
    pattern = 0 if not m else 1 if re.fullmatch(r"\d+\.", x) else 2 if re.fullmatch(r"[\dl]+( \.)?", x) else 3
    letters = sum(c.isalpha() for c in x) * (2 if _CJK.search(x) else 1)
    share = 0 if same < 2 else 1 if same * 2 < pages else 2 if same < pages else 3
    size = int(np.digitize(letters, [1, 8, 12, 20]))
    edge = min(top, foot, EDGE)
    ids = [edge, 4 + pattern, 8 + share, 12 + size, 17 + run]
    ids += [20 + edge * 4 + pattern, 40 + share * 5 + size, 60 + pattern * 2 + run, 70 + edge * 4 + share, 90 + (pattern * 4 + share), 110 + pattern * 8 + edge * 2 + run]
    return ids


LINE_FEATURES = 150


def _page_lines(pages: list[list[str]]) -> list[list[tuple[int, list[int]]]]:
    """For each page the numbers of its lines with text, with their features."""
    kept = [[i for i, x in enumerate(p) if x.strip()] for p in pages]
    where: dict[str, set[int]] = defaultdict(set)
    numbers: dict[tuple[str, int], set[int]] = defaultdict(set)

    def zone(k: int, n: int) -> str:
        return "top" if k < EDGE and k <= n - 1 - k else "foot" if n - 1 - k < EDGE else ""

    def count(line: str) -> int | None:
        m = re.search(r"[\dlIO]+", line)
        return int(m[0].translate(str.maketrans("lIO", "110"))) if m and _PAGE_NO.match(line.strip()) else None

    for p, (page, own) in enumerate(zip(pages, kept, strict=True)):
        for k, i in enumerate(own):
            if z := zone(k, len(own)):
                if key := folded(page[i]):
                    where[key].add(p)
                if (c := count(page[i])) is not None:
                    numbers[z, c - p].add(p)
    out = []
    for p, (page, own) in enumerate(zip(pages, kept, strict=True)):
        texts, rows = [page[i] for i in own], []
        for k, i in enumerate(own):
            z = zone(k, len(own))
            same = len(where.get(folded(page[i]), ())) if z else 0
            c = count(page[i]) if z else None
            run = c is not None and len(numbers.get((z, c - p), ())) > 1
            rows.append((i, _line_features(texts, len(pages), k, k, same, run)))
        out.append(rows)
    return out


def _noisy(line: str, rng: random.Random, share: float) -> str:
    back = {v: k for k, v in list(CONFUSIONS.items())[:12]}
    return "".join(back[c] if c in back and rng.random() < share else c for c in line)


def _made_documents(body: list[str], rng: random.Random, number: int) -> Iterator[tuple[list[list[str]], list[list[int]]]]:
    """Documents with furniture whose kind is known, made of body lines."""
    words = [w for x in body for w in re.findall(r"[^\W\d_]{4,}", x)] or ["text"]
    styles = ("{n}", "- {n} -", "– {n} –", "[{n}]", "{n}/{m}", "{n} / {m}", "Page {n} of {m}", "Seite {n} von {m}", "page {n} sur {m}", "Pág. {n} de {m}", "第 {n} 页 共 {m} 页", "第{n}页")
    for _ in range(number):
        pages, kinds = [], []
        count, first = rng.randint(2, 9), rng.choice((1, 1, 1, rng.randint(2, 60)))
        title = " ".join(rng.choice(words).capitalize() for _ in range(rng.randint(2, 5)))
        if rng.random() < 0.5:
            title += rng.choice((" – ", " | ", " · ")) + rng.choice(words)
        suffix = rng.random() < 0.3
        second = rng.choice(body)[: rng.randint(14, 50)] if rng.random() < 0.3 else None
        style, top_no, top_title = rng.choice(styles), rng.random() < 0.5, rng.random() < 0.6
        has_no, has_title = rng.random() < 0.9, rng.random() < 0.8
        for p in range(count):
            at = rng.randrange(max(1, len(body) - 40))
            lines = [(x, BODY) for x in body[at : at + rng.randint(5, 35)]]
            for k in range(len(lines)):
                if rng.random() < 0.04:
                    lines[k] = (rng.choice((f"{rng.choice(words)} –", f"{rng.choice(words)}: {rng.randint(2, 40)} -", f"{rng.randint(2, 250)}.", "。")), BODY)
            if rng.random() < 0.15:
                lines.append((f"{rng.randint(2, 250)}.", BODY))
            no = (style.format(n=first + p, m=first + count + 3) + (" ." if rng.random() < 0.1 else ""), PAGE_NO)
            head = [((("  " if rng.random() < 0.1 else "") + _noisy(title, rng, 0.01) + (f" | S. {p + first}" if suffix else "")), HEADER)] if has_title and rng.random() < 0.97 else []
            if second and head:
                head.append((_noisy(second, rng, 0.01), HEADER))
            if has_title:
                lines = head + lines if top_title else lines + head
            if has_no and rng.random() < 0.97:
                lines = [no, *lines] if top_no else [*lines, no]
            pages.append([x for x, _ in lines])
            kinds.append([k for _, k in lines])
        yield pages, kinds


def fit_furniture(body: list[str]) -> Perceptron:
    rng = random.Random(17)
    x, y = [], []
    for pages, kinds in _made_documents(body or ["text of a line."], rng, 400):
        for rows, own in zip(_page_lines(pages), kinds, strict=True):
            for i, f in rows:
                x.append(f)
                y.append(own[i])
    return train(np.array(x), np.array(y), LINE_FEATURES, 3, rounds=3)


def _char_class(c: str) -> int:
    """0 nothing, 1 lower, 2 upper, 3 digit, 4 Chinese, 5 blank, 6 other."""
    if not c:
        return 0
    if _CJK.match(c):
        return 4
    return 1 if c.islower() else 2 if c.isalpha() else 3 if c.isdigit() else 5 if c.isspace() else 6


END_FEATURES = 1000


def _end_features(line: str, after: str, width: int) -> list[int]:
    """Feature ids of the last character of a line: what it is, what is before it and on the next line, the lengths of the word's parts there."""
    last, before = line[-1:], line[-2:-1]
    kind = HYPHENS.find(last) if last and last in HYPHENS else 6 + (0 if last in ".!?。！？" else 1 if _CJK.match(last) else 2 if last.isalnum() else 3)
    b, n = _char_class(before), _char_class(after[:1])
    tail = re.search(r"[^\W\d_一-鿿]*$", line[:-1] if kind < 6 else line)[0]
    head = re.match(r"[^\W\d_一-鿿]*", after)[0]
    t, h, full = min(len(tail), 4), min(len(head), 4), len(line) * 10 >= 7 * width
    return [kind, 10 + kind * 7 + b, 80 + (kind * 7 + b) * 7 + n, 570 + kind * 5 + t, 620 + kind * 5 + h, 670 + kind * 2 + full, 690 + (kind < 6) * 25 + t * 5 + h, 740 + kind * 25 + t * 5 + h]


def _made_ends(body: list[str], rng: random.Random) -> tuple[list[list[int]], list[int]]:
    """Line ends with what is to be done there: words split by a hyphen, dashes between words, and the lines' own ends."""
    x, y = [], []
    width = max((len(b) for b in body), default=0)
    for line, after in zip(body, [*body[1:], ""], strict=True):
        line, after = line.strip(), after.strip()
        if line and line[-1] not in HYPHENS and len(x) < 30_000:
            x.append(_end_features(line, after, width))
            y.append(KEEP)
        words = [m for m in _WORD.finditer(line) if len(m[0]) > 4 and m[0].isalpha()]
        hyphen = rng.choice("-" * 8 + HYPHENS)
        for m in rng.sample(words, min(2, len(words))):
            at = m.start() + rng.randint(2, len(m[0]) - 2)
            x.append(_end_features(line[:at] + hyphen, line[at:], width))
            y.append(JOIN)
        for m in rng.sample(words, min(1, len(words))):
            dash = rng.choice((f" {rng.randint(1, 99)} {hyphen}", f" {hyphen}", f"{rng.choice(',;:)')}{hyphen}", f" {hyphen}{hyphen}"))
            x.append(_end_features(line[: m.start()].rstrip() + dash, line[m.start() :], width))
            y.append(KEEP)
    return x, y


def fit_joiner(body: list[str]) -> Perceptron:
    """The editor's part for line ends."""
    x, y = _made_ends(body or ["text of several lines"], random.Random(29))
    return train(np.array(x), np.array(y), END_FEATURES, 5, rounds=3)


def _document(model: Perceptron, joiner: Perceptron):
    """Lines of one document's pages: their kind, whether they are hyphenated, and their words."""

    def run(table: pa.Table) -> pa.Table:
        rows = {r["ocr_id"]: r for r in table.to_pylist() if r["text"]}
        rows = sorted(rows.values(), key=lambda r: (r["page_num"] is None, r["page_num"], r["ocr_id"]))
        pages = [r["text"].split("\n") for r in rows]
        flat: list[tuple[int, int, str, int]] = []
        for p, own in enumerate(_page_lines(pages)):
            kinds = model.predict(np.array([f for _, f in own])) if own else []
            flat += [(p, i, pages[p][i].rstrip("\r").rstrip(), int(k)) for (i, _), k in zip(own, kinds, strict=True)]
        body = [k for k, x in enumerate(flat) if x[3] == BODY]
        joined, begins, follows = {}, {}, dict(zip(body, body[1:], strict=False))
        width = max((len(flat[k][2]) for k in body), default=0)
        ends = list(zip(body, body[1:], strict=False))
        told = joiner.predict(np.array([_end_features(flat[a][2], flat[b][2].lstrip(), width) for a, b in ends])) if ends else []
        for (a, b), op in zip(ends, told, strict=True):
            tail, head = re.search(r"[^\W_一-鿿]+$", flat[a][2][:-1]), _WORD.match(flat[b][2].lstrip())
            if op == JOIN and tail and head:
                joined[a] = (tail[0], head[0])
                begins[b] = True
        out: dict[str, list] = defaultdict(list)
        for k, (p, i, text, kind) in enumerate(flat):
            words: list[dict] = []
            if kind == BODY:
                pieces = _WORD.findall(text[:-1] if k in joined else text)
                if k in joined and pieces:
                    pieces = pieces[:-1]
                if begins.get(k) and pieces:
                    pieces = pieces[1:]
                words = [{"word": w.lower(), "cut": -1, "next": -1} for w in pieces if len(w) > 1]
                wide = f" {text} "
                words += [{"word": wide[j - 1 : j + 2], "cut": -1, "next": -1} for j in range(1, len(wide) - 1) if wide[j] in _ALIKE and (_CJK.match(wide[j - 1]) or _CJK.match(wide[j + 1]))]
                if k in joined:
                    a, b = joined[k]
                    nxt = flat[follows[k]]
                    words.append({"word": (a + b).lower(), "cut": len(a), "next": rows[nxt[0]]["ocr_id"] * 100000 + nxt[1]})
            for name, value in (
                ("ocr_id", rows[p]["ocr_id"]),
                ("doc_id", rows[p]["doc_id"]),
                ("page", p),
                ("line_no", i),
                ("text", text),
                ("kind", ("body", "header", "page_no")[kind]),
                ("hyphen", k in joined),
                ("words", words),
            ):
                out[name].append(value)
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in _LINES})

    return run


_LINES = pa.schema(
    [
        ("ocr_id", pa.int64()),
        ("doc_id", pa.int64()),
        ("page", pa.int32()),
        ("line_no", pa.int32()),
        ("text", pa.string()),
        ("kind", pa.string()),
        ("hyphen", pa.bool_()),
        ("words", pa.list_(pa.struct([("word", pa.string()), ("cut", pa.int32()), ("next", pa.int64())]))),
    ]
)
_LINES_DDL = "ocr_id long, doc_id long, page int, line_no int, text string, kind string, hyphen boolean, words array<struct<word:string,cut:int,next:long>>"


def _sites(word: str) -> list[tuple[int, str, str]]:
    """Where a confusion could stand in a word: place, what is there, what it could be."""
    if _CJK.search(word):
        return [(1, word[1], c) for c in _ALIKE.get(word[1], "")]
    out = []
    for a, b in CONFUSIONS.items():
        k = word.find(a)
        while k >= 0:
            out.append((k, a, b))
            k = word.find(a, k + 1)
    return out


def repairs(word: str) -> dict[str, tuple[int, int]]:
    """Repaired forms of a word with up to two confusions undone: the place of the first, and the operation on it."""
    sites = _sites(word)
    out: dict[str, tuple[int, int]] = {}
    op = lambda a, b: REPLACE if len(a) == len(b) else DELETE if len(a) > len(b) else INSERT
    for k, a, b in sites:
        out.setdefault(word[:k] + b + word[k + len(a) :], (k, op(a, b)))
    if not _CJK.search(word):
        strong = [s for s in sites if s[1] not in ("m", "e", "i")]
        for n, (k, a, b) in enumerate(strong):
            for k2, a2, b2 in strong[n + 1 :]:
                (p, x, y), (q, u, v) = sorted(((k, a, b), (k2, a2, b2)))
                if p + len(x) <= q:
                    out.setdefault(word[:p] + y + word[p + len(x) : q] + v + word[q + len(u) :], (p, op(x, y)))
    return out


def _bins(n: int) -> int:
    return int(np.digitize(n, [1, 2, 4, 8, 20, 60, 200]))


def _digit_inside(word: str) -> int:
    if _CJK.search(word):
        return 0
    letters = sum(c.isalpha() for c in word)
    digits = sum(c in "015698" for c in word)
    if not digits or sum(c.isdigit() for c in word) != digits:
        return 0
    if re.fullmatch(r"\d*l\d+|\d+l\d*", word):
        return 3
    return 2 if letters >= 3 and digits <= 2 else 1


def _word_features(word: str, n: int, fix: str, n_fix: int) -> list[int]:
    """Feature ids of a character: how often the word and its repair are written and their ratio, the character, its neighbours and what it could be."""
    k = next((i for i, (a, b) in enumerate(zip(word, fix, strict=False)) if a != b), min(len(word), len(fix)) - 1)
    # the shorter side ends where the rest is alike
    end = next((i for i in range(1, min(len(word), len(fix)) - k + 1) if word[-i] != fix[-i]), min(len(word), len(fix)) - k + 1) - 1
    bad, good = word[k : len(word) - end] or word[k : k + 1], fix[k : len(fix) - end] or fix[k : k + 1]
    left, right = word[k - 1 : k], word[k + len(bad) : k + len(bad) + 1]
    near = [zlib.crc32(f"{tag}|{x}".encode()) % SITES for tag, x in enumerate((f"{bad}>{good}", f"{left}{bad}>{good}", f"{bad}>{good}{right}"))]
    cjk = 1 if _CJK.search(word) else 0
    ratio = int(np.digitize(n_fix / max(1, n), [0.5, 2, 5, 12, 40, 150]))
    d, short = _digit_inside(word), int(np.digitize(len(word), [4, 6]))
    own = [_bins(n), 8 + _bins(n_fix), 16 + ratio + 7 * cjk, 32 + d, 36 + (len(good) > len(bad)) + 2 * (len(good) < len(bad)), 44 + (d * 7 + ratio), 80 + _bins(n) * 7 + ratio, 140 + short * 7 + ratio, 170 + _bins(n_fix) * 2 + (d > 1)]
    return own + [190 + i * SITES + x for i, x in enumerate(near)]


#: Hashed features of a character with its neighbours.
SITES = 1024
WORD_FEATURES = 190 + 3 * SITES


def fit_editor(known: list[tuple[str, int]], counts: dict[str, int]) -> Perceptron:
    """The editor, from words of the corpus with their counts: kept ones, and ones with a confusion put in."""
    rng = random.Random(23)
    back = defaultdict(list)
    for a, b in CONFUSIONS.items():
        back[b].append(a)
    x, y = [], []
    for word, n in known:
        best = max(((counts.get(f, 0), f, op) for f, (_, op) in repairs(word).items()), default=None)
        # a word that a much commoner one explains is no clean example
        if best and not (best[0] >= 10 * n and best[0] > 5) and not _digit_inside(word):
            x.append(_word_features(word, n, best[1], best[0]))
            y.append(KEEP)
        if n < 4 or _digit_inside(word):
            continue
        for _ in range(2):
            if _CJK.search(word):
                made = [word[0] + c + word[2:] for c in _ALIKE.get(word[1], "")]
            else:
                made = [word[:k] + a + word[k + len(b) :] for b, sources in back.items() for a in sources for k in range(len(word)) if word.startswith(b, k)]
            if not made:
                break
            bad = rng.choice(made)
            found = max(((counts.get(f, 0), f, op) for f, (_, op) in repairs(bad).items()), default=None)
            if found and counts.get(bad, 0) * 5 < n:
                x.append(_word_features(bad, counts.get(bad, 0) or 1, found[1], found[0]))
                y.append(found[2])
    if not x:
        x, y = [_word_features("a", 1, "a", 1)], [KEEP]
    return train(np.array(x), np.array(y), WORD_FEATURES, 5, rounds=4)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            for fix, (k, op) in repairs(word).items():
                for col, v in zip(out, (word, n, fix, k, op), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["word", "n", "fix", "at", "op"])


def _judge(editor: Perceptron):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            x = np.array([_word_features(r["word"], r["n"], r["fix"], r["n_fix"]) for r in rows])
            got = editor.predict(x) if len(rows) else np.zeros(0)
            keep = np.flatnonzero(got == np.array([r["op"] for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][c] for i in keep], t) for c, t in (("word", pa.string()), ("fix", pa.string()), ("at", pa.int32()))], names=["word", "fix", "at"])

    return run


def page_lines(ocr: DataFrame, documents: DataFrame) -> DataFrame:
    """Lines with text of the pages of scanned documents, with their kind and words. Repeated pages count once; null and empty ones have none."""
    scanned = documents.filter("is_scanned").select("doc_id").distinct()
    pages = ocr.select("ocr_id", "doc_id", "page_num", "text").join(scanned, "doc_id")
    sample = sampled(pages.filter(F.length("text").between(1, TRAIN_LETTERS)).select("ocr_id", "text"), "ocr_id", TRAIN_PAGES)
    body = [x for r in sample for x in r["text"].split("\n")[EDGE:-EDGE] if x.strip()]
    return materialise(pages.groupBy("doc_id").applyInArrow(_document(fit_furniture(body), fit_joiner(body)), _LINES_DDL))


def misread_words(lines: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(word, fix, at): words of the pages that are judged misread, the repaired form and where it differs first."""
    words = lines.select(F.explode("words").alias("w")).select("w.word").groupBy("word").agg(F.count("*").alias("n"))
    clean = paragraphs.select(F.explode("tokens").alias("word")).select(F.lower("word").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    pairs_of = "filter(transform(sequence(1, greatest(length({x}) - 1, 1)), i -> substring({x}, i, 2)), p -> p rlike '^[一-鿿]{{2}}$')"
    pairs = F.expr(pairs_of.format(x="text"))
    grams = lines.filter("kind = 'body' and text rlike '[一-鿿]'").select(F.explode(pairs).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    inner = clean.filter("word rlike '^[一-鿿]{3,}$'").select(F.explode(F.expr(pairs_of.format(x="word"))).alias("word"), "n")
    counts = materialise(words.union(clean).union(grams).union(inner).groupBy("word").agg(F.sum("n").alias("n")))
    latin = words.filter("not word rlike '[一-鿿]'").select("word").join(counts, "word")
    # a Chinese place is as common as the commoner of its two pairs of characters
    places = words.filter("word rlike '[一-鿿]'").select("word")
    candidates = materialise(latin.union(places.select("word", F.lit(0).cast("long").alias("n"))).mapInArrow(_candidates, "word string, n long, fix string, at int, op int"))
    plain = candidates.filter("not word rlike '[一-鿿]'").join(counts.select(F.col("word").alias("fix"), F.col("n").alias("n_fix")), "fix", "left")
    plain = plain.select("word", "n", "fix", "at", "op", F.coalesce("n_fix", F.lit(0)).alias("n_fix"))
    chinese = candidates.filter("word rlike '[一-鿿]'").select("word", "fix", "at", "op")
    keyed = chinese.select("word", "fix", "at", "op", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.substring(c, k, 2).alias("p")) for c, s in (("word", "n"), ("fix", "n_fix")) for k in (1, 2)])).alias("x"))
    keyed = keyed.select("word", "fix", "at", "op", "x.side", F.col("x.p").alias("p")).join(counts.select(F.col("word").alias("p"), "n"), "p", "left")
    chinese = keyed.groupBy("word", "fix", "at", "op").pivot("side", ["n", "n_fix"]).agg(F.max(F.coalesce("n", F.lit(0))))
    rows = plain.union(chinese.select("word", "n", "fix", "at", "op", "n_fix"))
    best = rows.groupBy("word").agg(F.max_by(F.struct("n", "fix", "at", "op", "n_fix"), F.struct("n_fix", F.length("fix"), "fix")).alias("b")).select("word", "b.*")
    best = materialise(best)
    sample = sampled(best, "word", TRAIN_WORDS)
    alternatives = {r["fix"]: r["n_fix"] for r in sample} | {r["word"]: r["n"] for r in sample}
    editor = fit_editor([(r["word"], r["n"]) for r in sample], alternatives)
    return best.mapInArrow(_judge(editor), "word string, fix string, at int")


def marked_lines(ocr: DataFrame, documents: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of page_lines(), and (ocr_id, line_no, word, fix) of the misread words on them."""
    lines = page_lines(ocr, documents)
    bad = misread_words(lines, paragraphs)
    words = lines.select("ocr_id", "line_no", F.explode("words").alias("w")).select("ocr_id", "line_no", "w.*").join(bad, "word")
    # a joined word's misread place may lie on the next line
    later = (F.col("cut") >= 0) & (F.col("at") >= F.col("cut"))
    marks = words.select(
        F.when(later, F.floor(F.col("next") / 100000)).otherwise(F.col("ocr_id")).alias("ocr_id"),
        F.when(later, F.col("next") % 100000).otherwise(F.col("line_no")).cast("int").alias("line_no"),
        "word",
        "fix",
        "cut",
    )
    return lines, marks


def found(ocr: DataFrame, documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(ocr_id, line_no, kind): hyphen, char, header and page_no lines of scanned documents' pages."""
    lines, marks = marked_lines(ocr, documents, paragraphs)
    furniture = lines.filter("kind <> 'body'").select("ocr_id", "line_no", "kind")
    hyphens = lines.filter("hyphen").select("ocr_id", "line_no", F.lit("hyphen").alias("kind"))
    return furniture.union(hyphens).union(marks.select("ocr_id", "line_no", F.lit("char").alias("kind"))).distinct()


def _repaired_line(text: str, fixes: dict[str, str], begin: int, end: int) -> str:
    """A line with its misread words between ``begin`` and ``end`` and its misread Chinese characters repaired."""
    if not fixes:
        return text
    wide = f" {text} "
    text = "".join(fixes.get(wide[j - 1 : j + 2], wide[j - 1 : j + 2])[1] for j in range(1, len(wide) - 1))
    return text[:begin] + _WORD.sub(lambda m: _cased(m[0], fixes.get(m[0].lower())), text[begin:end]) + text[end:]


def _join_lines(table: pa.Table) -> pa.Table:
    """One document's body lines, repaired and put together into paragraphs."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["page"], r["ocr_id"], r["line_no"]))
    paragraphs, now, joins = [], "", {}
    width = max((len(r["text"]) for r in rows), default=0)
    for r in rows:
        text = r["text"].strip()
        fixes = {f["word"]: f["fix"] for f in r["fixes"] or () if f["cut"] < 0}
        # a joined word's repair stands at the line of its misread place: the one before or this one
        before, joins = joins, {f["word"]: f["fix"] for f in r["fixes"] or () if f["cut"] >= 0}
        head = _WORD.match(text) if now.endswith("\x00") else None
        tail = _TAIL.search(text[:-1]) if r["hyphen"] else None
        # the parts of joined words are no words of this line
        begin = head.end() if head else 0
        end = max(begin, tail.start()) if tail else len(text)
        rest = _repaired_line(text, fixes, begin, end)
        if head:
            first = _TAIL.search(now[:-1])
            whole = (first[0] if first else "") + head[0]
            fix = (before | joins).get(whole.lower())
            now = now[: len(now) - 1 - len(whole) + len(head[0])] + _cased(whole, fix) + rest[begin:]
        elif now.endswith("\x00"):
            now = now[:-1] + rest
        elif now:
            now += rest if _CJK.match(now[-1]) and _CJK.match(text[:1] or " ") else f" {rest}"
        else:
            now = rest
        if r["hyphen"]:
            now = now[:-1] + "\x00"
        elif text and text[-1] in ".。!?！？" and len(r["text"]) < 0.8 * width:
            paragraphs.append(now)
            now = ""
    if now:
        paragraphs.append(now.rstrip("\x00"))
    return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "text": ["\n".join(paragraphs)]})


def _cased(word: str, fix: str | None) -> str:
    if fix is None:
        return word
    return fix.upper() if word.isupper() and len(word) > 1 else fix.capitalize() if word[:1].isupper() else fix


def repaired(ocr: DataFrame, documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, text): each scanned document's pages as continuous paragraphs, without furniture. Documents of blank pages give no row."""
    lines, marks = marked_lines(ocr, documents, paragraphs)
    fixes = marks.groupBy("ocr_id", "line_no").agg(F.collect_set(F.struct("word", "fix", "cut")).alias("fixes"))
    body = lines.filter("kind = 'body'").select("doc_id", "page", "ocr_id", "line_no", "text", "hyphen").join(fixes, ["ocr_id", "line_no"], "left")
    return body.groupBy("doc_id").applyInArrow(_join_lines, "doc_id long, text string")
