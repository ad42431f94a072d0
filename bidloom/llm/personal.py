"""Problem 7: personal information inside free text.

A linear-chain conditional random field over word-shape features, trained on the
labelled table of personal_labels.py and decoded by Viterbi in numpy batches. The
field reads every line of every text: tokens, their features and their scores are
made for all texts of a batch at once. A line is left out of the decoding only if
no token's score for any kind, with the most that moves between states can add,
reaches that for ordinary text, for then the best path is known. Found spans are
trimmed to whole values by their form.

Whether a word is common in contact persons' names is a feature among others: a
name that none of them has is found by its shape and what is around it.

Scale: one pass over the texts without a shuffle; only the found values are made
distinct. The words of names sent to all tasks are those of at least one in
NAMES_SHARE names, so their number is bounded whatever the table's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm import personal_labels
from bidloom.llm.crf import Crf, train
from bidloom.llm.sampling import sampled
from bidloom.llm.tokenize import _LETTER, _NUMBER, _SPACE, classes
from bidloom.llm.windows import Powers, codes, prefix
from bidloom.session import materialise

KINDS = ("person", "phone", "email", "id", "address")
STATES = 2 * len(KINDS) + 1
#: Bounds of the labelled table: sentences, lines without values, paragraphs that lines are taken from.
SENTENCES, OTHER, LINES = 4200, 2400, 1500
#: A word of names is known if it is in one of so many names, and in 5.
NAMES_SHARE = 2000
HASHED = 1 << 15
_CJK = re.compile(r"[⺀-鿿豈-﫿]")
CHUNK = 1 << 20
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
#: Lines with these are no examples of lines without values.
_DOUBTFUL = re.compile(r"\d{5}|[@＠]|\bat\b|电话|手机|身份证|邮箱|联系|签字|授权|女士|先生|持证|现住|送货|[A-ZÀ-Ý]\. [A-ZÀ-Ý]")
#: Words next to the values of the labelled table; lines with them may hold values.
_CUES = {w.lower() for f in personal_labels.FRAMES if re.search(r"\{(?:person|phone|email|id|address)\}", f) for w in re.findall(r"[^\W\d_]{4,}", re.sub(r"\{\w+\}", " ", f))} - {"pour", "para", "over", "sobre", "that", "about"}


def _lower() -> np.ndarray:
    """For each code point its lower-case form, where that is one character."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x10000):
        x = chr(c).lower()
        if len(x) == 1:
            out[c] = ord(x)
    return out


class Tokens:
    """The tokens of some texts: runs of letters, runs of digits, and all other characters but blanks alone. Lines are sequences."""

    _WORD, _DIGIT, _BLANK, _ONE = range(4)
    lower: np.ndarray | None = None

    def __init__(self, texts: list[str], powers: Powers) -> None:
        if Tokens.lower is None:
            Tokens.lower = _lower()
        self.flat, lengths = codes(texts)
        flat, n = self.flat, len(self.flat)
        kind = classes()[flat]
        wide = (flat >= 0x2E80) & (flat <= 0x9FFF) | (flat >= 0xF900) & (flat <= 0xFAFF)
        cls = np.full(n, self._ONE, np.uint8)
        cls[(kind == _LETTER) & ~wide] = self._WORD
        cls[kind == _NUMBER] = self._DIGIT
        cls[kind == _SPACE] = self._BLANK
        fresh = np.zeros(n + 1, bool)
        fresh[np.cumsum(lengths) - lengths] = True
        change = np.ones(n + 1, bool)
        change[1:n] = (cls[1:] != cls[:-1]) | fresh[1:n] | (cls[1:] == self._ONE)
        bounds = np.flatnonzero(change)
        self.start = bounds[:-1][cls[bounds[:-1]] != self._BLANK] if n else bounds[:0]
        self.end = bounds[1:][cls[bounds[:-1]] != self._BLANK] if n else bounds[:0]
        self.cls = cls[self.start] if n else cls
        self.ends = np.cumsum(lengths)
        self.text = np.searchsorted(self.ends, self.start, side="right")
        self.begin = (self.ends - lengths)[self.text] if n else self.start
        feeds = np.cumsum(np.concatenate([[0], (flat == 10) | (flat == 0x2028)]))
        line = feeds[self.start] + self.text if n else self.start
        m = len(self.start)
        first = np.ones(m, bool)
        first[1:] = (line[1:] != line[:-1]) | (self.text[1:] != self.text[:-1])
        self.sequence = np.cumsum(first) - 1
        self.first = np.flatnonzero(first)
        self.size = np.diff(np.append(self.first, m))
        self.gap = np.zeros(m, np.int64)
        self.gap[1:] = self.start[1:] > self.end[:-1]
        self.gap[self.first] = 2
        low = Tokens.lower[flat]
        sums = prefix(low, powers)
        up, _ = powers.upto(len(sums))
        size = self.end - self.start
        h = (sums[self.end] - sums[self.start]) * up[self.start] ^ (size.astype(np.uint64) << np.uint64(48))
        self.word = np.where(self.cls == self._DIGIT, np.minimum(size, 4).astype(np.uint64), h)
        at = np.maximum(self.end - 3, self.start)
        tail = (sums[self.end] - sums[at]) * up[at]
        self.suffix = np.where((self.cls == self._WORD) & (size > 4), ((tail ^ tail >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.int64) % 4093 + 1, 0)
        upper = np.cumsum(np.concatenate([[0], low != flat]))
        capitals, big = upper[self.end] - upper[self.start], (low != flat)[self.start] if n else self.start
        form = np.where(capitals == size, 0, np.where(capitals == 0, 1, np.where((capitals == 1) & big, 2, 3)))
        shape = form * 3 + np.where(size == 1, 1, np.where(size < 4, 2, 0))
        shape = np.where(self.cls == self._DIGIT, 12 + np.minimum(size, 20), shape)
        one = flat[self.start].astype(np.int64) if n else self.start
        shape = np.where(self.cls == self._ONE, np.where(wide[self.start] if n else False, 33, 34 + one % 200), shape)
        self.shape = shape.astype(np.int64)
        self.one = np.where(self.cls == self._ONE, one, 0)


class Features:
    """Feature ids of tokens."""

    def __init__(self, words: np.ndarray, gaz: np.ndarray, chars: np.ndarray) -> None:
        #: Sorted hashes of the words with features of their own and of the words of names; code points of characters of names.
        self.words, self.gaz, self.chars = words, gaz, chars

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table, x), max(0, len(table) - 1))
        return np.where(table[at] == x, at + 1, 0) if len(table) else np.zeros(len(x), np.int64)

    def ids(self, t: Tokens) -> np.ndarray:
        """(slots, tokens)."""
        n = len(t.start)
        at = np.arange(n)
        first, last = t.first[t.sequence], (t.first + t.size - 1)[t.sequence]
        w, s = self._find(self.words, t.word), t.shape
        g = np.where(self._find(self.gaz, t.word) > 0, 1, np.where(np.isin(t.one, self.chars) & (t.one > 0), 2, 0))

        def near(col: np.ndarray, k: int) -> np.ndarray:
            if not k:
                return col + 1
            p = at + k
            return np.where((p >= first) & (p <= last), col[np.clip(p, 0, n - 1)] + 1, 0)

        out, base = [], 1

        def add(x: np.ndarray, size: int) -> None:
            nonlocal base
            out.append(base + x)
            base += size

        wn, sn, gn = {k: near(w, k) for k in range(-4, 4)}, {k: near(s, k) for k in range(-2, 3)}, {k: near(g, k) for k in range(-1, 2)}
        after = near(t.gap, 1)
        for k in range(-3, 4):
            add(wn[k], len(self.words) + 3)
        for k in range(-2, 3):
            add(sn[k], 256)
        add(t.suffix, 4096)
        add(t.gap + 3 * after, 16)

        def cross(*cols: np.ndarray, salt: int) -> None:
            h = np.full(n, salt, np.uint64)
            for c in cols:
                h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            add((h % np.uint64(HASHED)).astype(np.int64), HASHED)

        cross(sn[-1], sn[0], t.gap, salt=1)
        cross(sn[0], sn[1], after, salt=2)
        cross(wn[-1], sn[0], salt=3)
        cross(wn[-2], wn[-1], salt=4)
        cross(gn[-1], gn[0], gn[1], sn[0], salt=5)
        cross(sn[-1], sn[0], sn[1], salt=6)
        cross(wn[-4], wn[-3], wn[-2], salt=7)
        cross(wn[-3], wn[-2], sn[0], salt=8)
        self.size = base
        return np.stack(out)


class Finder:
    """The trained field with its features."""

    def __init__(self, lines: list[str], gaz: list[str], chars: str) -> None:
        self.powers = Powers()
        given = [g for g in gaz if g[:1].isupper() and g.isalpha()][:150]
        plain = [x for x in lines if not _CJK.search(x)]
        table = personal_labels.labelled(plain, [x for x in lines if _CJK.search(x)], given, chars, SENTENCES)
        table += [(x, []) for x in lines[:OTHER]]
        texts = [t for t, _ in table]
        t = Tokens(texts, self.powers)
        known, seen = np.unique(t.word, return_counts=True)
        words = Tokens([g for g in gaz if g], self.powers).word
        self.features = Features(known[seen > 2], np.unique(words), np.array(sorted({ord(c) for c in chars}), np.int64))
        ids = self.features.ids(t)
        steps = int(t.size.max())
        step = np.arange(len(t.start)) - t.first[t.sequence]
        x = np.zeros((len(t.first), steps, len(ids)), np.int32)
        y = np.zeros((len(t.first), steps), np.int64)
        x[t.sequence, step] = ids.T
        begin, end = t.start - t.begin, t.end - t.begin
        rows = np.searchsorted(t.text, np.arange(len(texts) + 1))
        for i, (_, marks) in enumerate(table):
            own = slice(rows[i], rows[i + 1])
            for s, e, kind in marks:
                inside = np.flatnonzero((begin[own] >= s) & (end[own] <= e)) + rows[i]
                y[t.sequence[inside], step[inside]] = 2 * KINDS.index(kind) + 2
                y[t.sequence[inside[:1]], step[inside[:1]]] -= 1
        self.crf: Crf = train(x, t.size, y, self.features.size, STATES, rounds=8, rate=0.3)
        self.crf.emit = self.crf.emit.astype(np.float32)
        for k in range(len(KINDS)):  # a value's inside follows only its beginning or inside
            inside = 2 * k + 2
            self.crf.start[inside] = -50
            self.crf.move[[x for x in range(STATES) if x not in (inside - 1, inside)], inside] = -50
        # the most that moves into a state, and from it back to ordinary text, can add to a path
        stay = self.crf.move[0, 0]
        into = np.maximum((self.crf.move - stay).max(0), self.crf.start - self.crf.start[0])
        self.bonus = (into + np.maximum(self.crf.move[:, 0] - stay, 0))[1:].astype(np.float32)

    def states(self, t: Tokens) -> np.ndarray:
        """Each token's state on the best path of its line."""
        ids = self.features.ids(t)
        scores = np.zeros((len(t.start), STATES), np.float32)
        part = np.empty_like(scores[: 1 << 14])
        for k in range(0, len(scores), 1 << 14):  # stays in the cache
            own = scores[k : k + (1 << 14)]
            for slot in ids[:, k : k + (1 << 14)]:
                own += np.take(self.crf.emit, slot, axis=0, out=part[: len(own)], mode="clip")
        out = np.zeros(len(t.start), np.int8)
        hope = scores[:, 1] + self.bonus[0]
        for k in range(2, STATES):
            np.maximum(hope, scores[:, k] + self.bonus[k - 1], out=hope)
        hope = hope > scores[:, 0]
        order = np.flatnonzero(np.add.reduceat(hope, t.first) > 0)
        order = order[np.argsort(t.size[order], kind="stable")]
        for part in np.array_split(order, max(1, len(order) // 2048)) if len(order) else []:
            size = t.size[part]
            steps = int(size.max())
            grid = t.first[part][:, None] + np.minimum(np.arange(steps)[None], size[:, None] - 1)
            got = self.crf.viterbi(scores[grid], size)
            live = np.arange(steps)[None] < size[:, None]
            out[grid[live]] = got[live]
        return out

    def label(self, texts: list[str]) -> list[tuple[int, int, int, str]]:
        """(text, start, end, kind) of the values in the texts."""
        t = Tokens(texts, self.powers)
        if not len(t.start):
            return []
        states = self.states(t)
        marked = np.flatnonzero(states)
        out, now = [], None
        begin, end = t.start - t.begin, t.end - t.begin
        for k in marked.tolist():
            kind, inside, line = (int(states[k]) - 1) // 2, states[k] % 2 == 0, t.sequence[k]
            if now and inside and now[5] == line and now[3] == kind and now[4] == k - 1:
                now[2], now[4] = end[k], k
                continue
            if now:
                out.append(now)
            now = [int(t.text[k]), int(begin[k]), end[k], kind, k, line]
        if now:
            out.append(now)
        found = []
        for i, a, b, kind, *_ in out:
            text = texts[i]
            if v := checked(text, *self._whole(text, a, int(b), kind), KINDS[kind]):
                found.append((i, *v))
        return found

    def _whole(self, text: str, a: int, b: int, kind: int) -> tuple[int, int]:
        """A Chinese name with the characters of names beside it, up to four."""
        if KINDS[kind] != "person" or not _CJK.search(text[a:b]):
            return a, b
        known = self.features.chars
        chars = {chr(c) for c in known[np.isin(known, [ord(c) for c in text[max(0, a - 5) : b + 5]])]}
        size = sum(c.isalpha() for c in text[a:b])
        while size < 4 and b < len(text):
            gap = text[b] in " ·　" and size == 2
            if text[b + gap : b + gap + 1] not in chars or not text[b + gap : b + gap + 1]:
                break
            b, size = b + gap + 1, size + 1
        while size < 4 and a > 0 and text[a - 1] in chars:
            a, size = a - 1, size + 1
        return a, b


_EMAIL = re.compile(r"[\w.+\-]+\s?(?:@|＠|\[at\]|\(at\)|\{at\}|\bat\b)\s?[\w\-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\sdot\s)[\w\-]+)+", re.I)


_DIGITS = re.compile(r"(?:\+|\(|(?<![A-Za-z0-9.]))\d[\d ().\-/]*\d")
_ZH_ADDRESS = re.compile(r"(?:现住|送货至|住址|地址|至)?[\s:：]*((?:[一-鿿]{2,4}市)?[一-鿿]{2,4}[区县][一-鿿]{1,6}[路街巷道]\d+号(?:\d+(?:单元|栋|幢|楼|层|室|号))*)")
_LEFT = re.compile(
    r"((?:\b\d{1,4}[a-z]?(?: bis| ter)?,? (?:[a-zé]+ ){0,3}|\b(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Am|An der)(?: de| del)? (?:[A-ZÀ-Ý][a-zà-ÿ]+,? )?"
    r"|\b[A-ZÄÖÜ][a-zäöüß]+(?:str\.|straße|weg|allee|gasse|hof|platz) |\bFlat \d+, ))$"
)
#: Words and endings of street names.
_STREET = re.compile(
    r"(?i)str\.|stra(?:ß|ss)e|weg\b|hof\b|allee|gasse|platz\b|feld\b|ufer\b|ring\b|c/|\b(?:road|rd|street|st|lane|ln|avenue|ave|drive|way|square|court|close|terrace|rue|boulevard|bd|chemin|impasse|quai|place|allée|calle|avda|avenida|plaza|paseo|camino|ronda)\b"
)
_RIGHT = re.compile(r"(?: [A-D](?=,))?(?:,? (?:[A-Z]{1,2}-)?\d{5}\b)?(?:(?<=\d) |, )(?:Saint-|Sainte-)?[A-ZÀ-Ý][a-zà-ÿ]+(?:[ -][A-ZÀ-Ý][a-zà-ÿ]+(?=[,.;:)]|$| [A-Z]{2}\d))?(?: [A-Z]{2}\d \d[A-Z]{2})?(?![\w])|(?: [A-Z]{2}\d \d[A-Z]{2})\b")


def checked(text: str, a: int, b: int, kind: str) -> tuple[int, int, str] | None:
    """A found span trimmed to whole values, or None if it can't be of its kind."""
    while a < b and text[a] in " \t\n　:：;；,，。<>《》":
        a += 1
    while a < b and text[b - 1] in " \t\n　:：;；,，。<>":
        b -= 1
    value = text[a:b]
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        for m in _EMAIL.finditer(text, max(0, a - 40), min(len(text), b + 60)):
            if m.start() < b and m.end() > a:
                return m.start(), m.end(), kind
        return None
    if kind == "phone":
        for m in _DIGITS.finditer(text, max(0, a - 20), min(len(text), b + 20)):
            if m.start() < b and m.end() > a:
                a, b = m.span()
                if text[a:b].count("(") != text[a:b].count(")"):
                    cut = text.find(")", a, b)
                    a, b = (a, cut) if cut >= 0 and "(" not in text[a:cut] else (text.find("(", a, b) + 1, b) if cut < 0 else (a, b)
                break
        value = text[a:b].rstrip(" .-/")
        b = a + len(value)
        digits = sum(c.isdigit() for c in value)
        if digits > 15:
            return checked(text, a, b, "id")
        ok = 7 <= digits and not re.fullmatch(r"\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d\d-\d\d", value)
    elif kind == "id":
        while a and (text[a - 1].isalnum() and text[a - 1].isascii() or text[a - 1] == "*"):
            a -= 1
        while b < len(text) and (text[b].isalnum() and text[b].isascii() or text[b] == "*" or text[b] == "-" and text[b + 1 : b + 2].isupper()):
            b += 1
        value = text[a:b].rstrip("-.")
        b = a + len(value)
        digits = sum(c.isdigit() for c in value)
        ok = digits >= 5 and not re.match(r"\d{4}-\d", value)
    elif kind == "person":
        value = re.sub(r"^(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Sr|Sra)\.?\s+", "", value)
        a = b - len(value)
        if value[-1:] != "." and text[b : b + 1] == "." and re.search(r"[,\s][A-Z]$", value):
            b += 1
        letters = [w for w in re.findall(r"[^\W\d_]+", value)]
        ok = digits == 0 and (_CJK.search(value) or not re.search(r"[^\w\s.,'’\-]", value)) and (len(letters) > 1 if not _CJK.search(value) else len(re.sub(r"\W", "", value)) in (2, 3, 4, 5)) and any(len(w) > 2 or _CJK.search(w) for w in letters)
    elif _CJK.search(value):
        m = next((m for m in _ZH_ADDRESS.finditer(text, max(0, a - 16), min(len(text), b + 20)) if m.start() < b and m.end() > a), None)
        if not m:
            return None
        a, b = m.span(1)
        ok = True
    else:
        before = _LEFT.search(text, max(0, a - 40), a)
        if before:
            a = before.start(1)
        if text[b : b + 1] == "." and re.search(r"\W(?:St|Rd|Ave)$", text[a:b]):
            b += 1
        elif text[b - 1 : b] == "." and not re.search(r"\W(?:St|Rd|Ave)\.$", text[a:b]):
            b -= 1
        after = _RIGHT.match(text, b)
        if after:
            b = after.end()
        value = text[a:b]
        ok = any(c.isdigit() for c in value) and "\t" not in value and bool(re.search(r"[^\W\d_]{3}", value)) and bool(_STREET.search(value)) and not re.search(r"\d/\d|://|:", value)
    return (a, b, kind) if ok and b > a else None


def _span_rows(finder: Finder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column("para_id")
            sizes = np.cumsum([len(t) for t in texts])
            cuts = np.flatnonzero(np.diff(sizes // CHUNK)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
                part = texts[x:y]
                got = finder.label(part)
                t, a, b, k = zip(*got, strict=True) if got else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([i + x for i in t], pa.int64())), pa.array(k, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array([part[i][p:q] for i, p, q in zip(t, a, b, strict=True)], pa.string())],
                    names=["para_id", "kind", "start", "end", "value"],
                )

    return run


def finder(paragraphs: DataFrame, contacts: DataFrame, aliases: DataFrame) -> Finder:
    """The field, fitted for these tables: on made sentences around a bounded sample of lines, with the words that are common in contact names."""
    names = materialise(contacts.select(F.explode("contact_names").alias("name")).distinct())
    least = max(5, names.count() / NAMES_SHARE)
    words = names.select(F.explode(F.split("name", r"[^\p{L}]+")).alias("w")).filter(r"w rlike '^[\\p{L}&&[^⺀-鿿]]{3,}$'").groupBy("w").count()
    gaz = [r[0] for r in words.filter(F.col("count") >= least).orderBy(F.desc("count"), "w").collect()]
    gaz += [x for r in aliases.filter("kind = 'given'").select("formal", "alias").collect() for x in r if x]
    letters = names.select(F.explode(F.split("name", "")).alias("c")).filter("c rlike '[⺀-鿿]'").groupBy("c").count().filter(F.col("count") >= least)
    chars = "".join(sorted(r[0] for r in letters.select("c").collect() if r[0] not in "先生女士小姐经理博士"))
    sample = sampled(paragraphs.filter("length(text) between 40 and 2000").select("para_id", "text"), "para_id", LINES)
    known = {g.lower() for g in gaz}
    clean = [
        s.strip()[:200] for r in sample for s in re.split(r"(?<=[.。\n])\s*", r["text"]) if 15 < len(s) < 400 and not _DOUBTFUL.search(s) and not (known | _CUES) & {w.lower() for w in re.findall(r"[^\W\d_]+", s)}
    ]
    return Finder(clean, list(dict.fromkeys(gaz)), chars)


def spans(paragraphs: DataFrame, contacts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(para_id, kind, start, end, value): each place with personal data, in characters from the text's start. Null and empty texts have none."""
    rows = _span_rows(finder(paragraphs, contacts, aliases))
    return paragraphs.select("para_id", "text").mapInArrow(rows, "para_id long, kind string, start int, end int, value string")


def found(paragraphs: DataFrame, contacts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(para_id, kind, value), each once for a paragraph."""
    return spans(paragraphs, contacts, aliases).select("para_id", "kind", "value").distinct()


def redacted(paragraphs: DataFrame, contacts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(para_id, text, values): each paragraph with its values replaced by [PERSON], [PHONE], [EMAIL], [ID] and [ADDRESS]; the rest is unchanged, null stays null."""
    marks = spans(paragraphs, contacts, aliases).select("para_id", F.struct("start", "end", "kind").alias("m")).distinct().groupBy("para_id").agg(F.sort_array(F.collect_list("m")).alias("marks"))
    texts = paragraphs.select("para_id", "text").dropDuplicates(["para_id"]).join(marks, "para_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                parts, at = [], 0
                for m in own or ():
                    if text is not None and m["start"] >= at:
                        parts += [text[at : m["start"]], PLACEHOLDER[m["kind"]]]
                        at = m["end"]
                out.append(None if text is None else "".join([*parts, text[at:]]))
                n.append(len(own or ()))
            yield pa.RecordBatch.from_arrays([batch.column("para_id"), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["para_id", "text", "values"])

    return texts.mapInArrow(run, "para_id long, text string, values int")
