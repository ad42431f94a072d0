import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bidloom.llm import repeated_lines, repetition, scans, shared_spans, term_weights

P = "para_id long, doc_id long, para_index int, text string, tokens array<string>, extra string"
D = "doc_id long, source string, text string, total_text_length long, is_scanned boolean"


def para(spark, rows):
    return spark.createDataFrame([(i, d, i, t, k, None) for i, d, t, k in rows], P)


def docs(spark, rows):
    return spark.createDataFrame(rows, D)


def test_repeated_lines_and_blocks(spark):
    notice = "Share This: page 1\nAll rights reserved!"
    rows = [(10 * d, d, f"{notice.replace('1', str(d))}\nown line {chr(96 + d)} here", []) for d in range(1, 6)]
    rows += [(100, 6, None, None), (101, 7, "", []), (102, 8, "12345\n---", []), (10, 1, rows[0][2], [])]
    p, d = para(spark, rows), docs(spark, [(i, "s", None, None, None) for i in range(1, 8)] + [(8, None, None, None, None)])
    got = {tuple(r) for r in repeated_lines.found(p, d).collect()}
    assert got == {(10 * i, n) for i in range(1, 6) for n in (0, 1)}
    blocks = {(r["para_id"], r["line_no"], r["size"]): r["docs"] for r in repeated_lines.repeated_blocks(p, d).collect()}
    assert blocks[10, 0, 2] == 5 and blocks[10, 1, 1] == 5
    clean = {r["para_id"]: (r["text"], r["lines_removed"]) for r in repeated_lines.cleaned(p, d).collect()}
    assert clean[10] == ("own line a here", 2) and clean[100] == (None, 0) and clean[101] == ("", 0)
    assert repeated_lines.found(p.limit(0), d).count() == 0


def test_blocks_longer_than_the_first_depth_are_found_whole(spark):
    block = [f"notice {chr(97 + k)} of the portal" for k in range(21)]
    rows = [(k, k, "\n".join([f"own {chr(97 + k)} line", *block[: 21 if k < 4 else 13]]), 0) for k in range(7)]
    d = docs(spark, [(k, "x", None, None, None) for k in range(7)])
    p = spark.createDataFrame([(a, b, i, t, None) for a, b, t, i in rows], "para_id long, doc_id long, para_index int, text string, tokens array<string>")
    got = {(r["size"], r["blocks"], r["docs_max"]) for r in repeated_lines.blocks_report(p, d).collect()}
    assert got == {(n, 22 - n, 7 if n <= 13 else 4) for n in range(1, 22)}


def test_repeated_lines_need_a_fifth_of_the_source(spark):
    rows = [(d, d, "the same line" if d <= 3 else f"line {chr(96 + d)}", []) for d in range(1, 17)]
    d = docs(spark, [(i, "s", None, None, None) for i in range(1, 17)])
    assert repeated_lines.found(para(spark, rows), d).count() == 0
    assert repeated_lines.found(para(spark, rows[:15]), d).count() == 3


def brute_spans(rows, span):
    at = defaultdict(set)
    for p, d, t, _ in rows:
        for i in range(len(t or "") - span + 1):
            at[t[i : i + span]].add((p, d))
    return {(min(a, b)[0], max(a, b)[0]) for s in at.values() for a in s for b in s if a[1] != b[1]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_spans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdef 世界") for _ in range(n))
    long, edge, short = text(500), text(200), text(199)
    rows = []
    for k in range(40):
        t = text(rng.randint(0, 300))
        extra = rng.choice([long[rng.randint(0, 100) :][: rng.randint(150, 400)], edge, short, short + "x", "ab" * 200, ""])
        rows.append((k, k % 25, t[:100] + extra + t[100:], []))
    rows += [(100, 1, None, None), (101, 2, "", []), (102, 3, "ab" * 300, []), (103, 4, "a" * 500, []), (104, 5, "a" * 201, []), rows[0]]
    got = {tuple(r) for r in shared_spans.found(para(spark, rows)).collect()}
    assert got == brute_spans(rows, 200)


def test_shared_parts(spark):
    s = "".join(random.Random(5).choice("abcdefgh") for _ in range(300))
    rows = [(1, 1, s + "x" * 100, []), (2, 2, "y" * 50 + s, []), (3, 3, "nothing", [])]
    d = docs(spark, [(1, "s", None, 400, None), (2, "s", None, None, None), (3, "s", None, 7, None)])
    got = {r["doc_id"]: (r["shared_chars"], r["total_chars"], r["share"]) for r in shared_spans.shared_parts(para(spark, rows), d).collect()}
    assert got == {1: (300, 400, 0.75), 2: (300, 350, round(300 / 350, 6))}
    assert shared_spans.found(para(spark, rows).limit(0)).count() == 0


def test_terms(spark):
    rows = [(i, i, "t", ["Common", "—Rare,"] if i < 3 else ["common"]) for i in range(1, 9)] + [(20, 1, "t", None), (1, 1, "t", ["Common", "—Rare,"])]
    m = spark.createDataFrame([(1, 1, 2, ["RARE", "common", "rare.", "gone", "", "!!", None]), (1, 1, 2, ["RARE"]), (2, 1, 3, ["rare"]), (3, 4, 5, None), (4, 4, 5, [])], "match_id long, doc_a long, doc_b long, shared_rare_words array<string>")
    got = {(r["match_id"], r["term"]): r for r in term_weights.term_scores(m, para(spark, rows)).collect()}
    assert set(got) == {(1, "rare"), (1, "common"), (1, "gone"), (2, "rare")}
    assert (got[1, "rare"]["docs"], got[1, "common"]["docs"], got[1, "gone"]["docs"]) == (2, 8, 0)
    assert got[1, "rare"]["score"] > got[1, "common"]["score"] > got[1, "gone"]["score"] == 0
    assert got[1, "rare"]["tf_a"] == 1
    assert {tuple(r) for r in term_weights.found(m, para(spark, rows)).collect()} == {(1, "rare")}
    assert term_weights.term_scores(m.limit(0), para(spark, rows)).count() == 0


def brute_repetition(t):
    s = [c for c in (t or "").lower() if c.isalpha()]
    seen, cover = set(), [False] * len(s)
    for i in range(len(s) - 39):
        g = tuple(s[i : i + 40])
        if g in seen:
            cover[i : i + 40] = [True] * 40
        seen.add(g)
    return sum(cover) / max(1, len(s))


def test_repetition_equals_brute_force(spark):
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(12))
    texts = []
    for k in range(60):
        own = [line() for _ in range(rng.randint(1, 12))]
        texts.append("\n".join(own + [rng.choice(own) for _ in range(rng.choice([0, 0, 1, len(own), 3 * len(own)]))]))
    phrase = line()[:64]
    texts += [" ".join(f"{line()[:90]} {phrase}" for _ in range(30)), "\n".join(f"{phrase} {line()[:70]}" for _ in range(9))]
    texts += [None, "", "   ", "1234 5678", "a" * 400, "短文本" * 100, line() * 3000]
    d = docs(spark, [(k, None, t, None, None) for k, t in enumerate(texts)])
    got = {r["doc_id"] for r in repetition.found(d).collect()}
    assert got == {k for k, t in enumerate(texts) if brute_repetition(t) >= 0.3}
    shares = repetition.shares(d).collect()
    assert sum(r["letters"] == 0 for r in shares) == 4
    assert all(abs(r["repeated_share"] - brute_repetition(texts[r["doc_id"]])) < 1e-9 for r in shares)
    assert repetition.found(d.limit(0)).count() == 0


def test_scanned_pages(spark):
    rng = random.Random(6)
    words = "the bridge remains with supplier while each modular network covers foundation of electrical server and provisional permit documents".split()
    pages, ocr = [], 0
    for doc in range(1, 13):
        for p in range(4):
            body = [" ".join(rng.choice(words) for _ in range(9)) + ("." if rng.random() < 0.4 else "") for _ in range(20)]
            body[5], body[6] = "each modular network covers the electri-", "cal server and the provisional permit"
            if p == 1:
                body[8] = body[8].split(" ", 1)[0] + " e1ectrical supplicr remains"
            pages.append((ocr, doc, p + 1, "\n".join([f"Annual Report of Company {chr(64 + doc)}{chr(64 + doc)}orp", *body, f"- {p + 3} -"])))
            ocr += 1
    pages += [(900, 1, 9, None), (901, 1, None, ""), (902, 50, 1, "not scanned -\n1"), pages[0]]
    o = spark.createDataFrame(pages, "ocr_id long, doc_id long, page_num int, text string")
    d = docs(spark, [(i, None, None, None, True) for i in range(1, 13)] + [(50, None, None, None, None)])
    p = para(spark, [(i, i, "t", words) for i in range(100, 130)])
    got = {tuple(r) for r in scans.found(o, d, p).collect()}
    assert {(k, 0, "header") for k in range(48)} <= got and {(k, 21, "page_no") for k in range(48)} <= got
    assert {(k, 6, "hyphen") for k in range(48)} == {x for x in got if x[2] == "hyphen"}
    chars = {x[:2] for x in got if x[2] == "char"}
    assert chars == {(k, 9) for k in range(48) if k % 4 == 1}
    text = scans.repaired(o, d, p).filter("doc_id = 1").first()["text"]
    assert "the electrical server" in text and "Annual Report" not in text and "electrical supplier remains" in text
    assert scans.found(o.limit(0), d, p).count() == 0


def test_joined_words_and_line_edges_are_repaired(spark, monkeypatch):
    rows = [(1, 1, 0, 0, "The  Iicence of the mainte-", True), (1, 1, 0, 1, "uauce crew was givcn. The COMPU-", True), (1, 1, 0, 2, "TFR room", False), (1, 1, 0, 3, "材科的目录和材科", False)]
    lines = spark.createDataFrame([(*r, "body") for r in rows], "doc_id long, ocr_id long, page int, line_no int, text string, hyphen boolean, kind string")
    fixes = [(0, "iicence", "licence", -1), (1, "maintenauce", "maintenance", 6), (1, "maintenauce", "x", -1), (1, "maintеuauce", "y", 6), (0, "mainteuauce", "maintenance", 6), (1, "givcn", "given", -1)]
    fixes += [(2, "computfr", "computer", 5), (2, "tfr", "wrong", -1), (3, " 材科", " 材料", -1), (3, "材科 ", "材料 ", -1), (3, "材科的", "材料的", -1)]
    marks = spark.createDataFrame([(1, *f) for f in fixes], "ocr_id long, line_no int, word string, fix string, cut int")
    monkeypatch.setattr(scans, "marked_lines", lambda *_: (lines, marks))
    text = scans.repaired(None, None, None).first()["text"]
    assert text == "The  Licence of the maintenance crew was given. The COMPUTER room 材料的目录和材料", text
