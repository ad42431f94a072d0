import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.llm import bpe, crf, names, packing, personal, personal_labels, tokenize, vectors
from bidloom.llm.perceptron import train as train_perceptron

ALIASES = [("Robert", "Bob", "given"), ("Eleanor", "Nell", "given"), ("Edward", "Ned", "given"), ("Construction", "Constr.", "trade"), ("Limited", "Ltd", "legal"), ("建设工程", "建工", "trade"), (None, None, None)]


def test_osa():
    assert names.osa("abcd", "abdc") == 1 and names.osa("abcd", "abc") == 1 and names.osa("abcd", "wxyz") == 3 and names.osa("", "ab") == 2


def test_bands_follow_the_collision_curve():
    b = names.bands(4, 0.5, 0.98)
    assert 1 - (1 - 0.5**4) ** b >= 0.98 > 1 - (1 - 0.5**4) ** (b - 1)


def test_names(spark):
    firms = ["Zobar & Trukel Construction Limited", "ZOBAR & TRUKEL CONSTRUCTION LTD", "Zobar Trukel Constr. Ltd", "Construction Zobar Trukel", "Zobra & Trukel Construction Limited", "Zobar & Minkel Construction Limited", "南江市华金建设工程有限公司", "华金(南江)建工公司", "华银(南江)建工公司", "Ltd", None, ""]
    people = ["Robert Tavomir", "Tavomir, Bob", "R. Tavomir", "Dr. Robert Tavomir", "Robert Tavomri", "Eleanor Tavomir", "Nell Tavomir", "王小明 先生", "王 小明", "王小红", None, " "]
    c = spark.createDataFrame([(n,) for n in firms], "bidder_name string")
    f = spark.createDataFrame([(None, people), (["南江市另名建设工程有限公司", "(南江)"], None), ([], [])], "company_names array<string>, contact_names array<string>")
    a = spark.createDataFrame(ALIASES, "formal string, alias string, kind string")
    got = {tuple(r) for r in names.found(c, f, a).collect()}

    def group(kind, xs):
        return {(kind, min(x, y), max(x, y)) for x in xs for y in xs if x != y}

    assert group("company", firms[:5]) <= got and not any("Minkel" in x + y for _, x, y in got)
    assert group("person", people[:5]) <= got and group("person", people[5:7]) <= got and group("person", people[7:9]) <= got
    assert not any("Eleanor" in x + y and "Robert" in x + y for _, x, y in got) and not any("王小红" in x + y for _, x, y in got)
    assert names.found(c.limit(0), f.limit(0), a).count() == 0


def test_vectors_find_the_nearest(spark):
    rng = np.random.default_rng(3)
    topics = rng.standard_normal((6, 384))
    base = topics[rng.integers(6, size=500)] / 19.6 + rng.standard_normal((500, 384)) / 19.6
    near = base[:150] + rng.standard_normal((150, 384)) / 19.6 * rng.uniform(0.2, 0.9, (150, 1))
    v = np.concatenate([base, near]) * rng.uniform(0.5, 2, (650, 1))
    rows = [(i, x.astype(float).tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 384), (902, [float("nan")] + [1.0] * 383), (903, [1.0] * 100), (0, v[0].tolist())]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, 1, kind="stable")[:, :10]
    want = {(min(i, j), max(i, j)) for i in range(650) for j in top[i].tolist() if s[i, j] >= 0.8}
    got = {tuple(r) for r in vectors.found(t).collect()}
    assert len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(got) + 1
    near = vectors.neighbours(t, F.col("vec_id") % 100 == 0).collect()
    hits = sum(r["other"] in top[r["vec_id"]] for r in near)
    assert hits >= 0.9 * 70
    assert vectors.found(t.limit(0)).count() == 0


TEXTS = ["", None, "plain words, and more words.", "it's we'll I'M 's 'tis don''t's  \n's x  'll  ", "a  b　　c \x1c\x1d d", "<|endoftext|> hi", "\r\n\r\n  x", " " * 500 + "a", "aaaa" * 500, "你好世界" * 50, "😀👩‍👩‍👧é́", "1234567 ½ ٣"]


def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenize.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_public_library_s(spark):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice("ab '\n\ts19é中😀.,  　́re vll") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: list(r[1]) for r in tokenize.encode(d).collect()}
    want = [x.ids for x in tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == dict(enumerate(want))
    back = dict(tuple(r) for r in tokenize.decode(tokenize.encode(d)).collect())
    assert back == {k: t or "" for k, t in enumerate(texts)}


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_long_pieces_of_one_hash_are_told_apart(spark):
    # these pairs collide in every polynomial hash modulo 2**64
    texts = [thue_morse(n, *p) for n in (1024, 2048, 4096) for p in ("ab", "ba")] * 2
    got = [list(r["ids"]) for r in tokenize.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [x.ids for x in tokenizer().encode_batch(texts, add_special_tokens=False)]


def test_transducer_equals_merging():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cc": 259, b"abab": 260}
    t = bpe.Transducer(ranks)
    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        assert t.encode(s) == t.merged(s.encode())


def test_utf8_stream_in_any_portions():
    rng = random.Random(2)
    text = "aé中😀" * 20
    data, stream, out, at = text.encode(), bpe.Utf8Stream(), "", 0
    while at < len(data):
        n = rng.randint(1, 3)
        out += stream.feed(data[at : at + n])
        at += n
    assert out + stream.end() == text
    assert bpe.Utf8Stream().feed(b"\xff\xfea") == "��a"


def test_containers(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([3, 7, 20, 50, 99, 100, 130, 250])) for i in range(400)] + [(1000, 0), (1001, 100), (1001, 100)]
    specs = spark.createDataFrame([(1, 100), (2, 300), (3, None), (4, 0), (1, 100)], "spec_id int, capacity int")
    s = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    got = packing.fill(s, specs).collect()
    for spec, cap in ((1, 100), (2, 300)):
        mine = [r for r in got if r["spec_id"] == spec]
        load, docs = {}, {}
        for r in mine:
            load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
            docs.setdefault(r["doc_id"], []).append(r["tokens"])
        assert max(load.values()) <= cap
        assert {d: sum(x) for d, x in docs.items()} == {d: n for d, n in sizes if n}
        assert all(len(docs[d]) == max(1, -(-n // cap)) for d, n in sizes if n)
        assert sum(load.values()) / len(load) / cap > 0.9
    assert packing.fill(s.limit(0), specs).count() == 0


def test_plan_fills_exactly_where_it_can():
    counts = np.zeros(11, np.int64)
    counts[[1, 2, 3, 4, 6, 7]] = 2, 2, 2, 2, 2, 2
    plan = packing.plan(counts)
    assert sum(t for t, _ in plan) == 5 and all(sum(x) <= 10 for _, x in plan)
    used = np.zeros(11, np.int64)
    for t, xs in plan:
        for x in xs:
            used[x] += t
    assert (used == counts).all()


def test_random_field_learns_and_decodes():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 4, (200, 9, 1))
    y = (np.cumsum(x[..., 0] == 3, axis=1) > 0).astype(int)  # the state stays on after the first 3
    lengths = rng.integers(2, 10, 200)
    m = crf.train(x, lengths, y, 4, 2, rounds=80)
    got = m.viterbi(m.scores(x), lengths)
    live = np.arange(9)[None] < lengths[:, None]
    assert (got == y)[live].mean() > 0.98 and (got[~live] == -1).all()


def test_viterbi_finds_the_best_path_of_rows_of_any_length():
    rng = np.random.default_rng(5)
    m = crf.Crf(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    for rows in (3, 120):
        lengths = rng.integers(0, 7, rows)
        scores = rng.normal(size=(rows, 6, 3))
        got = m.viterbi(scores, lengths)
        for i, n in enumerate(lengths.tolist()):
            value = lambda p: m.start[p[0]] + sum(scores[i, t, x] for t, x in enumerate(p)) + sum(m.move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
            assert (got[i, n:] == -1).all()
            if n:
                assert tuple(got[i, :n]) == max(itertools.product(range(3), repeat=n), key=value)


def test_perceptron_learns():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (400, 3))
    y = (x == 5).any(1).astype(int)
    assert (train_perceptron(x, y, 6, 2).predict(x) == y).mean() > 0.95


@pytest.fixture(scope="module")
def found_personal(spark):
    table = personal_labels.labelled(["The bridge is built in time, while the roof waits"], ["工程按时完成并通过验收"], personal_labels.GIVEN, "安平文博思远嘉宁子轩若兰", 330, seed=77)
    rows = [(i, t) for i, (t, _) in enumerate(table)] + [(900, None), (901, ""), (902, "x" * 5000), (0, table[0][0])]
    p = spark.createDataFrame(rows, "para_id long, text string")
    c = spark.createDataFrame([([f"{g} Vandomir{k}" for g in personal_labels.GIVEN for k in "abcdef"],), (["安平文博", "思远嘉宁", "子轩若兰"] * 3,), (None,)], "contact_names array<string>")
    a = spark.createDataFrame(ALIASES, "formal string, alias string, kind string")
    return table, p, c, a


def test_personal_data_held_out(spark, found_personal):
    table, p, c, a = found_personal
    got = {tuple(r) for r in personal.found(p, c, a).collect()}
    want = {(i, k, t[s:e]) for i, (t, marks) in enumerate(table) for s, e, k in marks}
    hit = len(got & want)
    assert hit / len(want) > 0.8 and hit / len(got) > 0.8


def test_redaction_changes_only_the_values(spark, found_personal):
    table, p, c, a = found_personal
    out = {r["para_id"]: r["text"] for r in personal.redacted(p, c, a).collect()}
    assert out[900] is None and out[901] == "" and out[902] == "x" * 5000
    spans = {}
    for r in personal.spans(p, c, a).distinct().collect():
        spans.setdefault(r["para_id"], []).append(r)
    for i, (t, _) in enumerate(table[:100]):
        want = t
        for r in sorted(spans.get(i, []), key=lambda r: -r["start"]):
            want = want[: r["start"]] + f"[{r['kind'].upper()}]" + want[r["end"] :]
        assert out[i] == want


def test_values_in_frames_that_the_table_does_not_have(spark, found_personal):
    _, p, c, a = found_personal
    finder = personal.finder(p, c, a)
    table = [
        ("We met Quentin Zabrowski on site yesterday", "person", "Quentin Zabrowski"),
        ("Kaltrina Vukovic asked for the plans again.", "person", "Kaltrina Vukovic"),
        ("Please forward everything to jane.doe@mail.example before noon", "email", "jane.doe@mail.example"),
        ("The invoices go to bau-team(at)norwick.test from now on.", "email", "bau-team(at)norwick.test"),
        ("She can be reached on +49 351 4567890 in the evening", "phone", "+49 351 4567890"),
    ]
    got = [(t, k, t[x:y]) for t, _, _ in table for _, x, y, k in finder.label([t])]
    assert len(set(got) & set(table)) >= 4 and len(set(got) - set(table)) <= 1
    assert table[0] in got and table[1] in got
    assert finder.label(["The roof of the bridge is built in time, while lot 42 waits.", "", "\n \n"]) == []
