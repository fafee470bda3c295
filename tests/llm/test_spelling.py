"""Spelling variants against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from eventspark.llm import spelling

LONG = "".join(random.Random(3).choice("abcdefgh") for _ in range(5000))


def plain_words(docs, least=6):
    totals = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                totals[run] += 1
    return totals


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    n = {w: k for w, k in plain_words(docs).items() if k >= 5}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n}


def made(seed, words=150, rows=60):
    """Words of a few letters with variants in chains, upper case and letters beyond ASCII."""
    r = random.Random(seed)
    pool = ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababàb", "Àbabab", "×÷abcd", LONG, LONG[:-1]]
    while len(pool) < words:
        w = r.choice(pool) if r.random() < 0.6 else "".join(r.choice("abÿc") for _ in range(r.randint(5, 9)))
        i = r.randrange(len(w))
        pool.append(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abZ") + w[i:], w[:i] + "b" + w[i + 1 :]]))
    weight = [5 ** r.randint(0, 4) for _ in pool]
    texts = [" ".join(r.choices(pool, weight, k=400)) for _ in range(rows)]
    extra = [None, "", "5 - 6", "short one", texts[0], f"{LONG} {LONG[:-1]} " * 5]
    return [(None if k == 3 else k // 2, t) for k, t in enumerate(texts + extra)]


def rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize(("seed", "block"), [(1, 2048), (3, 7)])
def test_variants(spark, seed, block):
    docs = made(seed)
    frame = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int")
    want = plain_variants(docs)
    df = spelling.variants(frame, block=block)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    out = df.collect()
    assert len(out) == len(want) and rows(df) == want
    assert any(f and want[f][0] for f, *_ in want.values()), "no chain in the fixture"


def test_query_equals_plain_python(spark):
    from eventspark.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert rows(QUERIES["op12_spelling_tiles"](spark, d)) == plain_variants(docs)


def test_no_words(spark):
    for data in ([], [(1, None)], [(1, "")], [(None, "few words here")]):
        frame = spark.createDataFrame(data, "doc_id long, text string")
        assert spelling.variants(frame).collect() == []


def test_words_are_counted_in_parts(spark, monkeypatch):
    docs = made(5, rows=20)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(spelling, "HELD", 3)
    got = Counter()
    for r in spelling.counted_words(frame).collect():
        got[r.word] += r.n
    assert got == plain_words(docs)


@pytest.mark.parametrize("prefix", [True, False])
def test_pairs_of_a_bucket(prefix, monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 200)
    r = random.Random(9)
    words = sorted({"".join(r.choice("abc") for _ in range(r.choice((5, 6)))) for _ in range(150)})

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    for split in (None, 40):
        pairs = itertools.combinations(range(len(words)), 2) if split is None else itertools.product(range(40), range(40, len(words)))
        want = {
            p
            for p in pairs
            if max(len(words[x]) for x in p) == 6
            and one_edit(*(words[x] for x in p))
            and (common(*(words[x] for x in p)) >= 3) == prefix
        }
        a, b = spelling.near_pairs(words, 6, split, prefix)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)
