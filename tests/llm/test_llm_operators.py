"""Training-data operators against brute force, round trips and hand-written edge cases."""

import binascii
import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventspark.llm import (
    backoff_lm,
    bpe_fst,
    chat,
    embedding_tiles,
    graph,
    joins,
    line_dedup,
    minhash_forest,
    packing,
    quality_rules,
    warc,
    weak_quality,
    words,
)
from eventspark.llm.queries import BYTE_BPE, CHAT_BPE, WORD_BPE

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (None, "null id has a text of six words"), (7, LONG)]
SCHEMA = "doc_id long, text string"


def docs(spark, rows, lang="en"):
    """With columns whose names the operators use inside."""
    extra = {"key": F.lit(1), "cid": F.lit("c"), "chunk": F.lit(2), "score": F.lit(0.5), "root": F.lit("r")}
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({"lang": F.lit(lang), "source": F.lit("s"), "n_chars": F.lit(1), **extra})


# --- words and graph --------------------------------------------------------------------------------------------------


def test_shingle_sets_are_those_of_the_definition():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choices("aAbBé \n\t\x0b\x1c\xa0", k=r.randint(0, 60)))
        w = text.encode().lower().split()
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(words.shingles(text.encode())) == len(want)
    assert words.word_hashes(b"AB ab\x0bAb")[0] == words.word_hashes(b"x ab")[1]


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (2000, 2001), (2001, 2000)]
    edges += [(r.randint(5000, 5400), r.randint(5000, 5400)) for _ in range(250)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = lambda of: {frozenset(v for _, v in g) for _, g in itertools.groupby(sorted((of(x), x) for x in got), lambda p: p[0])}
    assert groups(got.get) == groups(find)
    assert set(got) == {x for e in edges for x in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: MinHash forest ------------------------------------------------------------------------------------------------


def brute_components(rows, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted((repr(rows[i][0]), len(sets[i]), repr(least[find(i)])) for i in range(len(rows)))


def near_rows():
    """A chain of near copies of growing distance, a crowd of near copies of one text, exact copies, edges."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    rows = list(EDGES)
    base = [word() for _ in range(200)]
    for i in range(25):
        rows.append((100 + i, " ".join(base)))
        base[r.randrange(200)] = word()
    crowd = [word() for _ in range(150)]
    for i in range(300):
        mine = list(crowd)
        for _ in range(r.randint(0, 4)):
            mine[r.randrange(150)] = word()
        rows.append((1000 + i, " ".join(mine)))
    rows += [(2000 + i, "exactly the same text of a few words again") for i in range(40)] + [(2000, "another text")]
    rows += [(3000 + i, " ".join(word() for _ in range(60))) for i in range(60)]
    return rows


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "TILE", 32)
    monkeypatch.setattr(minhash_forest, "CROWD", 5)
    rows = near_rows()
    got = minhash_forest.near_duplicates(docs(spark, rows)).collect()
    assert sorted((repr(x.doc_id), x.n_shingles, repr(x.component_id)) for x in got) == brute_components(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_duplicates_of_nothing(spark):
    assert minhash_forest.near_duplicates(docs(spark, [])).collect() == []


def test_regions_of_other_documents_are_not_taken_for_the_same(spark):
    """Two pairs of documents whose sums of 40-bit hashes are equal."""
    n = 4000
    low = spark.range(n).select((F.xxhash64("id") % 2**40).alias("low")).toPandas()["low"].to_numpy()
    a, b = np.triu_indices(n, 1)
    order = np.argsort(low[a] + low[b], kind="stable")
    equal = order[np.flatnonzero(np.diff((low[a] + low[b])[order]) == 0)[0] :][:2]
    pairs = [(k, int(c), int(c)) for k, x in enumerate(equal) for c in (a[x], b[x])]
    assert len({c for _, c, _ in pairs}) == 4
    stats = minhash_forest._stats(spark.createDataFrame(pairs, "region long, cid long, group long"))
    assert stats.drop("region", "top").distinct().count() == 2


# --- 2: byte-level BPE ------------------------------------------------------------------------------------------------


def reference_encoding():
    ranks = bpe_fst.read_ranks(BYTE_BPE)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_agrees_and_round_trips(spark):
    enc, made = reference_encoding(), bpe_fst.codec(BYTE_BPE, P.PATTERN)
    r = random.Random(5)
    letters = list("aaabcthe  \n\t.,-!0123'sé漢字😀мир") + ["://", "----", "    "]
    texts = ["".join(r.choices(letters, k=r.randint(0, 80))) for _ in range(400)]
    texts += ["a" * 20_000, "-" * 9_000, " " * 5_000, LONG, "", "<|endoftext|>"]
    texts += [x.text for x in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    for text in texts:
        ids = made.encode(text).tolist()
        assert ids == enc.encode_ordinary(text)
        assert "".join(made.decode_stream(ids, every=1)) == text


def test_tables_that_start_anew_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe_fst, "MAX_STATES", 50)
    monkeypatch.setattr(bpe_fst, "MAX_PIECES", 10)
    monkeypatch.setattr(bpe_fst, "SETTLE", 300)
    made, enc = bpe_fst.Codec(bpe_fst.read_ranks(BYTE_BPE), P.PATTERN), reference_encoding()
    for text in ("ab" * 3000, LONG[:5000], "x" + "-" * 2000):
        assert made.encode(text).tolist() == enc.encode_ordinary(text)


def test_bpe_rows(spark):
    enc = reference_encoding()
    got = {x.doc_id: x for x in bpe_fst.digests(docs(spark, EDGES), BYTE_BPE, P.PATTERN).collect()}
    for doc, text in EDGES:
        ids = np.array(enc.encode_ordinary(text or ""), "<u4")
        assert got[doc].n_tokens == len(ids) and got[doc].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    both = bpe_fst.decode(bpe_fst.encode(docs(spark, EDGES), BYTE_BPE, P.PATTERN), BYTE_BPE, P.PATTERN)
    assert all(x.decoded == (x.text or "") for x in both.collect())
    assert bpe_fst.digests(docs(spark, []), BYTE_BPE, P.PATTERN).count() == 0


# --- 3: language model ------------------------------------------------------------------------------------------------


def test_scores_against_plain_counts(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{DIR}/documents.parquet").collect()] + EDGES + [(5, "one")]
    m = 8.0
    got = backoff_lm.scores(docs(spark, rows), prior=m, chunk_bytes=40_000).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: d is not None and binascii.crc32(str(d).encode()) % 7 == 2
    train = [tokens(t) for d, t in rows if not held(d)]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([0, *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    before = {**c, 0: len(train)}
    p = lambda w: (c[w] + 1) / (n + v + 1)
    want = []
    for d, t in rows:
        x = tokens(t)
        score = sum(math.log10((pairs[h, w] + m * p(w)) / (before.get(h, 0) + m)) for h, w in zip([0, *x], x, strict=False))
        want.append((repr(d), held(d), len(x), sum(c[w] > 0 for w in x), n, sum(math.log10(p(w)) for w in x), score))
    got = sorted((repr(g.doc_id), *g[1:]) for g in got)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    unknown = math.log10(1 / (n + v + 1))
    assert sum(10 ** (unknown if w is ... else math.log10(p(w))) for w in [*c, ...]) == pytest.approx(1)
    assert backoff_lm.scores(docs(spark, [])).collect() == []


def test_automaton_walks_like_a_plain_one(monkeypatch):
    """States, arcs and failure arcs as data: a text at a time, word by word, gives the same as all abreast and in pieces."""
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefg") for _ in range(n)).encode() for n in (0, 1, 5, 40, 700)]
    learns = np.array([True, False, True, True, False])
    chunk = backoff_lm.Chunk(texts, learns)
    words, pairs = (x.astype(np.int64) for x in chunk.own)
    n, v, starts = int(words.sum()), int((words > 0).sum()), 3
    made = backoff_lm.Automaton(chunk, words, pairs, n, v, starts, 4.0)
    arcs = {divmod(int(a), made.n_words): w for a, w in zip(made.arcs, made.arc_weight, strict=True)}

    def plain(tokens):
        state, total = made.start, 0.0
        for w in tokens:
            while (state, w) not in arcs and state:
                total, state = total + made.fail_weight[state], int(made.fails_to[state])
            total += arcs[state, w] if state else made.empty_arcs[w]
            state = w + 1
        return total

    tokens = [chunk.at[0][a : a + n].tolist() for a, n in zip(chunk.first, chunk.n_tokens, strict=True)]
    for piece in (256, 3):
        monkeypatch.setattr(backoff_lm, "PIECE", piece)
        assert made.walk(chunk.at[0], chunk.first, chunk.n_tokens) == pytest.approx([plain(t) for t in tokens], rel=1e-12)
    assert len(arcs) == len(made.arcs) and (made.fails_to == 0).all()
    # what leaves a state: its arcs, and the failure arc times what the empty state has beyond them
    for state in {s for s, _ in arcs}:
        own = {w: 10**x for (s, w), x in arcs.items() if s == state}
        rest = 1 - sum(10 ** made.empty_arcs[w] for w in own)
        assert sum(own.values()) + 10 ** made.fail_weight[state] * rest == pytest.approx(1)


def test_held_out_texts_are_more_likely_than_by_single_words(spark):
    held = backoff_lm.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    x = held.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert x.s > x.b


# --- 4: quality rules -------------------------------------------------------------------------------------------------


def test_counts_of_single_texts(spark):
    gram = "a b c d e f g h"
    rows = [*EDGES, (10, f"{gram} x {gram}"), (11, "q " * 30), (12, "A!! #$\nA!! #$\n\n\nA!! #$ "), (13, f"{gram} i {gram} i")]
    got = {x.doc_id: x for x in quality_rules.measures(docs(spark, rows)).collect()}
    assert got[10].n_repeat_words == 16 and got[11].n_repeat_words == 30 and got[13].n_repeat_words == 18
    assert (got[12].n_dup_lines, got[12].n_symbols, got[12].n_words, got[12].word_chars) == (1, 6, 6, 15)
    assert (got[1].n_words, got[2].n_words, got[3].n_words, got[3].n_lines) == (0, 0, 0, 0)
    assert got[7].n_words == 30_000


def test_tail_is_the_binomial_one(spark):
    for k, n, p in ((0, 10, 0.1), (3, 10, 0.1), (10, 10, 0.5), (40, 5000, 0.01), (0, 0, 0.2)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        cols = [F.lit(k).cast("long"), F.lit(n).cast("long"), F.lit(p)]
        assert spark.range(1).select(quality_rules.binomial_tail(*cols)).first()[0] == pytest.approx(want, rel=1e-9)


def test_cutoffs_need_evidence_and_respect_strata(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    loud = " ".join(f"WORD{i}!!" for i in range(40))
    rows = [(i, clean) for i in range(2000)] + [(5000, loud), (5001, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(2000)] + [(5000, 0), (None, 1)], "doc_id long, quality int")
    kept = lambda d, lab: {x.doc_id for x in quality_rules.judge(d, lab).filter("kept").collect()}
    assert kept(docs(spark, rows), labels) == set(range(2000))
    # a stratum without labels keeps it, and so does a table without labels
    other = docs(spark, [(5000, loud)], lang="fr").unionByName(docs(spark, rows[:2000]))
    assert kept(other, labels) == {*range(2000), 5000}
    assert kept(docs(spark, rows), labels.limit(0)) == {*range(2000), 5000}
    assert quality_rules.judge(docs(spark, []), labels).count() == 0


def test_strata_have_cutoffs_of_their_own_and_the_small_ones_share_theirs(spark):
    """At sf0.01: two strata, different steps, documents that only a cutoff rejects, and a plain recount of the guarantee."""
    d = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    measured = quality_rules.measures(documents).cache()
    table = {r.stratum: r for r in quality_rules.cutoffs(quality_rules.steps(measured, labels)).collect()}
    assert set(table) == {"en", None} and table[None].pooled and not table["en"].pooled
    assert table["en"].last != table[None].last and None not in (table["en"].last, table[None].last)
    good = {r.doc_id for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").collect()}
    rows = [r for r in measured.collect() if not r.base_failed and r.doc_id in good]
    for stratum, t in table.items():
        mine = [r for r in rows if (r.lang == "en") == (stratum == "en")]
        cuts = {r: t[f"{r}_cut"] for r in quality_rules.CUTOFFS}
        k = sum(any(c is not None and r[rule] > c for rule, c in cuts.items()) for r in mine)
        tail = lambda k, n: sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1))
        assert len(mine) == t.n and tail(k, t.n) <= 0.05 / 2
        if t.last == len(quality_rules.PATH) - 1:
            continue
        # the next step is one too many
        rule, i = quality_rules.PATH[t.last + 1]
        cuts[rule] = quality_rules.CUTOFFS[rule][i]
        k = sum(any(c is not None and r[rule] > c for rule, c in cuts.items()) for r in mine)
        assert tail(k, t.n) > 0.05 / 2
    kept = quality_rules.judge(documents, labels).collect()
    assert sum(not r.kept and not r.base_failed for r in kept) > 20
    assert sum(not r.kept and not r.base_failed and r.doc_id in good for r in kept) < 0.05 * len(rows)


def test_large_counts_are_bounded_not_summed(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "SUMMED", 5)
    cases = [(0, 90, True), (0, 50, False), (3, 219, True), (9, 219, False), (20, 2000, True), (90, 2000, False), (100, 2000, False)]
    for k, n, want in cases:
        cols = [F.lit(x).cast("long") for x in (k, n)]
        assert spark.range(1).select(quality_rules.admissible(*cols, 0.05, F.lit(0.0125))).first()[0] is want, (k, n)


def test_verdicts_do_not_change_their_kind_with_the_size(spark):
    """Beyond ``SUMMED`` rejections the exact tail still decides; a bound from above refused the first of each pair."""
    def tail(k, n):
        logs = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.05) + (n - i) * math.log(0.95) for i in range(k + 1))
        return math.fsum(math.exp(x) for x in logs)

    for k, n, want in ((24_600, 500_000, True), (24_700, 500_000, False), (49_450, 1_000_000, True), (49_600, 1_000_000, False)):
        assert (tail(k, n) <= 0.0125) is want
        cols = [F.lit(x).cast("long") for x in (k, n)]
        fine, found = quality_rules.admissible(*cols, 0.05, F.lit(0.0125)), quality_rules.binomial_tail(*cols, F.lit(0.05))
        row = spark.range(1).select(fine.alias("fine"), found.alias("tail")).first()
        assert row.fine is want and row.tail == pytest.approx(tail(k, n), rel=1e-6), (k, n)


# --- 5: line dedup ----------------------------------------------------------------------------------------------------


def test_boilerplate_is_relative_to_the_host(spark):
    rows = [(i, f"menu\nown {i}\n\n menu ") for i in range(10)] + [(99, None), (98, "")]
    frame = docs(spark, rows).withColumn("n_lines", F.lit("x"))
    other = docs(spark, [(200 + i, f"menu\nother {i}" if i < 4 else f"other {i}") for i in range(400)])
    frame = frame.drop("n_lines").unionByName(other.withColumn("source", F.lit(None).cast("string")))
    got = {x.doc_id: x for x in line_dedup.without_boilerplate(frame, ratio=0.5).collect()}
    assert got[3].text == "own 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[200].text == "menu\nother 0" and got[99].text is None and got[98].text == "" and len(got) == 412
    assert line_dedup.without_boilerplate(docs(spark, [])).count() == 0


def sites(spark, n=110):
    """A site of ``n`` pages with a menu; ten of them are copies of one text. Helper names of the operator are columns."""
    rows = [(i, f"menu\nown {i}\nfoot") for i in range(n - 10)] + [(1000 + i, "menu\nthe copied\ntext") for i in range(10)]
    named = {c: F.lit(c) for c in ("drops", "of", "gone", "kept", "kept_lines", "host", "digest", "line", "page", "id")}
    return docs(spark, rows).withColumns(named)


@pytest.mark.parametrize("most", [200_000, 0])
def test_copies_keep_their_text_and_columns_stay(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST", most)
    frame = sites(spark)
    out = line_dedup.without_boilerplate(frame)
    assert set(out.columns) == {*frame.columns, "n_lines", "n_dropped"}
    got = {x.doc_id: x for x in out.collect()}
    assert len(got) == 110 and got[5].text == "own 5" and all(x.of == "of" and x.kept_lines == "kept_lines" for x in got.values())
    assert all(got[1000 + i].text == "the copied\ntext" and got[1000 + i].n_dropped == 1 for i in range(10))
    null = frame.withColumn("source", F.lit(None).cast("string"))
    assert {x.text for x in line_dedup.without_boilerplate(null).filter("doc_id < 3").collect()} == {"own 0", "own 1", "own 2"}


def test_rows_with_one_copy_of_are_one_page(spark):
    rows = [(i, f"menu\nown {i}") for i in range(20)] + [(100 + i, f"same\nlast {i}") for i in range(20)] + [(None, "same\nx")]
    same = spark.createDataFrame([(100 + i, 100) for i in range(20)], "doc_id long, copy_of long")
    got = {x.doc_id: x.text for x in line_dedup.without_boilerplate(docs(spark, rows), copies=same).collect()}
    assert got[3] == "own 3" and got[107] == "same\nlast 7" and got[None] == "same\nx"
    plain = {x.doc_id: x.text for x in line_dedup.without_boilerplate(docs(spark, rows)).collect()}
    assert plain[107] == "last 7" and plain[None] == "x"


def test_texts_stay_where_they_are(spark, capsys):
    frame = spark.read.parquet(f"{DIR}/documents.parquet")
    line_dedup.without_boilerplate(frame).explain("formatted")
    plan = capsys.readouterr().out
    moved = [x for x in plan.split("\n\n") if "Exchange" in x.split("\n")[0] and "Broadcast" not in x.split("\n")[0]]
    assert not any("text#" in x for x in moved)


@pytest.mark.parametrize("hot", [1, 1000])
def test_join_of_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(joins, "HOT", hot)
    monkeypatch.setattr(joins, "BROADCAST", 2)
    rows = [(i, k) for i, k in enumerate([1] * 50 + [2] * 9 + [3] * 5 + [4, 5] + [None] * 30)]
    frame = spark.createDataFrame(rows, "i long, k long")
    facts = spark.createDataFrame([(1, "a", 50), (2, "b", 9), (3, "c", 5), (4, None, 1), (6, "z", 0)], "k long, v string, n long")
    got = {x.i: x.v for x in joins.join_unique(frame, facts, "k", "n").collect()}
    assert got == {i: {1: "a", 2: "b", 3: "c"}.get(k) for i, k in rows}


# --- 6: weak labels ---------------------------------------------------------------------------------------------------


def test_classifier_finds_junk_without_labels(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = weak_quality.classify(docs_, sample=600).join(labels, "doc_id").collect()
    share = lambda q: np.mean([x.kept for x in got if x.quality == q])
    assert share(1) > 0.97 and share(0) < 0.3


def test_classifier_on_edges(spark):
    got = {x.doc_id: x for x in weak_quality.classify(docs(spark, EDGES)).collect()}
    assert len(got) == len(EDGES) and not any(got[i].kept for i in (1, 2, 3))
    assert weak_quality.classify(docs(spark, [])).count() == 0


# --- 7: chat ----------------------------------------------------------------------------------------------------------


def test_chat_round_trip_and_mask(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "\\[INST]", "", "é漢😀", "[NAME]x[/ROLE]", " lead ", "<s", ">"]
    turns = [(1, i, r, t) for i, (r, t) in enumerate(itertools.product(["user", "assistant", "system", "to[NAME]ol"], nasty))]
    turns += [(2, 0, "user", None), (2, 1, None, "x"), (None, 0, "assistant", "y"), (3, None, "assistant", LONG), (2, 1, None, "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({"ids": F.lit(1), "formatted": F.lit("f"), "turns": F.lit("t")})
    out = chat.format_conversations(frame, CHAT_BPE).collect()
    got = {x.conv_id: x for x in chat.digests(chat.format_conversations(frame, CHAT_BPE), CHAT_BPE).collect()}
    for x in out:
        mine = sorted(((t if t is not None else -1), r or "", s or "") for c, t, r, s in turns if c == x.conv_id)
        assert chat.parse(x.formatted) == [(r, s) for _, r, s in mine]
        said = "".join(s for _, r, s in mine if r == "assistant")
        assert got[x.conv_id].loss_chars == len(said)
        assert got[x.conv_id].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        e = chat.tokenizer(CHAT_BPE).encode(x.formatted, add_special_tokens=False)
        spans = chat.masked_spans(np.array(e.offsets), np.array(x.loss))
        assert chat.unescape("".join(x.formatted[a:b] for a, b in spans)) == said
    assert chat.format_conversations(frame.limit(0), CHAT_BPE).count() == 0


def test_rows_without_a_conversation_are_one_each(spark):
    turns = [(None, i, "user", f"t{i}") for i in range(9)] + [(1, i, "user", f"t{i}") for i in range(3)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    said = [[t for _, t in chat.parse(x.formatted)] for x in chat.format_conversations(frame, CHAT_BPE).collect()]
    assert sorted(said) == sorted([["t0", "t1", "t2"], *([f"t{i}"] for i in range(9))])


# --- 8: revisits ------------------------------------------------------------------------------------------------------


def test_canonical_urls(spark):
    same = ["http://WWW.a.org/x/?b=2&a=1#top", "https://a.org:443/x?a=1&utm_source=q&b=2", " //a.org/x?a=1&b=2&ref=z".replace("//", "")]
    got = spark.createDataFrame([(u,) for u in same], "u string").select(warc.canonical_url(F.col("u"))).distinct().collect()
    assert [x[0] for x in got] == ["a.org/x?a=1&b=2"]


def test_revisits_one_by_one(spark):
    rows = [
        (1, "http://a/", 10, "response", {"etag": '"1"', "last-modified": "d", "content-length": "3"}, "one"),
        (2, "http://a/", 20, "response", {"etag": '"2"'}, "two"),
        (3, "http://a", 20, "revisit", {"etag": 'W/"1"', "content-length": "0", "date": "n"}, None),
        (4, "https://a/#x", 21, "revisit", {"etag": '"1"'}, None),
        (5, "http://a/", 5, "revisit", {"etag": '"1"'}, None),
        (6, "http://a/", 15, "revisit", {"last-modified": "d"}, None),
        (7, "http://a/", 15, "revisit", None, None),
        (8, None, 15, "revisit", {"etag": '"1"'}, None),
        (9, "http://a/", None, "revisit", {"etag": '"1"'}, None),
        (10, "http://a/", 30, None, None, "ignored"),
    ]
    rows += [(100 + i, "http://hot/", i, "revisit" if i % 3 else "response", {"etag": "e"}, f"p{i}") for i in range(300)]
    frame = spark.createDataFrame(
        rows, "record_id long, url string, ts long, kind string, headers map<string,string>, payload string"
    ).withColumns({"key": F.lit(0), "full": F.lit("x"), "original": F.lit(1)})
    got = {x.record_id: x for x in warc.resolve(frame).collect()}
    assert {i: got[i].state for i in range(3, 10)} == {
        3: "resolved", 4: "changed", 5: "no_original", 6: "resolved", 7: "no_validator", 8: "no_original", 9: "no_original"
    }
    assert got[3].payload == "one" and got[3].original_id == 1
    assert got[3].headers == {"etag": 'W/"1"', "last-modified": "d", "content-length": "3", "date": "n"}
    assert all(got[100 + i].payload == f"p{i // 3 * 3}" for i in range(300) if i % 3)
    assert 1 not in got and 10 not in got and warc.resolve(frame.limit(0)).count() == 0


# --- 9: packing -------------------------------------------------------------------------------------------------------


def test_words_are_encoded_as_by_the_library():
    mine, lib = packing.encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    r = random.Random(6)
    letters = list("abzSITt's  \n.,-!012éÉßÀn’…Σσ漢́İ\x1f\x0b\xa0") + ["<|endoftext|>", "½", "it's"]
    for _ in range(1500):
        text = "".join(r.choices(letters, k=r.randint(0, 30)))
        ids = np.frombuffer(mine.encode(text), "<u4").tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids


def test_best_two_fit_replaces_the_smallest():
    # 6 + 3 leaves 1; 3 gives way to 2 + 2
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert {n: rows.tolist() for n, rows in plan.items()}[2][0][1] == plan[6][0][1] and plan[3][0][1] != plan[6][0][1]


def test_a_process_gives_up_its_encoders_and_makes_them_again():
    before = packing.encoder(WORD_BPE).encode("Some words, some more.")
    packing.forget()
    assert not packing._ENCODERS
    assert packing.encoder(WORD_BPE).encode("Some words, some more.") == before


def test_packing_is_whole_and_tight(spark):
    rows = [(x.doc_id + 100, x.text) for x in spark.read.parquet(f"{DIR}/documents.parquet").collect()] + EDGES
    got = packing.pack(docs(spark, rows), WORD_BPE, capacity=512).toPandas()
    lib = Tokenizer.from_file(WORD_BPE)
    for doc, text in rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id.isna() if doc is None else got.doc_id == doc].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.start.diff().dropna() == 512).all()
        assert all(binascii.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in mine.itertuples())
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum()[:-1]] and bin_.length.sum() <= 512
    assert got.sequence_id.nunique() <= 1.02 * math.ceil(got.length.sum() / 512) + 1
    assert packing.pack(docs(spark, []), WORD_BPE).count() == 0


# --- 10: embeddings ---------------------------------------------------------------------------------------------------


def test_bounds_hold_and_links_are_exact(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(12, 16))
    x = np.concatenate([base[r.integers(0, 12, 300)] + 0.35 * r.normal(size=(300, 16)), r.normal(size=(40, 16))]).astype(np.float32)
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [1.0, None] * 8), (1004, [math.nan] * 16), (1005, [math.inf] * 16)]
    bad += [(None, [1.0, 5.0, 7.0]), (None, None)]
    bad += [(1006, [1.0, 2.0]), (1007, [2.0, 4.0])]
    frame = spark.createDataFrame(rows + bad + [(7, rows[7][1])], "vec_id long, embedding array<float>")
    frame = frame.withColumns({"vector": F.lit("v"), "cid": F.lit(1), "links": F.lit(2)})
    got = embedding_tiles.near_vectors(frame, block=64).collect()
    all_rows = [*rows, (7, rows[7][1])]
    y = np.array([v for _, v in all_rows], dtype=np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in all_rows])
    while True:
        new = np.array([min(label[i], label[near[i]].min()) if near[i].any() else label[i] for i in range(len(label))])
        if (new == label).all():
            break
        label = new
    want = sorted((i, int(near[k].sum()), int(label[k])) for k, (i, _) in enumerate(all_rows))
    assert [tuple(g) for g in got if g.vec_id is None] == [(None, 0, None, True)] * 2
    got = [g for g in got if g.vec_id is not None]
    mine = sorted(tuple(g)[:3] for g in got if g.vec_id < 1000)
    assert mine == want
    assert {g.vec_id: (g.n_links, g.component_id) for g in got if g.vec_id >= 1000} == {
        **{i: (0, i) for i in range(1000, 1006)}, 1006: (1, 1006), 1007: (1, 1006)
    }
    q, scale, length, error = embedding_tiles.quantised(y)
    gap = np.abs(y @ y.T - (q.astype(float) @ q.astype(float).T) * np.outer(scale, scale))
    assert (gap <= np.outer(length, error) + error[:, None] + 1e-12).all()
    left, right, room = embedding_tiles.bounds(y)
    assert ((left @ right.T).astype(float) + room >= y @ y.T).all()
    assert ((left @ right.T).astype(float) - y @ y.T).max() < 0.05
    assert embedding_tiles.near_vectors(frame.limit(0)).count() == 0
