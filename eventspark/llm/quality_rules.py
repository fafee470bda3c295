"""Quality rules whose cutoffs come with a guarantee, in DataFrame functions only.

Each rule compares a share of a text with a cutoff. All rules start at their loosest cutoff and are tightened in turn along a
path fixed beforehand (``PATH``). The good documents among the labelled ones are the holdout: a step of the path is
admissible in a stratum if the rules together reject so few of them that, were the true rate of false rejection above
``risk``, that few would have a probability of at most ``doubt`` / number of strata (exact binomial tail). Steps are tested
in order up to the first that fails, so steps cost no doubt (fixed-sequence testing) and only strata do (Bonferroni). With
probability 1 - ``doubt``, no stratum loses more than ``risk`` of its good documents to the rules.

A language is a stratum of its own if it has enough good labelled documents for any test to succeed; the others are one
stratum together. That depends on their numbers only, not on what the rules do to them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.session import stored

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
RISK, DOUBT = 0.05, 0.05
#: Rules: share -> cutoffs on the path; none is so tight that ordinary texts with a refrain or a list exceed it.
CUTOFFS = {
    "symbol_share": (0.01, 0.015, 0.02, 0.03, 0.04, 0.06, 0.08, 0.16, 0.32),
    "line_share": (0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7),
    "repeat_share": (0.08, 0.1, 0.12, 0.14, 0.16, 0.18, 0.2, 0.25, 0.29),
    "capital_share": (0.1, 0.125, 0.15, 0.175, 0.2, 0.25, 0.3, 0.5, 0.7),
    "shout_share": (0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.04, 0.08, 0.16),
}
#: Steps in their order: each sets one rule to the cutoff of that number; rounds go from the loosest cutoffs to the tightest.
PATH = [(rule, i) for i in reversed(range(9)) for rule in CUTOFFS]
#: Terms of the tail that are listed at once; all of them are summed, however many.
SUMMED = 20_000


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated(words: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words that occur twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words) - (WINDOW - 1)
    # held in a one-element array so that it is made once per row
    grams = lambda h: F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    )

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = lambda s: F.filter(
            F.transform(
                s,
                lambda p, k: F.when(
                    (p["x"] == F.get(s, k - 1)["x"]) | (p["x"] == F.get(s, k + 1)["x"]), p["i"]
                ),
            ),
            lambda p: p.isNotNull(),
        )
        ordered = F.get(F.transform(F.array(pairs), lambda s: F.array_sort(again(s))), F.lit(0))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).cast("long").alias("n"), (p + WINDOW).alias("end")
        )
        return F.aggregate(ordered, start, step, lambda a: a["n"])

    def judged(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long"))

    def one(h: Column) -> Column:
        return F.get(F.transform(F.array(grams(h)), judged), F.lit(0))

    made = F.get(F.transform(F.array(hashes), one), F.lit(0))
    return F.when(n > 1, made).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, the counts of each whole text, ``base_failed`` and the shares the rules use."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text.alias("t"))
    words = F.filter(F.split(F.translate("t", SPACE, " " * len(SPACE)), " +", -1), lambda w: w != "")
    rows = rows.select("doc_id", "lang", "t", words.alias("words"), lines.alias("lines"))
    long = lambda c: c.cast("long")
    rows = rows.select(
        "doc_id",
        "lang",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.translate("t", SPACE, ""))).alias("word_chars"),
        long(_count(F.col("t"), SYMBOLS)).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(_count(F.col("t"), CAPITALS)).alias("n_capitals"),
        long(_count(F.col("t"), "!")).alias("n_shouts"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return rows.withColumn("base_failed", failed).select(
        "*",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_shouts", "word_chars").alias("shout_share"),
    )


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(at most ``k`` of ``n``) at rate ``p``, summed from logarithms so that large ``n`` does not underflow.

    Every term is summed, block by block, so that a large ``k`` needs time but no more memory.
    """
    first = n * F.log1p(-p)
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i) + F.log(p / (1 - p))
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    size = F.lit(SUMMED).cast("long")
    firsts = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k, size)).otherwise(F.array().cast("array<long>"))
    block = lambda a, i: F.aggregate(F.sequence(i, F.least(k, i + size - 1)), a, step)
    return F.aggregate(firsts, start, block, lambda a: a["sum"])


def admissible(k: Column, n: Column, risk: float, level: Column) -> Column:
    """Whether ``k`` of ``n`` show a rate of at most ``risk`` at ``level``; nothing is summed where ``k`` is not below it."""
    return F.when((n > 0) & (k < n * risk), binomial_tail(k, n, F.lit(risk)) <= level).otherwise(F.lit(False))


def first_step(rules: Sequence[tuple[str, int]] = PATH) -> Column:
    """Number of the first step of the path whose cutoffs reject a document (null: none does)."""
    firsts = []
    for rule, cuts in CUTOFFS.items():
        own = [(at, cuts[i]) for at, (r, i) in enumerate(rules) if r == rule]
        cases = None
        for at, cut in own:
            over = F.col(rule) > cut
            cases = F.when(over, at) if cases is None else cases.when(over, at)
        firsts.append(cases)
    return F.least(*firsts)


def steps(measured: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """``(stratum, pooled, n, last)``: how many good documents a stratum has and the last step it takes (null: none).

    The stratum of the small languages together has ``pooled`` set. A document is good if its labels all say quality 1.
    Documents that fail the base rules are not part of the holdout.
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    good = good.filter("quality = 1").select("doc_id")
    held = measured.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    at = F.coalesce(first_step(), F.lit(len(PATH)))
    counted = stored(held.groupBy("lang", at.alias("at")).agg(F.count("*").alias("k")))
    sizes = counted.groupBy(F.col("lang").alias("of")).agg(F.sum("k").alias("size"))
    languages = sizes.agg(F.count("*").alias("s")).scalar()
    least = F.log(F.lit(doubt) / (languages + 1)) / math.log1p(-risk)
    sizes = sizes.withColumn("pooled", F.col("size") < least)
    rows = counted.join(sizes, F.col("lang").eqNullSafe(F.col("of")))
    rows = rows.withColumn("stratum", F.when(~F.col("pooled"), F.col("lang")))
    rows = stored(rows.groupBy("stratum", "pooled", "at").agg(F.sum("k").alias("k")))
    strata = rows.select("stratum", "pooled").distinct().agg(F.count("*").alias("s")).scalar()
    each = F.sort_array(F.collect_list(F.struct("at", "k")))
    strata_of = rows.groupBy("stratum", "pooled").agg(F.sum("k").alias("n"), each.alias("found"))
    so_far = F.aggregate(
        F.filter("found", lambda x: x["at"] <= F.col("step")), F.lit(0).cast("long"), lambda acc, x: acc + x["k"]
    )
    tried = strata_of.select("stratum", "pooled", "n", "found", F.explode(F.sequence(F.lit(0), F.lit(len(PATH) - 1))).alias("step"))
    tried = tried.select("stratum", "pooled", "n", "step", so_far.alias("k"))
    fine = admissible(F.col("k"), F.col("n"), risk, F.lit(doubt) / F.greatest(strata, F.lit(1)))
    # the rejected grow along the path, so the last admissible step follows admissible ones only
    return tried.groupBy("stratum", "pooled", "n").agg(F.max(F.when(fine, F.col("step"))).alias("last"))


def cutoffs(table: DataFrame) -> DataFrame:
    """The table of :func:`steps` with the cutoff of every rule after the last step (null: the rule is not used)."""

    def cut(rule: str) -> Column:
        out = F.lit(None).cast("double")
        for at, (r, i) in enumerate(PATH):
            if r == rule:
                out = F.when(F.col("last") >= at, CUTOFFS[rule][i]).otherwise(out)
        return out.alias(f"{rule}_cut")

    return table.select("*", *[cut(rule) for rule in CUTOFFS])


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """``docs (doc_id, text, lang, ..)`` with ``labels (doc_id, quality, ..)`` -> counts, ``base_failed`` and ``kept``.

    A null text has no words and fails. A null language is a language of its own; one without good labelled documents
    belongs to the pooled stratum. A null or unknown doc_id has no label; repeated rows are judged each. Without labels only
    the base rules count. Other columns are ignored. An empty table gives no rows.
    """
    measured = stored(measures(docs).withColumn("at", first_step()))
    table = stored(steps(measured, labels, risk, doubt))
    own = table.filter(~F.col("pooled")).select("stratum", F.lit(True).alias("own"), "last")
    pooled = table.filter("pooled").agg(F.max("last").alias("last")).scalar()
    judged = measured.join(own, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    last = F.when(F.col("own"), F.col("last")).otherwise(pooled)
    beyond = F.coalesce(F.col("at") <= last, F.lit(False))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*counts, (~(F.col("base_failed") | beyond)).alias("kept"))


def _sql() -> str:
    w = r"[^\x20\x09-\x0D]+"
    grams = " || chr(0) || ".join(f"lead(word, {k}) over d" for k in range(1, WINDOW))
    grid = ", ".join(f"({at}, '{rule}', {CUTOFFS[rule][i]})" for at, (rule, i) in enumerate(PATH))
    shares = {
        "symbol_share": ("n_symbols", "word_chars"),
        "line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "capital_share": ("n_capitals", "word_chars"),
        "shout_share": ("n_shouts", "word_chars"),
    }
    cells = " union all ".join(
        f"select doc_id, lang, base_failed, '{rule}' as rule, {a} / greatest({b}, 1) as share from counted"
        for rule, (a, b) in shares.items()
    )
    return rf"""
with docs as (select doc_id, lang, coalesce(text, '') as t from documents),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos
          from (select doc_id, regexp_extract_all(t, '{w}') as ws from docs)),
grams as (select doc_id, pos, word || chr(0) || {grams} as gram from words window d as (partition by doc_id order by pos)),
starts as (select doc_id, pos, gram is not null and count(*) over (partition by doc_id, gram) > 1 as twice from grams),
covered as (select doc_id, max(twice::int) over (partition by doc_id order by pos rows between {WINDOW - 1} preceding and current row) as hit
            from starts),
by_word as (select doc_id, count(*) as n_words, sum(hit)::bigint as n_repeat_words from covered group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from docs),
by_line as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
            from lines where regexp_matches(line, '{w}') group by doc_id),
counted as (
  select doc_id, lang, coalesce(n_words, 0) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals,
    length(t) - length(replace(t, '!', '')) as n_shouts,
    coalesce(n_words, 0) < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * coalesce(n_words, 0) as base_failed
  from docs left join by_word using (doc_id) left join by_line using (doc_id)),
shares as ({cells}),
good as (select doc_id from labels group by doc_id having min(quality) = 1),
path(pos, rule, cut) as (values {grid}),
firsts as (select doc_id, min(pos) as pos from shares s join path p on s.rule = p.rule and share > cut group by doc_id),
holdout as (
  select lang, pos from counted c left join firsts using (doc_id) where not base_failed and doc_id in (select doc_id from good)),
sizes as (select lang, count(*) < ln({DOUBT} / ((select count(distinct coalesce(lang, chr(0))) from holdout) + 1)) / ln(1 - {RISK}) as pooled
          from holdout group by lang),
strata as (select case when not pooled then s.lang end as stratum, pooled, pos
           from holdout h join sizes s on h.lang is not distinct from s.lang),
tried as (
  select stratum, pooled, p.pos as step, count(*) as n, count(*) filter (s.pos <= p.pos) as k
  from strata s cross join path p group by all),
terms as (select *, unnest(range(0, k + 1)) as j from tried where k < n * {RISK}),
tails as (
  select stratum, pooled, step,
    sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK}))) as tail
  from terms group by all),
chosen as (
  select stratum, pooled, max(step) as last from tails
  where tail <= {DOUBT} / (select count(*) from (select distinct stratum, pooled from strata)) group by all),
rejected as (
  select doc_id from counted c join firsts f using (doc_id) left join sizes s on c.lang is not distinct from s.lang
  join chosen h on h.pooled = coalesce(s.pooled, true) and (h.pooled or h.stratum is not distinct from c.lang) and f.pos <= h.last)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and doc_id not in (select doc_id from rejected) as kept
from counted"""


SQL = _sql()
