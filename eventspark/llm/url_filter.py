"""Verdicts on urls by rules and by exact membership in a list, held as a cascade of Bloom filters.

The keys are the hosts, the universe every host of the corpus. Level 1 encodes the listed keys of the universe; the other
keys that it lets pass are its false positives, which level 2 encodes; the listed keys that level 2 lets pass go to level 3,
and so on until a level lets nothing wrong pass. A key is listed if the first level that rejects it has an even number, or
if none does and their number is odd. As every key that will ever be asked took part, the answer is exact, and a url is
judged by looking up bits, without a join: joins touch distinct hosts only, where the list is brought to the universe.

A pass holds filters for ``max_keys`` listed keys at most (about 3 bytes a key); a longer list is dealt into as many
passes by a hash of the key, each over a stored table. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.session import stored

#: Listed keys whose filters are held in memory at once.
MAX_KEYS = 4_000_000
#: 64-bit words in one stored chunk of a filter.
CHUNK = 1024
#: Parts of the hosts of one domain.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both are empty where it is null or has no ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def domains(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    names = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(names)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its number, hash functions and bits, and one row with the bits as an array of chunks."""

    number: int
    hashes: int
    bits: int
    chunks: DataFrame

    def positions(self, key: Column) -> list[Column]:
        hashed = [F.xxhash64(F.lit(self.number), F.lit(j), key) for j in range(self.hashes)]
        return [F.pmod(h, F.lit(self.bits).cast("long")) for h in hashed]

    def passes(self, key: Column) -> Column:
        held = self.chunks.scalar()

        def is_set(at: Column) -> Column:
            word = F.shiftright(at, 6)
            chunk = F.get(held, F.shiftright(at, 16).cast("int"))
            return F.getbit(F.get(chunk, (word % CHUNK).cast("int")), (at % 64).cast("int")) == 1

        return reduce(lambda a, b: a & b, [is_set(p) for p in self.positions(key)])


def _level(number: int, rate: float, n: int, keys: DataFrame) -> Level:
    """A filter over the ``n`` rows of ``keys`` that lets other keys pass at about ``rate``."""
    hashes = max(1, round(math.log2(1 / rate)))
    words = max(1, math.ceil(n * hashes / math.log(2) / 64))
    level = Level(number, hashes, words * 64, keys)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    bits = at.select(F.shiftright("at", 6).alias("word"), one.alias("bits"))
    blank = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = bits.union(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = lambda x, at, value: F.transform(
        F.array_sort(F.collect_list(F.struct(at, value))), lambda s: s[value]
    ).alias(x)
    chunks = dense.withColumn("chunk", F.floor(F.col("word") / CHUNK)).groupBy("chunk")
    chunks = stored(chunks.agg(in_order("words", "word", "bits")))
    return Level(number, hashes, words * 64, chunks.agg(in_order("chunks", "chunk", "words")))


def cascade(universe: DataFrame) -> list[Level]:
    """Levels that tell the listed keys of ``universe (key, listed)`` from all its others; keys are distinct, not null."""
    levels: list[Level] = []
    sides = [universe.filter("listed").select("key"), universe.filter("not listed").select("key")]
    n, others = sides[0].count(), sides[1].count()
    while n:
        number = len(levels) + 1
        # the first level is as fine as the shares of the sides ask for, the others halve
        rate = min(0.5, n / others * math.sqrt(0.5)) if number == 1 and others else 0.5
        levels.append(_level(number, rate, n, sides[0]))
        wrong = stored(sides[1].filter(levels[-1].passes(F.col("key"))))
        sides, n = [wrong, sides[0]], wrong.count()
    return levels


def member(levels: Sequence[Level], key: Column) -> Column:
    """Whether ``key``, one of the universe's, is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.passes(key), F.lit(level.number % 2 == 0)).otherwise(out)
    return out


def hosts_of(urls: DataFrame, url: str = "url") -> DataFrame:
    """Every host of ``urls`` once, as ``host``."""
    return urls.select(url_parts(F.col(url))[0].alias("host")).distinct()


def universe_of(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """``(key, listed)`` for each of the distinct ``hosts (host)``: whether it or a parent domain is in ``listed (key)``."""
    # a domain such as "com" is a parent of a large share of all hosts: its rows are dealt by salt
    names = hosts.select("host", F.explode(domains(F.col("host"))).alias("domain"))
    names = names.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    wanted = listed.select(F.col("key").alias("domain")).filter("domain is not null").distinct().select("domain", salts)
    inside = names.join(wanted, ["domain", "salt"], "left_semi").select(F.col("host").alias("key")).distinct()
    rest = hosts.join(inside, F.col("host") == F.col("key"), "left")
    return stored(rest.select(F.col("host").alias("key"), F.col("key").isNotNull().alias("listed")))


def judge(
    pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, url: str = "url", max_keys: int = MAX_KEYS
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits; at equal length the one with the longer host, then
    the earlier) and ``verdict``: that rule's, else "block" where the host or a parent domain is in ``listed (key)``, else
    "allow".

    All rows are kept, repeated ones too. A null url and one without ``://`` have an empty host and path, which no rule
    with a host fits and no list holds. Null, repeated and unknown keys of ``listed`` have no effect. Columns of ``pages``
    already named ``host``, ``path``, ``rule`` or ``verdict`` are replaced, all others stay. An empty table gives no rows.
    """
    host, path = url_parts(F.col(url))
    universe = universe_of(hosts_of(pages, url), listed)
    passes = max(1, math.ceil(universe.filter("listed").count() / max_keys))
    # a hash of its own: the filters' are taken within a pass
    turn = lambda key: F.pmod(F.xxhash64(F.lit("pass"), key), F.lit(passes))
    hit = "listed" + "_" * max(map(len, pages.columns), default=0)
    out = pages.withColumns({"host": host, "path": path, "rule": F.lit(None).cast("string"), "verdict": F.lit("")})
    out = out.withColumn(hit, F.lit(False))
    for n in range(passes):
        levels = cascade(universe.filter(turn(F.col("key")) == n) if passes > 1 else universe)
        found = member(levels, F.col("host"))
        if passes > 1:
            out = stored(out.withColumn(hit, F.when(turn(F.col("host")) == n, found).otherwise(F.col(hit))))
        else:
            out = out.withColumn(hit, found)
    first = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    rule = verdict = None
    for r in first:
        fits = r.fits(F.col("host"), F.col("path"))
        rule = F.when(fits, r.name) if rule is None else rule.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    own = F.when(F.col(hit), "block").otherwise("allow")
    if first:
        out = out.withColumns({"rule": rule, "verdict": verdict.otherwise(own)})
    else:
        out = out.withColumn("verdict", own)
    return out.drop(hit)


#: Rules of the registered query (fixed values).
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Names of unwanted sites (fixed values): a domain is listed if its first label is one of them.
NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def listed_domains(urls: DataFrame, names: Sequence[str] = NAMES, url: str = "url") -> DataFrame:
    """The domains of the corpus whose first label is one of ``names``, as ``key``."""
    every = hosts_of(urls, url).select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    return every.filter(F.substring_index("key", ".", 1).isin(*names))


_NAMES = ", ".join(f"'{n}'" for n in NAMES)
_CASES = [
    (f"(host = '{r.host}' or suffix(host, '.{r.host}')) and starts_with(path, '{r.path}')", r)
    for r in sorted(RULES, key=lambda r: -len(r.name))
]
SQL = rf"""
with parts as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages)
select page_id, host, path, case {" ".join(f"when {c} then '{r.name}'" for c, r in _CASES)} end as rule,
  case {" ".join(f"when {c} then '{r.verdict}'" for c, r in _CASES)}
    when list_has_any(string_split(host, '.'), [{_NAMES}]) then 'block' else 'allow' end as verdict
from parts"""
