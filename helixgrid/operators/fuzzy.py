"""Approximate lookup: wildcards, Hamming balls, position groups, lengths off by a few.

A query stands for a set of words. Sets up to the query's limit are listed and
joined with the table; a word that the table lacks is looked up by its reverse
complement in a second join, since one join on either would be a nested loop.
The listing stops at the first word over the limit. What then happens is the
caller's choice: an error (the default), or a scan of the table with the query
as a predicate, which is exact for sets of any size. A batch reports it per
query.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, product
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import BASES, reverse_complement

MAX_VARIANTS = 10_000
MAX_LENGTH_CHANGE = 3
MAX_QUERY = 1000


class FuzzyError(ValueError):
    """A query that is malformed or out of bounds."""


class TooManyVariants(FuzzyError):
    """A query that stands for more words than its limit."""


@dataclass(frozen=True)
class PositionGroup:
    """Places (from 0) of which at most `limit` may differ."""

    positions: tuple[int, ...]
    limit: int


def parse_positions(text: str) -> tuple[PositionGroup, ...]:
    """'3,4,5:2;6-8:1' -> groups; ranges are inclusive, empty parts between semicolons are skipped."""
    groups = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        m = re.fullmatch(r"([^:]*):\s*(\d+)\s*", part)
        if not m:
            raise FuzzyError(f"a group is positions:limit, not {part!r}")
        places: list[int] = []
        for item in m[1].split(","):
            r = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", item)
            if not r or (r[2] and int(r[2]) < int(r[1])):
                raise FuzzyError(f"bad position {item!r} in group {part!r}")
            places += range(int(r[1]), int(r[2] or r[1]) + 1)
        groups.append(PositionGroup(tuple(places), int(m[2])))
    return tuple(groups)


def check_positions(groups: Iterable[PositionGroup], length: int) -> None:
    seen: set[int] = set()
    for i, g in enumerate(groups):
        for p in g.positions:
            if p >= length:
                raise FuzzyError(f"group {i}: position {p} is beyond {length - 1}")
            if p in seen:
                raise FuzzyError(f"group {i}: position {p} is used twice")
            seen.add(p)
        if g.limit > len(g.positions):
            raise FuzzyError(f"group {i}: {g.limit} mutations, only {len(g.positions)} positions")


def estimate_wildcards(pattern: str) -> int:
    return 4 ** pattern.count("N")


def estimate_mutations(length: int, distance: int) -> int:
    """The bound that decides refusals: exact for distances up to two, n^i / i^i ways above."""
    total = 1
    for i in range(1, distance + 1):
        total += (comb(length, i) if i <= 2 else length**i // i**i) * 3**i
    return total


def exact_mutations(length: int, distance: int) -> int:
    """Words within a distance of one word."""
    return sum(comb(length, i) * 3**i for i in range(distance + 1))


def estimate_groups(groups: Iterable[PositionGroup]) -> int:
    total = 1
    for g in groups:
        total *= exact_mutations(len(g.positions), g.limit)
    return total


def expand_wildcards(pattern: str, limit: int = MAX_VARIANTS) -> list[str]:
    """Every word that a pattern with N stands for."""
    n = estimate_wildcards(pattern)
    if n > limit:
        raise TooManyVariants(f"{pattern!r} stands for {n} words, the limit is {limit}")
    parts = [BASES if c == "N" else c for c in pattern]
    return ["".join(p) for p in product(*parts)]


def _changed(word: str, places: tuple[int, ...]) -> Iterator[str]:
    letters = list(word)
    for bases in product(*[[b for b in BASES if b != word[p]] for p in places]):
        for p, b in zip(places, bases, strict=True):
            letters[p] = b
        yield "".join(letters)
        for p in places:
            letters[p] = word[p]


def mutations(word: str, distance: int, limit: int = MAX_VARIANTS) -> list[str]:
    """The words within a distance, the word itself included, sorted."""
    if distance > len(word) // 2:
        raise FuzzyError(f"a distance of {distance} is over half of {len(word)} bases")
    if estimate_mutations(len(word), distance) > limit:
        raise TooManyVariants(f"about {estimate_mutations(len(word), distance)} words, the limit is {limit}")
    return sorted({v for d in range(distance + 1) for places in combinations(range(len(word)), d) for v in _changed(word, places)})


def grouped_mutations(word: str, groups: tuple[PositionGroup, ...], limit: int = MAX_VARIANTS) -> list[str]:
    """The words that differ within the groups only, each group within its limit. Over the limit is an error, never a cut."""
    check_positions(groups, len(word))
    if estimate_groups(groups) > limit:
        raise TooManyVariants(f"{estimate_groups(groups)} words, the limit is {limit}")
    own = [[places for d in range(g.limit + 1) for places in combinations(g.positions, d)] for g in groups]
    return sorted({v for pick in product(*own) for v in _changed(word, tuple(p for part in pick for p in part))})


def normalise_length(query: str, k: int) -> list[str]:
    """Words or patterns of length k: shorter queries padded with N on either side, longer ones cut to every window."""
    d = len(query) - k
    if abs(d) > MAX_LENGTH_CHANGE:
        raise FuzzyError(f"a query of {len(query)} bases is over {MAX_LENGTH_CHANGE} off {k}")
    if d <= 0:
        return list(dict.fromkeys("N" * i + query + "N" * (-d - i) for i in range(-d + 1)))
    return [query[i : i + k] for i in range(d + 1)]


def normalise_likely(query: str, k: int) -> list[str]:
    """The forms of normalise_length, those nearest the middle first: evenly padded, or cut evenly at both ends."""
    every = normalise_length(query, k)
    return sorted(every, key=lambda form: abs(2 * every.index(form) - abs(len(query) - k)))


def normalisation_report(query: str, k: int) -> dict[str, object]:
    d = len(query) - k
    kind = "none" if d == 0 else "padded" if d < 0 else "truncated"
    return {"type": kind, "original_length": len(query), "target_length": k, "variants": len(normalise_length(query, k))}


@dataclass(frozen=True)
class FuzzyQuery:
    """A pattern over A, C, G, T, N with a tolerance; position groups replace the tolerance."""

    pattern: str
    k: int
    distance: int = 0
    groups: tuple[PositionGroup, ...] = field(default_factory=tuple)
    limit: int = MAX_VARIANTS

    def check(self) -> None:
        if not self.pattern or len(self.pattern) > MAX_QUERY or not re.fullmatch("[ACGTN]+", self.pattern):
            raise FuzzyError(f"a query is 1 to {MAX_QUERY} of A, C, G, T, N: {self.pattern[:80]!r}")
        if not self.groups and self.distance > self.k // 2:
            raise FuzzyError(f"a distance of {self.distance} is over half of {self.k}")
        if self.groups:
            check_positions(self.groups, self.k)
        if self.limit < 1:
            raise FuzzyError("the limit must be positive")

    def estimate(self) -> int:
        """How many words the query stands for at most."""
        words = sum(map(estimate_wildcards, normalise_length(self.pattern, self.k)))
        return words * (estimate_groups(self.groups) if self.groups else exact_mutations(self.k, self.distance))

    def expand(self) -> list[str]:
        """Length, then wildcards, then mutations; sorted and distinct. Never holds more than twice the limit."""
        self.check()
        out: set[str] = set()
        for pattern in normalise_length(self.pattern, self.k):
            for word in expand_wildcards(pattern, self.limit):
                if self.groups:
                    out.update(grouped_mutations(word, self.groups, self.limit))
                else:
                    out.update(mutations(word, self.distance, self.limit) if self.distance else (word,))
                if len(out) > self.limit:
                    raise TooManyVariants(f"{self.pattern!r} stands for more words than its limit of {self.limit}")
        return sorted(out)

    def accepts(self, word: Column) -> Column:
        """The query as a predicate on words of k bases, for scans."""
        self.check()
        tests = []
        for form in normalise_length(self.pattern, self.k):
            fixed = [(i, b) for i, b in enumerate(form) if b != "N"]
            if not self.groups and not self.distance:
                tests.append(word.like(form.replace("N", "_")))
                continue
            differs = {i: F.when(F.substring(word, i + 1, 1) != b, 1).otherwise(0) for i, b in fixed}

            def within(places: Iterable[int], most: int, differs=differs) -> Column:
                own = [differs[i] for i in places if i in differs]
                return reduce(lambda x, y: x + y, own) <= most if own else F.lit(True)

            if not self.groups:
                tests.append(within(range(self.k), self.distance))
                continue
            grouped = {p for g in self.groups for p in g.positions}
            parts = [within(g.positions, g.limit) for g in self.groups] + [within([i], 0) for i, _ in fixed if i not in grouped]
            tests.append(reduce(lambda x, y: x & y, parts))
        return reduce(lambda x, y: x | y, tests)

    def distance_column(self, word: Column) -> Column:
        """As distance_of, on a column."""
        each = [reduce(lambda x, y: x + y, [F.when(F.substring(word, i + 1, 1) != b, 1).otherwise(0) for i, b in enumerate(form) if b != "N"] or [F.lit(0)]) for form in normalise_length(self.pattern, self.k)]
        return F.least(*each) if len(each) > 1 else each[0]

    def distance_of(self, word: str) -> int:
        """The smallest number of places in which a word differs from the query, N apart."""
        return min(sum(p != "N" and p != w for p, w in zip(pattern, word, strict=True)) for pattern in normalise_length(self.pattern, self.k))

    def kind(self) -> str:
        if len(self.pattern) != self.k:
            return "normalised"
        if self.groups:
            return "positions"
        if self.distance:
            return "mutation" if "N" not in self.pattern else "combined"
        return "wildcard" if "N" in self.pattern else "exact"


#: Words of all queries together up to which they are listed on the driver and sent to every task; beyond it the
#: queries are dealt out, listed by the tasks, and joined by a shuffle.
TOGETHER = 200_000

VARIANT = "query_id int, query string, sequence string, distance int, match_type string"


def _listed(i: int, q: FuzzyQuery) -> list[tuple]:
    return [(i, q.pattern, w, q.distance_of(w), q.kind()) for w in q.expand()]


def _status(i: int, q: FuzzyQuery) -> tuple:
    try:
        return (i, q.pattern, len(q.expand()), q.distance, "ok")
    except TooManyVariants:
        return (i, q.pattern, 0, q.distance, "too many variants")
    except ValueError as e:
        return (i, q.pattern, 0, q.distance, f"error: {e}")


def _small(queries: list[FuzzyQuery]) -> bool:
    return sum(q.limit for q in queries) <= TOGETHER


def _over(spark: SparkSession, queries: list[FuzzyQuery], work: Callable[[int, FuzzyQuery], list[tuple]], schema: str) -> DataFrame:
    """work's rows of every query: made here for few words, else by the tasks."""
    if _small(queries):
        return spark.createDataFrame([r for i, q in enumerate(queries) for r in work(i, q)], schema)
    columns = [c.split()[0] for c in schema.split(", ")]
    parts = min(len(queries), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(i, q.pattern, q.k, q.distance, [(list(g.positions), g.limit) for g in q.groups], q.limit) for i, q in enumerate(queries)], "i int, pattern string, k int, distance int, groups array<struct<positions: array<int>, most: int>>, n int").repartition(parts)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                groups = tuple(PositionGroup(tuple(int(p) for p in g["positions"]), int(g["most"])) for g in r.groups)
                yield pd.DataFrame(work(r.i, FuzzyQuery(r.pattern, r.k, r.distance, groups, r.n)), columns=columns)

    return rows.mapInPandas(run, schema)


def _variants_or_none(i: int, q: FuzzyQuery) -> list[tuple]:
    try:
        return _listed(i, q)
    except ValueError:
        return []


def search(table: DataFrame, queries: list[FuzzyQuery], beyond: str = "error") -> DataFrame:
    """query_id, query, sequence, count, match_type, distance for every word of every query that the table holds.

    All queries are one job. A word is taken as it is, or else under its reverse complement. A query that stands
    for more words than its limit raises TooManyVariants, or with beyond="scan" is answered by a pass over the table.
    """
    if beyond not in ("error", "scan"):
        raise ValueError(f"beyond is 'error' or 'scan', not {beyond!r}")
    for q in queries:
        q.check()
    spark = table.sparkSession
    refused = [i for i, _, _, _, status in _over(spark, queries, lambda i, q: [_status(i, q)], STATUS).where("status <> 'ok'").collect()]
    if refused and beyond == "error":
        raise TooManyVariants("; ".join(f"{queries[i].pattern!r} stands for more words than its limit of {queries[i].limit}" for i in refused[:10]))
    out = _matched(table, _over(spark, queries, _variants_or_none, VARIANT), _small(queries))
    for i in refused:
        out = out.union(scan(table, queries[i], i))
    return out


def scan(table: DataFrame, query: FuzzyQuery, query_id: int = 0) -> DataFrame:
    """As search for one query, by testing every word of the table and its reverse complement; exact for any number of variants."""
    word = F.col("sequence")
    own = table.select(F.col("kmer").alias("sequence"), "count", F.lit(0).alias("_r")).where(query.accepts(word))
    other = table.select(reverse_complement(F.col("kmer")).alias("sequence"), "count", F.lit(1).alias("_r")).where(query.accepts(word))
    # A word that the table holds itself goes before one that it holds as a reverse complement.
    best = own.union(other).groupBy("sequence").agg(F.min(F.struct("_r", "count")).alias("_b"))
    hits = best.where("_b.count > 0")
    return hits.select(F.lit(query_id).alias("query_id"), F.lit(query.pattern).alias("query"), "sequence", F.col("_b.count").alias("count"), F.lit(query.kind()).alias("match_type"), query.distance_column(word).alias("distance"))


STATUS = "query_id int, query_string string, variants_generated int, mutations int, status string"


def _matched(table: DataFrame, variants: DataFrame, small: bool) -> DataFrame:
    asked = variants.withColumn("_rc", reverse_complement(F.col("sequence")))
    # Only rows that a variant names leave the scan's stage; where the variants are sent along, TOGETHER bounds them.
    wanted = asked.select(F.col("sequence").alias("kmer")).union(asked.select(F.col("_rc").alias("kmer"))).distinct()
    hit = table.join(F.broadcast(wanted), "kmer", "left_semi") if small else table
    one, two = hit.select(F.col("kmer").alias("sequence"), F.col("count").alias("_own")), hit.select(F.col("kmer").alias("_rc"), F.col("count").alias("_other"))
    found = asked.join(one, "sequence", "left").join(two, "_rc", "left").withColumn("count", F.coalesce("_own", "_other")).where("count > 0")
    return found.select("query_id", "query", "sequence", "count", "match_type", "distance")


def search_batch(table: DataFrame, queries: list[FuzzyQuery], fail_fast: bool = False) -> DataFrame:
    """One row per query: query_id, query_string, variants_generated, mutations, total_matches (sum of counts), matched_kmers, status.

    A query that is malformed or over its limit has its error as status and no matches; with fail_fast the first one raises.
    """
    spark = table.sparkSession
    status = _over(spark, queries, lambda i, q: [_status(i, q)], STATUS)
    if fail_fast:
        bad = status.where("status <> 'ok'").orderBy("query_id").head()
        if bad:
            raise FuzzyError(f"query {bad['query_id']}, {bad['query_string'][:80]!r}: {bad['status']}")
    per = _matched(table, _over(spark, queries, _variants_or_none, VARIANT), _small(queries)).groupBy("query_id").agg(F.sum("count").alias("_sum"), F.count("*").alias("_n"))
    return status.join(per, "query_id", "left").select("query_id", "query_string", "variants_generated", "mutations", F.coalesce("_sum", F.lit(0)).alias("total_matches"), F.coalesce("_n", F.lit(0)).alias("matched_kmers"), "status")


def near_words(words: DataFrame, query: str, distance: int, word: str = "kmer") -> DataFrame:
    """The words within a distance of a query, with their distance; other lengths never are. A scan, for tables small or unindexed."""
    from ..functions.sequence import hamming

    return words.withColumn("distance", hamming(F.col(word), F.lit(query))).where(F.col("distance") <= distance)


def matches_by_distance(found: DataFrame, distance: int) -> DataFrame:
    return found.where(F.col("distance") == distance)


def top_matches(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(F.desc("count"), "sequence").limit(n)
