"""Bounded top-k search for similar names.

The measure is ``difflib.SequenceMatcher.ratio``, lifted to a fixed score where one name holds the
other. It can't be indexed, but it is never above the share of common letters, which can:

1. A few companies that share rare trigrams with a name are scored first. The k-th best of them is the
   name's floor: no pair bounded below it can be among its k best. Leaving a seed out costs speed only.
2. Two strings whose common letters reach the floor share one of the rarest letters (numbered by
   occurrence) in a short prefix of both. That is the join key; lengths and the positions of the
   letter in both prefixes are conditions of the join. Containment is found by its rarest trigram.
3. The candidates of a name are read by falling bound. Scoring stops where no bound beats the k-th
   best score; candidates of names with very many go through several such searches.

Names of different scopes (dataset snapshots) never meet.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlake import vocab
from brokerlake.scale import durable

#: Rare trigrams of a name that are looked up, companies looked at for each, and seeds scored.
_SEED_GRAMS, _SEED_POSTINGS, _SEEDS = 4, 64, 8
#: Candidates of a name that are searched in one go.
_SEARCH = 20_000
_SLACK = 1e-9


def grams(column: Column, size: int) -> Column:
    """Distinct substrings of the given length."""
    last = F.char_length(column) - (size - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1))))
    none = F.array().cast("array<string>")
    return F.coalesce(
        F.array_distinct(F.transform(starts, lambda i: F.substring(column, i, F.lit(size)))), none
    )


def letters(column: Column) -> Column:
    """The letters of a name as a set of (letter, how often so far), e.g. o1 o2."""
    size = F.char_length(column)
    starts = F.when(size >= 1, F.sequence(F.lit(1), F.greatest(size, F.lit(1))))
    single = F.transform(starts, lambda i: F.substring(column, i, F.lit(1)))
    numbered = F.transform(
        single,
        lambda c, i: F.concat(
            c, F.size(F.filter(F.slice(single, F.lit(1), i + 1), lambda d: d == c)).cast("string")
        ),
    )
    return F.coalesce(numbered, F.array().cast("array<string>"))


@F.pandas_udf(T.DoubleType())
def name_ratio(name: pd.Series, company: pd.Series) -> pd.Series:
    """``SequenceMatcher`` ratio, without the lift."""
    matcher = difflib.SequenceMatcher(None)
    out = []
    for left, right in zip(name, company):
        matcher.set_seqs(left, right)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def _letter_bound(name: pd.Series, company: pd.Series) -> pd.Series:
    """Twice the common letters over all letters: at least the ratio."""
    counted: dict[str, Counter] = {}

    def of(text: str) -> Counter:
        if text not in counted:
            counted[text] = Counter(text)
        return counted[text]

    return pd.Series([
        2 * sum((of(left) & of(right)).values()) / max(1, len(left) + len(right))
        for left, right in zip(name, company)
    ], dtype="float64")


def inside(name: str = "name", company: str = "company") -> Column:
    """Whether one of two names holds the other."""
    return F.contains(company, name) | F.contains(name, company)


def lifted(ratio: Column, holds: Column) -> Column:
    """The score of a pair: its ratio, or the containment score where that is more."""
    return F.when(holds, F.greatest(ratio, F.lit(vocab.CONTAINMENT_SCORE))).otherwise(ratio)


def contained(
    inner: DataFrame, outer: DataFrame, small: str, large: str, scope: tuple[str, ...] = ()
) -> DataFrame:
    """Pairs where ``inner.id`` is a substring of ``outer.id``, joined on one gram of ``inner``.

    A gram nobody has means no container; otherwise the rarest trigram (a single letter, for shorter
    names) decides. Both tables are distinct in (scope, id).
    """
    gram_sets = outer.select(
        *scope, F.col("id").alias(large),
        F.explode(F.array_union(grams(F.col("id"), 3), grams(F.col("id"), 1))).alias("gram"),
    )
    weights = gram_sets.groupBy(*scope, "gram").agg(F.count("*").alias("weight"))
    own = F.when(F.char_length("id") >= 3, grams(F.col("id"), 3)).otherwise(grams(F.col("id"), 1))
    picked = (
        inner.select(*scope, F.col("id").alias(small), F.explode(own).alias("gram"))
        .join(weights, [*scope, "gram"], "left")
        .groupBy(*scope, small)
        .agg(F.min_by("gram", F.struct(F.coalesce("weight", F.lit(0)), "gram")).alias("gram"))
    )
    return (
        picked.join(gram_sets, [*scope, "gram"]).where(F.contains(F.col(large), F.col(small)))
        .select(*scope, small, large)
    )


def _floors(names: DataFrame, companies: DataFrame, threshold: float, keep: int) -> DataFrame:
    """``names`` with ``floor``: the score of the keep-th best seed, or the threshold."""
    postings = companies.select(
        "scope", F.col("id").alias("company"), F.explode(grams(F.col("id"), 3)).alias("gram")
    )
    weights = postings.groupBy("scope", "gram").agg(F.count("*").alias("weight"))
    # any few companies of a gram will do: a seed only raises the floor
    few = Window.partitionBy("scope", "gram").orderBy(F.xxhash64("company"), "company")
    shown = postings.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= _SEED_POSTINGS)
    rarest = Window.partitionBy("scope", "name").orderBy("weight", "gram")
    asked = (
        names.select("scope", F.col("id").alias("name"), F.explode(grams(F.col("id"), 3)).alias("gram"))
        .join(weights, ["scope", "gram"])
        .withColumn("_n", F.row_number().over(rarest)).where(F.col("_n") <= _SEED_GRAMS)
    )
    common = Window.partitionBy("scope", "name").orderBy(F.desc("shared"), "apart", "company")
    seeds = (
        asked.drop("_n").join(shown.drop("_n"), ["scope", "gram"])
        .groupBy("scope", "name", "company").agg(F.count("*").alias("shared"))
        .withColumn("apart", F.abs(F.char_length("name") - F.char_length("company")))
        .withColumn("_n", F.row_number().over(common)).where(F.col("_n") <= _SEEDS)
        .withColumn("ratio", lifted(name_ratio(F.col("name"), F.col("company")), inside()))
    )
    best = F.sort_array(F.collect_list("ratio"), asc=False)  # at most _SEEDS
    floors = seeds.groupBy("scope", F.col("name").alias("id")).agg(F.get(best, keep - 1).alias("_kth"))
    floor = F.greatest(F.coalesce("_kth", F.lit(0.0)), F.lit(threshold))
    return names.join(floors, ["scope", "id"], "left").withColumn("floor", floor).drop("_kth")


def _close(names: DataFrame, companies: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose common letters may reach the name's floor, by a shared letter of both prefixes."""
    weights = companies.select("scope", F.explode("letters").alias("token")).groupBy(
        "scope", "token"
    ).agg(F.count("*").alias("weight"))

    def ranked(side: DataFrame, *more: str) -> DataFrame:
        """The letters of each name, rarest first; a letter no company has is the rarest."""
        tokens = side.select(
            "scope", "id", F.size("letters").alias("len"), *more, F.explode("letters").alias("token")
        ).join(weights, ["scope", "token"], "left")
        by_rarity = Window.partitionBy("scope", "id").orderBy(F.coalesce("weight", F.lit(0)), "token")
        return tokens.withColumn("at", F.row_number().over(by_rarity)).drop("weight")

    def needed(score: Column | float, length: Column) -> Column:
        """Letters shared with the shortest partner that can reach the score."""
        score = score if isinstance(score, Column) else F.lit(score)
        shortest = F.ceil(length * score / (2 - score) - _SLACK)
        return F.greatest(F.ceil(score / 2 * (length + shortest) - _SLACK), F.lit(1))

    left = ranked(names, "floor")
    left = left.where(F.col("at") <= F.col("len") - needed(F.col("floor"), F.col("len")) + 1).select(
        "scope", "token", F.col("id").alias("name"), F.col("len").alias("la"), F.col("at").alias("ia"), "floor"
    )
    right = ranked(companies)
    right = right.where(F.col("at") <= F.col("len") - needed(threshold, F.col("len")) + 1).select(
        "scope", "token", F.col("id").alias("company"), F.col("len").alias("lb"), F.col("at").alias("ib")
    )
    letters_of_both = F.col("la") + F.col("lb")
    shared = F.greatest(F.ceil(F.col("floor") / 2 * letters_of_both - _SLACK), F.lit(1))
    fits = (
        (left["scope"] == right["scope"]) & (left["token"] == right["token"])
        & (2 * F.least("la", "lb") >= F.col("floor") * letters_of_both - _SLACK)
        & (F.col("ia") <= F.col("la") - shared + 1) & (F.col("ib") <= F.col("lb") - shared + 1)
    )
    return left.join(right, fits).select(left["scope"], "name", "company").distinct()


def candidate_pairs(
    names: DataFrame, companies: DataFrame, threshold: float, keep: int
) -> DataFrame:
    """Pairs that may be among a name's ``keep`` best: scope, name, company, floor, held, bound.

    Both tables hold distinct (scope, id); ``companies`` also ``first``, the order of equal scores.
    A pair whose score is the containment score whatever its ratio counts only if it is among the
    first ``keep`` of its name.
    """
    a = durable(names.select("scope", "id").withColumn("letters", letters(F.col("id"))))
    b = durable(companies.select("scope", "id", "first").withColumn("letters", letters(F.col("id"))))
    floored = durable(_floors(a, b, threshold, keep))
    holding = floored.where(F.col("floor") <= vocab.CONTAINMENT_SCORE)
    held = contained(holding, b, "name", "company", ("scope",)).unionByName(
        contained(b, holding, "company", "name", ("scope",))
    )
    every = (
        _close(floored, b, threshold).unionByName(held).distinct()
        .join(floored.select("scope", F.col("id").alias("name"), "floor"), ["scope", "name"])
        .join(b.select("scope", F.col("id").alias("company"), "first"), ["scope", "company"])
        .withColumn("held", inside())
        .withColumn("bound", _letter_bound(F.col("name"), F.col("company")))
    )
    score = vocab.CONTAINMENT_SCORE
    flat = F.col("held") & (F.col("bound") <= score)
    order = Window.partitionBy("scope", "name", "flat").orderBy("first")
    fixed = (
        every.withColumn("flat", flat).where("flat").withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= keep).drop("_n", "flat").withColumn("bound", F.lit(score))
    )
    return every.where(~flat).unionByName(fixed).where(F.col("bound") >= F.col("floor") - _SLACK)


def _best_bounded_first(keep: int):
    """The mapInPandas function over rows in order of (scope, name, salt, falling bound)."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = difflib.SequenceMatcher(None)
        current, best = None, []
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                key = (row.scope, row.name, row.salt)
                if key != current:
                    current, best = key, [row.floor] * keep
                if row.bound < best[-1] - _SLACK:
                    continue
                if row.held and row.bound <= vocab.CONTAINMENT_SCORE:
                    ratio, scored = vocab.CONTAINMENT_SCORE, False
                else:
                    matcher.set_seqs(row.name, row.company)
                    ratio, scored = matcher.ratio(), True
                    if row.held:
                        ratio = max(ratio, vocab.CONTAINMENT_SCORE)
                rows.append((row.scope, row.name, row.company, ratio, scored))
                if ratio > best[-1]:
                    best = sorted([*best[:-1], ratio], reverse=True)
            yield pd.DataFrame(rows, columns=["scope", "name", "company", "ratio", "scored"])

    return search


def top_similar(names: DataFrame, companies: DataFrame, threshold: float, keep: int) -> DataFrame:
    """Pairs that hold every name's ``keep`` best companies, ties included, with their ``ratio``.

    ``scored`` tells whether the ratio had to be computed. Rows below the threshold are pairs that
    were compared in vain.
    """
    pairs = durable(candidate_pairs(names, companies, threshold, keep))
    sizes = pairs.groupBy("scope", "name").agg(F.count("*").alias("_n"))
    salts = (F.col("_n") / _SEARCH).cast("int") + 1
    ordered = (
        pairs.join(sizes, ["scope", "name"])
        .withColumn("salt", F.pmod(F.xxhash64("company"), salts))
        .repartition("scope", "name", "salt")
        .sortWithinPartitions("scope", "name", "salt", F.desc("bound"), "company")
    )
    return ordered.select("scope", "name", "company", "floor", "held", "bound", "salt").mapInPandas(
        _best_bounded_first(keep), "scope string, name string, company string, ratio double, scored boolean"
    )
