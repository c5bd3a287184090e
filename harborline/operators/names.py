"""Names by similarity: an index that leaves few pairs to compare, then the exact score of each.

The score (``token_set_ratio``) of two names depends on their sets of words alone, so sets are matched and not rows; repeated names
meet nobody twice. A pair can reach a score of T in two ways:

* Words in common make up T / (200 - T) of the shorter set, or more. Sorted from rare to frequent, the words of a set from
  where the rest is too short for that need no index: a pair meets by one of the words before (a prefix filter).
* The longest common subsequence of the joined words has T / 200 of both lengths, or more. So many letters, counted with
  repeats, are in common; of sorted letters a prefix is enough, and it must share two letters, so pairs of letters are the key.

The second way is only asked with the score that a mention's best names have reached by the first, and not at all at 100. Names
that share a mention's rare stretches of letters are scored before, only to raise that score. Where it leaves room for
K insertions and deletions, each spoils one of K + 1 stretches that are apart and within words, so one of them stands whole in a
word of the name: the rarest such stretches are the keys, and letters are only asked where there are not enough.
Everything is an equi-join; frequent words and letters come last in the order and so are seldom in a prefix.
"""

from __future__ import annotations

import re
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ..materialize import materialized

#: Sets of words up to the first length are keyed by pairs of letters, those above the second by single ones; in between by both,
#: so any two whose lengths may fit (a factor of 1.9 at most from T = 70 on) share a kind of key.
PAIRS_UP_TO, SINGLE_ABOVE = 192, 64


#: Lengths of stretches, and the most names that one of them may bring before the score is known.
STRETCHES, FEW = (8, 4), 32


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of b."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    row = every = (1 << len(b)) - 1
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & every
    return len(b) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 (1 - insertions and deletions / both lengths), by the longest common subsequence."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def name_words(name: str | None) -> list[str]:
    return sorted(set(re.findall(r"\w+", (name or "").lower())))


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of two names by their common and their other words, letter case and order aside."""
    x, y = set(name_words(a)), set(name_words(b))
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = " ".join(filter(None, [both, *[" ".join(sorted(x - y))]])), " ".join(filter(None, [both, *[" ".join(sorted(y - x))]]))
    return max(indel_ratio(left, right), indel_ratio(both, left) if both else 0.0, indel_ratio(both, right) if both else 0.0)


@F.pandas_udf(StringType())
def _word_set(name: pd.Series) -> pd.Series:
    return name.map(lambda x: " ".join(name_words(x)))


@F.pandas_udf(DoubleType())
def _score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype=float)


def _need(size: Column, threshold: Column) -> Column:
    """The share of its own length that a set must have in common, as the shorter one or the other."""
    return size * threshold / (200 - threshold) - 1e-9


def _rare_first(rows: DataFrame, of: DataFrame, item: str) -> DataFrame:
    """rows(key, item) plus n: how many rows of the other side have the item (0: none)."""
    return rows.join(of.groupBy(item).agg(F.count("*").alias("n")), item, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def by_words(mentions: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(mention_key, name_key) that may have enough words in common; both sides: key, the joined words of a set."""
    word = lambda df: df.select("key", F.explode(F.split("key", " ")).alias("word"))
    a, b = word(mentions), word(names)

    def prefix(rows: DataFrame, other: DataFrame) -> DataFrame:
        rest = F.sum(F.length("word") + 1).over(Window.partitionBy("key").orderBy("n", "word").rowsBetween(Window.currentRow, Window.unboundedFollowing)) - 1
        return _rare_first(rows, other, "word").withColumn("rest", rest).where((F.col("rest") >= _need(F.length("key"), F.lit(threshold))) & (F.col("n") > 0)).select("key", "word")

    m, n = lambda df: df.withColumnRenamed("key", "mention_key"), lambda df: df.withColumnRenamed("key", "name_key")
    return m(prefix(a, b)).join(n(b), "word").union(m(a).join(n(prefix(b, a)), "word")).select("mention_key", "name_key").distinct()


@F.pandas_udf(ArrayType(StringType()))
def _letters(key: pd.Series) -> pd.Series:
    """Letters of a text, each with how often it has come before."""

    def numbered(t: str) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for c in t:
            seen[c] = seen.get(c, 0) + 1
            out.append(f"{c}{seen[c]}")
        return out

    return key.map(numbered)


def _keys(least_pair: bool):
    @F.pandas_udf(ArrayType(StringType()))
    def keys(prefix: pd.Series, size: pd.Series) -> pd.Series:
        def of(items, n):
            items, out = list(items), []
            if least_pair and n <= PAIRS_UP_TO:
                out += ["|".join(sorted(p)) for p in combinations(items, 2)]
            if not least_pair or n > SINGLE_ABOVE:
                out += items
            return out

        return pd.Series([of(p, n) for p, n in zip(prefix, size)])

    return keys


def by_letters(mentions: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(mention_key, name_key) that may have a common subsequence long enough; mentions: key, reach (the score to reach)."""
    two = threshold > 50  # below that, single letters in common can be enough
    letter = lambda df, *more: df.select("key", *more, F.explode(_letters(F.col("key"))).alias("letter"))
    b = letter(names, F.lit(threshold).alias("reach"))

    def prefix(rows: DataFrame) -> DataFrame:
        size = F.length("key")
        enough = F.greatest(F.ceil(_need(size, F.col("reach"))), F.lit(2 if two else 1))
        placed = _rare_first(rows, b, "letter").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("n", "letter"))).where(F.col("place") <= size - enough + (2 if two else 1))
        kept = placed.groupBy("key", "reach").agg(F.collect_list("letter").alias("prefix"))
        return kept.select("key", "reach", F.explode(_keys(two)(F.col("prefix"), size)).alias("at"))

    m = prefix(letter(mentions, "reach")).select(F.col("key").alias("mention_key"), "reach", "at")
    n = prefix(b).select(F.col("key").alias("name_key"), "at")
    s, t = F.length("mention_key"), F.length("name_key")
    near = 200 * F.least(s, t) >= F.col("reach") * (s + t) - 1e-6
    return m.join(n, "at").where(near).select("mention_key", "name_key").distinct()


@F.pandas_udf(ArrayType(StructType().add("at", IntegerType()).add("gram", StringType())))
def _stretches(key: pd.Series) -> pd.Series:
    """All stretches of a text, with where they begin; none holds a space."""
    return key.map(lambda k: [{"at": i, "gram": k[i : i + q]} for q in STRETCHES for i in range(len(k) - q + 1) if " " not in k[i : i + q]])


@F.pandas_udf(ArrayType(StringType()))
def _rarest_apart(found: pd.Series, need: pd.Series) -> pd.Series:
    """The rarest stretches (n, at, gram) that do not overlap, ``need`` of them, or null where that many are not found."""

    def of(items, need):
        out: list[dict] = []
        for g in sorted([] if items is None else items, key=lambda g: (g["n"], g["at"], -len(g["gram"]))):
            if len(out) < need and all(g["at"] >= o["at"] + len(o["gram"]) or o["at"] >= g["at"] + len(g["gram"]) for o in out):
                out.append(g)
        return [g["gram"] for g in out] if len(out) == need else None

    return pd.Series([of(f, n) for f, n in zip(found, need)], dtype=object)


def fuzzy_match(mentions: DataFrame, names: DataFrame, threshold: float = 70.0, top: int = 1) -> DataFrame:
    """(mention, id, name, score, rank): best names of each mention at or above the threshold; mentions(mention), names(id, name).

    Each distinct mention once, ties by id; mentions and names that are null or have no word match nothing. Of names with the
    same words the first ``top`` ids are enough. The result is that of comparing all pairs.
    """
    said = materialized(mentions.select("mention").where("mention is not null").distinct().withColumn("key", _word_set(F.col("mention"))).where("key <> ''"), "mentions")
    same = Window.partitionBy("key").orderBy("id")
    known = names.select("id", "name").where("name is not null").withColumn("key", _word_set(F.col("name"))).where("key <> ''")
    known = materialized(known.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= top).drop("_n"), "names")
    asked, given = said.select("key").distinct(), known.select("key").distinct()
    score = lambda pairs: pairs.withColumn("score", _score(F.col("mention_key"), F.col("name_key"))).where(F.col("score") >= threshold)
    cut = lambda df: df.select("key", F.explode(_stretches(F.col("key"))).alias("g")).select("key", "g.at", "g.gram")
    grams = materialized(cut(given).select(F.col("key").alias("name_key"), "gram").distinct(), "grams")
    counted = cut(asked).join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    placed = materialized(counted.groupBy("key").agg(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "gram")).alias("found")), "placed")
    meeting = lambda df, column: df.select(F.col("key").alias("mention_key"), F.explode(column).alias("gram")).join(grams, "gram").select("mention_key", "name_key").distinct()
    likely = meeting(placed, _rarest_apart(F.filter("found", lambda g: (g["n"] > 0) & (g["n"] <= FEW)), F.lit(1)))
    first = materialized(score(by_words(asked, given, threshold).union(likely).distinct()), "by_words")
    best = F.row_number().over(Window.partitionBy("mention_key").orderBy(F.desc("score")))
    reached = first.withColumn("_n", best).where(F.col("_n") == top).select(F.col("mention_key").alias("key"), "score")
    rest = asked.join(reached, "key", "left").select("key", F.coalesce("score", F.lit(threshold)).alias("reach")).where("reach < 100")
    edits = F.floor(2 * F.length("key") * (100 - F.col("reach")) / F.col("reach") + 1e-6) if threshold > 0 else F.lit(1 << 30)
    rest = materialized(rest.join(placed, "key", "left").select("key", "reach", _rarest_apart(F.col("found"), (edits + 1).cast("long")).alias("keys")), "rest")
    near, far = meeting(rest.where("keys is not null"), F.col("keys")), rest.where("keys is null").select("key", "reach")
    pairs = first.union(score(near)).union(score(by_letters(far, given, threshold))).distinct()
    ids = pairs.join(known, pairs["name_key"] == known["key"]).select("mention_key", "id", "name", "score")
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("mention_key").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top)
    return ranked.join(said, ranked["mention_key"] == said["key"]).select("mention", "id", "name", "score", "rank")
