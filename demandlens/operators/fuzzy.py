"""The best of many options for each text, by tiers of likeness, without comparing all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts of up to so many characters are looked up as such; of longer ones, a part of this length.
PART = 4


def normalized(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def likeness(a: Column, b: Column) -> Column:
    """Equal 1000; one starts with the other 800, holds it 600, less the length difference; else 400 times the share of b's
    words that a has, rounded, less a tenth of the difference; 0 without such a word."""
    gap = F.abs(F.length(a) - F.length(b))
    words = F.split(b, " ")
    share = F.size(F.filter(words, lambda w: F.array_contains(F.split(a, " "), w))) / F.size(words)
    return (
        F.when(a == b, 1000.0).when(F.startswith(a, b) | F.startswith(b, a), 800.0 - gap).when(F.contains(a, b) | F.contains(b, a), 600.0 - gap).when(share > 0, F.floor(share * 400 + 0.5) - gap / 10).otherwise(0.0)
    )


def _prefixes(c: str) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substr(F.col(c), F.lit(1), n)))


def _parts(c: str, least: int = 1) -> Column:
    """The distinct parts of up to PART characters (of PART only with ``least`` = PART)."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substr(F.col(c), i, F.lit(n)))
    every = F.array_distinct(F.concat(*(of(n) for n in range(least, PART + 1))))
    return F.explode(F.filter(every, lambda p: F.length(p) >= least) if least > 1 else every)


def _rarest(texts: DataFrame, c: str, part_of_others: DataFrame) -> DataFrame:
    """Of each longer text, the part that the fewest others have; none where no other has all of its parts."""
    counted = part_of_others.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    own = texts.where(F.length(c) > PART).select(c, _parts(c, PART).alias("part")).join(counted, "part", "left")
    return own.groupBy(c).agg(F.min_by("part", F.struct("n", "part")).alias("part"), F.count_if(F.col("n").isNull()).alias("absent")).where("absent = 0").drop("absent")


def best_match(options: DataFrame, targets: DataFrame, minimum: float = 300) -> DataFrame:
    """For each target (target_id, target) the option (place, option) with the highest ``likeness`` above ``minimum`` (not
    negative); ties: first place. Targets without one are left out.

    Normalised texts are made distinct on both sides first, so copies are compared once. Tiers are searched by equality, from
    the best down, each only for the targets that may still gain by it: whole texts and beginnings; texts inside one another, short
    ones as they stand and longer ones by their rarest part of four characters; words, by the rarest ones of which a good
    enough option must have at least one. Of the options that have the same short text or beginning only the best is
    listed. What the parts and words find is scored in full.
    """
    asked = targets.select("target_id", normalized(F.col("target")).alias("b"))
    known = options.select(normalized(F.col("option")).alias("a"), "place").where("a <> ''").groupBy("a").agg(F.min("place").alias("place"))
    todo = asked.select("b").where("b <> ''").distinct()
    size = F.struct(F.length("a").alias("size"), "place")
    gap = F.abs(F.col("best.size") - F.length("b"))
    shown = lambda df, score: df.select("b", F.col("best.place").alias("place"), score.cast("double").alias("score")).where(F.col("score") > minimum)
    top = lambda df: df.groupBy("b").agg(F.min_by(F.struct("place", "score"), F.struct(-F.col("score"), "place")).alias("x")).select("b", "x.*")
    longest = F.min(F.struct((-F.length("a")).alias("less"), "place")).alias("best")

    # an option begins with the text: the shortest counts; the text begins with an option: the longest
    begun = known.select(_prefixes("a").alias("b"), size.alias("best")).groupBy("b").agg(F.min("best").alias("best"))
    first = shown(todo.join(begun, "b"), F.when(gap == 0, 1000).otherwise(800 - gap))
    inverse = todo.select("b", _prefixes("b").alias("a")).where("a <> b").join(known, "a").groupBy("b").agg(longest)
    second = inverse.select("b", F.struct((-F.col("best.less")).alias("size"), F.col("best.place").alias("place")).alias("best"))
    found = [top(first.unionByName(shown(second, 800 - gap)))]

    def left(above: float) -> DataFrame:
        """Targets that have nothing beyond this yet."""
        return todo.join(reduce(DataFrame.unionByName, found).where(F.col("score") > above).select("b").distinct(), "b", "left_anti")

    if minimum < 599:  # the most that a text inside another can score
        rest = left(599)
        part_of_options = known.select("a", "place", _parts("a").alias("part"))
        held = part_of_options.groupBy(F.col("part").alias("b")).agg(F.min(size).alias("best"))
        short = shown(rest.join(held, "b"), 600 - gap)
        parts_of_targets = rest.select("b", _parts("b").alias("part"))
        inside = parts_of_targets.join(known.withColumnRenamed("a", "part"), "part").groupBy("b").agg(F.min(F.struct((-F.length("part")).alias("less"), "place")).alias("best"))
        inside = inside.select("b", F.struct((-F.col("best.less")).alias("size"), F.col("best.place").alias("place")).alias("best"))
        longer = _rarest(rest, "b", part_of_options).join(part_of_options, "part").where(F.contains("a", "b"))
        held_longer = _rarest(known, "a", parts_of_targets).join(known, "a").join(parts_of_targets, "part").where(F.contains("b", "a"))
        scored = longer.select("b", "a", "place").unionByName(held_longer.select("b", "a", "place")).select("b", "place", likeness(F.col("a"), F.col("b")).alias("score")).where(F.col("score") > minimum)
        found.append(top(short.unionByName(shown(inside, 600 - gap)).unionByName(scored)))
    if minimum < 400:  # the most that shared words can score
        rest = left(400)
        words_of_options = known.select("a", "place", F.explode(F.array_distinct(F.split("a", " "))).alias("word"))
        often = words_of_options.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        words = rest.select("b", F.size(F.split("b", " ")).alias("all"), F.explode(F.split("b", " ")).alias("word")).groupBy("b", "all", "word").agg(F.count(F.lit(1)).alias("times")).join(often, "word")
        # from here on, the rarest first, words must not be too few for a score beyond the minimum
        later = F.sum("times").over(Window.partitionBy("b").orderBy(F.desc("n"), F.desc("word")))
        need = F.greatest(F.lit(1), F.ceil((minimum - 0.5) / 400 * F.col("all") - 1e-9))
        chosen = words.withColumn("later", later).where(F.col("later") >= need)
        pairs = chosen.select("b", "word").join(words_of_options, "word").where(F.abs(F.length("a") - F.length("b")) < (400.5 - minimum) * 10).select("b", "a", "place").distinct()
        found.append(top(pairs.select("b", "place", likeness(F.col("a"), F.col("b")).alias("score")).where(F.col("score") > minimum)))
    best = top(reduce(DataFrame.unionByName, found))
    return asked.join(best, "b").select("target_id", "place", "score")

