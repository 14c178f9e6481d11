"""Correction candidates of words from a dictionary, as equi-joins instead of loops over all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.similarity import blended, indel_distance, ngram_jaccard, ratcliff_ratio, soundex_variant
from lexloom.functions.text import char_ngrams, letters
from lexloom.operators.setjoin import best_by_jaccard, pairs_by_jaccard
from lexloom.session import shared_dir



def _deletions(word: Column, k: int) -> Column:
    """(variant, d): what is left of a word by d deletions, 0 <= d <= k."""
    level = F.array(word)
    out = F.transform(level, lambda v: F.struct(v.alias("v"), F.lit(0).alias("d")))

    def less(v: Column) -> Column:
        shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))
        return F.when(F.length(v) > 0, shorter).otherwise(F.array().cast("array<string>"))

    def made(d: int):
        return lambda v: F.struct(v.alias("v"), F.lit(d).alias("d"))

    for d in range(1, k + 1):
        level = F.array_distinct(F.flatten(F.transform(level, less)))
        out = F.concat(out, F.transform(level, made(d)))
    return out


def _by_deletions(asked: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """query, word, distance: words are within k if and only if deletions of k letters in all make them equal."""
    side = lambda df, c, d: df.select(c, F.explode(_deletions(F.lower(c), k)).alias("x")).select(c, F.col("x.v").alias("v"), F.col("x.d").alias(d))
    met = side(asked, "query", "da").join(side(words, "word", "db"), "v").where(F.col("da") + F.col("db") <= k)
    return met.groupBy("query", "word").agg(F.min(F.col("da") + F.col("db")).alias("distance"))


def _by_pieces(asked: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """The same for words of more than k letters: of k + 1 pieces of a word, k edits leave one as it is.

    A word's pieces are as equal in length as can be, so its length tells where they begin.  With d more
    letters in the query, a piece moved by s places asks for |s| edits before it and |d - s| after it,
    so only moves of |s| + |d - s| <= k are looked at; pieces meet by the word's length, their number and letters.
    """
    start = lambda size, i: F.call_function("div", size * i, F.lit(k + 1)).cast("int")
    cut = lambda text, size, i, move: F.substring(text, start(size, i) + 1 + move, start(size, i + 1) - start(size, i))
    w, q, n = F.lower("word"), F.lower("query"), F.length("word")
    theirs = words.select("word", n.alias("size"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("i"), cut(w, n, i, F.lit(0)).alias("piece")))).alias("p")).select("word", "size", "p.i", "p.piece")

    def at(d: Column, i: Column, move: Column) -> Column:
        size = F.length("query") - d
        inside = (start(size, i) + move >= 0) & (start(size, i + 1) + move <= F.length("query")) & (size > k)
        return F.when(inside, F.struct(size.alias("size"), i.alias("i"), cut(q, size, i, move).alias("piece")))

    around, pieces = F.sequence(F.lit(-k), F.lit(k)), F.sequence(F.lit(0), F.lit(k))
    moves = lambda d: F.filter(around, lambda s: F.abs(s) + F.abs(d - s) <= k)
    moved = F.transform(around, lambda d: F.flatten(F.transform(pieces, lambda i: F.transform(moves(d), lambda s: at(d, i, s)))))
    ours = asked.select("query", F.explode(F.array_distinct(F.array_compact(F.flatten(moved)))).alias("p")).select("query", "p.size", "p.i", "p.piece")
    pairs = ours.join(theirs, ["size", "i", "piece"]).select("query", "word").distinct().where(F.levenshtein(q, w, k) >= 0)
    return pairs.select("query", "word", indel_distance(q, w).alias("distance")).where(F.col("distance") <= k)


def indel_pairs(queries: DataFrame, dictionary: DataFrame, k: int = 2) -> DataFrame:
    """query, word, distance of all pairs at a distance (substitutions cost 2) of k or less, for any k.

    Both sides meet on what up to k deletions leave of them, or, since these multiply with k, on pieces for
    k above 2 and words of more than k letters.
    """
    asked, words = queries.select("query").distinct(), dictionary.select("word")
    if k <= 2:
        return _by_deletions(asked, words, k)
    short = _by_deletions(asked.where(F.length("query") <= 2 * k), words.where(F.length("word") <= k), k)
    return short.union(_by_pieces(asked, words.where(F.length("word") > k), k))


def edit_candidates(queries: DataFrame, dictionary: DataFrame, k: int = 2) -> DataFrame:
    """query, word, distance, rank: a dictionary word alone, else all within k by (distance, word), else the query itself at 0."""
    asked = queries.select("query").distinct()
    known = asked.join(dictionary.select(F.col("word").alias("w")).distinct(), F.lower("query") == F.col("w"), "left_semi")
    unknown = asked.join(known, "query", "left_anti")
    near = unknown.join(indel_pairs(unknown, dictionary, k), "query", "left")
    word, distance = F.coalesce("word", F.lower("query")).alias("word"), F.coalesce("distance", F.lit(0)).alias("distance")
    whole = near.select("query", word, distance).union(known.select("query", F.lower("query"), F.lit(0)))
    order = Window.partitionBy("query").orderBy("distance", "word")
    return whole.withColumn("rank", F.row_number().over(order))


def ngram_pairs(queries: DataFrame, dictionary: DataFrame, n: int = 2) -> DataFrame:
    """query, word, jaccard of all pairs that share an n-gram (all others have 0)."""
    return pairs_by_jaccard(queries, dictionary, n)


def ngram_best(queries: DataFrame, dictionary: DataFrame, n: int = 2) -> DataFrame:
    """query, word, jaccard, rank: all words of the greatest similarity, rank 1 the first by name.

    Where no word shares an n-gram every word ties at 0; the least word stands for all of them, and
    the query itself if there is no word.
    """
    shared_dir(dictionary.sparkSession)
    dictionary = dictionary.select("word").distinct().checkpoint()  # it may have been drawn from a whole corpus
    best = best_by_jaccard(queries, dictionary, n)
    least = dictionary.agg(F.min("word").alias("least"))
    none = queries.select("query").distinct().join(best.select("query").distinct(), "query", "left_anti")
    filled = none.join(F.broadcast(least)).select("query", F.coalesce("least", F.lower("query")).alias("word"), F.lit(0.0).alias("jaccard"))
    return best.union(filled).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("word")))


def hybrid_candidates(queries: DataFrame, dictionary: DataFrame, n: int = 2, ngram_weight: float = 0.5, edit_weight: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """query, word, score, rank: blended scores of the threshold or more, by (score down, word); else the query at 0.

    A dictionary word scores 1 against itself.  A ratio is at most 2 min / (sum of lengths), and at most
    2 common letters / (sum of lengths), so pairs whose bounds stay below the threshold are dropped
    before the ratio is computed.  Pairs without a
    shared n-gram come by their lengths if the edit weight alone can reach the threshold; if it only
    just can (as by default), the ratio must be 1, so these are equal words shorter than n.
    """
    pairs = ngram_pairs(queries, dictionary, n)
    la, lb = F.length("query"), F.length("word")
    alike = F.when(la + lb > 0, 2 * F.least(la, lb) / F.greatest(la + lb, F.lit(1))).otherwise(1.0)
    if edit_weight >= threshold - 1e-9:
        near = (F.lower("query") == F.col("word")) & (la < n) if edit_weight <= threshold else edit_weight * alike >= threshold - 1e-9
        others = queries.select("query").distinct().join(dictionary.select("word").distinct(), near)
        pairs = others.join(pairs, ["query", "word"], "left_anti").withColumn("jaccard", F.lit(0.0)).union(pairs)
    pairs = pairs.where(ngram_weight * F.col("jaccard") + edit_weight * alike >= threshold - 1e-9)
    # Blocks that match are of common letters, each as often as both words have it.
    asked, words = queries.select("query").distinct(), dictionary.select("word").distinct()
    pairs = pairs.join(asked.select("query", letters(F.lower("query")).alias("x")), "query").join(words.select("word", letters(F.col("word")).alias("y")), "word")
    common = F.when(la + lb > 0, 2 * F.size(F.array_intersect("x", "y")) / F.greatest(la + lb, F.lit(1))).otherwise(1.0)
    pairs = pairs.where(ngram_weight * F.col("jaccard") + edit_weight * common >= threshold - 1e-9)
    scored = pairs.select("query", "word", blended(F.col("jaccard"), ratcliff_ratio(F.lower("query"), F.col("word")), ngram_weight, edit_weight).alias("score"))
    kept = scored.where(F.col("score") >= threshold)
    none = queries.select("query").distinct().join(kept.select("query").distinct(), "query", "left_anti")
    whole = kept.union(none.select("query", F.col("query").alias("word"), F.lit(0.0)))
    return whole.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "word")))


def soundex_candidates(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """query, word: dictionary words of equal phonetic code."""
    asked = queries.select("query").distinct().where("query != ''").withColumn("code", soundex_variant(F.col("query")))
    words = dictionary.where("word != ''").withColumn("code", soundex_variant(F.col("word")))
    return asked.join(words, "code").select("query", "word").distinct()


def soundex_edit(queries: DataFrame, dictionary: DataFrame, k: int = 2) -> DataFrame:
    """query, word, distance: words of equal code within k edits."""
    return indel_pairs(queries, dictionary, k).where(soundex_variant(F.col("query")) == soundex_variant(F.col("word")))


def soundex_ngram(queries: DataFrame, dictionary: DataFrame, n: int = 2) -> DataFrame:
    """query, word, jaccard: of the words of equal code those of the greatest similarity, which may be 0."""
    pairs = soundex_candidates(queries, dictionary)
    alike = ngram_jaccard(char_ngrams(F.lower("query"), n), char_ngrams(F.col("word"), n))
    pairs = pairs.select("query", "word", alike.alias("jaccard"))
    return pairs.withColumn("top", F.max("jaccard").over(Window.partitionBy("query"))).where("jaccard = top").drop("top")
