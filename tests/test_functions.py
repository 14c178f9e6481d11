import difflib
import random

from pyspark.sql import functions as F

from lexloom.functions import similarity, text


def column(spark, values, f):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in frame.select(f(F.col("v"))).collect()]


def pairs(spark, values, f):
    frame = spark.createDataFrame(values, "a string, b string")
    return [r[0] for r in frame.select(f(F.col("a"), F.col("b"))).collect()]


def test_tokenizers(spark):
    assert column(spark, ["", " a\tB c ", None], text.split_words) == [[], ["a", "B", "c"], None]
    assert column(spark, ["Élève_1 l'an", ""], text.word_characters) == [["Élève_1", "l", "an"], []]
    assert column(spark, ["The Cat2 and cat Über"], text.analyze) == [["cat", "über"]]


def test_ngrams(spark):
    assert [sorted(x) for x in column(spark, ["", "a", "ab", "banana"], text.char_ngrams)] == [[], [], ["ab"], ["an", "ba", "na"]]


def indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else min(row[j], new[-1]) + 1)
        row = new
    return row[-1]


def test_indel_distance_and_ratio(spark):
    rng = random.Random(1)
    words = [("", ""), ("", "ab"), ("ab", ""), ("tide", "diet"), ("diet", "tide")]
    words += [tuple("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(2)) for _ in range(150)]
    assert pairs(spark, words, similarity.indel_distance) == [indel(a, b) for a, b in words]
    assert pairs(spark, words, similarity.ratcliff_ratio) == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in words]


def test_jaccard(spark):
    f = lambda a, b: similarity.ngram_jaccard(text.char_ngrams(a), text.char_ngrams(b))
    assert pairs(spark, [("", ""), ("abc", "bcd"), ("ab", "ab")], f) == [0.0, 1 / 3, 1.0]


def test_soundex_variant_published_groups(spark):
    # Words that published results list for one query share a code.
    for group in (["befroe", "behavior", "before", "behaviour"], ["absnce", "absent", "absence"], ["arbitrrily", "arbitrary", "arbitrarily", "arrived"]):
        assert len(set(column(spark, group, similarity.soundex_variant))) == 1
    assert column(spark, ["Tymczak", "Pfister"], similarity.soundex_variant) == ["T520", "P123"]


def test_all_text(spark):
    frame = spark.createDataFrame([("Über Alles", None, "aLL")], "x string, y string, p string")
    assert frame.select(text.all_text(F.col("x"), F.col("y"))).first()[0] == "über alles none"
    assert text.format_bytes(1536) == "1.50 KB"


def test_matching_characters():
    rng = random.Random(2)
    make = lambda: "".join(rng.choice("abcé🎉") for _ in range(rng.randrange(0, 14)))
    pairs = [(make(), make()) for _ in range(3000)] + [("", ""), ("a", ""), ("tide", "diet"), ("diet", "tide"), ("abcabc", "bcabca")]
    got = similarity.matching_characters([a for a, _ in pairs], [b for _, b in pairs])
    want = [sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in pairs]
    assert got.tolist() == want


def test_ratio_of_long_and_short_words(spark):
    rows = [("abc" * 90, "acb" * 80), ("tide", "diet"), ("", ""), ("x", "")]
    frame = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in frame.select(similarity.ratcliff_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in rows]


def test_phrase_codes(spark):
    frame = spark.createDataFrame([("befroe  Robert",), ("",)], "p string")
    got = [r[0] for r in frame.select(similarity.soundex_phrase(F.col("p"))).collect()]
    assert got == [[frame.select(similarity.soundex_variant(F.lit(w))).first()[0] for w in ("befroe", "Robert")], []]
