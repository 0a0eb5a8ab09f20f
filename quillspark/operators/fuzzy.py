"""Exact fuzzy joins: all pairs of strings within an edit distance or above a similarity.

No pair is compared unless it shares a key that every pair within the distance must share:

* distance 1: a string of length m and its m strings with one character deleted; of a pair within
  one edit the shorter is such a string of the longer, or both have one in common;
* distance k of 2 or more: one string is cut into k + 1 segments, of which k edits leave one as it
  is; the other gives its substrings of that length at the places to which the edits before and
  behind can have moved it.

Keys carry the length of the longer string, from which the distance that a similarity allows
follows. Candidates are verified by the distance itself, so that results are exact. Strings are
compared once, whatever the number of their rows; nothing is crossed or blocked by another column.

A segment that very many strings share makes as many candidates as an all-pairs join within them;
distances of 1 are free of that. Defined cases: null strings match nothing; two empty strings
match; repeated strings give each pair of their rows; an empty side gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import octets_of

#: What a similarity may lose by rounding: candidates are looked for with a little more, then verified.
ROUNDING = 1e-6
#: Phrases of at most some hundred keys each that are broadcast.
FEW = 1_000


def _allowed(length: str, similarity: float | None, distance: int | None) -> str:
    """SQL: the distance that the longer length allows."""
    return str(int(distance)) if distance is not None else f"cast(floor({1 - similarity!r} * {length} + {ROUNDING!r}) as int)"


def _lengths(similarity: float | None, distance: int | None) -> str:
    """SQL: the lengths m that the longer of a pair with x may have."""
    top = f"char_length(x) + {int(distance)}" if distance is not None else f"cast(floor(char_length(x) / {similarity!r}) as int) + 1"
    return f"filter(sequence(char_length(x), {top}), m -> m - {_allowed('m', similarity, distance)} <= char_length(x))"


#: SQL: x itself, and where it is as long as m, x with each character deleted.
_DELETED = "if(char_length(x) = m, concat(array(x), transform(sequence(1, m), i -> concat(substring(x, 1, i - 1), substring(x, i + 1)))), array(x))"
#: SQL: the start of segment i (from 0) of a string of length n cut into k + 1; the first ones are shorter.
_START = "(i * (n div (k + 1)) + greatest(0, i - (k + 1 - n % (k + 1))))"
_SIZE = "(n div (k + 1) + if(i < k + 1 - n % (k + 1), 0, 1))"
#: SQL: (n, i, segment) of a string that is cut, and of one that looks for the segments of strings of length n.
_CUT = f"transform(sequence(0, k), i -> named_struct('n', n, 'i', i, 'piece', substring(x, {_START} + 1, {_SIZE})))"
_SOUGHT = f"""transform(filter(sequence({_START} - i, {_START} + i), p -> p >= 0 and p + {_SIZE} <= char_length(x) and abs(p - {_START} - (char_length(x) - n)) <= k - i),
    p -> named_struct('n', n, 'i', i, 'piece', substring(x, p + 1, {_SIZE})))"""


def _keys(strings: DataFrame, cut: bool, similarity: float | None, distance: int | None) -> DataFrame:
    """The rows of strings ``x`` with m, n, i and piece, once for each of their keys."""
    own = strings.columns
    rows = strings.select(*own, F.explode(F.expr(_lengths(similarity, distance))).alias("m")).withColumn("k", F.expr(_allowed("m", similarity, distance)))
    whole = "array(named_struct('n', 0, 'i', 0, 'piece', x))"
    deleted = f"transform({_DELETED}, y -> named_struct('n', 0, 'i', 0, 'piece', y))"
    if cut:
        pieces = f"transform(array(char_length(x)), n -> {_CUT})[0]"
    else:  # if x is shorter than m, the other has length m
        lengths = "if(char_length(x) = m, sequence(greatest(m - k, 0), m), array(m))"
        pieces = f"flatten(transform({lengths}, n -> flatten(transform(sequence(0, k), i -> {_SOUGHT}))))"
    every = f"case when k <= 0 then {whole} when k = 1 then {deleted} else {pieces} end"
    return rows.select(*own, "m", F.explode(F.array_distinct(F.expr(every))).alias("_k")).select(*own, "m", "_k.n", "_k.i", "_k.piece")


def _distance(a: str, b: str, octets: bool) -> Column:
    return F.levenshtein(octets_of(F.col(a)), octets_of(F.col(b))) if octets else F.levenshtein(a, b)


def close(left: DataFrame, a: str, right: DataFrame, b: str, similarity: float | None = None, distance: int | None = None, octets: bool = False) -> DataFrame:
    """(a, b, distance): the distinct pairs of strings of both columns that are close enough, by one of
    the two measures; the similarity is 1 less the distance over the longer length, above 0.

    With ``octets`` edits are of UTF-8 bytes, as engines count them that compare bytes (lengths stay
    those of characters). Such a distance is never below that of characters, for a character that
    isn't kept takes an edit of one of its bytes or within it; so the keys find those pairs too."""
    if (similarity is None) == (distance is None) or similarity is not None and not 0 < similarity <= 1:
        raise ValueError("give either a similarity above 0 or a distance")
    one, two = (df.select(F.col(c).alias("x")).where(F.col(c).isNotNull()).distinct() for df, c in ((left, a), (right, b)))
    mine = _keys(one, False, similarity, distance).withColumnRenamed("x", "a")
    theirs = _keys(two, True, similarity, distance).withColumnRenamed("x", "b")
    pairs = mine.join(theirs, ["m", "n", "i", "piece"]).where("greatest(char_length(a), char_length(b)) = m").select("a", "b").distinct()
    found = pairs.withColumn("distance", _distance("a", "b", octets))
    longest = F.greatest(F.char_length("a"), F.char_length("b"))
    good = F.col("distance") <= distance if distance is not None else F.when(longest == 0, 1.0).otherwise(1 - F.col("distance") / longest) >= similarity
    return found.where(good)


def joined(left: DataFrame, a: str, right: DataFrame, b: str, similarity: float | None = None, distance: int | None = None, equal: dict[str, str] | None = None, octets: bool = False) -> DataFrame:
    """All rows of the left with all of the right whose strings are close enough, with ``distance``;
    the columns of both sides must differ. ``equal`` gives columns of the left and those of the right
    that must have the same value: rows meet by them too."""
    pairs = close(left, a, right, b, similarity, distance, octets).withColumnsRenamed({"a": "_a", "b": "_b"})
    same = [F.col(x) == F.col(y) for x, y in (equal or {}).items()]
    return left.join(pairs, F.col(a) == F.col("_a")).join(right, reduce(Column.__and__, same, F.col("_b") == F.col(b))).drop("_a", "_b")


def phrases_in(docs: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, similarity: float = 0.9, octets: bool = False) -> DataFrame:
    """(key, phrase, found, place, similarity): for each document and phrase the first window of as many
    words as the phrase has that is close enough, by the place of its first word from 1.

    The windows are exploded where they are, with the few keys of strings that are cut, and meet the
    keys of the phrases, which are broadcast if there are at most ``FEW`` phrases; only hits are shuffled then.
    ``octets`` is as in ``close``.
    """
    from quillspark.functions.text import ngrams, tokens

    wanted = phrases.select(F.lower(phrase).alias("phrase")).where("phrase <> ''").distinct().withColumn("words", F.size(tokens(F.col("phrase"))))
    sizes = wanted.groupBy("words").agg(F.min(F.char_length("phrase")), F.max(F.char_length("phrase"))).limit(101).collect()
    if len(sizes) > 100:
        raise ValueError("phrases of more than 100 different numbers of words")
    t = tokens(F.lower(text))

    def of(row):
        """Windows of a number of words that are neither too short nor too long for its phrases."""
        n, least, most = row
        every = F.transform(ngrams(t, n), lambda w, at: F.struct(w.alias("found"), (at + 1).alias("place"), F.lit(n).alias("words")))
        return F.filter(every, lambda w: F.char_length(w["found"]).between(int(least * similarity), int(most / similarity) + 1))

    every = F.concat(*map(of, sizes)) if sizes else F.array().cast("array<struct<found:string,place:int,words:int>>")
    windows = docs.select(F.col(key).alias("key"), F.explode(every).alias("w")).select("key", "w.place", "w.words", F.col("w.found").alias("x"))
    sought = _keys(wanted.withColumnRenamed("phrase", "x"), False, similarity, None).withColumnsRenamed({"x": "phrase"})
    cut = _keys(windows, True, similarity, None).withColumnRenamed("x", "found")
    hits = cut.join(F.broadcast(sought) if wanted.count() <= FEW else sought, ["m", "n", "i", "piece", "words"])
    hits = hits.where("greatest(char_length(found), char_length(phrase)) = m").withColumn("distance", _distance("found", "phrase", octets))
    score = 1 - F.col("distance") / F.col("m")
    first = hits.where(score >= similarity).groupBy("key", "phrase").agg(F.min(F.struct("place", "found", F.round(score, 6).alias("similarity"))).alias("x"))
    return first.select(F.col("key").alias(key), "phrase", "x.found", "x.place", "x.similarity")
