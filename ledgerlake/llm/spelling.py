"""Spelling variants among the words of a corpus (operator 13).

Two words are near if exactly one code point is inserted, deleted or replaced.
A word's form is its commonest near word, if that is ``factor`` times as common
as the word; following forms ends in the word's root.

Method (PartEnum): a word is the multiset of its letters, a binary vector with a
dimension for each letter and repetition.  Near words of different length differ
in one dimension, near words of equal length in at most two.  The letters are
dealt into groups; for vectors that differ in at most k dimensions there are k
groups without which they are equal.  A signature is the multiset without k
groups, for every choice of k, with the words' length and one of the word's two
halves in its order: one edit leaves one half as it was.  Equal signatures are
joined and each pair is verified, so the answer is exact.

Scale: everything is DataFrame functions.  Each word has a fixed number of
signatures (24).  A signature that many words share would make the square of
them in candidates; such signatures are found in a hashed sixteenth of the words
and refined by the word without one of its letters (at its place), which near
words share as well and at most an alphabet of words has.  The sample only picks
the route, both of which are exact: a signature that it misses has some hundred
words with overwhelming probability.  Refined signatures are broadcast only
where their counted size is below ``HOT_BYTES``.  Chains of forms grow by the
factor at each step, so pointer jumping ends after a few rounds.

Defined results: null texts have no words; rows without an id count as rows with
an empty one; repeated rows count again; ties of forms go to the word that is
smaller in code-point order; null words are left out and rows of the same word
added up; an empty table gives no words; other columns play no part.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import settle

HOT_BYTES = 16 << 20
SAMPLE, SAMPLE_HOT = 16, 8
#: Letters in about the order of their frequency, dealt to the groups in turn to and fro; all others go to the last group.
LETTERS = "etaoinshrdlucmfwypvbgkjqxz" + "".join(chr(c) for c in range(0xDF, 0x100)) + "".join(chr(c) for c in range(0xC0, 0xDF))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAME, SHORTER, LONGER = 0, 1, 2
GROUPS = {SAME: (4, 2), SHORTER: (3, 1), LONGER: (3, 1)}
"""Groups of letters and how many of them a signature leaves out, by the word's part in a pair."""


def corpus_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = 7, most_rare: int = 2, slip: int = 31) -> DataFrame:
    """Words of ``least`` letters or more (A-Z lower-cased, Latin-1 letters) with their counts n,
    from ``most_rare`` on.  Every occurrence in a document whose crc32 with the id divides by
    ``slip`` has lost one letter, as slips of the pen do; 0 leaves words as they are."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"([A-Za-zÀ-ÿ]{{{least},}})"), F.lit(1))).alias("r"))
    word = F.col("w")
    words = runs.select("d", F.translate("r", UPPER, LOWER).alias("w"))
    if slip:
        words = words.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")))
        at = (F.col("h") % F.length("w")).cast("int")
        short = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
        words = words.select(F.when(F.col("h") % slip == 0, short).otherwise(word).alias("w"))
    return words.where(F.length("w") >= least).groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most_rare)


def letter_groups(many: int) -> list[str]:
    """The letters dealt to groups of about equal frequency."""
    groups = [""] * many
    for i, letter in enumerate(LETTERS):
        row, k = divmod(i, many)
        groups[k if row % 2 == 0 else many - 1 - k] += letter
    return groups


def _projections(many: int) -> list[Column]:
    """A word's sorted letters of each group; the last group has all letters outside the table too."""
    groups = letter_groups(many)
    patterns = [f"[^{g}]+" for g in groups[:-1]] + [f"[{''.join(groups[:-1])}]+"]
    return [F.regexp_replace("letters", p, "").alias(f"g{many}_{i}") for i, p in enumerate(patterns)]


def signatures(side: int) -> Column:
    """The word's signatures as one side of a pair: an array of hashes.  Verification follows, so
    that a hash stands for the signature costs a comparison at most."""
    many, dropped = GROUPS[side]
    n = F.col("len") - (1 if side == LONGER else 0)
    half = F.floor(n / 2).cast("int")
    halves = [F.substr("word", F.lit(1), half), F.substr("word", half + (2 if side == LONGER else 1))]
    kind = SAME if side == SAME else SHORTER
    keys = []
    for d, kept in enumerate(combinations(range(many), many - dropped)):
        keys += [F.xxhash64(F.lit((kind * 100 + d) * 2 + h), n, part, *(F.col(f"g{many}_{g}") for g in kept)) for h, part in enumerate(halves)]
    return F.array(*keys)


def _of_side(side: int) -> Column:
    return F.transform(signatures(side), lambda sig: F.struct(F.lit(side).alias("side"), sig.alias("sig")))


def _one_less(place: Column) -> Column:
    return F.concat(F.substr("word", F.lit(1), place - 1), F.substr("word", place + 1))


def _keys() -> Column:
    """What a row is joined on: its signature, or for a hot one the refined signatures."""
    places = F.sequence(F.lit(1), F.col("len"))
    same = F.transform(places, lambda p: F.xxhash64("sig", p, _one_less(p)))
    longer = F.array_distinct(F.transform(places, lambda p: F.xxhash64("sig", _one_less(p))))
    refined = F.when(F.col("side") == SAME, same).when(F.col("side") == LONGER, longer).otherwise(F.array(F.xxhash64("sig", "word")))
    return F.when(F.col("hot"), refined).otherwise(F.array("sig"))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (word, n, near, near_n) of near words, in both directions, once each."""
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    base = words.select("word", "n", F.length("word").alias("len"), letters.alias("letters"))
    base = base.select("word", "n", "len", *(p for many in sorted({many for many, _ in GROUPS.values()}) for p in _projections(many)))
    rows = base.select("word", "n", "len", F.explode(F.flatten(F.array(*map(_of_side, (SAME, SHORTER, LONGER))))).alias("s")).select("word", "n", "len", "s.*")
    some = rows.where(F.pmod(F.xxhash64("word"), F.lit(SAMPLE)) == 0)
    hot = settle(some.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= SAMPLE_HOT).select("sig", F.lit(True).alias("hot")))
    hot = F.broadcast(hot) if hot.count() * 16 <= HOT_BYTES else hot
    rows = rows.join(hot, "sig", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    rows = rows.select("word", "n", "side", F.explode(_keys()).alias("key"))
    a = rows.where(F.col("side") != LONGER).select("key", F.col("word").alias("word"), "n", "side")
    b = rows.where(F.col("side") != SHORTER).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("side").alias("near_side"))
    fits = (F.col("side") + F.col("near_side") == SHORTER + LONGER) | ((F.col("side") + F.col("near_side") == 2 * SAME) & (F.col("word") < F.col("near")))
    pairs = a.join(b, "key").where(fits).where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")
    one = F.struct(F.col("word").alias("word"), F.col("n").alias("n"), F.col("near").alias("near"), F.col("near_n").alias("near_n"))
    other = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.explode(F.array(one, other)).alias("p")).select("p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form: words that have one) to (word, root), by pointer jumping."""
    jump = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(jump.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        jump = moved.select("word", "root")


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """``words`` (word, n) with n_near, form, form_n and root."""
    words = settle(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    best = near_pairs(words).groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    common = -F.col("best.less")
    fits = common >= factor * F.col("n")
    near = settle(best.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, common).alias("form_n")))
    out = words.join(near, "word", "left").join(roots(near.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
