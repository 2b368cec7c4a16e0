"""Line dedup: an exact set-similarity join of lines by their words, in Spark alone.

A line is the set of its words.  A line is removed when an earlier line (by doc_id, NULL
last, then a hash of the text, then line number) has a Jaccard similarity of at least
``THRESHOLD`` with it; lines without words stay.  All of it is exact:

1. Rarity.  Words are counted over the whole corpus by a 16-bit part of their hash.  A word
   becomes one number, the level of that count (``LEVELS`` steps of its logarithm) above
   the remaining 58 bits of the hash, so a sorted array of numbers is the set ordered by
   rarity.  The levels are a constant of each plan: as small numbers they keep plans small,
   which the driver holds as text for every job.
2. Equal sets meet in one aggregate: the earliest stands for all.
3. Prefixes.  Sets of similarity t share a word among the n - ceil(t n) + 1 rarest of the
   larger and the n - ceil(2t / (1 + t) n) + 1 rarest of the smaller.  Only those words are
   joined on.  Candidates must pass the length filter, the positional filter (what can
   still be common after this word) and a bitmap filter (a parity of the words differs
   in at most as many bits as the sets in words; 64 bits, and 128 between long lines,
   which would fill 64).
4. Verification compares the whole sets of the candidates.

Groups of thousands of variants of one line would pair up quadratically.  So the first
``LEADS`` words of each prefix are looked up first against the earliest set under the
same word only, where more than ``FEW`` sets share it, and lines this decides need no
further partner.  Changed words are the rarest, so lines of such a group may share none of
these: the whole prefixes of undecided lines are then looked up under ``hot`` words, those
which more than ``HOT`` sets share among their last prefix words, against ``PARTS`` early sets
each.  The full join then emits only pairs whose later side is undecided.
Nothing is capped by that, as a removed line still serves as the earlier partner of others.

Sets are numbered in the order of their places, so that of a pair the larger number is the
later line, also within one text.

Joins are on plain keys, so adaptive execution can split hot ones; aggregates are partial
before their shuffle.  Lines are cut once to narrow rows (no text) in the shared
folder; verification reads the lines of candidates from the documents again, picked
out by a bitmap of fixed size before any of their words are split.

Defined cases: NULL and empty texts have no lines to remove; repeated rows (same doc_id
and text) are one document and keep or lose the same lines; an empty table stays
empty; further columns pass through, under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.lineage import release
from sluice.llm.common import WORD, bitmap, cut, in_bitmap, unused

THRESHOLD = 0.8
BUCKETS = 1 << 16
LEVELS = 64
LEADS = 3
FEW = 16
HOT = 128
PARTS = 4
# Words from which a line has the second half of its parity.
LONG = 64
EPS = 1e-9


def _rows(docs: DataFrame) -> DataFrame:
    """doc, hash of the text, line number from 0, line."""
    # The hash comes first: beside the generator it would be taken once per line.  The split
    # stands in the generator: of a column, Spark would first filter by its size, split again.
    return (docs.filter(F.col("text").isNotNull())
            .select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("h"), "text")
            .select("doc", "h", F.posexplode(F.split("text", "\n")).alias("line", "words")))


def _words(line: Column) -> Column:
    """The words of a line; a plain split where single spaces are all that divides them."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(
        line, F.lit(" "))
    for white in "\t\v\f\r":
        odd = odd | F.contains(line, F.lit(white))
    return F.when(odd, F.regexp_extract_all(line, F.lit(WORD), F.lit(0))).otherwise(
        F.split(line, " "))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 48).cast("int")


def rarity(docs: DataFrame) -> Column:
    """By bucket of words, as a constant array, what turns the upper 6 bits of their hashes
    by XOR into the level of how often its words occur, the rarest lowest."""
    # Words that other white space divides stay together here; only the order would tell.
    counts = (docs.filter(F.col("text").isNotNull())
              .select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "))
                      .alias("w"))
              .select(_bucket(F.xxhash64("w")).alias("b"))
              .groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    known = (docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
             .join(counts, "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n")))
    whole = known.agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("o"),
                      F.greatest(F.max("n"), F.lit(1)).alias("most"))

    def turn(x: Column) -> Column:
        level = F.floor(F.log2(x["n"] + 1) / F.log2(F.col("most") + 1) * (LEVELS - 1))
        return (level.cast("int") - LEVELS // 2).bitwiseXOR(
            F.shiftright(x["b"], 10)).bitwiseAND(LEVELS - 1)

    joined = whole.select(F.array_join(F.transform("o", lambda x: turn(x).cast("string")), ",")
                          .alias("r")).first()["r"]
    # A literal of BUCKETS numbers: subqueries may not stand inside higher-order functions.
    return F.split(F.lit(joined), ",").cast("array<tinyint>")


def _tokens(line: Column, ranks: Column) -> Column:
    """The line's set of words as numbers, rarest first."""
    # One hash per word, and as few steps on it as can be: they are not compiled.
    hashes = F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(hashes, lambda h: h.bitwiseXOR(
        F.shiftleft(ranks[F.shiftrightunsigned(h, 48)].cast("bigint"), 58))))


def _prefix_length(size: Column, share: float) -> Column:
    """Number of rarest words of which one is common to two sets that have ``share`` of this
    set's words in common."""
    return size - F.ceil(size * F.lit(share) - EPS).cast("int") + 1


def line_sets(docs: DataFrame, ranks: Column, threshold: float) -> DataFrame:
    """Narrow rows of all lines: place, size, key of the set, parity, prefix."""
    rows = (_rows(docs).filter(F.col("words").rlike(WORD))
            .select("doc", "h", "line", _tokens(F.col("words"), ranks).alias("t")))
    parity = "aggregate({}, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))"
    half = F.expr(parity.format("filter(t, x -> (x & 64) = 64)"))
    # Prefix words by the upper 31 bits: order is kept, and clashes only add candidates.
    prefix = F.transform(F.slice("t", F.lit(1), _prefix_length(F.size("t"), threshold)),
                         lambda x: F.shiftright(x, 32).cast("int"))
    return cut(rows.select("doc", "h", "line", F.size("t").alias("size"),
                           F.xxhash64("t").alias("key"), F.expr(parity.format("t")).alias("sig"),
                           F.when(F.size("t") >= LONG, half).otherwise(0).alias("wide"),
                           prefix.alias("prefix")), "lines")


def _place() -> Column:
    """Sorts as lines do: NULL documents last."""
    return F.struct(F.col("doc").isNull().alias("nodoc"), "doc", "h", "line")


def line_reps(lines: DataFrame) -> DataFrame:
    """The earliest line of every set, with an ``id`` that grows with its place."""
    firsts = cut(lines.groupBy("key", "sig", "size")
                 .agg(F.min(F.struct(_place().alias("place"), "wide", "prefix")).alias("first"),
                      (F.count(F.lit(1)) > 1).alias("many"))
                 .select("key", "sig", "size", "many", "first.place.*", "first.wide",
                         "first.prefix"),
                 "firsts")
    # Sorted by ranges: numbers grow within a partition and from one to the next.
    reps = cut(firsts.orderBy("nodoc", "doc", "h", "line").drop("nodoc")
               .select(F.monotonically_increasing_id().alias("id"), "*"), "reps")
    release(firsts)
    return reps


def _close(a: str, b: str, threshold: float, positions: bool) -> Column:
    """Length, positional and bitmap filter for two postings."""
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    total = n + m
    whole = F.col(f"{a}.sig").bitwiseXOR(F.col(f"{b}.sig"))
    half = F.col(f"{a}.wide").bitwiseXOR(F.col(f"{b}.wide"))
    bits = F.when(F.least(n, m) >= LONG, F.bit_count(half) + F.bit_count(
        whole.bitwiseXOR(half))).otherwise(F.bit_count(whole))
    ok = (F.least(n, m) >= F.greatest(n, m) * threshold - EPS) & (
        bits <= total * ((1 - threshold) / (1 + threshold)) + EPS)
    if positions:
        after = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
        ok = (after >= total * (threshold / (1 + threshold)) - EPS) & ok
    return ok


def _matched(docs: DataFrame, ranks: Column, reps: DataFrame, pairs: DataFrame,
             threshold: float, label: str) -> DataFrame:
    """Numbers of the sets that match an earlier one of the candidate ``pairs`` (a before b)."""
    pairs = cut(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = cut(reps.select("id", "doc", "h", "line").join(ids, "id", "left_semi"), "wanted")
    loc = F.xxhash64("doc", "h", "line")
    chosen = in_bitmap(_rows(docs), loc, bitmap(wanted, loc, "bitmap")).alias("c")
    here = wanted.alias("w")
    same = F.col("c.doc").eqNullSafe(F.col("w.doc")) & (F.col("c.h") == F.col("w.h")) & (
        F.col("c.line") == F.col("w.line"))
    # Repeated rows are one document.
    sets = cut(chosen.join(here, same).groupBy("id").agg(F.min("words").alias("words"))
               .select("id", _tokens(F.col("words"), ranks).alias("t")), "sets")
    common = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - common
    joined = (pairs.join(sets.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
              .join(sets.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b"))
    found = cut(joined.filter(common >= union * threshold - EPS)
                .select(F.col("b").alias("id")).distinct(), label)
    for done in (pairs, wanted, sets):
        release(done)
    return found


def led_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a before b) of sets with the earliest set under one of their rarest words."""
    leads = reps.select(F.explode(F.slice("prefix", 1, LEADS)).alias("word"), "id", "size",
                        "sig", "wide")
    leaders = (leads.groupBy("word")
               .agg(F.min(F.struct("id", "size", "sig", "wide")).alias("x"),
                    F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") > FEW).select("word", "x.*"))
    return leads.alias("y").join(leaders.alias("x"), "word").filter(
        (F.col("x.id") < F.col("y.id")) & _close("x", "y", threshold, False)).select(
            F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def hot_words(reps: DataFrame) -> DataFrame:
    """Words that more than ``HOT`` sets have among the last of their prefixes."""
    ends = reps.select(F.explode(F.slice(F.reverse("prefix"), 1, LEADS)).alias("word"))
    return cut(ends.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") > HOT).select("word"), "hot")


def hot_pairs(reps: DataFrame, decided: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a before b) of sets that are not ``decided`` with ``PARTS`` early sets, each the
    earliest of its share of the sets, under every ``hot`` word of their prefix."""
    columns = ["id", "size", "sig", "wide"]
    postings = reps.select(F.explode("prefix").alias("word"), *columns).join(hot, "word")
    leaders = (postings.groupBy("word", F.pmod("id", F.lit(PARTS)).alias("part"))
               .agg(F.min(F.struct(*columns)).alias("x")).select("word", "x.*"))
    late = postings.join(decided, "id", "left_anti")
    return late.alias("y").join(leaders.alias("x"), "word").filter(
        (F.col("x.id") < F.col("y.id")) & _close("x", "y", threshold, False)).select(
            F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def candidate_pairs(reps: DataFrame, decided: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a before b) that pass all filters and whose later set is not ``decided``."""
    marked = reps.join(decided.withColumn("done", F.lit(True)), "id", "left")
    postings = marked.select("id", "size", "sig", "wide",
                             F.coalesce("done", F.lit(False)).alias("done"),
                             F.posexplode("prefix").alias("at", "word"))
    # Of two sets the smaller, or of equal sizes the earlier, is met under fewer words.
    few = _prefix_length(F.col("size"), 2 * threshold / (1 + threshold))
    small = postings.filter(F.col("at") < few).alias("x")
    x, y = F.col("x.id"), F.col("y.id")
    order = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (x < y))
    late_done = F.when(x < y, F.col("y.done")).otherwise(F.col("x.done"))
    both = small.join(postings.alias("y"), "word").filter(
        order & _close("x", "y", threshold, True) & ~late_done)
    # A pair is found once per shared word.
    return both.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with lines to remove: doc, h, lines (sorted numbers)."""
    ranks = rarity(docs)
    lines = line_sets(docs, ranks, threshold)
    reps = line_reps(lines)
    decided = _matched(docs, ranks, reps, led_pairs(reps, threshold), threshold, "decided")
    hot = hot_words(reps)
    if not hot.isEmpty():
        decided = decided.union(_matched(docs, ranks, reps, hot_pairs(
            reps, decided, hot, threshold), threshold, "decided"))
    found = _matched(docs, ranks, reps, candidate_pairs(reps, decided, threshold), threshold,
                     "found")
    late = decided.union(found).withColumn("late", F.lit(True))
    verdict = reps.join(late, "id", "left").filter(
        F.col("many") | F.col("late").isNotNull()).select(
        "key", "sig", "size", _place().alias("first"), "late")
    gone = (lines.join(verdict, ["key", "sig", "size"])
            .filter(F.col("late").isNotNull() | (_place() != F.col("first"))))
    return gone.groupBy("doc", "h").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def annotate(docs: DataFrame, rows: DataFrame | None = None, text_hash: Column | None = None,
             threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: numbers of the lines to remove.

    Where the texts are not needed beside the result, ``rows`` is a narrower form of
    ``docs`` with doc_id, and ``text_hash`` its column with the hash of the text.
    """
    rows = docs if rows is None else rows
    name, doc, h = (unused(rows, n) for n in ("removed_lines", "_line_doc", "_line_h"))
    gone = removed_lines(docs, threshold).select(
        F.col("doc").alias(doc), F.col("h").alias(h), F.col("lines").alias(name))
    text_hash = F.xxhash64("text") if text_hash is None else text_hash
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (text_hash == F.col(h))
    joined = rows.join(gone, same, "left").drop(doc, h)
    return joined.withColumn(name, F.coalesce(name, F.array().cast("array<int>"))), name


def remove_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the removed lines; documents left without a word go if they
    had one.  ``n_chars`` follows the text where the table has that column."""
    found, name = annotate(docs, threshold=threshold)
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(name), i)), "\n")
    before, word = unused(found, "had_words"), F.lit(WORD)
    out = (found.withColumn(before, F.col("text").isNotNull() & F.col("text").rlike(WORD))
           .withColumn("text", F.when(F.size(name) > 0, kept).otherwise(F.col("text")))
           .filter(~F.col(before) | F.regexp_like("text", word)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(
            F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
            .otherwise(F.col("n_chars")))
    return out.select(*[F.col(c) for c in docs.columns])
