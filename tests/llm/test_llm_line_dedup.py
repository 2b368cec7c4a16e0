"""Line dedup against comparing every line with every earlier one."""

import random
import re

from pyspark.sql import functions as F

from sluice.llm import line_dedup
from sluice.llm.common import ready

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(60)]


def line(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def variant(text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def corpus():
    base = [line(rng.randint(1, 25)) for _ in range(30)]
    docs = []
    for i in range(60):
        lines = [rng.choice((line(rng.randint(1, 12)), variant(rng.choice(base), rng.randint(0, 3)),
                             "", " \t", rng.choice(base))) for _ in range(rng.randint(1, 8))]
        docs.append((i * 3 % 61, "\n".join(lines)))
    hot = line(20)
    docs += [(100 + i, "\n".join([variant(hot, 1), f"id {i}"])) for i in range(80)]
    return docs + [(None, base[0] + "\n" + base[1]), (None, base[2]), (500, None), (501, ""),
                   (502, "a  b\tc\x0b d e \r\ne d c b a"), (503, base[3] + "\nonly here 503"),
                   (503, base[3] + "\nonly here 503"), (504, "\n".join([hot] * 400))]


def brute(docs):
    distinct = {d for d in docs if d[1] is not None}
    ordered = sorted(distinct, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    earlier, gone = [], {}
    for doc, text in ordered:
        for n, body in enumerate(text.split("\n")):
            w = frozenset(WORD.findall(body))
            if not w:
                continue
            if any(5 * len(w & e) >= 4 * len(w | e) for e in earlier):
                gone.setdefault((doc, text), []).append(n)
            earlier.append(w)
    return gone


def test_removed_lines_match_brute_force(spark):
    ready(spark)
    docs = corpus()
    # Texts under one doc_id are ordered by their hash; here each has one text or is alone.
    docs = [d for d in docs if d[0] is not None or "\n" in d[1]]
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs],
                                  "doc_id bigint, text string, key string, line int")
    found, name = line_dedup.annotate(frame)
    got = {(r["doc_id"], r["text"]): r[name] for r in found.collect() if r[name]}
    assert got == brute(docs)
    assert found.count() == len(docs)


def test_remove_lines(spark):
    ready(spark)
    rows = [(1, "one two three\nfour five", 22, "x"), (2, "one two three\nsix", 17, "x"),
            (3, "four five", 9, "x"), (4, None, None, "x"), (5, "", 0, "x"), (None, "six", 3, "x"),
            (7, "seven eight nine ten\n\nseven eight nine ten", 41, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, size string")
    out = line_dedup.remove_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [
        (1, "one two three\nfour five", 22), (2, "six", 3), (4, None, None), (5, "", 0),
        (7, "seven eight nine ten\n", 21)]
    assert line_dedup.remove_lines(docs.limit(0)).count() == 0


def test_main_path_is_native(spark):
    ready(spark)
    docs = spark.createDataFrame([(1, "a b c d e\nf")], "doc_id bigint, text string")
    plan = line_dedup.remove_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_long_lines_of_common_words_are_no_candidates(spark):
    """Their parities fill 64 bits; pairs grew with the square of such lines."""
    ready(spark)
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(rng.sample(words, 150))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    reps = line_dedup.line_reps(line_dedup.line_sets(docs, line_dedup.rarity(docs), 0.8))
    none = reps.select("id").limit(0)
    assert line_dedup.candidate_pairs(reps, none, 0.8).distinct().count() < 30


def test_sets_are_numbered_by_place(spark):
    ready(spark)
    rows = [(None, "z"), (2, "a b\nc d"), (1, "e f\na b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    reps = line_dedup.line_reps(line_dedup.line_sets(docs, line_dedup.rarity(docs), 0.8))
    assert [(r["doc"], r["line"]) for r in reps.orderBy("id").collect()] == [
        (1, 0), (1, 1), (2, 1), (None, 0)]


def test_rarity_keeps_plans_small_and_rare_words_first(spark):
    """The driver holds every plan as text; with a number of 64 bits a bucket these filled it."""
    ready(spark)
    docs = spark.createDataFrame([(i, f"common r{i}") for i in range(50)],
                                 "doc_id bigint, text string")
    ranks = line_dedup.rarity(docs)
    tokens = docs.select(line_dedup._tokens(F.col("text"), ranks).alias("t"))
    assert len(tokens._jdf.queryExecution().toString()) < 3_000_000
    assert len({r["t"][1] for r in tokens.collect()}) == 1
    assert len({r["t"][0] for r in tokens.collect()}) == 50


def test_near_copies_do_not_pair_up(spark):
    """Every line has rare words of its own: those decide none, and pairs grew with the square."""
    ready(spark)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([w for w in base if w != f"b{i % 60}"] + [f"own{i}-{j}" for j in range(5)]))
            for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ranks = line_dedup.rarity(docs)
    reps = line_dedup.line_reps(line_dedup.line_sets(docs, ranks, 0.8))
    decided = reps.select("id").limit(0)
    hot = line_dedup.hot_words(reps)
    pairs = line_dedup.hot_pairs(reps, decided, hot, 0.8).distinct()
    assert 0 < pairs.count() <= 300 * 8 * line_dedup.PARTS
    late = line_dedup._matched(docs, ranks, reps, pairs, 0.8, "late")
    assert late.count() > 280
    assert line_dedup.candidate_pairs(reps, late, 0.8).distinct().count() < 1000
    # Whatever the groups, the lines are those of the brute force.
    gone = line_dedup.removed_lines(docs).count()
    assert gone == len(brute(rows))
