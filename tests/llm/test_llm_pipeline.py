"""The pipeline's stages on a small corpus, each against plain rules, and run() whole."""

import random
from pathlib import Path

import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import decontam, mixing, quality

rng = random.Random(41)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def line(n):
    return " ".join("".join(rng.choice(("er", "on", "the", "is", "at", "lo", "mi", "ka"))
                            for _ in range(rng.randint(1, 6))) for _ in range(n))


def tables(spark, folder):
    item = line(30)
    docs = [(i, "\n".join(line(rng.randint(8, 20)) for _ in range(4)), f"s{i % 4}")
            for i in range(60)]
    docs += [(100, docs[0][1], "s1"), (101, "too short", "s1"), (102, "spam egg " * 200, "s0"),
             (103, line(40) + "\n" + item, "s2"), (104, None, None), (105, docs[3][1] + "\n" + line(30), None)]
    near = docs[5][1].replace("\n", " ").split(" ")
    near[3] = "changedword"
    docs.append((106, " ".join(near), "s3"))
    frame = spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in docs], SCHEMA)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        f"{folder}/benchmark.parquet")


def brute(spark, folder):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    texts = {i: r["text"] for i, r in rows.items() if quality.judge(r["text"], packer)[6]}
    seen, kept = [], {}
    for i in sorted(texts):
        lines = []
        for body in texts[i].split("\n"):
            w = frozenset(body.split())
            if not w or not any(5 * len(w & e) >= 4 * len(w | e) for e in seen):
                lines.append(body)
            seen.append(w) if w else None
        if "\n".join(lines).split():
            kept[i] = "\n".join(lines)

    def shingles(text):
        w = decontam.normal_words(text)
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    alone = []
    for i in kept:
        if not any(5 * len(shingles(kept[i]) & shingles(kept[j]))
                   >= 4 * len(shingles(kept[i]) | shingles(kept[j])) for j in alone):
            alone.append(i)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"].split()
    windows = {" ".join(item[k:k + 13]) for k in range(len(item) - 12)}
    return {i: kept[i] for i in alone if not any(w in " ".join(kept[i].split()) for w in windows)}


def test_run_matches_plain_rules(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    want = brute(spark, folder)
    out = corpus_pipeline.run(spark, folder)
    source = spark.read.parquet(f"{folder}/documents.parquet")
    assert out.columns == source.columns
    mixed = spark.createDataFrame(
        [(r["doc_id"], want[r["doc_id"]], r["source"]) for r in source.collect()
         if r["doc_id"] in want], "doc_id bigint, text string, source string")
    planned, name = mixing.plan_copies(mixed)
    expected = {r["doc_id"]: r["k"] for r in planned.select(
        "doc_id", F.col(name["copies"]).alias("k")).collect() if r["k"]}
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == expected
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert texts == {i: (want[i], len(want[i])) for i in expected}
    # The judged cases: base failures, copies, near copies and the benchmark passage are gone.
    assert not {100, 101, 102, 103, 104, 106} & set(want) and 105 in want


def test_stages_take_odd_tables(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("hits", F.lit("x"))
    for rows in (docs.limit(0), docs.limit(3).union(docs.limit(3))
                 .withColumn("doc_id", F.lit(None).cast("bigint"))):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, folder)
            assert out.columns == docs.columns
            out.count()
    assert Path(corpus_pipeline.__file__).parent.name
