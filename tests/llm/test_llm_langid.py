"""Language ID: held-out accuracy, rows not learned from, odd texts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluice.llm import langid
from sluice.llm.common import ready

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs = ready(spark).read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.train(docs)
    scored = docs.filter(langid.held_out(F.col("doc_id"))).select(
        "lang", langid.predict(F.col("text"), model).alias("p")).collect()
    right = [r["lang"] == r["p"]["lang_pred"] for r in scored]
    assert len(right) > 100 and sum(right) / len(right) >= 0.97
    assert all(0 <= r["p"]["score"] <= 1 for r in scored)
    accepted = [r for r in scored if not r["p"]["rejected"]]
    assert sum(r["lang"] == r["p"]["lang_pred"] for r in accepted) / len(accepted) >= 0.97


def small(spark):
    rows = [(i, f"der die das und nicht {i} schön", "de") for i in range(40)]
    rows += [(100 + i, f"the and of with this {i} thing", "en") for i in range(40)]
    rows += [(200, None, "de"), (201, "", "en"), (202, "12 34 ...", "fr"), (203, "the of", None),
             (None, "und nicht", "de"), (203, "the of", None), (204, "the and " * 200_000, "en")]
    return ready(spark).createDataFrame([(*r, 0.5) for r in rows],
                                        "doc_id bigint, text string, lang string, score double")


def test_odd_rows(spark):
    docs = small(spark)
    model = langid.train(docs)
    assert "fr" not in model.langs
    got = {r["doc_id"]: r["p"] for r in docs.withColumn(
        "p", langid.predict(F.col("text"), model)).collect()}
    for i in (200, 201, 202):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[203]["lang_pred"] == "en" and got[204]["lang_pred"] == "en"
    assert got[None]["lang_pred"] == "de"
    assert langid.train(docs.limit(0)) is None
    none = docs.select(langid.predict(F.col("text"), None).alias("p")).collect()
    assert {r["p"]["lang_pred"] for r in none} == {"und"}


def test_many_languages_are_all_learned(spark):
    signs = [chr(0x4E00 + 40 * k) + chr(0x4E01 + 40 * k) for k in range(300)]
    rows = [(1000 * n + k, f"{s} {s}{s} the {n}", f"l{k:03}") for k, s in enumerate(signs)
            for n in range(3)] + [(10**6 + i, "and of with", "en") for i in range(3000)]
    docs = ready(spark).createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, most=300)
    learned = {r[0] for r in docs.filter(~langid.held_out(F.col("doc_id")))
               .select("lang").distinct().collect()}
    assert set(model.langs) == learned and len(learned) > 290
    again = langid.train(docs.repartition(7), most=300)
    assert (again.table == model.table).all() and again.threshold == model.threshold


def test_temperature_is_not_the_edge_of_its_grid(spark):
    docs = ready(spark).read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.train(docs)
    assert langid.TEMPERATURES[0] < model.temperature < langid.TEMPERATURES[-1]
    assert 0 < model.threshold <= 1


def test_gradient_steps_lower_the_loss_as_a_plain_loop_does():
    rows = [([1, 5], [.5, .5], "a"), ([2, 5], [.5, .5], "b"), ([1, 7], [.5, .5], "a"),
            ([2, 7], [.5, .5], "b")]
    model = langid.fit(rows)
    scores = [langid.softmax((model.table[at] * [[s] for s in share]).sum(0) + model.bias)
              for at, share, _ in rows]
    assert [model.langs[int(p.argmax())] for p in scores] == ["a", "b", "a", "b"]


def test_held_out_rows_do_not_matter(spark):
    docs = small(spark)
    spoiled = docs.withColumn("text", F.when(langid.held_out(F.col("doc_id")), F.lit("zzz qqq"))
                              .otherwise(F.col("text")))
    spoiled = spoiled.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx"))
                                 .otherwise(F.col("lang")))
    one, two = langid.train(docs), langid.train(spoiled)
    assert one.langs == two.langs and (one.table == two.table).all()


def test_blocks_change_little(monkeypatch):
    text = "Größe und Maß. " * 400
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 500)
    parts = langid.counts(text)
    assert set(whole[0]) <= set(parts[0])
