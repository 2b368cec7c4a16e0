"""Personal data: base spans against the plain patterns, and what the field adds."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import pii
from sluice.llm.common import ready

PATTERNS = (
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
     lambda s: all(int(p) <= 255 for p in s.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"),
     lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and plain_luhn(re.sub("[^0-9]", "", s))),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
     lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(map(int, digits[::-1])):
        total += sum(divmod(2 * d, 10)) if i % 2 else d
    return total % 10 == 0


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS)
                  for m in p.finditer(text) if ok(m.group()))


PIECES = st.sampled_from(["a.b", "@", "x-1", ".", "com", " ", "1", "12", "255", "256", "+", "-", "(",
                          ")", "4111111111111111", "é", "\n", "_", "%", "4", "+1 (555) 123-4567",
                          "a@b.cc", "10.0.0.1"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text)[0] == plain(text)


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 60_000, "+1" * 60_000):
        pii.base_spans(text)


def documents():
    rows = []
    for i in range(150):
        rows.append((i, f"Mail user{i}@host.example or call +1 (555) 123-{4000 + i} soon, room {i}."))
        rows.append((1000 + i, f"Host 10.0.{i}.7 paid with 4111111111111111 in {1900 + i}."))
    return rows


def test_the_field_adds_what_a_pattern_swallowed(spark):
    ready(spark)
    odd = [(5000, "Call +1 (555) 123-9876 4111111111111111 now."), (5001, None), (5002, ""),
           (5003, "no digits here"), (None, "x@y.zz"), (5004, "version 3.0 of 2024, item 77"),
           (5003, "no digits here"), (5005, "7 " * 20_000)]
    docs = spark.createDataFrame([(*r, "f") for r in documents() + odd],
                                 "doc_id bigint, text string, base string")
    field = pii.train(docs)
    got = {r["doc_id"]: r["f"] for r in docs.withColumn("f", pii.find(F.col("text"), field))
           .collect()}
    text = odd[0][1]
    added = {(pii.KINDS[s["kind"]], text[s["start"]:s["end"]]) for s in got[5000]["added"]}
    assert added == {("phone", "+1 (555) 123-9876"), ("card", "4111111111111111")}
    for i in (5001, 5002, 5003, 5004):
        assert got[i]["base"] == [] and got[i]["added"] == []
    assert [s["kind"] for s in got[None]["base"]] == [0]
    for i, t in documents():
        assert [tuple(s) for s in got[i]["base"]] == plain(t) and got[i]["added"] == []


def test_repeats_share_their_label():
    """Far from its evidence, a token that looks like nothing takes its twin's label."""
    field = pii.Field.train(pii.Graph([t for _, t in documents()]))
    field.skip[:] = 6.0
    far = " word" * 500
    graph = pii.Graph([f"Write to kim.lee@host.example today.{far} kim.lee@host.invalid"])
    p = field.beliefs(graph)
    assert len(graph.skip) and p[-1].argmax() == 1
    alone = pii.Graph([f"Write.{far} kim.lee@intranet"])
    paired = pii.Graph([f"Write kim.lee@host.example.{far} kim.lee@intranet"])
    assert field.beliefs(paired)[-1][1] > field.beliefs(alone)[-1][1]


def test_without_any_base_span(spark):
    docs = ready(spark).createDataFrame([(1, "room 7"), (2, None)], "doc_id bigint, text string")
    assert pii.train(docs) is None and pii.train(docs.limit(0)) is None
    assert docs.select(pii.find(F.col("text"), None).alias("f")).filter(
        F.size("f.added") > 0).count() == 0
    spans = docs.select(pii.as_text(F.col("f.base")).alias("s")) if "f" in docs.columns else (
        docs.select(pii.as_text(pii.find(F.col("text"), None)["base"]).alias("s")))
    assert {r["s"] for r in spans.collect()} == {""}


def test_parts_of_thousands_of_zeros_are_numbers():
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}1.2.3.{zeros}")[0] == [(0, 1, 10006)]
    assert pii.base_spans(f"{zeros}256.2.3.4")[0] == []
    assert pii.all_spans([f"x {zeros}9.9.9.9"], None) == [([(2, 1, 5009)], [])]


def test_query_counts_every_kind(spark, tmp_path):
    from sluice.llm.queries import op4_personal_data
    rows = [(0, "a@b.co or c@d.ee, 10.0.0.1"), (1, "4111 1111 1111 1111 4111"), (2, None),
            (3, "+1 (555) 123-4567 / +1 (555) 123-4568 / +1 (555) 123-4569 and 4111111111111111"),
            (None, "1.2.3.4 5.6.7.8 9.9.9.9 x@y.zz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: tuple(r)[1:5] for r in op4_personal_data(spark, str(tmp_path)).collect()}
    wanted = {i: tuple(sum(k == j for _, k, _ in plain(t or "")) for j in range(4)) for i, t in rows}
    assert found == wanted
    assert wanted[0] == (2, 1, 0, 0) and wanted[3][3] == 3 and wanted[None] == (1, 3, 0, 0)
