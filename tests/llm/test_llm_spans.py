"""Sentence spans against comparing them as text."""

import random

from sluice.llm import spans
from sluice.llm.common import ready

rng = random.Random(23)


def sentence():
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(1, 15))) + rng.choice(".!?")


def corpus():
    passages = [[sentence() for _ in range(12)] for _ in range(4)]
    docs = []
    for i in range(60):
        own = [sentence() for _ in range(rng.randint(0, 12))]
        if i % 2:
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(passages)[rng.randint(0, 3):]
        docs.append((i * 7 % 61, rng.choice((" ", "\n")).join(own)))
    hot = " ".join(passages[0])
    docs += [(100 + i, f"Intro {i}. {hot}") for i in range(60)]
    return docs + [(200, None), (201, ""), (202, "..!?\n"), (None, hot), (203, hot), (203, hot),
                   (204, hot + " " + hot), (205, "one two three"), (206, "w " * 40_000)]


def brute(docs):
    seen, gone = set(), {}
    distinct = {d for d in docs if d[1] is not None}
    for doc, text in sorted(distinct, key=lambda d: (d[0] is None, d[0] or 0, d[1])):
        words = [tuple(s[2]) for s in spans.sentences(text)]
        long_ = {(i, j) for i in range(len(words)) for j in range(i + 1, min(len(words), i + 25))
                 if sum(map(len, words[i:j + 1])) >= spans.WORDS}
        runs = sorted((i, j) for i, j in long_ if not any((i, k) in long_ for k in range(i, j))
                      or not any((k, j) in long_ for k in range(i + 1, j)))
        for i, j in runs:
            key = tuple(words[i:j + 1])
            if key in seen:
                gone.setdefault((doc, text), set()).update(range(i, j + 1))
            seen.add(key)
    return {d: sorted(v) for d, v in gone.items()}


def test_removed_sentences_match_brute_force(spark):
    ready(spark)
    docs = corpus()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs],
                                  "doc_id bigint, text string, gone string, first int")
    found, name = spans.annotate(frame)
    assert {(r["doc_id"], r["text"]): r[name] for r in found.collect() if r[name]} == brute(docs)
    out = spans.remove_spans(frame)
    assert out.columns == frame.columns and out.count() == len(docs)
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert left[200] is None and left[150].strip() == "Intro 50." and left[205] == "one two three"
    assert spans.remove_spans(frame.limit(0)).count() == 0


def test_sentences_cover_the_text():
    text = "One. Two?! three\n\nfour a.b c"
    assert [text[a:b] for a, b, _ in spans.sentences(text)] == [
        "One.", " Two?!", " three\n", "four a.", "b c"]
