"""Quality rules against plain counting, and the bands on texts made for them."""

import random
import re

import pytest

from sluice.llm import quality
from sluice.llm.common import ready

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again,
            len(hit), failed)


def prose(n):
    parts = ["".join(rng.choice(("er", "on", "the", "is", "ü", "at", "lo", "mi", "ka", "ne"))
                     for _ in range(rng.randint(1, 5))) for _ in range(n)]
    return " ".join(parts)


TEXTS = [None, "", " \n\t", "one", prose(300), prose(30) + "\n" + prose(30), "a b c d e f g h " * 9,
         "x\x85y z \x1c   w", "l\n\nl\n l\nl\n", "## $$ || <> &", prose(20_000),
         "\n".join([prose(12)] * 3 + [prose(200)]), "w " * 50_000,
         " ".join(["p q r s t u v w"] + [prose(9) for _ in range(5)] + ["p q r s t u v w"])]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_match_plain_counting(text):
    import zstandard
    assert quality.judge(text, zstandard.ZstdCompressor(level=3))[:6] == brute(text)


def test_bands_reject_repetition_and_noise_and_keep_prose():
    import zstandard
    packer = zstandard.ZstdCompressor(level=3)
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(12)) for _ in range(900))
    assert quality.judge(prose(2000), packer)[6]
    assert quality.judge(prose(60), packer)[6]
    # No window of eight words repeats, yet the text is one pattern.
    pattern = " ".join(f"{'item-' * 12}{i}" for i in range(3000))
    assert quality.judge(pattern, packer)[5:7] == (False, False)
    assert quality.judge(noise, packer)[5:7] == (False, False)
    # Half of the chunks are noise, and the whole is in its band.
    mixed = prose(1500) + " " + noise
    assert not quality.judge(mixed, packer)[6]


def test_rows_and_other_columns(spark):
    ready(spark)
    docs = spark.createDataFrame([(i, t, "v", 1.5) for i, t in enumerate(TEXTS)]
                                 + [(None, TEXTS[4], None, None)] * 2,
                                 "doc_id bigint, text string, verdict string, ratio double")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert [r for r in rows if r["doc_id"] is None] and len(rows) < docs.count()
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert quality.keep_good(docs.limit(0)).count() == 0
