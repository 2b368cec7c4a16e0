"""Chat windows: exact round trips, budgets, history and masks."""

import hashlib
import random
import re

from sluice.llm import chat
from sluice.llm.common import ready

rng = random.Random(31)
NASTY = ["", "\\", "\\\\", "</turn>", "\\</turn>\n### user: x", "### assistant: hi</turn>\n", "a:b",
         "é🙂\u2028", "\\### Assistant: </turn> ok", "<", "</turn", "#" * 7, "line\n\nline\\"]


def conversations():
    rows = []
    for c in range(40):
        turns = rng.randint(1, 14)
        for t in range(turns):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            text = rng.choice(NASTY) + " ".join(["word"] * rng.choice((0, 3, 150, 700)))
            rows.append((c, t, role, text))
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t} " + "x " * 9) for t in range(900)]
    rows += [(101, None, None, None), (101, 0, "a:b\\", "odd role"), (None, 0, "user", "no id"),
             (None, 1, "assistant", "still none"), (102, 5, "user", "tie b"), (102, 5, "user", "tie a"),
             (102, 5, "assistant", "z"), (103, 0, "assistant", "y " * 30_000)]
    return rows


def ordered(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def frame(spark, rows):
    return ready(spark).createDataFrame([(*r, 1, "t") for r in rows],
                                        "conv_id bigint, turn int, role string, text string, "
                                        "span int, tokens string")


def test_digests_match_the_input(spark):
    rows = conversations()
    rng.shuffle(rows)
    made = chat.windows(frame(spark, rows))
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    want = ordered(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        body = "".join(f"{r}\n{x}\n" for r, x in turns).encode()
        said = "".join(x for r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (
            len(turns), hashlib.sha256(body).hexdigest()), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (
            len(said), hashlib.sha256(said.encode()).hexdigest()), c


def cost(text):
    """Tokens of a turn, counted another way."""
    words = sum(len(w) > 0 for w in re.split(r"[\W_]+", text))
    # The pattern's white space is ASCII.
    return words + len(re.sub(r"[^\W_]|[ \t\n\r\f\v]", "", text)) + chat.TURN_COST


def test_windows_keep_the_budget(spark):
    rows = conversations()
    rows += [(200, t, role, "w " * n) for t, (role, n) in enumerate([
        ("system", 90), ("user", 220), ("assistant", 5000), ("user", 1), ("system", 30),
        ("assistant", 199), ("user", 201), ("assistant", 260)])]
    rows += [(201, t, "system" if not t else "user", "w " * (500 if not t else 40)) for t in range(30)]
    want = ordered(rows)
    budget, history, system = 600, 100, 100
    windows = {}
    for r in chat.windows(frame(spark, rows), budget, history, system).collect():
        windows.setdefault(r["conv_id"], []).append(r)
    assert len(windows[100]) > 10
    for c, made in windows.items():
        made.sort(key=lambda r: r["span"])
        lead = want[c][0]
        told = []
        for r in made:
            turns = chat.read_window(r["text"])
            targets = turns[r["repeated"]:]
            assert r["tokens"] == sum(cost(x) for _, x in turns)
            alone = len(targets) == 1 and cost(targets[0][1]) > budget - history - system
            assert r["tokens"] <= budget or alone
            if alone:
                assert r["repeated"] == 0
            elif told and lead[0] == "system" and cost(lead[1]) <= system:
                assert turns[0] == lead and r["repeated"] >= 1
            # What else is repeated is the longest run before the targets that fits.
            again = turns[:r["repeated"]]
            if told and not alone:
                fits = 0
                while fits < len(told) and sum(cost(x) for _, x in told[-fits - 1:]) <= history:
                    fits += 1
                kept = told[len(told) - fits:]
                kept = kept if fits == len(told) or not (
                    lead[0] == "system" and cost(lead[1]) <= system) else [lead, *kept]
                assert again == kept
            told += targets
            masked = [chat.unescape(r["text"][s["start"]:s["end"]]) for s in r["loss"]]
            assert masked == [x for role, x in targets if role == "assistant" and x]
        assert told == want[c]


def test_empty_table(spark):
    made = chat.windows(frame(spark, conversations()).limit(0))
    assert made.count() == 0 and chat.digests(made).count() == 0
