"""Quotation linking against a brute-force version: links, contents and the order of replies."""

import os
import random
from collections import defaultdict

import pytest

from strandweave.llm import chat
from strandweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(conv, turn, role, content, parent's content, link, position) of every row, by plain loops."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        content, units, passages = chat.parse(text)
        convs[conv].append((turn, role, content, units, passages))
    out = []
    for conv, messages in convs.items():
        messages.sort(key=lambda m: (m[0], m[1], m[2]))
        parent, kind = [], []
        for turn, _, _, _, passages in messages:
            quoted = []
            for level, passage in passages:
                source = None
                for unit in [chat.normal(passage), *[chat.normal(x) for x in passage_parts(passage)]]:
                    first = next((i for i, m in enumerate(messages) if unit and unit in m[3]), None)
                    if first is not None and messages[first][0] < turn:
                        source = first
                        break
                if source is not None and level == 1:
                    quoted.append(source)
            before = [i for i, m in enumerate(messages) if m[0] < turn]
            parent.append(max(quoted) if quoted else before[-1] if before else None)
            kind.append("quote" if quoted else "turn" if before else "root")
        place, stack = {}, [i for i in reversed(range(len(messages))) if parent[i] is None]
        while stack:
            i = stack.pop()
            place[i] = len(place)
            stack += [k for k in reversed(range(len(messages))) if parent[k] == i]
        for i, m in enumerate(messages):
            p = parent[i]
            out.append((conv, *m[:3], None if p is None else messages[p][0], None if p is None else place[p], kind[i], place[i]))
    return sorted(out, key=str)


def passage_parts(passage):
    import re

    return [*re.split(r"\n\s*\n", passage), *passage.split("\n")]


def talk(rng, conv, n):
    """Messages that quote whole, partly, nested, re-wrapped, themselves, later ones and things never said."""
    rows, said = [], []
    for turn in range(n):
        own = "\n\n".join(" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 3)))
        text, kind = own, rng.randrange(8)
        if said and kind < 5:
            old = rng.choice(said)
            if kind == 1:
                old = rng.choice(old.split("\n\n"))
            if kind == 2:
                old = old.replace(" ", "\n", 2)
            marks = "> > " if kind == 3 else ">"
            text = "On Monday X wrote:\n" + "\n".join(marks + line for line in old.split("\n")) + "\n" + own
            if kind == 4:
                other = rng.choice(said)
                text += "\n" + "\n".join("> " + line for line in other.split("\n"))
        elif kind == 5:
            text = f"> {own}\n{own}"
        elif kind == 6:
            text = f"> never said {turn}\n{own}"
        rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
        if rng.randrange(6) == 0:
            rows.append((conv, turn, "user", text + " again"))
        said.append(own)
    return rows


def result(df):
    return sorted(((r["conv_id"], r["turn"], r["role"], r["content"], r["parent_turn"], r["parent_position"], r["link"], r["position"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("span", [1000, 3])
def test_replies_against_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(chat, "RANGE", span)
    rng = random.Random(span)
    rows = [r for conv, n in ((1, 40), (2, 1), (3, 25), (7, 12)) for r in talk(rng, conv, n)]
    rows += [(9, 0, "user", "same"), (9, 0, "user", "same"), (9, 1, "user", "> same\nyes"), (9, 1, "user", "no"), (10, 4, "user", None), (10, 5, None, "")]
    rng.shuffle(rows)
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = plain.selectExpr("conv_id", "turn", "role", "text", "1 as position", "'x' as content", "2 as g", "3 as parent", "4 as run")
    for df in (plain, wide):
        got = result(chat.link_quotes(df))
        want = brute([(c, t, r, x) for c, t, r, x in rows if r is not None])
        assert [r for r in got if r[0] != 10] == [r for r in want if r[0] != 10]
    assert len(got) == len(rows)
    positions = defaultdict(list)
    for r in got:
        positions[r[0]].append(r[-1])
        assert r[5] is None or r[5] < r[-1]
    assert all(sorted(p) == list(range(len(p))) for p in positions.values())
    assert chat.link_quotes(plain.filter("false")).count() == 0


def test_many_replies_to_one_message_and_long_chains(spark):
    """All answers quote the first message; and a chain in which every second message goes back to the first."""
    rows = [(1, 0, "user", "start here")] + [(1, t, "user", f"> start here\nreply {t}") for t in range(1, 300)]
    rows += [(2, 0, "user", "begin")] + [(2, t, "user", f"> begin\nr {t}" if t % 2 else f"r {t}") for t in range(1, 200)]
    got = result(chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == brute(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op3_quotation_linking"](spark, SF)) == brute(rows)
