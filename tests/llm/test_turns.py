"""Conversation repair against all edits and against a search over single edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from lectern.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, place string, segment int, row double"
OTHER = {"u": "user", "a": "assistant"}


def judged(rows):
    """initial, must go, truncated and counts of ordered rows (role, text)."""
    seen, out, counts = set(), [], [0, 0, 0]
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        blank, repeat = not bare, (role, text) in seen
        cut = bool(bare) and not repeat and bare[-1] not in ".!?"
        for i, x in enumerate((blank, not blank and repeat, cut)):
            counts[i] += x
        seen.add((role, text))
        out.append((role[:1] or " ", blank or repeat, cut))
    return out, counts


def searched(rows):
    """Cheapest cost and least initials by Dijkstra over (row, last roles), one edit a step."""
    step = {"-": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "-")], set()
    while heap:
        cost, audit, n, state = heapq.heappop(heap)
        if (n, state) in done:
            continue
        done.add((n, state))
        if n == len(rows) and state in "-a":
            return cost, audit
        for role in "ua":
            if role in step[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", n, role))
        if n < len(rows):
            initial, must_go, cut = rows[n]
            heapq.heappush(heap, (cost + 4, audit + "D", n + 1, state))
            if not must_go:
                for role, letter, price in ((initial, "K", 0), ("u", "R", 3), ("a", "R", 3)):
                    if role in step[state]:
                        heapq.heappush(heap, (cost + price + 3 * cut, audit + letter, n + 1, role))


def every_way(rows):
    """The same by writing out all edits with up to two inserted turns in each gap."""
    gaps = ["", "u", "a", "ua", "au"]
    choices = [[("D", "", 4)] + ([] if go else [("K", r, 3 * cut), ("R", "u", 3 + 3 * cut), ("R", "a", 3 + 3 * cut)]) for r, go, cut in rows]
    best = None
    for edits in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            roles = put[0] + "".join(e[1] + g for e, g in zip(edits, put[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                way = (sum(e[2] for e in edits) + 3 * sum(map(len, put)), "I" * len(put[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, put[1:])))
                best = way if best is None else min(best, way)
    return best


def applied(rows, audit):
    """Lines of the repaired conversation: the edits name it wholly."""
    lines, at = [], 0
    size = len(audit) - audit.count("D")
    pattern = ["s"] * (size % 2) + ["u", "a"] * (size // 2)
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        role = pattern[len(lines)]
        if letter == "I":
            lines.append(f"{OTHER[role]}:")
        else:
            lines.append(f"{rows[at][0] if letter == 'K' else OTHER[role]}:{rows[at][1]}")
            at += 1
    return lines


def random_rows(draw, n):
    return [(draw.choice("ssuuuaaax"), draw.random() < 0.15, draw.random() < 0.2) for _ in range(n)]


def test_cheapest_equals_all_edits():
    draw = random.Random(1)
    for n in [0, 1, 2, 3] * 20:
        rows = random_rows(draw, n)
        best = min((c + 3 * turns.AFTER[r], a + "I" * turns.AFTER[r]) for r, (c, a) in turns.cheapest(rows, "-").items())
        assert best == every_way(rows) == searched(rows), rows


def test_cheapest_equals_a_search_also_from_later_roles():
    draw = random.Random(2)
    for _ in range(400):
        rows = random_rows(draw, draw.randrange(0, 25))
        cut = draw.randrange(0, len(rows) + 1)
        chained = {}
        for role, (c, a) in turns.cheapest(rows[:cut], "-").items():
            for last, (c2, a2) in turns.cheapest(rows[cut:], role).items():
                way = (c + c2, a + a2)
                chained[last] = min(chained.get(last, way), way)
        best = min((c + 3 * turns.AFTER[r], a + "I" * turns.AFTER[r]) for r, (c, a) in chained.items())
        assert best == searched(rows)


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest())


def plain(table):
    out = {c: [] for c, *_ in table}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(key.encode()) % 20
        if way:
            text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
            out[conv] += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    rows = []
    for conv, given in out.items():
        given = sorted(given, key=order)
        judge, counts = judged([g[1:] for g in given])
        numbers = [g[0] for g in given if g[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judge, judge[1:]))
        cost, audit = searched(judge)
        text = "\n".join(applied([g[1:] for g in given], audit))
        rows.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(rows, key=repr)


def made(seed, convs):
    draw = random.Random(seed)
    table = []
    for c in range(convs):
        for t in range(draw.choice([1, 2, 3, 6, 9])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = draw.choice(["Hi.", "Yes!", "What?  \n", "cut off", "", " \t", None, f"Line {draw.randrange(9)}.", "a\nb:c.", "é日."])
            table.append((c, draw.choice([t, t, t, t + 1, None, 10 * t]), role, text))
    return table + [(None, 1, "user", "Hm."), (None, None, "assistant", "So."), (None, None, None, None)]


def found(spark, table):
    rows = spark.createDataFrame([(*r, "p", 1, 0.5) for r in table], SCHEMA)
    return sorted(map(tuple, turns.repaired(rows, turns.damaged(rows)).collect()), key=repr)


@pytest.mark.parametrize("bits", [11, 2, 0])
def test_query_equals_plain(spark, monkeypatch, bits):
    monkeypatch.setattr(turns, "SEGMENT_BITS", bits)  # small segments: conversations are chained
    table = made(bits, 60)
    long_ = [(1000, t, random.Random(t).choice(["user", "assistant", "system"]), f"Turn {t % 70}" + "." * (t % 3)) for t in range(300)]
    assert found(spark, table + long_) == plain(table + long_)


def test_equal_rows_in_great_number_and_long_texts(spark):
    table = [(7, 3, "user", "Again.")] * 3000 + [(8, t, "user" if t % 2 == 0 else "assistant", "long words " * 20000 + ".") for t in range(4)]
    assert found(spark, table) == plain(table)


def test_nothing_left_and_empty_table(spark):
    assert found(spark, []) == []
    gone = next((c, 1) for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert found(spark, [(*gone, "user", "Hi.")]) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_turns_of_a_repair(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "So.", "p", 1, 0.5), (1, 1, "user", "Why?", "p", 1, 0.5), (1, 2, "user", " ", "p", 1, 0.5)], SCHEMA)
    lines = [(r["turn"], r["role"], r["text"]) for r in turns.Repair(rows).turns().orderBy("place", "step").collect()]
    assert lines == [(None, "user", ""), (0, "assistant", "So."), (1, "user", "Why?"), (None, "assistant", "")]
