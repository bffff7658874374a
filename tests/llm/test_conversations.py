"""Repair of conversations against plain versions that keep whole edit strings, or try all of them."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from strandline.llm import conversations as c

SHAPE = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def ways(rows):
    """Every edit string with its cost and resulting rows; at most two inserts in a place, as a third never helps."""
    steps = {"0": ("u",), "s": ("u",), "u": ("a",), "a": ("u",)}

    def go(k, state, cost, edits, out):
        for n in range(3):  # inserts here
            s, more = state, []
            for _ in range(n):
                s = steps[s][0]
                more.append((NAMES[s], ""))
            here = (cost + 5 * n, edits + "I" * n, out + more)
            if k == len(rows):
                yield here
                continue
            role, text, fault = rows[k]
            yield from go(k + 1, s, here[0] + 2, here[1] + "D", here[2])
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                t = steps[s][0]
                yield from go(k + 1, t, here[0] + 1 + extra, here[1] + "R", here[2] + [(NAMES[t], text)])
                if role[:1] in ("s", "u", "a"):
                    yield from go(k + 1, role[0], here[0] + extra, here[1] + "K", here[2] + [(role, text)])

    for cost, edits, out in go(0, "0", 0, "", []):
        if SHAPE.fullmatch("".join(r[:1] for r, _ in out)):
            yield cost, edits, out


def whole_strings(rows):
    """The same by dynamic programming over (state, cost, whole edit string)."""
    turn = {"0": "u", "s": "u", "u": "a", "a": "u"}
    keep = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def filled(best):
        for _ in range(3):
            for s, (cost, edits, out) in list(best.items()):
                new = (cost + 5, edits + "I", [*out, (NAMES[turn[s]], "")])
                if turn[s] not in best or new[:2] < best[turn[s]][:2]:
                    best[turn[s]] = new
        return best

    best = filled({"0": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for s, (cost, edits, out) in best.items():
            options = [(s, cost + 2, edits + "D", out)]
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                options.append((turn[s], cost + 1 + extra, edits + "R", [*out, (NAMES[turn[s]], text)]))
                if (s, role[:1]) in keep:
                    options.append((keep[s, role[:1]], cost + extra, edits + "K", [*out, (role, text)]))
            for t, *way in options:
                if t not in after or tuple(way[:2]) < after[t][:2]:
                    after[t] = tuple(way)
        best = filled(after)
    return min((best[s] for s in ("0", "a") if s in best), key=lambda w: w[:2])


def plain(rows, solve=whole_strings):
    """Figures of one conversation's (turn, role, text) rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, judged, counts = set(), [], defaultdict(int)
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        judged.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = solve(judged)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha


def test_plain_versions_agree():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{k}", rng.choice(["", "", "truncated", "blank", "duplicate"])) for k in range(rng.randint(0, 4))]
        assert min(ways(rows), key=lambda w: w[:2])[:2] == whole_strings(rows)[:2]


def edits_of(rows):
    work, out, window = c.Repair(), [], 0
    for role, _, fault in rows:
        out += work.add(role[:1], ["", "blank", "duplicate", "truncated"].index(fault))
        window = max(window, len(work.open))
        assert len(work.tips) <= 4
    out += work.end()
    return work, out, window


def test_every_short_conversation():
    for n in range(5):
        for kinds in itertools.product([("user", ""), ("assistant", ""), ("system", ""), ("tool", ""), ("user", "truncated"), ("assistant", "truncated"), ("system", "truncated"), ("user", "blank")], repeat=n):
            rows = [(role, "x", fault) for role, fault in kinds]
            cost, audit, out = whole_strings(rows)
            work, edits, _ = edits_of(rows)
            assert (work.cost, "".join(e for _, e, _ in edits)) == (cost, audit), kinds
            made = [(role or rows[p - 1][0], "x" if p else "") for p, e, role in edits if e != "D"]
            assert made == out and [p for p, _, _ in edits if p] == list(range(1, n + 1))


def test_long_conversations_and_what_stays_open():
    rng = random.Random(2)
    for weights in ([8, 8, 1, 1, 1], [1, 1, 5, 1, 1], [1, 9, 0, 0, 0], [3, 3, 3, 3, 9], [0, 0, 1, 0, 0]):
        for faults in (["", "", "", "truncated"], ["blank", ""], ["truncated"], ["", "duplicate", "blank"]):
            rows = [(rng.choices(["user", "assistant", "system", "tool", ""], weights)[0], "x", rng.choice(faults)) for _ in range(400)]
            work, edits, _ = edits_of(rows)
            cost, audit, _ = whole_strings(rows)
            assert (work.cost, "".join(e for _, e, _ in edits)) == (cost, audit)
    rows = [(("user", "assistant")[k % 2], "x", "blank" if k % 11 == 5 else "truncated" if k % 7 == 3 else "") for k in range(20_000)]
    assert edits_of(rows)[2] < 60


def damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, role, text


def test_tables(spark):
    rng = random.Random(7)
    rows = [(i, t, ("system", "user", "assistant")[t % 3 if t % 5 == 0 else 1 + t % 2], rng.choice(["Yes.", "No!", "cut", " \t", "Été? \n", "a. b"]) + rng.choice(["", str(t) + "."])) for i in range(60) for t in range(rng.randint(1, 14))]
    rows += [(None, t, rng.choice(["user", None, "", "tool"]), rng.choice([None, "", "x.", "y"])) for t in range(9)] + [(70, None, "user", "q?")] * 3
    rows += [(71, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)] + [(72, 5, "user", "Same.")] * 900 + [(73, 1, "user", "long " * 200_000)]
    rows += [(k, 0, "user", "Lone.") for k in range(1000, 1060)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, position int, _conv string, cost int").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in c.repaired_damage(df).collect()}
    by = {r[0]: [] for r in rows}
    for conv, *row in damage(rows):
        by[conv].append(row)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    want = {conv: plain(found) if found else empty for conv, found in by.items()}
    assert empty in want.values() and got == want
    assert c.repaired_damage(df.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [("k", 3, "assistant", "There."), ("k", 1, "user", "Where?"), ("k", 2, "user", "cut"), ("l", 1, "user", "Hm.")]
    repaired, figures = c.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    got = sorted(map(tuple, repaired.select("conv_id", "seq", "turn", "role", "text", "edit").collect()))
    assert got == [("k", 1, 1, "user", "Where?", "K"), ("k", 2, 2, "user", "cut", "D"), ("k", 3, 3, "assistant", "There.", "K"), ("l", 1, 1, "user", "Hm.", "D")]
    assert {r.conv_id: (r.cost, r.truncated, r.illegal) for r in figures.collect()} == {"k": (2, 1, 1), "l": (2, 0, 0)}
    with pytest.raises(StopIteration):
        next(c._repaired(iter([])))
