"""Conversation repair against an exhaustive search over edits."""
import hashlib
import heapq
import random
import zlib

import pytest

from loanscope.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, live string, rng int, audit string"
ROWS = ["conv_id", "turn", "role", "text"]


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        cell = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{cell(c)}:{cell(t)}".encode()) % 20
        r, x = cell(r), cell(x)
        if kind == 1:
            x = ""
        elif kind == 2:
            x = "".join(ch for ch in x if ch not in ".!?")
        elif kind == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def search(kinds):
    """Least (cost, audit) by a search over edits, one at a time: no spans, no cells."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(kinds) and q in (0, 3):
            return cost, audit
        for r in "ua":
            if (q, r) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", i, step[q, r]))
        if i < len(kinds):
            role, fault = kinds[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                if (q, role) in step:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, step[q, role]))
                for r in "ua":
                    if (q, r) in step:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, step[q, r]))


def plain(conv_ids, rows):
    out = {}
    for conv in conv_ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, kinds, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in mine:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            kinds.append((role[:1], fault))
        turns = [t for _, t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit = search(kinds)
        made, i = [], 0
        total = len(audit) - audit.count("D")
        for e in audit:
            role = "user" if (len(made) - total % 2) % 2 == 0 else "assistant"
            if e == "I":
                made.append(f"{role}:")
                continue
            if e != "D":
                made.append(f"{mine[i][2] if e == 'K' else role}:{mine[i][3]}")
            i += 1
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(), made)
    return out


def test_charts_equal_the_search_and_any_split():
    rng = random.Random(5)
    kinds = {"x": ("u", "blank"), **{c: (c, None) for c in "sua"}, "o": ("t", None), **{c.upper(): (c, "truncated") for c in "sua"}, "O": ("t", "truncated")}
    for n in list(range(9)) * 40 + [16] * 5:
        line = "".join(rng.choice("xsuaoSUAOuauaua") for _ in range(n))
        assert repair.best(repair.chart(line)) == search([kinds[c] for c in line]), line
        cut = rng.randrange(n + 1)
        assert repair.joined(repair.chart(line[:cut]), repair.chart(line[cut:])) == repair.chart(line), line


def some_rows():
    rng = random.Random(11)
    texts = ["Hello there.", "Why?", "cut off", "", " \t", "Ja!", "so ...\n", "ends with space. "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "System"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts) + (f" {t}." if rng.random() < 0.7 else ""))
            for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(500, t, rng.choice(roles[:5]), f"Turn {t % 350}." if t % 7 else "again") for t in range(0, 1200)]  # spans many segments
    rows += [(600, 1, "user", "same.")] * 300  # repeated rows
    rows += [(700, None, None, None), (700, 3, None, "x."), (700, 5, "user", None), (None, 1, "user", "Null."), (None, None, "assistant", "Id.")]
    rows += [(800, t, ("user", "assistant")[t % 2], "w" * 700_000 + f"{t}.") for t in range(4)]  # very long texts
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "Gone.")], dropped


@pytest.mark.parametrize("shuffles", [1, 5, 20])
def test_repair_equals_the_search(spark, shuffles):
    rows, dropped = some_rows()
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
    try:
        turns = repair.damaged(repair.turns_of(frame))
        got = {r.conv_id: tuple(r)[1:] for r in repair.repair(turns).collect()}
        want = plain({r[0] for r in rows}, plain_damage(rows))
        assert got == {k: v[:-1] for k, v in want.items()}
        assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        if shuffles == 5:
            made = {}
            for r in repair.repaired_turns(turns, repair.repair(turns)).orderBy("conv_id", "place").collect():
                made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
            assert made == {k: v[-1] for k, v in want.items() if v[-1]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_empty_table(spark):
    assert repair.repair(repair.damaged(repair.turns_of(spark.createDataFrame([], SCHEMA)))).count() == 0
