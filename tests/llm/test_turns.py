"""Repaired conversations against all edits there are, and against a table filled turn by turn."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from tidewater.llm import turns
from tidewater.llm.turns import Turn

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """{conversation: rows after damage}, every conversation included."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def faulty(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = BLANK.findall(text)
        out.append(Turn(role, text, "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def by_table(rows):
    """(cost, audit, lines): the best of each state after each turn."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    want = {0: "user", 1: "user", 2: "assistant", 3: "user"}

    def closed(best):
        for _ in range(4):
            for s, (c, a, out) in list(best.items()):
                t, made = step[s, want[s][0]], (c + 2, a + "I", [*out, want[s] + ":"])
                best[t] = min(best.get(t, made), made)
        return best

    best = closed({0: (0, "", [])})
    for r in rows:
        new = {}

        def put(s, made):
            new[s] = min(new.get(s, made), made)

        for s, (c, a, out) in best.items():
            put(s, (c + 3, a + "D", out))
            if r.fault not in ("blank", "duplicate"):
                more = r.fault == "truncated"
                put(step[s, want[s][0]], (c + 2 + more, a + "R", [*out, f"{want[s]}:{r.text}"]))
                if (s, r.role[:1]) in step:
                    put(step[s, r.role[:1]], (c + more, a + "K", [*out, f"{r.role}:{r.text}"]))
        best = closed(new)
    return min(best[s] for s in (0, 3) if s in best)


def by_all_edits(rows):
    """(cost, audit): every way to edit the turns, with up to two inserted turns in each gap."""
    gaps = [("",), ("u",), ("a",), ("u", "a"), ("a", "u"), ("u", "u"), ("a", "a")]
    found = []
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        inserts = ["".join(g) for g in inserts]
        for edits in itertools.product("KDua", repeat=len(rows)):
            if any(e != "D" and r.fault in ("blank", "duplicate") for e, r in zip(edits, rows)):
                continue
            roles = inserts[0] + "".join(("" if e == "D" else (r.role[:1] or "?") if e == "K" else e) + g for e, r, g in zip(edits, rows, inserts[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                cost = 2 * len("".join(inserts)) + sum({"K": 0, "D": 3}.get(e, 2) + (e != "D" and r.fault == "truncated") for e, r in zip(edits, rows))
                found.append((cost, "I" * len(inserts[0]) + "".join({"u": "R", "a": "R"}.get(e, e) + "I" * len(g) for e, g in zip(edits, inserts[1:]))))
    return min(found)


def conversation(rng, n):
    texts = ["Yes.", "No!", "Why", "", " \t", "Go on", "Done?", "Fine. "]
    return [Turn(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(texts), None) for _ in range(n)]


def test_search_finds_the_best_of_all_edits():
    rng = random.Random(2)
    for n in (0, 1, 2, 2, 2, 3, 3, 3):
        rows = faulty([(0, t.role, t.text) for t in conversation(rng, n)])
        (path,) = turns.cheapest({0: turns.Path()}, rows, True).values()
        assert (path.cost, path.audit) == by_all_edits(rows) == by_table(rows)[:2]


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(3)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(turns, "BLOCK_TURNS", size)
        for n in (0, 1, 2, 5, 40, 130):
            rows = faulty([(0, t.role, t.text + (str(i) if rng.random() < 0.7 else "")) for i, t in enumerate(conversation(rng, n))])
            talk = turns.Conversation()
            for i, r in enumerate(rows):
                talk.add(i, r)
            cost, audit, lines = by_table(rows)
            assert talk.report()[5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Bye"), (1, 4, "user", "Bye"), (1, 9, "assistant", "See you!"),
    (2, None, "user", "a?"), (2, 5, None, "b"), (2, 5, "user", None), (2, 7, "assistant", ""), (None, 1, "user", "lost."), (None, None, None, None),
    (3, 1, "", "no role."), (3, 2, "assistant", "é" * 100_000 + "."), (4, 1, "user", "x "), (4, 1, "user", "x "), (4, 2, "bot", "\x1f\x85"), (5, -(2**63), "user", "a."), (5, 2**63 - 1, "assistant", "b."),
]


def expected(rows):
    out = {}
    for conv, after in damaged(rows).items():
        marked = faulty(after)
        numbers = [t for t, _, _ in after if t is not None]
        pairs = list(zip([r.role[:1] for r in marked], [r.role[:1] for r in marked[1:]]))
        cost, audit, lines = by_table(marked)
        gaps = min(max(numbers) - min(numbers) + 1 - len(set(numbers)), 2**63 - 1) if numbers else 0
        out[conv] = (gaps, *[sum(r.fault == f for r in marked) for f in ("blank", "duplicate", "truncated")], sum(p not in {("s", "u"), ("u", "a"), ("a", "u")} for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("conv", "kind", "copy", "dropped", "seen", "fault", "audit", "cost"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_reports_and_turns(spark):
    rng = random.Random(4)
    rows = ODD + [(100 + c, t, r.role, r.text) for c in range(60) for t, r in enumerate(conversation(rng, rng.randint(1, 9)))] + [(999, t, r.role, r.text + str(t)) for t, r in enumerate(conversation(rng, 400))]
    rows += [(5000 + c, 0, "user", "only.") for c in range(40)]  # some are dropped whole
    after = turns.damage(frame(spark, rows))
    reports = turns.repair(after)
    got = {r[0]: tuple(r)[1:] for r in reports.collect()}
    assert got == expected(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()
    made = {}
    for r in turns.repaired_turns(after, reports).orderBy("position").collect():
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(made.get(c, [])).encode()).hexdigest() for c in got} == {c: r[-1] for c, r in got.items()}


def test_whole_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (2, 0, "assistant", "Hm")]
    got = {r.conv_id: (r.cost, r.audit) for r in turns.repair(turns.whole(frame(spark, rows))).collect()}
    assert got == {1: (0, "KK"), 2: (3, "D")}
    none = turns.damage(frame(spark, rows).limit(0))
    assert turns.repair(none).count() == 0 == turns.repaired_turns(none, turns.repair(none)).count()
