import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from podia.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place int, kind string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def damaged(rows):
    """The contract's damage, in plain Python."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        inner = text.strip("\t\n\x0b\x0c\r ")
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows, kinds, most_inserts):
    """All (cost, audit, lines) of edits that give legal roles."""
    done = []

    def go(i, cost, audit, lines, inserts):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x, _ in lines)):
            done.append((cost, audit, lines))
        if inserts < most_inserts:
            for role in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*lines, (role, "")], inserts + 1)
        if i == len(rows):
            return
        _, role, text = rows[i]
        go(i + 1, cost + 4, audit + "D", lines, inserts)
        if kinds[i] not in ("blank", "duplicate"):
            more = 3 * (kinds[i] == "truncated")
            if role:
                go(i + 1, cost + more, audit + "K", [*lines, (role, text)], inserts)
            for to in ("user", "assistant"):
                go(i + 1, cost + 3 + more, audit + "R", [*lines, (to, text)], inserts)

    go(0, 0, "", [], 0)
    return min(done, key=lambda x: x[:2])


def least_by_suffixes(rows, kinds):
    """The same from the end, over states, for longer conversations: least cost, then least audit."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        options = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserts < 2:
            role = "a" if state == "u" else "u"
            c, t = best(i, role, inserts + 1)
            options.append((c + 3, "I" + t))
        if i < len(rows):
            c, t = best(i + 1, state, 0)
            options.append((c + 4, "D" + t))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 * (kinds[i] == "truncated")
                initial = rows[i][1][:1]
                if initial and initial in follow[state]:
                    c, t = best(i + 1, initial, 0)
                    options.append((c + more, "K" + t))
                c, t = best(i + 1, "a" if state == "u" else "u", 0)
                options.append((c + 3 + more, "R" + t))
        return min(options, default=(10**9, ""))

    return best(0, "", 0)


def repaired(rows, audit):
    lines, i = [], 0
    for letter in audit:
        free = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
        if letter == "I":
            lines.append((free, ""))
            continue
        if letter == "K":
            lines.append(rows[i][1:])
        elif letter == "R":
            lines.append((free, rows[i][2]))
        i += 1
    return lines


def of_rows(rows):
    repair = turns.Repair()
    for turn, role, text in rows:
        repair.add(turn, role, text.encode())
    return repair.result()


def test_cheapest_and_least_of_all_edits():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool", "u", ""]), rng.choice(["a.", "a", "b!", ""])) for i in range(rng.randint(0, 3))]
        kinds = faults(rows)
        cost, audit, lines = every_repair(rows, kinds, 3)
        got = of_rows(rows)
        assert (got["cost"], got["audit"]) == (cost, audit), rows
        assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def test_longer_conversations_from_the_end():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(i, rng.choice(["system", "user", "assistant", "user", "assistant", "x"]), rng.choice(["a.", "b", "c?", "d!", " "])) for i in range(rng.randint(4, 40))]
        got = of_rows(rows)
        assert (got["cost"], got["audit"]) == least_by_suffixes(tuple(rows), tuple(faults(rows))), rows


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Good day."),
    (2, 0, "user", "Same."), (2, 0, "user", "Same."), (2, 5, "assistant", "cut of"), (2, 9, "assistant", "Yes."),
    (3, None, "user", "No turn."), (3, None, None, None), (3, 4, "assistant", ""),
    (None, 1, "user", "Nobody's."), (None, None, "assistant", "Neither."), (4, 7, "tool", "naïve 😀 text!"),
    *((5 + i, j, r, f"{r} {i} {j}.") for i in range(60) for j, r in enumerate(["system", "user", "assistant", "user", "assistant"])),
    *((100 + i, 0, "user", "Alone.") for i in range(60)),
    (80, 1, "user", "long. " * 50_000), (80, 2, "assistant", "x" * 300_000),
    *((81, i, "user" if i % 2 == 0 else "assistant", f"turn {i % 700}.") for i in range(3000)),
]


def test_query_matches_brute_force(spark):
    got = {r.conv_id: r for r in turns.repairs(turns.damage(table(spark, ROWS))).collect()}
    want = damaged(ROWS)
    assert set(got) == set(want)
    assert any(not rows for rows in want.values())
    for conv, rows in want.items():
        r, kinds = got[conv], faults(rows)
        numbers = [t for t, _, _ in rows if t is not None]
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        if len(rows) < 100:
            assert (r.cost, r.audit) == least_by_suffixes(tuple(rows), tuple(kinds))
        lines = repaired(rows, r.audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x, _ in lines))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()


def test_repaired_turns_are_what_the_digest_is_of(spark):
    rows = turns.damage(table(spark, ROWS))
    found = turns.repairs(rows)
    lines = defaultdict(list)
    for r in turns.repaired_turns(rows, found).collect():
        lines[r.conv_id].append((r.place, f"{r.role}:{r.text}", r.edit))
    for r in found.collect():
        own = sorted(lines[r.conv_id])
        assert [x[0] for x in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(x[1] for x in own).encode()).hexdigest() == r.repaired_sha256
        assert "".join(x[2] for x in own) == r.audit.replace("D", "")


def test_empty_and_plain_tables(spark):
    assert turns.repairs(turns.damage(table(spark, []))).count() == 0
    plain = turns.repairs(table(spark, [(1, 1, "user", "Hi."), (1, 2, "assistant", "Hello.")])).collect()
    assert [(r.conv_id, r.cost, r.audit) for r in plain] == [(1, 0, "KK")]


@pytest.mark.parametrize(("role", "audit"), [("user", "KI"), ("assistant", "IK"), ("system", "D"), ("x", "D"), ("", "D")])
def test_single_turns(role, audit):
    assert of_rows([(1, role, "One.")])["audit"] == audit
