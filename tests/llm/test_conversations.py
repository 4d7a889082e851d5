"""Conversation repair against an exhaustive search and a plain copy of the damage rules."""

import hashlib
import random
import re
import zlib

import pytest

from plurivote.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, label string, id string, audit string"


def best_edits(codes):
    """Least cost and audit by a search over phases, one turn at a time."""
    states = {"B": (0, "")}
    puts = {"B": [("", "B"), ("I", "u")], "s": [("", "s"), ("I", "u"), ("II", "a")], "u": [("", "u"), ("I", "a")], "a": [("", "a"), ("I", "u")]}
    for code in codes:
        state, kind = divmod(code, 4)
        following = {}
        for phase, (cost, audit) in states.items():
            for letters, now in puts[phase]:
                wanted = "a" if now == "u" else "u"
                ways = [("D", 3, now)]
                if state < 2:
                    own = C.CLASSES[kind]
                    if own == wanted or (own == "s" and now == "B"):
                        ways.append(("K", state, own))
                    ways.append(("R", 2 + state, wanted))
                for letter, price, end in ways:
                    found = (cost + 2 * len(letters) + price, audit + letters + letter)
                    following[end] = min(following.get(end, found), found)
        states = following
    ends = [(cost + 2 * len(letters), audit + letters) for phase, (cost, audit) in states.items() for letters, now in puts[phase] if now in "Ba"]
    return min(ends)


def random_codes(rng, n):
    usual = [1 + (i % 2) for i in range(n)]
    return bytes(rng.choice([k, k, k, rng.randrange(4)]) + 4 * rng.choice([0, 0, 0, 0, 1, 2, 3]) for k in usual)


@pytest.mark.parametrize("seed", range(6))
def test_edits_are_the_cheapest(seed):
    rng = random.Random(seed)
    for _ in range(120):
        codes = random_codes(rng, rng.randrange(0, 14))
        assert C.edits([codes]) == best_edits(codes), codes


@pytest.mark.parametrize("piece", [1, 2, 5, 64])
def test_pieces_give_the_same_edits(piece):
    rng = random.Random(piece)
    for n in (3, 17, 64, 65, 200):
        codes = random_codes(rng, n)
        assert C.edits([codes[i : i + piece] for i in range(0, n, piece)]) == best_edits(codes)


def test_worst_cases():
    # Roles that never fit, turns that all must go, one system turn, a truncated pair.
    for codes in (bytes([3] * 30), bytes([8] * 30), bytes([0]), bytes([4]), bytes([0, 0, 0]), bytes([5, 6]), bytes([2] * 31), bytes([1] * 32)):
        assert C.edits([codes]) == best_edits(codes)
    assert C.edits([b""]) == C.edits([]) == (0, "")


def plain(rows):
    """The contract of the query, row by row."""
    known = {r[0] for r in rows}
    found = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        found += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    made = {}
    for conv in known:
        mine = [r for r in found if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        seen, codes = set(), []
        for _, _, role, text in mine:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            state = 2 if not body else 3 if (role, text) in seen else 0 if body[-1] in ".!?" else 1
            seen.add((role, text))
            codes.append(4 * state + (C.CLASSES.index(role[0]) if role[:1] in set("sua") and role else 3))
        cost, audit = best_edits(codes)
        lines, at, phase = [], 0, "B"
        for letter in audit:
            asked = "assistant" if phase == "u" else "user"
            if letter == "I":
                lines.append(f"{asked}:")
            else:
                _, _, role, text = mine[at]
                at += 1
                if letter == "D":
                    continue
                lines.append(f"{role if letter == 'K' else asked}:{text}")
            phase = lines[-1][:1]
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        made[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(sum(c // 4 == s for c in codes) for s in (2, 3, 1)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return made


def run(spark, tmp_path, rows):
    from plurivote.llm.queries import op12_conversation_repair

    folder = str(tmp_path)
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    found = op12_conversation_repair(spark, folder).collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in found}


def test_edge_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."),
        (2, None, "user", "no turn."), (2, 5, "user", None), (2, 5, None, "no role."), (2, 9, "", "empty role"),
        (None, 1, "user", "null id."), (None, None, None, None),
        (3, 0, "user", " \t\n"), (4, 1, "tool", "x."), (4, 7, "Assistant", "y!"), (5, 0, "user", "z" * 200_000 + "."),
    ]
    rows += [(100 + c, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["a.", "b", "c!", "", "d? "])) for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(7, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(400)]  # many pieces
    assert run(spark, tmp_path, rows) == plain(rows)


def test_dropped_and_empty(spark, tmp_path):
    gone = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, tmp_path / "a", [(8, gone, "user", "x.")]) == {8: (0, 0, 0, 0, 0, 0, "", empty)}
    assert run(spark, tmp_path / "b", []) == {}


def test_repaired_turns_alternate(spark):
    rows = [(c, t, ["user", "assistant", "user"][(t * c) % 3], f"{c} {t}.") for c in range(20) for t in range(9)]
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    audits = C.judged(given)
    turns = {}
    for r in C.repaired(given, audits).collect():
        turns.setdefault(r["id"], []).append((r["position"], r["role"]))
    costs = {r["id"]: r["cost"] for r in audits.collect()}
    assert len(costs) == 20
    for found in turns.values():
        roles = [role for _, role in sorted(found)]
        assert [p for p, _ in sorted(found)] == list(range(len(found)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles))
