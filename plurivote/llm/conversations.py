"""Repair of conversations: the cheapest edits after which the turns alternate.

The roles of a sound conversation spell ``(s?(ua)+)?``: nothing, or user and assistant in turn, after a system turn
at most. Its string of any length is one alternating string, so a conversation is aligned to the string of each
feasible length by Wagner and Fischer's table. Only cells that can lie on a path no dearer than the best
alignment so far are filled (Ukkonen's band), and lengths that cannot reach it are left out. Every alignment is
traced back to its audit, one letter an edit; the cheapest wins, then the least audit.

| letter | edit | cost |
|---|---|---|
| K | keep the turn | 0 |
| R | give it the role the string asks for, user or assistant | 2 |
| D | delete it; blank and duplicate turns must go | 3 |
| I | insert an empty user or assistant turn | 2 |

A truncated turn that stays costs 1 more. The first fault of a turn counts: blank (no character but white space),
duplicate (role and text seen earlier in the conversation), truncated (the last character that is not white space
is none of ``.!?``).

A conversation of more than ``PIECE`` turns is aligned piece by piece between every two phases of the string (nothing
yet, after s, after u, after a), and the pieces are joined by least cost and audit; an insertion stands before the
turn it precedes, so the audits of a piece are never each other's beginnings and the join is exact. Work is linear in
the turns, and a task holds the audits of one conversation, no texts. The texts pass by once more, sorted, when
the edits are applied. A conversation is one task's work there: its audit and digest are single values.

Turns stand in the order of ``turn``, nulls first; turns of one number by the digest of role and text.

Defined cases: null role or text is one blank; null ids are one conversation; a role's initial is its first character,
only s, u and a can be kept; repeated rows are duplicates; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurivote.llm.arrow import ddl, kept

BLANKS = " \t\n\u000b\u000c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
PIECE = 64
KEPT = 50_000  # alignments a worker remembers
ROLES = {"u": "user", "a": "assistant"}
# A turn's code: its class (s, u, a, or other) plus 4 times its state (sound, truncated, blank, duplicate).
CLASSES = "sua?"
SOUND, CUT, BLANK, DUPLICATE = range(4)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
OUT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def feasible(begin: str, end: str, least: int, most: int) -> Iterator[str]:
    """Strings of the grammar between two phases, of a length from ``least`` to ``most``. Phases: B (nothing), s, u, a."""
    for length in range(max(least, 0), most + 1):
        if not length:
            if begin == end:
                yield ""
            continue
        following = {"B": "ua", "s": "ua", "u": "au", "a": "ua"}[begin] * (length // 2 + 1)
        plain = following[:length]
        if plain[-1] == end:
            yield plain
        if begin == "B":
            system = "s" + following[: length - 1]
            if system[-1] == end:
                yield system


def align(codes: bytes, target: str, limit: int, last: bool) -> tuple[int, str] | None:
    """Least cost and least audit that turn ``codes`` into ``target``, or None if it costs more than ``limit``.

    Unless it is the ``last`` piece, nothing is inserted after its last turn.
    """
    m, n = len(codes), len(target)
    none = limit + 1

    def off(d: int) -> int:
        return DELETE * d if d > 0 else -INSERT * d

    # Band: a path through cell (i, j) deletes or inserts at least the difference before it and the one after it.
    shifts = [d for d in range(-n, m + 1) if off(d) + off(m - n - d) <= limit]
    if not shifts:
        return None
    low, high = shifts[0], shifts[-1]

    def steps(i: int, j: int) -> list[tuple[str, int, int, int]]:
        """Edits that may come next, least letter first."""
        found = []
        if i < m:
            found.append(("D", DELETE, i + 1, j))
        if j < n:
            wanted = target[j]
            if wanted != "s" and (i < m or last):
                found.append(("I", INSERT, i, j + 1))
            if i < m:
                state, kind = divmod(codes[i], 4)
                if state < BLANK:
                    if CLASSES[kind] == wanted:
                        found.append(("K", KEEP + TRUNCATED * state, i + 1, j + 1))
                    elif wanted != "s":
                        found.append(("R", REROLE + TRUNCATED * state, i + 1, j + 1))
        return found

    table = {(m, n): 0}
    for i in range(m, -1, -1):
        for j in range(min(n, i - low), max(0, i - high) - 1, -1):
            if (i, j) != (m, n):
                table[i, j] = min((cost + table.get((a, b), none) for _, cost, a, b in steps(i, j)), default=none)
    total = table.get((0, 0), none)
    if total > limit:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (m, n):
        for letter, cost, a, b in steps(i, j):
            if cost + table.get((a, b), none) == table[i, j]:
                audit.append(letter)
                i, j = a, b
                break
    return total, "".join(audit)


def cheapest(codes: bytes, begin: str, end: str, last: bool) -> tuple[int, str] | None:
    """``least`` of the arguments; a worker keeps what it found, as short conversations are much alike."""
    known = kept("conversation-edits", dict)
    if (codes, begin, end, last) not in known:
        if len(known) >= KEPT:
            known.clear()
        known[codes, begin, end, last] = least(codes, begin, end, last)
    return known[codes, begin, end, last]


def least(codes: bytes, begin: str, end: str, last: bool) -> tuple[int, str] | None:
    """Least (cost, audit) over the strings of all feasible lengths between two phases; None if there is none."""
    forced = sum(c // 4 >= BLANK for c in codes)
    usable = len(codes) - forced
    best = None
    # Dearer than any useful alignment: delete all and insert the shortest string.
    limit = DELETE * len(codes) + INSERT * 3
    for away in range(max(usable, (limit // INSERT)) + 1):
        if DELETE * forced + min(INSERT, DELETE) * away > limit:
            break  # both directions cost more than the incumbent from here on
        for length in {usable - away, usable + away}:
            for target in feasible(begin, end, length, length) if length >= 0 else ():
                found = align(codes, target, limit, last)
                if found is not None and (best is None or found < best):
                    best, limit = found, found[0]
    return best


def edits(pieces: Iterable[bytes]) -> tuple[int, str]:
    """Cost and audit of one conversation, given as pieces of codes; the last piece may be empty."""
    # For every phase: cost, rank of its audit among the phases, and the way it was reached.
    reached, trail = {"B": (0, 0)}, []
    held = None

    def join(piece: bytes, last: bool) -> None:
        nonlocal reached
        found = {}
        for end in "Ba" if last else "Bsua":
            ways = []
            for begin, (cost, rank) in reached.items():
                way = cheapest(piece, begin, end, last)
                if way is not None:
                    ways.append((cost + way[0], rank, way[1], begin))
            if ways:
                found[end] = min(ways)
        order = sorted(found, key=lambda end: found[end][1:3])
        trail.append({end: (way[3], way[2]) for end, way in found.items()})
        reached = {end: (found[end][0], order.index(end)) for end in found}

    for piece in pieces:
        if held is not None:
            join(held, False)
        held = piece
    join(held if held is not None else b"", True)
    phase = min(reached, key=reached.get)
    cost, parts = reached[phase][0], []
    for step in reversed(trail):
        phase, part = step[phase]
        parts.append(part)
    return cost, "".join(reversed(parts))


class _Conversation:
    """What is known of the turns so far: counts, and the codes in pieces."""

    def __init__(self):
        self.pieces, self.piece = [], bytearray()
        self.first = self.latest = self.before = None
        self.distinct = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn, code: int) -> None:
        if turn is not None and turn != self.latest:
            self.first = turn if self.first is None else self.first
            self.latest, self.distinct = turn, self.distinct + 1
        state, kind = divmod(code, 4)
        self.faults[state] += 1
        now = CLASSES[kind]
        if self.before is not None and (self.before, now) not in LEGAL:
            self.illegal += 1
        self.before = now
        self.piece.append(code)
        if len(self.piece) == PIECE:
            self.pieces.append(bytes(self.piece))
            self.piece.clear()

    def result(self) -> tuple:
        cost, audit = edits([*self.pieces, bytes(self.piece)] if self.piece or not self.pieces else self.pieces)
        gaps = 0 if self.first is None else self.latest - self.first + 1 - self.distinct
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, cost, audit


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, turn, code) → one row per conversation. A null code only names the conversation."""
    made, key, now = [], None, None
    schema = None

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        if schema is None:
            fields = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())]
            schema = pa.schema([("id", batch.schema.field(0).type), *fields, ("cost", pa.int64()), ("audit", pa.string())])
        for conv, turn, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != key:
                if now is not None:
                    made.append((key, *now.result()))
                key, now = conv, _Conversation()
                if len(made) >= 10_000:
                    yield packed()
                    made = []
            if code is not None:
                now.add(turn, code)
    if now is not None:
        made.append((key, *now.result()))
        yield packed()


def _turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    blank = F.lit(" ")
    narrow = rows.select(F.col(conv_id).alias("id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"))
    return narrow.withColumn("key", F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))))


def judged(rows: DataFrame, everyone: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``id``, counts of faults, ``cost`` and ``audit`` of every conversation.

    ``everyone`` may name conversations (one column) that have no row left.
    """
    turns = _turns(rows, conv_id, turn, role, text)
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    alone = F.when(end == "", BLANK).when(F.substring(end, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    # Everything a turn says is reduced to one number before the exchange; a conversation's copies of a turn meet by digest.
    seen = Window.partitionBy("id", "key").orderBy(F.col("turn").asc_nulls_first())
    known = turns.select("id", "turn", "key", kind.alias("kind"), alone.alias("state"))
    known = known.withColumn("again", F.row_number().over(seen))
    state = F.when((F.col("state") != BLANK) & (F.col("again") > 1), DUPLICATE).otherwise(F.col("state"))
    coded = known.select("id", "turn", "key", "again", (F.col("kind") + 4 * state).alias("code"))
    if everyone is not None:
        named = everyone.select(F.col(everyone.columns[0]).alias("id")).distinct()
        coded = coded.unionByName(named, allowMissingColumns=True)
    dealt = coded.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "key", "again").select("id", "turn", "code")
    return dealt.mapInArrow(_judge, f"{ddl(dealt, 'id')}, {OUT}")


def _applied(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Sorted (id, audit, role, text): a conversation's audit, then its turns. Yields digests or the repaired turns."""
    made, size, kind = [], 0, None
    conv, audit, at, phase, hashed, position, started = None, "", 0, "B", None, 0, False

    def packed():
        nonlocal size
        size = 0
        names = ["id", "repaired_sha256"] if digest else ["id", "position", "role", "text", "edit"]
        types = [kind, pa.string()] if digest else [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)
        made.clear()
        return batch

    def put(role: str, text: str, edit: str) -> None:
        nonlocal position, size, phase
        if digest:
            hashed.update((("\n" if position else "") + f"{role}:{text}").encode())
        else:
            made.append((conv, position, role, text, edit))
            size += len(text)
        position += 1
        phase = role[:1]

    def wanted() -> str:
        return "a" if phase == "u" else "u"

    def inserted() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(ROLES[wanted()], "", "I")
            at += 1

    def ended() -> None:
        inserted()
        if digest:
            made.append((conv, hashed.hexdigest()))

    for batch in batches:
        kind = batch.schema.field(0).type
        for key, told, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if told is not None:
                if started:
                    ended()
                conv, audit, at, phase, position, started = key, told, 0, "B", 0, True
                hashed = hashlib.sha256()
                continue
            inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                put(role if edit == "K" else ROLES[wanted()], text, edit)
            if len(made) >= 10_000 or size > 4 << 20:
                yield packed()
    if started:
        ended()
    if made:
        yield packed()


def _with_audits(rows: DataFrame, audits: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    turns = _turns(rows, conv_id, turn, role, text)
    both = turns.unionByName(audits.select("id", "audit"), allowMissingColumns=True)
    order = ["id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "key"]
    return both.repartition("id").sortWithinPartitions(*order).select("id", "audit", "role", "text")


def repaired(rows: DataFrame, audits: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``id``, ``position``, ``role``, ``text``, ``edit`` of every turn that stays or was inserted."""
    dealt = _with_audits(rows, audits, conv_id, turn, role, text)
    return dealt.mapInArrow(lambda b: _applied(b, False), f"{ddl(dealt, 'id')}, position bigint, role string, text string, edit string")


def digests(rows: DataFrame, audits: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``id`` and the SHA-256 of its repaired turns as ``role:text`` lines, worked out while they stream by."""
    dealt = _with_audits(rows, audits, conv_id, turn, role, text)
    return dealt.mapInArrow(lambda b: _applied(b, True), f"{ddl(dealt, 'id')}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by ``crc32(conv_id:turn) % 20``.

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's. Null: one blank.
    """
    blank = F.lit(" ")
    fault = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])) % 20
    plain = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), fault.alias("fault"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return plain.where("fault != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")
