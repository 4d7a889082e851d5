"""Personal data: fixed patterns, and a character tagger that adds what they miss (operator 7).

The tagger is a bidirectional LSTM over characters with a CRF over the tags (begin and inside
of each kind, and outside), trained here in numpy from labelled spans. Its gates are piecewise linear, which numpy works
out several times faster than exponentials.

A text is read whole, in windows of up to 1,024 characters that overlap by 48. Each is decoded by Viterbi.
Then the text is reconciled: every character takes its tag from the window in which it
stands nearest to the middle, and spans are read off the joined tags, so a span that crosses a
window's edge is one span. Added spans that touch a pattern's span are dropped; the pattern's spans always stay.

Learning uses a bounded sample: at most ``MAX_DOCUMENTS`` documents with a digit or ``@`` (those with the smallest hash of
their id) and ``MAX_WINDOWS`` windows of them. Their labels are the pattern spans; copies in other notations (e-mails in
words, addresses with bracketed dots, cards in other groups, phone numbers without ``+``, wide digits) teach the tagger
what the patterns do not know.

Defined cases: a null text counts as empty and has no spans; spans of different kinds may overlap, those of one kind do
not; without labelled spans only the patterns work; repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurivote.llm.arrow import ddl, ragged, slices, text_buffers
from plurivote.session import settle

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE = 64, 32  # of the examples
READ, OVERLAP = (64, 128, 256, 512, 1024), 48  # of the texts: window sizes by length of text, and how far windows overlap
HIDDEN, EMBEDDED = 8, 8
TAGS = 1 + 2 * len(KINDS)  # 0: outside, 2k + 1: begin of kind k, 2k + 2: inside
MAX_DOCUMENTS, MAX_WINDOWS = 2_000, 4_000
STEPS, BATCH, RATE = 700, 96, 0.03
RUNS = 4_096  # runs that are searched at once
TEXTS = 1 << 19  # characters that are read at once

# ---- the patterns ----
MAY_HOLD = re.compile("[0-9@]")  # no pattern fits a text without
EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` outward; the same spans as the pattern's, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_HEAD:
            start -= 1
        tail = EMAIL_TAIL.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
            done = tail.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns, by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def card_shapes(text: str) -> list[tuple[int, int, int]]:
    """Numbers of a card's shape whose check digit fails. They teach the tagger the shape; an added card must pass the check."""
    found = ((m.start(), m.end(), digits_of(m.group())) for m in CARD.finditer(text))
    return [(a, 2, b) for a, b, digits in found if 12 <= len(digits) <= 19 and not luhn(digits)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


# ---- characters and windows ----
MARKS = "@.-+()_%/:=\"',;!?#*&|$~[]{}<>\\"
PAD, DIGIT, BLANK, BREAK, LETTER, OTHER = range(6)
FIRST_MARK, FIRST_LETTER = 6, 6 + len(MARKS)
SYMBOLS = FIRST_LETTER + 26


def _symbol(point: int) -> int:
    """Class of a character: letters in either case alike, wide forms like plain ones, digits of all scripts alike."""
    if 0xFF01 <= point <= 0xFF5E:
        point -= 0xFEE0
    c = chr(point)
    if c in MARKS:
        return FIRST_MARK + MARKS.index(c)
    if "a" <= c.lower() <= "z" and point < 128:
        return FIRST_LETTER + ord(c.lower()) - ord("a")
    if c in "\t ":
        return BLANK
    if c in "\r\n":
        return BREAK
    if unicodedata.decimal(c, None) is not None:
        return DIGIT
    return LETTER if unicodedata.category(c)[0] in "LM" else OTHER


PLAIN = np.array([_symbol(point) for point in range(128)], dtype=np.int8)


def symbols(text: str) -> np.ndarray:
    """Class of every character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    plain = points < 128
    if plain.all():
        return PLAIN[points]
    out = np.empty(len(points), dtype=np.int8)
    out[plain] = PLAIN[points[plain]]
    kinds, which = np.unique(points[~plain], return_inverse=True)
    out[~plain] = np.array([_symbol(int(point)) for point in kinds], dtype=np.int8)[which]
    return out


def window_starts(low: int, high: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Begins of the windows of a stretch; the last one ends with it."""
    if high - low <= window:
        return [low]
    return [*range(low, high - window, stride), high - window]


def cut_windows(values: np.ndarray, low: int, high: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    out = np.zeros((len(starts := window_starts(low, high, window, stride)), window), dtype=np.int8)
    for i, start in enumerate(starts):
        part = values[start : min(start + window, high)]
        out[i, : len(part)] = part
    return out


def reading_window(length: int) -> int:
    """Size of the windows in which a text of this length is read."""
    return next((w for w in READ if length <= w), READ[-1])


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, dtype=np.int8)
    for start, kind, end in spans:
        if not tags[start:end].any():
            tags[start:end] = 2 * kind + 2
            tags[start] = 2 * kind + 1
    return tags


# ---- the tagger ----
class Tagger(NamedTuple):
    """Weights by name."""

    embed: np.ndarray  # (SYMBOLS, EMBEDDED)
    input: np.ndarray  # (2, EMBEDDED, 4 HIDDEN)
    state: np.ndarray  # (2, HIDDEN, 4 HIDDEN)
    bias: np.ndarray  # (2, 4 HIDDEN)
    out: np.ndarray  # (2 HIDDEN, TAGS)
    out_bias: np.ndarray
    move: np.ndarray  # (TAGS, TAGS)
    begin: np.ndarray


def fresh_tagger(seed: int = 7) -> Tagger:
    rng = np.random.default_rng(seed)
    bias = np.zeros((2, 4 * HIDDEN))
    bias[:, HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
    return Tagger(
        rng.normal(0, 0.5, (SYMBOLS, EMBEDDED)),
        rng.normal(0, EMBEDDED**-0.5, (2, EMBEDDED, 4 * HIDDEN)),
        rng.normal(0, HIDDEN**-0.5, (2, HIDDEN, 4 * HIDDEN)),
        bias,
        rng.normal(0, (2 * HIDDEN) ** -0.5, (2 * HIDDEN, TAGS)),
        np.zeros(TAGS),
        np.zeros((TAGS, TAGS)),
        np.zeros(TAGS),
    )


# The gates are piecewise linear: 0.25 z + 0.5 cut to 0 to 1; the candidate and the cell's way out are cut to -1 to 1.
SCALE = np.repeat([0.25, 0.25, 0.25, 1.0], HIDDEN)
SHIFT = np.repeat([0.5, 0.5, 0.5, 0.0], HIDDEN)
LEAST = np.repeat([0.0, 0.0, 0.0, -1.0], HIDDEN)[:, None]


def _scan(tagger: Tagger, x: np.ndarray, dtype: type, traces: tuple[list, list] | None = None) -> np.ndarray:
    """Hidden states (length, 2 HIDDEN, n) of both directions; ``traces`` get what the gradient needs."""
    n, length = x.shape
    columns, least = np.ascontiguousarray(x.T).astype(np.intp), LEAST.astype(dtype)
    both = np.empty((length, 2 * HIDDEN, n), dtype)
    z, fresh = np.empty((2, 4 * HIDDEN, n), dtype)
    i, f, o, g = (z[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
    for way in range(2):
        fed = (((tagger.embed @ tagger.input[way] + tagger.bias[way]) * SCALE + SHIFT).T).astype(dtype, order="C")
        state = (tagger.state[way] * SCALE).T.astype(dtype, order="C")
        h, c = np.zeros((2, HIDDEN, n), dtype)
        for t in range(length) if way == 0 else range(length - 1, -1, -1):
            np.take(fed, columns[t], axis=1, out=fresh, mode="clip")
            np.matmul(state, h, out=z)
            np.add(z, fresh, out=z)
            np.maximum(z, least, out=z)
            np.minimum(z, 1, out=z)
            if traces is not None:
                traces[way].append((t, z.copy(), h, c.copy()))
            np.multiply(c, f, out=c)
            np.multiply(g, i, out=g)
            np.add(c, g, out=c)
            h = both[t, way * HIDDEN : (way + 1) * HIDDEN]
            np.maximum(c, -1, out=h)
            np.minimum(h, 1, out=h)
            np.multiply(h, o, out=h)
    return both


def _emit(tagger: Tagger, both: np.ndarray) -> np.ndarray:
    """Scores (length, TAGS, n) of the states (length, 2 HIDDEN, n)."""
    return tagger.out.T.astype(both.dtype, order="C") @ both + tagger.out_bias.astype(both.dtype)[:, None]


def emissions(tagger: Tagger, x: np.ndarray) -> np.ndarray:
    """Scores (n, length, TAGS)."""
    return _emit(tagger, _scan(tagger, x, np.float64)).transpose(2, 0, 1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def loss_and_gradient(tagger: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, Tagger]:
    """Mean negative log-likelihood of the tags ``y`` per window, and its gradient."""
    n, length = x.shape
    traces: tuple[list, list] = ([], [])
    both = _scan(tagger, x, np.float64, traces)
    emit = _emit(tagger, both).transpose(2, 0, 1)

    forward, backward = np.empty_like(emit), np.zeros_like(emit)
    forward[:, 0] = tagger.begin + emit[:, 0]
    for t in range(1, length):
        forward[:, t] = emit[:, t] + _log_sum(forward[:, t - 1, :, None] + tagger.move, 1)
    for t in range(length - 2, -1, -1):
        backward[:, t] = _log_sum(tagger.move + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
    whole = _log_sum(forward[:, -1], 1)
    rows = np.arange(n)[:, None]
    path = tagger.begin[y[:, 0]] + emit[rows, np.arange(length), y].sum(axis=1) + tagger.move[y[:, :-1], y[:, 1:]].sum(axis=1)
    loss = float((whole - path).mean())

    d_emit = np.exp(forward + backward - whole[:, None, None])
    d_begin = d_emit[:, 0].sum(axis=0)
    np.subtract.at(d_begin, y[:, 0], 1)
    d_emit[rows, np.arange(length), y] -= 1
    d_emit /= n
    pairs = forward[:, :-1, :, None] + tagger.move + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
    d_move = np.exp(pairs).sum(axis=(0, 1))
    np.subtract.at(d_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)

    d_both = tagger.out @ d_emit.transpose(1, 2, 0)
    gradient = {
        "out": np.tensordot(both, d_emit, axes=([0, 2], [1, 0])),
        "out_bias": d_emit.sum(axis=(0, 1)),
        "move": d_move / n,
        "begin": d_begin / n,
        "embed": np.zeros_like(tagger.embed),
        "input": np.zeros_like(tagger.input),
        "state": np.zeros_like(tagger.state),
        "bias": np.zeros_like(tagger.bias),
    }
    for way, trace in enumerate(traces):
        d_h_next = d_c_next = np.zeros((HIDDEN, n))
        d_fed = np.zeros((SYMBOLS, 4 * HIDDEN))
        for t, z, before_h, before_c in reversed(trace):
            i, f, o, g = (z[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            c = f * before_c + i * g
            d_h = d_both[t, way * HIDDEN : (way + 1) * HIDDEN] + d_h_next
            d_c = d_c_next + d_h * o * (np.abs(c) < 1)
            d_z = np.concatenate([d_c * g, d_c * before_c, d_h * np.clip(c, -1, 1), d_c * i])
            d_z *= ((z > LEAST) & (z < 1)) * SCALE[:, None]
            gradient["state"][way] += before_h @ d_z.T
            d_fed += (x[:, t] == np.arange(SYMBOLS)[:, None]).astype(np.float64) @ d_z.T
            d_h_next, d_c_next = tagger.state[way] @ d_z, d_c * f
        gradient["bias"][way] = d_fed.sum(axis=0)
        gradient["input"][way] = tagger.embed.T @ d_fed
        gradient["embed"] += d_fed @ tagger.input[way].T
    return loss, Tagger(**gradient)


def train(x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7) -> Tagger:
    """Adam on batches drawn with a fixed seed."""
    rng = np.random.default_rng(seed)
    tagger = fresh_tagger(seed)
    first, second = ([np.zeros_like(w) for w in tagger] for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), min(BATCH, len(x)))
        _, gradient = loss_and_gradient(tagger, x[pick], y[pick].astype(np.int64))
        size = np.sqrt(sum(float((g**2).sum()) for g in gradient))
        moved = []
        for k, (w, g) in enumerate(zip(tagger, gradient, strict=True)):
            g = g * min(1.0, 5.0 / (size + 1e-12))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            moved.append(w - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
        tagger = Tagger(*moved)
    return tagger


def _worth(tagger: Tagger, emit: np.ndarray) -> np.ndarray:
    """Upper bound (length, n) of what a character adds, against the tag outside, to a run of other tags that holds it.

    Seen from a path that is outside throughout, a tag ``k`` pays the way in and the way out as if it stood alone, and the
    way between two tags of a run gives back ``inner``; the largest such gift of any tag before is taken.
    """
    move, begin = tagger.move, tagger.begin
    enter, leave = move[0] - move[0, 0], move[:, 0] - move[0, 0]
    inner = move - move[0] - move[:, :1] + move[0, 0]
    alone = (enter + leave + np.maximum(inner[1:].max(axis=0), 0))[1:]
    worth = (emit[:, 1:] + alone.astype(emit.dtype)[:, None]).max(axis=1) - emit[:, 0]
    worth[0] += max(0.0, (begin - begin[0] - enter)[1:].max())
    worth[-1] += max(0.0, -leave[1:].min())
    return worth + emit.dtype.type(1e-3)


def _in_runs(worth: np.ndarray) -> np.ndarray:
    """Whether a character lies in a stretch whose worth is positive in sum; no other one can be in a run of the best path."""
    before, after = np.empty_like(worth), np.empty_like(worth)
    last = np.zeros(worth.shape[1], worth.dtype)
    for sums, order in ((before, range(len(worth))), (after, range(len(worth) - 1, -1, -1))):
        last = np.zeros_like(last)
        for t in order:
            np.maximum(last, 0, out=sums[t])
            sums[t] += worth[t]
            last = sums[t]
    return before + after - worth > 0


def _runs(tagger: Tagger, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs that can hold a tag other than outside: window, place, size, and the scores (TAGS) of their characters."""
    n, length = x.shape
    emit = _emit(tagger, _scan(tagger, x, np.float32))
    worth = _worth(tagger, emit)
    some = np.flatnonzero((worth > 0).any(axis=0))
    free = np.zeros((n, length), dtype=bool)
    free[some] = _in_runs(worth[:, some]).T
    edge = np.zeros((n, 1), dtype=bool)
    steps = np.diff(np.concatenate([edge, free, edge], axis=1).astype(np.int8), axis=1)
    row, low = np.nonzero(steps == 1)
    size = np.nonzero(steps == -1)[1] - low
    at = ragged(size, low)
    return row, low, size, emit[at, :, np.repeat(row, size)]


def decode(tagger: Tagger, x: np.ndarray) -> np.ndarray:
    """Best tags of every window, by Viterbi.

    Only the runs that can hold a tag other than outside by an upper bound are searched; the result is that of a search
    over whole windows. States are worked out for ``TEXTS`` characters at a time, the runs of all windows are searched together.
    """
    n, length = x.shape
    tags = np.zeros((n, length), dtype=np.int8)
    batch = max(1, TEXTS // length)
    found = [_runs(tagger, x[i : i + batch]) for i in range(0, n, batch)]
    row = np.concatenate([f[0] + i * batch for i, f in enumerate(found)])
    low, size, scores = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
    first = np.cumsum(size) - size
    by_size = np.argsort(size, kind="stable")
    # Runs of like size together, so short ones do not wait for long ones.
    cuts = {0, len(row), *range(0, len(row), RUNS), *np.searchsorted(size[by_size], 2 ** np.arange(12)).tolist()}
    for at, stop in pairwise(sorted(cuts)):
        pick = by_size[at:stop]
        r, a, m, begin = row[pick], low[pick], size[pick], first[pick]
        longest = int(m.max())
        # Tags first, runs last. Runs come by size, so those that have ended are in front; ``live`` is where the others begin.
        best = np.where(a == 0, tagger.begin[:, None], tagger.move[0][:, None]) + scores[begin].T
        to, lives, bests = tagger.move.T[:, :, None], [0], [best.copy()]  # to: (tag here, tag before, 1)
        for t in range(1, longest):
            live = int(np.searchsorted(m, t, side="right"))
            best[:, live:] = (best[None, :, live:] + to).max(axis=1) + scores[begin[live:] + t].T
            lives.append(live)
            bests.append(best[:, live:].copy())
        # The way out of a run, where a character follows it; then back, each tag from the best one before it.
        tag = (best + np.where(a + m < length, tagger.move[:, :1], 0.0)).argmax(axis=0)
        for t in range(longest - 1, -1, -1):
            live = lives[t]
            tags[r[live:], a[live:] + t] = tag[live:]
            if t:
                tag[live:] = (bests[t - 1][:, live - lives[t - 1] :] + tagger.move[:, tag[live:]]).argmax(axis=0)
    return tags


# ---- spans of the tagger ----
def reconciled(tags: np.ndarray, low: int, high: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """One tag per character of the stretch, each from the window it is most central in."""
    starts = window_starts(low, high, window, stride)
    out, margin = np.zeros(high - low, dtype=np.int64), np.full(high - low, -1)
    for start, row in zip(starts, tags, strict=True):
        n = min(window, high - start)
        central = np.minimum(np.arange(n), n - 1 - np.arange(n))
        here = slice(start - low, start - low + n)
        nearer = central > margin[here]
        out[here] = np.where(nearer, row[:n], out[here])
        margin[here] = np.maximum(margin[here], central)
    return out


def spans_of(tags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(start, kind, end)`` read off the tags; an inside tag that follows nothing begins a span."""
    start = kind = None
    for at, tag in enumerate([*tags.tolist(), 0]):
        new_kind = None if tag == 0 else (tag - 1) // 2
        if start is not None and (new_kind != kind or tag % 2 == 1):
            yield start, kind, at
            start = None
        if start is None and new_kind is not None:
            start, kind = at, new_kind


NAME = "[a-z0-9_%+-]+"
DOT = r"(?:\.|[\x20]*[\[(]\x20?(?:dot|\.)\x20?[\])]\x20*|\x20+dot\x20+)"
AT = r"(?:\x20?@\x20?|\x20*[\[(]\x20?(?:at|@)\x20?[\])]\x20*|\x20+at\x20+)"
ADDRESS = re.compile(f"{NAME}(?:{DOT}{NAME})*{AT}{NAME}(?:{DOT}{NAME})+")


def plausible(kind: int, text: str) -> bool:
    """An added span keeps what its kind always has, in whatever notation: names around an at sign or word and a dot or its
    word behind it, four parts of at most 255, the check digit of a card, a phone number's count of digits.
    """
    plain = unicodedata.normalize("NFKC", text).lower()
    if not plain or not (plain[0].isalnum() or plain[0] in "+(") or not plain[-1].isalnum() or "\n" in plain:
        return False
    if KINDS[kind] == "email":
        return ADDRESS.fullmatch(plain) is not None
    digits = "".join(str(d) for c in plain if (d := unicodedata.decimal(c, None)) is not None)
    letters = re.sub("dot", "", plain) if KINDS[kind] == "ip" else plain
    if any(c.isalpha() for c in letters):
        return False
    if KINDS[kind] == "ip":
        parts = re.findall(r"\d+", plain)
        return len(parts) == 4 and all(len(p) <= 9 and int(p) <= 255 for p in parts)
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the tagger finds beside the base spans, in whole texts."""
    where: dict[int, list[tuple[int, int]]] = {w: [] for w in READ}  # row and number of windows, by size
    windows: dict[int, list[np.ndarray]] = {w: [] for w in READ}
    for row, text in enumerate(texts):
        if not text:
            continue
        window = reading_window(len(text))
        part = cut_windows(symbols(text), 0, len(text), window, window - OVERLAP)
        where[window].append((row, len(part)))
        windows[window].append(part)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for window in READ:
        if not where[window]:
            continue
        tags = decode(tagger, np.concatenate(windows[window]))
        tagged = tags.any(axis=1)
        at = 0
        for row, n in where[window]:
            text, mine = texts[row], slice(at, at + n)
            at += n
            if not tagged[mine].any():
                continue
            for start, kind, end in spans_of(reconciled(tags[mine], 0, len(text), window, window - OVERLAP)):
                if text[max(start - 1, 0) : start].isalnum() or text[end : end + 1].isalnum():
                    continue  # a piece of a longer word or number
                if plausible(kind, text[start:end]) and not any(a < end and start < b for a, _, b in base[row]):
                    out[row].append((start, kind, end))
    return out


# ---- learning ----
WIDE = {c: c + 0xFEE0 for c in [*range(48, 58), 64, 43]}  # digits, at and plus in their wide forms


def renamed(address: str, words: list[str], rng: random.Random) -> str:
    """Half of the addresses as they are, the others with names and hosts of words of the text."""
    if not words or rng.random() < 0.5:
        return address
    name = rng.choice([".", "_", "-", ""]).join(rng.choices(words, k=rng.randint(1, 2))) + rng.choice(["", "", str(rng.randrange(100))])
    return f"{name}@{'.'.join(rng.choices(words, k=rng.randint(1, 2)))}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"


def respelled(text: str, spans: list[tuple[int, int, int]], style: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans in another notation: style 0 to 3 of each kind."""
    out, moved, at = "", [], 0
    rng, words = random.Random(f"{style}:{text[:64]}"), re.findall("[A-Za-z]{2,12}", text[:2_000])
    for start, kind, end in spans:
        if start < at:
            continue
        part, digits = text[start:end], digits_of(text[start:end])
        if KINDS[kind] == "email":
            mark, dot = [(" (at) ", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)")][style]
            name, host = renamed(part, words, rng).split("@")
            part = (name.replace(".", dot) if style == 1 else name) + mark + host.replace(".", dot)
        elif KINDS[kind] == "ip":
            part = part.translate(WIDE) if style == 2 else part.replace(".", ["[.]", " . ", "", "(dot)"][style])
        elif KINDS[kind] == "card":
            part = part.translate(WIDE) if style == 3 else "._/"[style].join(digits[i : i + 4] for i in range(0, len(digits), 4))
        elif style == 0:
            part = part[part.index(" (") + 1 :] if " (" in part else part[1:]
        elif style == 1:
            part = part[1:].replace("(", "").replace(")", "").replace("-", " ")
        elif style == 2:
            part = "00" + part[1:]
        else:
            part = part.translate(WIDE)
        out += text[at:start]
        moved.append((len(out), kind, len(out) + len(part)))
        out += part
        at = end
    return out + text[at:], moved


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with their tags. ``part``: the first kind in it, 4 without a span but with a digit, 5 other."""
    for batch in slices(batches):
        keys, parts, xs, ys = [], [], [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            spans = sorted(base_spans(text) + card_shapes(text))
            for version, (body, marks) in enumerate([(text, spans), *[respelled(text, spans, style) for style in range(4)]]):
                if version and not spans:
                    break
                classes, tags = symbols(body), tags_of(len(body), marks)
                for x, y in zip(cut_windows(classes, 0, len(body)), cut_windows(tags, 0, len(body)), strict=True):
                    if version and not y.any():
                        continue
                    keys.append(f"{key}:{version}:{len(xs)}")
                    parts.append((int(y[y > 0][0]) - 1) // 2 if y.any() else len(KINDS) + int(not (x == DIGIT).any()))
                    xs.append(x.tobytes())
                    ys.append(y.tobytes())
        columns = [pa.array(keys, pa.string()), pa.array(parts, pa.int32()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "part", "x", "y"])


def fit(documents: DataFrame, max_documents: int = MAX_DOCUMENTS, max_windows: int = MAX_WINDOWS) -> Tagger | None:
    """Train the tagger on the pattern spans of a bounded sample: half of the windows hold spans, as many of each kind as
    there are up to an eighth, a quarter other digits.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = documents.where(F.col("text").rlike("[0-9@]")).select(key.alias("key"))
    last = rows.orderBy("key").limit(max_documents).agg(F.max("key").alias("key")).first()["key"]
    if last is None:
        return None
    # The key first: the texts of other documents are not looked through again.
    sample = documents.where(key <= last).where(F.col("text").rlike("[0-9@]")).select(key.alias("key"), "text")
    windows = sample.mapInArrow(_examples, "key string, part int, x binary, y binary")
    drawn = settle(windows.withColumn("place", F.md5("key")))
    shares = [max_windows // 8] * len(KINDS) + [max_windows // 4] * 2
    chosen = reduce(
        DataFrame.unionAll,
        [drawn.where(F.col("part") == part).orderBy("place", "key").limit(share).select("x", "y") for part, share in enumerate(shares)],
    ).toArrow()
    x, y = (np.frombuffer(b"".join(chosen.column(n).to_pylist()), dtype=np.int8).reshape(-1, WINDOW) for n in ("x", "y"))
    if not y.any():
        return None
    return train(x.astype(np.int64), y)


# ---- the operator ----
def _finder(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = None if shipped.value is None else Tagger(*shipped.value)
        for batch in slices(batches):
            _, bounds = text_buffers(batch.column("text"))
            rows = np.flatnonzero(np.diff(bounds))
            texts = batch.column("text").take(pa.array(rows)).to_pylist()
            base = [base_spans(t) if MAY_HOLD.search(t) else [] for t in texts]
            added = added_spans(tagger, texts, base) if tagger is not None else [[] for _ in texts]
            n = batch.num_rows
            counts = np.zeros((n, len(KINDS)), dtype=np.int64)
            base_text, all_text = [""] * n, [""] * n
            for row, own, more in zip(rows.tolist(), base, added, strict=True):
                for _, kind, _ in own:
                    counts[row, kind] += 1
                base_text[row], all_text[row] = joined(own), joined(sorted(own + more))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *[pa.array(counts[:, k].copy()) for k in range(len(KINDS))], pa.array(base_text, pa.string()), pa.array(all_text, pa.string())],
                names=[*kept, *[f"n_{k}" for k in KINDS], "base_spans", "spans"],
            )

    return run


def personal_data(documents: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (spans of the patterns), ``base_spans`` and ``spans``
    (those of the patterns and the tagger), as ``kind:start:end`` in code points. One pass, no shuffle.
    """
    # Shipped as a plain tuple: a broadcast class would be looked up by name on the executors.
    shipped = documents.sparkSession.sparkContext.broadcast(None if tagger is None else tuple(tagger))
    rows = documents.select("doc_id", "text")
    kinds = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInArrow(_finder(shipped), f"{ddl(rows, 'doc_id')}, {kinds}, base_spans string, spans string")


