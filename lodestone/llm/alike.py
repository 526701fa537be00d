"""Alike windows of one key: candidate pairs by prefix filters, verified by their best common interval.

A window is a row of 16-bit marks of shingles around a minimum, aligned so that
the minimum stands in one column; 0 stands for no shingle. Two windows are alike
if some interval of `width` shingles or more in one of them and one of the other
have a Jaccard similarity of `similarity` or more; they share `need` marks then.
An interval may begin and end with unlike shingles, as where a word near the end
of a passage was replaced; what is reported is cut to its equal ends.

All windows of many keys are dealt with at once by array operations:

1. Marks that no other window of the key has are blanked, and windows with
   fewer than `need` others left go: text around a shared line costs nothing.
2. Windows that are now equal are one pattern. They are alike among each other
   all or none, and alike to any other window all or none.
3. The key's consensus is the most frequent mark of each column. Of a pattern's
   S marks, those of the consensus last and else the rarest first, the first
   S - need + 1 are its prefix: patterns that share `need` marks have one in both
   prefixes. A pattern that is not alike to the consensus can't be alike to one
   with which it shares marks of the consensus only, so these go from its prefix:
   thousands of copies with many edits each do not meet each other.
4. Patterns meet at the marks of their prefixes; the one there that is nearest
   to the consensus is compared with all others whose documents aren't linked
   already, then goes, until one is left. A class of alike windows takes linear
   work.
"""

from __future__ import annotations

import bisect
import math

import numpy as np

from . import textscan as T

#: Pairs that are compared at once.
PAIRS = 1 << 14
#: Of them, pairs whose sums by column are held at once.
PIECE = 1 << 11
#: Pairs that are remembered as compared; beyond that some are compared again.
KNOWN = 1 << 21


def need_of(width: int, similarity: float) -> int:
    """Marks that alike windows share at least: those of an interval that lies whole in one of `width`."""
    return math.ceil(similarity * width - 1e-9)


def matrix(at: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray, marks: np.ndarray, width: int) -> np.ndarray:
    """Marks by row and column; the minimum is in column width - 1."""
    out = np.zeros((len(at), 2 * width - 1), np.uint16)
    row = np.repeat(np.arange(len(at)), size)
    column = T.gather_ragged(width - 1 - (at - first).astype(np.int64), size)
    out[row, column] = marks[T.gather_ragged(start, size)]
    return out


def aligned(x: np.ndarray, y: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of rows of marks: whether some interval of columns is alike, and the longest such one, cut to its equal ends."""
    n, m = x.shape
    if n > PIECE:
        parts = [aligned(x[i : i + PIECE], y[i : i + PIECE], width, similarity) for i in range(0, n, PIECE)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    ok, low, high = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return ok, low, high
    equal = (x > 0) & (x == y)
    # Of L columns c are equal: c >= s * (2 * L - c), or (1 + s) * c - 2 * s * L >= 0.
    sums = np.zeros((n, m + 1))
    np.cumsum((1 + similarity) * equal - 2 * similarity, axis=1, out=sums[:, 1:])
    begin, end = sums[:, :-1], sums[:, 1:]
    least = np.minimum.accumulate(begin, axis=1)
    ok = (end[:, width - 1 :] - least[:, : m - width + 1] >= -1e-9).any(axis=1)
    some = np.flatnonzero(ok)
    if not len(some):
        return ok, low, high
    begin, end, equal = begin[some], end[some], equal[some]
    best = np.zeros(len(some), np.int64)
    for a in range(m - width + 1):
        fits = end[:, a + width - 1 :] - begin[:, a : a + 1] >= -1e-9
        last = np.where(fits.any(axis=1), m - np.argmax(fits[:, ::-1], axis=1), 0)  # column after the last fitting one
        longer = last - a > best
        best[longer] = last[longer] - a
        low[some[longer]] = a
        high[some[longer]] = last[longer]
    columns = np.arange(m)
    inside = equal & (columns >= low[some, None]) & (columns < high[some, None])
    low[some], high[some] = np.argmax(inside, axis=1), m - np.argmax(inside[:, ::-1], axis=1)
    return ok, low, high


def _chain(at: np.ndarray) -> np.ndarray:
    """Places of a longest rising part of `at`."""
    if (at[1:] > at[:-1]).all():
        return np.arange(len(at))
    tops: list[int] = []
    ends: list[int] = []
    before = []
    for i, v in enumerate(at.tolist()):
        k = bisect.bisect_left(tops, v)
        before.append(ends[k - 1] if k else -1)
        tops[k : k + 1], ends[k : k + 1] = [v], [i]
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def shifted(x: np.ndarray, y: np.ndarray, width: int, similarity: float):
    """The longest alike interval of two rows whose columns may be shifted by inserted or deleted words: (first x, first y, size in x, size in y), or None."""
    place: dict[int, list[int]] = {}
    for j in np.flatnonzero(y).tolist():
        place.setdefault(int(y[j]), []).append(j)
    px, py = [], []
    for i in np.flatnonzero(x).tolist():
        found = place.get(int(x[i]))
        if found:
            px.append(i)
            py.append(min(found, key=lambda j: abs(j - i)))
    if not px:
        return None
    px, py = np.array(px), np.array(py)
    k = _chain(py)
    px, py = px[k], py[k]
    both = np.arange(1, len(px) + 1) - np.arange(len(px))[:, None]
    nx, ny = px - px[:, None] + 1, py - py[:, None] + 1
    # An interval that is too short takes in unlike words beside it.
    more = np.maximum(width - np.maximum(nx, ny), 0)
    ok = (both > 0) & (both >= similarity * (nx + ny + 2 * more - both) - 1e-9)
    if not ok.any():
        return None
    a, b = np.unravel_index(np.argmax(np.where(ok, nx + ny, 0)), ok.shape)
    return int(px[a]), int(py[a]), int(nx[a, b]), int(ny[a, b])


def may_shift(x: np.ndarray, y: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """For pairs of rows of marks: False where `shifted` finds nothing. All pairs at once; only those left need `shifted` itself.

    Rows whose matches rise are judged exactly; of others only the matches in x are counted.
    """
    n, need = len(x), need_of(width, similarity)
    if n > PIECE:
        return np.concatenate([may_shift(x[i : i + PIECE], y[i : i + PIECE], width, similarity) for i in range(0, n, PIECE)])
    ok = np.zeros(n, bool)
    of, i = np.nonzero(x)
    row_y, j = np.nonzero(y)
    # (row, mark, column) in one number; the nearest equal mark of y is beside that of x, the left one of ties.
    own = (of << 23) + (x[of, i].astype(np.int64) << 7) + i
    there = np.sort((row_y << 23) + (y[row_y, j].astype(np.int64) << 7) + j)
    if not len(own) or not len(there):
        return ok
    at = np.searchsorted(there, own)
    right, left = there[np.minimum(at, len(there) - 1)], there[np.maximum(at - 1, 0)]
    has_right, has_left = (at < len(there)) & (right >> 7 == own >> 7), (at > 0) & (left >> 7 == own >> 7)
    take = has_left & (~has_right | (own - left <= right - own))
    matched = has_left | has_right
    of, px, py = of[matched], i[matched], (np.where(take, left, right) & 127)[matched]
    count = np.bincount(of, minlength=n)
    place = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    most = int(count.max(initial=0))
    if most < need:
        return ok
    falls = np.zeros(n, bool)
    falls[of[1:][(of[1:] == of[:-1]) & (py[1:] <= py[:-1])]] = True
    wide_x, wide_y = np.full((n, most), -1, np.int64), np.full((n, most), -1, np.int64)
    wide_x[of, place], wide_y[of, place] = px, py
    for a in range(most - need + 1):
        left, right = slice(a, a + 1), slice(a + need - 1, None)
        both = np.arange(need, most - a + 1)
        nx, ny = wide_x[:, right] - wide_x[:, left] + 1, wide_y[:, right] - wide_y[:, left] + 1
        more = np.maximum(width - np.maximum(nx, ny), 0)
        fits = np.where(falls[:, None], both >= similarity * nx - 1e-9, both >= similarity * (nx + ny + 2 * more - both) - 1e-9)
        ok |= (fits & (wide_x[:, right] >= 0)).any(axis=1)
    return ok


def marks_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, token) of all marks; the k-th equal mark of a row is a token of its own."""
    row, column = np.nonzero(rows)
    token = rows[row, column].astype(np.int64) << 7
    ordered = np.sort(rows, axis=1)
    twice = ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] > 0)).any(axis=1)
    at = np.flatnonzero(twice[row])  # marks of the few rows in which one occurs again
    if len(at):
        at = at[np.argsort((row[at] << 23) + token[at], kind="stable")]
        new = np.ones(len(at), bool)
        new[1:] = (row[at][1:] != row[at][:-1]) | (token[at][1:] != token[at][:-1])
        place = np.arange(len(at))
        token[at] += place - np.maximum.accumulate(np.where(new, place, 0))
    return row, column, token


def _tokens(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, token, rows of the group that have it) of all marks; tokens are numbered by group."""
    row, column, token = marks_of(rows)
    token += group[row] << 23
    row, column = row.astype(np.int32), column.astype(np.int32)
    _, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
    inverse = inverse.astype(np.int32)
    return row, column, inverse, counts.astype(np.int32)[inverse]


class _Classes:
    """Classes of linked documents."""

    def __init__(self, label: np.ndarray):
        self.label, self.up = label, list(range(int(label.max()) + 1 if len(label) else 0))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(int(self.label[x])), self.root(int(self.label[y]))
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        up = np.array(self.up, np.int64)
        while True:
            now = up[up]
            if (now == up).all():
                break
            up = now
        return up[self.label]


def blank(group: np.ndarray, rows: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that share `need` marks or more with others of their group, and their marks without those that no other has."""
    alive, kept = np.arange(len(rows)), rows.copy()
    for _ in range(2):
        if not len(alive):
            break
        row, column, _, held = _tokens(group[alive], kept)
        lone = held == 1
        kept[row[lone], column[lone]] = 0
        full = (kept > 0).sum(axis=1) >= need
        alive, kept = alive[full], kept[full]
        if full.all():
            break
    return alive, kept


def pattern_hashes(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Equal for equal rows of marks of one group."""
    raw = np.concatenate([np.ascontiguousarray(group.astype(np.int64)).view(np.uint8).reshape(-1, 8), np.ascontiguousarray(rows).view(np.uint8)], axis=1)
    ends = np.arange(1, len(rows) + 1) * raw.shape[1]
    return T.hashes(raw.ravel(), ends - raw.shape[1], ends)


def links(group: np.ndarray, label: np.ndarray, rows: np.ndarray, width: int, similarity: float, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, other row, first column, first column in the other, size, size in the other), enough to connect all alike rows of a group; and open rows.

    group: numbers from 0; rows: marks as of `matrix`; label: rows of a group
    with one label are linked already and not compared with each other.
    rounds: stop after so many; the rows that may have links that are not yet
    found are the open ones.
    """
    need, nothing = need_of(width, similarity), np.zeros(0, np.int64)
    alive, kept = blank(group, rows, need)
    if not len(alive):
        return np.zeros((0, 6), np.int64), nothing
    group = group[alive]
    _, lead, pattern = np.unique(pattern_hashes(group, kept), return_index=True, return_inverse=True)
    _, label = np.unique(label[alive], return_inverse=True)
    classes = _Classes(np.unique(group.astype(np.int64) * (int(label.max()) + 1) + label, return_inverse=True)[1])
    # Rows of a pattern: if it is alike in itself, they are linked to the first one.
    rest = np.flatnonzero(lead[pattern] != np.arange(len(alive)))
    first = lead[pattern[rest]]
    ok, a, b = aligned(kept[first], kept[rest], width, similarity)
    whole = np.zeros(len(lead), bool)
    whole[pattern[rest[ok]]] = True
    found = [(x, y, c, c, n, n) for x, y, c, n in zip(first[ok].tolist(), rest[ok].tolist(), a[ok].tolist(), (b - a)[ok].tolist(), strict=True) if classes.join(x, y)]
    # If not, what one row of it is linked to, all are.
    several = np.bincount(pattern, minlength=len(lead)) > 1
    loose = np.flatnonzero(several & ~whole)
    members = {int(p): np.flatnonzero(pattern == p).tolist() for p in loose} if len(loose) < 50 else {}
    if len(loose) >= 50:
        order = np.argsort(pattern, kind="stable")
        edge = np.searchsorted(pattern[order], loose)
        stop = np.searchsorted(pattern[order], loose, "right")
        members = {int(p): order[i:j].tolist() for p, i, j in zip(loose, edge, stop, strict=True)}
    own = np.sort(lead)
    for x, y, *place in _between(group[own], kept[own], own, classes, need, width, similarity, rounds):
        found.append((x, y, *place))
        more = [(z, y) for z in members.get(int(pattern[x]), ()) if z != x] + [(x, z) for z in members.get(int(pattern[y]), ()) if z != y]
        found.extend((u, v, *place) for u, v in more if classes.join(u, v))
    out = np.array(found, np.int64).reshape(-1, 6)
    out[:, 0], out[:, 1] = alive[out[:, 0]], alive[out[:, 1]]
    if rounds is None:
        return out, nothing
    # Open: rows of groups that are not one class.
    root, n = classes.roots(), int(group.max()) + 1
    low, high = np.full(n, len(root)), np.full(n, -1)
    np.minimum.at(low, group, root)
    np.maximum.at(high, group, root)
    return out, alive[(low < high)[group]]


def _prefixes(group: np.ndarray, rows: np.ndarray, need: int, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the patterns' prefixes, by token, those nearest to the consensus first.

    A large key has millions of marks: what is known of each goes on return, before pairs are compared.
    """
    row, column, token, held = _tokens(group, rows)
    both = held > 1
    row, column, token, held = row[both], column[both], token[both], held[both]
    if not len(row):
        return row, token
    # Where is the consensus: the most frequent mark of each column of a group.
    mark, cell = rows[row, column].astype(np.int64), group[row] * rows.shape[1] + column
    kind, count = np.unique((cell << 16) + mark, return_counts=True)
    order = np.lexsort((-count, kind >> 16))
    _, top = np.unique(kind[order] >> 16, return_index=True)
    usual = np.zeros((int(group.max()) + 1) * rows.shape[1], np.uint16)
    usual[kind[order][top] >> 16] = kind[order][top] & 0xFFFF
    usual = usual.reshape(-1, rows.shape[1])[group]
    common = rows[row, column] == usual[row, column]
    near = ((rows == usual) & (rows > 0)).sum(axis=1)
    like = np.zeros(len(rows), bool)
    some = np.flatnonzero(near >= need)
    for i in range(0, len(some), PAIRS):
        like[some[i : i + PAIRS]] = aligned(rows[some[i : i + PAIRS]], usual[some[i : i + PAIRS]], width, similarity)[0]
    order = np.lexsort((token, held, common, row))
    row, token, common = row[order], token[order], common[order]
    count = np.bincount(row, minlength=len(rows))
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    prefix = (place < (count - need + 1)[row]) & (like[row] | ~common)
    row, token = row[prefix], token[prefix]
    order = np.lexsort((row, -near[row], token))
    return row[order], token[order]


def _between(group: np.ndarray, rows: np.ndarray, own: np.ndarray, classes: _Classes, need: int, width: int, similarity: float, rounds: int | None):
    """Links between patterns, numbered by `own`; classes are joined."""
    row, token = _prefixes(group, rows, need, width, similarity)
    done, turn = np.zeros(0, np.int64), 0
    while len(row) and (rounds is None or turn < rounds):
        turn += 1
        root = classes.roots()[own[row]]
        head = np.ones(len(row), bool)
        head[1:] = token[1:] != token[:-1]
        starts = np.flatnonzero(head)
        of = np.cumsum(head) - 1
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        go = mixed[of]
        if not go.any():
            return
        row, token, head, root, of = row[go], token[go], head[go], root[go], of[go]
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        pair = np.flatnonzero(~head & (root != root[first]))
        # Sorts, as the sets of numpy hash and then sort as well.
        code = np.sort((row[first[pair]].astype(np.int64) << 32) + row[pair])
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        if len(done):
            new &= done[np.minimum(np.searchsorted(done, code), len(done) - 1)] != code
        code = code[new]
        done = np.sort(np.concatenate([done, code]), kind="stable") if len(done) + len(code) <= KNOWN else code
        for i in range(0, len(code), PAIRS):
            yield from _verify(code[i : i + PAIRS] >> 32, code[i : i + PAIRS] & 0xFFFFFFFF, rows, own, classes, need, width, similarity)
        row, token = row[~head], token[~head]


def _verify(x: np.ndarray, y: np.ndarray, rows: np.ndarray, own: np.ndarray, classes: _Classes, need: int, width: int, similarity: float) -> list[tuple]:
    left, right = rows[x], rows[y]
    equal = ((left == right) & (left > 0)).sum(axis=1)
    near = np.flatnonzero(equal >= need)
    good, a, b = aligned(left[near], right[near], width, similarity)
    out = []
    for i in np.flatnonzero(good).tolist():
        u, v = int(own[x[near[i]]]), int(own[y[near[i]]])
        if classes.join(u, v):
            out.append((u, v, int(a[i]), int(a[i]), int(b[i] - a[i]), int(b[i] - a[i])))
    # Of the others only those that share marks in other columns can be alike.
    roots = classes.roots()
    rest = np.flatnonzero(roots[own[x]] != roots[own[y]])
    every = np.sort(np.concatenate([left[rest], right[rest]], axis=1), axis=1)
    shared = ((every[:, 1:] == every[:, :-1]) & (every[:, 1:] > 0)).sum(axis=1)
    rest = rest[(shared >= need) & (shared > equal[rest])]
    for i in rest[may_shift(left[rest], right[rest], width, similarity)].tolist():
        u, v = int(own[x[i]]), int(own[y[i]])
        if classes.root(int(classes.label[u])) == classes.root(int(classes.label[v])):
            continue
        best = shifted(left[i], right[i], width, similarity)
        if best is not None and classes.join(u, v):
            out.append((u, v, *best))
    return out
