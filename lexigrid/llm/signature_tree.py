"""Signature trees over shingle sets: nodes hold OR-combined bitmaps and size ranges; a dual traversal finds the pairs that link."""

from __future__ import annotations

import numpy as np

FAN_OUT = 8
#: Bits of a bitmap for each element of a node of FAN_OUT sets; bytes of all leaves' bitmaps, and of those compared at a time.
PER_ELEMENT, LEAF_BYTES, STEP_BYTES = 16, 1 << 25, 1 << 24


def _order(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """Sets of like size by their smallest hashes, so that like sets, which mostly share these, stand together."""
    width = np.log(den / num) if num < den else 1.0
    return sorted(range(len(sets)), key=lambda k: (int(np.log(max(1, len(sets[k]))) / width), sets[k][:4].tolist(), len(sets[k])))


class Tree:
    """levels, leaves first: bitmaps of all hashes below a node, the smallest and largest size, and the largest number of a set's elements
    that have no bit of their own."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        self.sets, size = sets, np.array([len(s) for s in sets])
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(maps, sets, strict=True):
            at = np.unique(s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        excess = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, excess)]
        while len(self.levels[-1][0]) > 1:
            m, low, high, excess = self.levels[-1]
            cut = np.arange(0, len(m), FAN_OUT)
            least, most = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((np.bitwise_or.reduceat(m, cut), least(low, cut), most(high, cut), most(excess, cut)))


def may_link(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of nodes may hold two sets that link.

    Two sets of x and y elements link if overlap * (den + num) >= num * (x + y). Their overlap has its bits in both bitmaps, one bit an element
    but for the elements without one of their own; and it is no larger than either set.
    """
    (_, low_a, high_a, ex_a), (_, low_b, high_b, ex_b) = a, b
    ok = (np.minimum(high_a[i], high_b[j]) * den >= num * np.maximum(low_a[i], low_b[j])) & (high_a[i] > 0) & (high_b[j] > 0)
    at = np.flatnonzero(ok)
    step = max(1, STEP_BYTES // (8 * a[0].shape[1]))
    for k in range(0, len(at), step):
        s = at[k : k + step]
        p, q = i[s], j[s]
        shared = np.bitwise_count(a[0][p] & b[0][q]).sum(axis=1, dtype=np.int64) + np.minimum(ex_a[p], ex_b[q])
        most = np.minimum(shared, np.minimum(high_a[p], high_b[q]))
        ok[s] = most * (den + num) >= num * (low_a[p] + low_b[q])
    return ok


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * den >= num * (len(x) + len(y) - both)


def _ends(of: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest component below each node of a level."""
    cut = np.arange(0, len(of), FAN_OUT**level)
    return np.minimum.reduceat(of, cut), np.maximum.reduceat(of, cut)


def linked(
    left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int, groups: np.ndarray | None = None, seen: dict | None = None
) -> list[tuple[int, int]]:
    """Links that, with those known, span the same components as all links between left and right (right None: within left), as
    (place in left, in left + right). groups: each set's component as known, -1 if none.

    Dual traversal from the roots; node pairs that no overlap can save are dropped, and so are those whose sets are one component
    already. Every pair of leaves that stays is decided on the whole sets. seen counts node pairs ("nodes") and leaf pairs decided ("leaves").
    """
    own = right is None
    sets = left + ([] if own else right)
    if not left or (not own and not right):
        return []
    need = PER_ELEMENT * FAN_OUT * sum(len(s) for s in sets) / len(sets)
    most = max(64, 8 * LEAF_BYTES // len(sets))
    bits = 1 << int(min(np.ceil(np.log2(max(64, need))), np.floor(np.log2(most))))
    at_a = np.array(_order(left, num, den))
    a = Tree([left[k] for k in at_a], bits)
    at_b, b = at_a, a
    if not own:
        at_b = len(left) + np.array(_order(right, num, den))
        b = Tree([sets[k] for k in at_b], bits)
    part = np.arange(len(sets))  # each set's component: the first of its places
    if groups is not None:
        _, place, which = np.unique(groups, return_index=True, return_inverse=True)
        part = np.where(groups >= 0, place[which], part)
    out: list[tuple[int, int]] = []
    seen = {} if seen is None else seen
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.array([0]), np.array([0]))]
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > 4096:  # depth first in pieces, so that memory stays small
            stack += [(la, lb, i[k : k + 4096], j[k : k + 4096]) for k in range(0, len(i), 4096)][::-1]
            continue
        (p_low, p_high), (q_low, q_high) = _ends(part[at_a], la), _ends(part[at_b], lb)
        open_ = (p_low[i] != p_high[i]) | (q_low[j] != q_high[j]) | (p_low[i] != q_low[j])
        i, j = i[open_], j[open_]
        seen["nodes"] = seen.get("nodes", 0) + len(i)
        ok = may_link(a.levels[la], b.levels[lb], i, j, num, den)
        i, j = i[ok], j[ok]
        if la == lb == 0:
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                x, y = int(at_a[p]), int(at_b[q])
                if part[x] == part[y]:
                    continue
                seen["leaves"] = seen.get("leaves", 0) + 1
                if similar(a.sets[p], b.sets[q], num, den):
                    part[part == max(part[x], part[y])] = min(part[x], part[y])
                    out.append((x, y))
            continue
        if la >= lb and la:
            i, j = (i[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel(), np.repeat(j, FAN_OUT)
            keep, la = i < len(a.levels[la - 1][0]), la - 1
        else:
            i, j = np.repeat(i, FAN_OUT), (j[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            keep, lb = j < len(b.levels[lb - 1][0]), lb - 1
        if own:  # of a symmetric pair, the one that stands first
            keep &= i * FAN_OUT**la <= (j + 1) * FAN_OUT**lb - 1
        if keep.any():
            stack.append((la, lb, i[keep], j[keep]))
    return out
