"""A gated recurrent language model in numpy: truncated backpropagation, and an output softmax factored by classes."""

from __future__ import annotations

import numpy as np

#: Units; streams that run side by side in training, and steps of a window; Adam's rate.
HIDDEN, STREAMS, STEPS, RATE = 24, 1024, 16, 0.004
UNKNOWN, END = 0, 1
#: Rows of a group from which it is summed by itself.
LONG = 16


def class_edges(size: int) -> np.ndarray:
    """Where each class of `size` outcomes begins, and the end. Outcomes stand by falling frequency, so classes widen: the frequent ones,
    which most steps need, are the narrow ones."""
    n = max(2, int(np.sqrt(size) / 2))
    return np.unique(np.concatenate([[0], np.round(size * (np.arange(1, n + 1) / n) ** 2).astype(np.int64)]))


def shapes(size: int) -> list[tuple[int, ...]]:
    """Of the weights of a network of `size` outcomes."""
    h, classes = HIDDEN, len(class_edges(size)) - 1
    return [(size + 1, 3 * h), (h, 2 * h), (h, h), (h, classes), (classes,), (size, h), (size,)]


def _by_part(w: np.ndarray, parts: int) -> np.ndarray:
    """Weights whose columns are those of `parts` parts, as an array for each part."""
    return np.ascontiguousarray(w.reshape(len(w), parts, -1).transpose(1, 0, 2))


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """np.add.reduceat(rows, first, axis=0), which walks down columns, row by row: long groups each at once, short ones side by side."""
    count = np.diff(np.append(first, len(rows)))
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    ones = np.ones(int(count.max()), rows.dtype)
    for i in np.flatnonzero(count > LONG):
        np.matmul(ones[: count[i]], rows[first[i] : first[i] + count[i]], out=out[i])
    short = np.flatnonzero(count <= LONG)
    short = short[np.argsort(-count[short], kind="stable")]
    total = rows[first[short]]
    for k in range(1, int(count[short[0]]) if len(short) else 0):
        m = int(np.searchsorted(-count[short], -k))
        total[:m] += rows[first[short[:m]] + k]
    out[short] = total
    return out


class Network:
    """h' = (1 - z) h + z tanh(a + U(r h)) with gates z and r; P(word) = P(class) P(word within its class).

    weights: what each word gives to the gates and the state, with one row more for a document's start; the state's own part of the
    gates, and of the new state; classes and their biases; words and their biases.
    """

    def __init__(self, counts: np.ndarray | None = None, weights: list[np.ndarray] | None = None) -> None:
        if weights is None:
            weights = self._initial(counts)
        self.weights = weights
        #: The id given before a document's first word.
        self.start = len(weights[0]) - 1
        self.edges = class_edges(self.start)
        self.class_of = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges)).astype(np.int16)
        self.moments: list | None = None
        self.t = 0

    @staticmethod
    def _initial(counts: np.ndarray) -> list[np.ndarray]:
        """Small random weights; biases that give each word its share of the counts."""
        rng, edges = np.random.default_rng(7), class_edges(len(counts))
        share = (counts + 1.0) / (counts + 1.0).sum()
        of_class = np.add.reduceat(share, edges[:-1])
        within = share / np.repeat(of_class, np.diff(edges))
        table, gates, own, cw, _, ww, _ = ((rng.standard_normal(s) * 0.1).astype(np.float32) for s in shapes(len(counts)))
        return [table, gates, own, cw, np.log(of_class).astype(np.float32), ww, np.log(within).astype(np.float32)]

    def window(self, h, given, fresh, target, real, learn: bool):
        """A window of (steps, streams): the last state, the natural log-probability of each target, and with learn the gradients.

        fresh: a document starts here; real: a step that counts. Gradients are of the summed negative log-probability, as a list
        of (index, values) beside the weights; of words' rows and classes only those in the window.
        """
        x, h, kept = self._states(h, given, fresh, learn)
        y = target.ravel()
        alive = np.flatnonzero(real.ravel())
        order = alive[np.argsort(self.class_of[y[alive]], kind="stable")]
        score, dx, grads = self._outcomes(np.take(x, order, axis=0), y[order], learn)
        out = np.zeros(y.size, x.dtype)
        out[order] = score
        if learn:
            every = np.zeros_like(x)
            every[order] = dx
            grads = self._back(kept, given, fresh, every.reshape(*given.shape, HIDDEN)) + grads
        return h, out.reshape(target.shape), grads

    def _states(self, h, given, fresh, learn: bool):
        """The states; each step's arrays are (part, streams, units), parts z, r and the new state, so that all that is done to one runs over
        memory in order."""
        table, gates, own, *_ = self.weights
        k, kept = HIDDEN, []
        words, at = _by_part(table, 3).reshape(-1, k), given[:, None] + len(table) * np.arange(3)[:, None]
        minus = -_by_part(gates, 2)
        states, a = np.empty((*given.shape, k), table.dtype), np.empty((3, given.shape[1], k), table.dtype)
        for t in range(len(given)):
            old = np.where(fresh[t][:, None], a.dtype.type(0), h) if fresh[t].any() else h
            np.take(words, at[t], axis=0, out=a, mode="clip")
            g = old @ minus
            g -= a[:2]
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            c = (g[1] * old) @ own
            c += a[2]
            np.tanh(c, out=c)
            h = states[t]
            np.subtract(c, old, out=h)
            h *= g[0]
            h += old
            if learn:
                kept.append((old, g, c))
        return states.reshape(-1, k), h, kept

    @staticmethod
    def _softmax(logits: np.ndarray, hit: np.ndarray, learn: bool) -> np.ndarray:
        """The log-probability of each column's row `hit`; columns of logits change in place, with learn to probabilities."""
        logits -= logits.max(axis=0)
        score = logits[hit, np.arange(len(hit))]
        np.exp(logits, out=logits)
        total = logits.sum(axis=0)
        if learn:
            logits /= total
        return score - np.log(total)

    def _outcomes(self, x: np.ndarray, y: np.ndarray, learn: bool):
        """Log-probabilities of outcomes y, sorted by class, in states x; with learn the gradients of x, classes and words."""
        *_, cw, cb, ww, wb = self.weights
        xt, cls = np.ascontiguousarray(x.T), self.class_of[y]
        dx, grads = None, None
        p = cw.T @ xt
        p += cb[:, None]
        score = self._softmax(p, cls, learn)
        if learn:
            p[cls, np.arange(len(y))] -= 1
            dx = p.T @ cw.T
            dww, dwb = np.zeros_like(ww), np.zeros_like(wb)
            grads = [(slice(None), (p @ x).T), (slice(None), p.sum(axis=1))]
        ends = np.searchsorted(cls, np.arange(len(self.edges)))
        for i in np.flatnonzero(np.diff(ends)):
            s, of = slice(ends[i], ends[i + 1]), slice(self.edges[i], self.edges[i + 1])
            w, hit = ww[of], y[s] - of.start
            q = w @ xt[:, s]
            q += wb[of, None]
            score[s] += self._softmax(q, hit, learn)
            if learn:
                q[hit, np.arange(len(hit))] -= 1
                dww[of], dwb[of] = q @ x[s], q.sum(axis=1)
                dx[s] += q.T @ w
        if learn:
            met = np.flatnonzero(np.diff(ends)[np.searchsorted(self.edges, np.arange(len(wb)), side="right") - 1])
            at = slice(None) if len(met) == len(wb) else met
            grads += [(at, dww[at]), (at, dwb[at])]
        return score, dx, grads

    def _back(self, kept: list, given: np.ndarray, fresh: np.ndarray, every: np.ndarray) -> list:
        """Backward through the window's steps, from the states' gradients."""
        _, gates, own, *_ = self.weights
        k, n = HIDDEN, given.shape[1]
        apart = _by_part(gates, 2)
        dgates, down, da = np.zeros_like(apart), np.zeros_like(own), np.empty((len(given), 3, n, k), every.dtype)
        dh = np.zeros_like(every[0])
        for t in range(len(given) - 1, -1, -1):
            old, g, c = kept[t]
            dh += every[t]
            new, dc, dg = dh * g[0], da[t, 2], da[t, :2]
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= new
            drh = dc @ own.T
            down += (g[1] * old).T @ dc
            np.subtract(c, old, out=dg[0])
            dg[0] *= dh
            np.multiply(drh, old, out=dg[1])
            dg *= g
            dg -= dg * g
            dgates += old.T @ dg
            dh -= new
            drh *= g[1]
            dh += drh
            dh += dg[0] @ apart[0].T
            dh += dg[1] @ apart[1].T
            if fresh[t].any():
                dh[fresh[t]] = 0
        ids = given.ravel()
        o = np.argsort(ids.astype(np.uint16) if self.start < 1 << 16 else ids, kind="stable")  # 16 bits are sorted by radix
        first = np.concatenate([[0], np.flatnonzero(np.diff(ids[o])) + 1])
        rows = np.take(da.reshape(-1, k), (o // n * 3 * n + o % n)[:, None] + n * np.arange(3), axis=0).reshape(-1, 3 * k)
        dgates = np.concatenate([*dgates], axis=1)
        return [(ids[o[first]], _sums(rows, first)), (slice(None), dgates), (slice(None), down)]

    def step(self, grads: list, n: int) -> None:
        """One step of Adam down the gradients of n outcomes' mean; rows without a gradient stay."""
        if self.moments is None:
            self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        self.t += 1
        rate = np.float32(RATE * np.sqrt(1 - 0.995**self.t) / (1 - 0.9**self.t))
        scale = np.float32(1 / n)
        for w, (at, g), (m, v) in zip(self.weights, grads, self.moments, strict=True):
            g *= scale
            some = not isinstance(at, slice)
            new_m, new_v = (m[at], v[at]) if some else (m, v)
            new_m *= np.float32(0.9)
            new_m += np.float32(0.1) * g
            new_v *= np.float32(0.995)
            g *= g
            g *= np.float32(0.005)
            new_v += g
            if some:
                m[at], v[at] = new_m, new_v
            root = np.sqrt(new_v)
            root += np.float32(1e-7)
            np.divide(new_m, root, out=root)
            root *= rate
            w[at] -= root


def _given(net: Network, target: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each target, and where documents start."""
    given, fresh = np.empty(len(target), np.int32), np.zeros(len(target), bool)
    given[1:] = target[:-1]
    given[first], fresh[first] = net.start, True
    return given, fresh


def taught(net: Network, docs: list[np.ndarray]) -> None:
    """One pass of truncated backpropagation: the documents (ids, END last) one after another, cut into streams of equal length."""
    if not docs:
        return
    target = np.concatenate(docs).astype(np.int32)
    given, fresh = _given(net, target, np.cumsum([0] + [len(d) for d in docs[:-1]]))
    n = max(1, min(STREAMS, len(target) // STEPS))
    steps = -(-len(target) // n)
    real = np.arange(n * steps) < len(target)
    target, given, fresh = (np.pad(x, (0, n * steps - len(x))) for x in (target, given, fresh))
    target, given, fresh, real = (np.ascontiguousarray(x.reshape(n, steps).T) for x in (target, given, fresh, real))
    h = np.zeros((n, HIDDEN), net.weights[0].dtype)
    for at in range(0, steps, STEPS):
        w = slice(at, at + STEPS)
        h, _, grads = net.window(h, given[w], fresh[w], target[w], real[w], True)
        net.step(grads, int(real[w].sum()))


def scored(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Each document's (ids, END last) log-probability, natural. The state goes from window to window and starts anew with each document.

    Documents fill streams evenly, longest first; streams run side by side, those that have ended drop out, and the fewer run, the
    longer a window is. Memory follows the tokens, not the longest stream.
    """
    if not docs:
        return np.zeros(0)
    lengths = np.array([len(d) for d in docs])
    order = np.argsort(-lengths, kind="stable")
    n = int(max(1, min(len(docs), 2 * STREAMS, max(64, lengths.sum() // lengths.max()))))
    fill, streams = np.zeros(n, np.int64), [[] for _ in range(n)]
    for start in range(0, len(order), n):
        at = np.argsort(fill, kind="stable")
        for s, d in zip(at, order[start : start + n], strict=False):
            streams[s].append(d)
            fill[s] += lengths[d]
    by = np.argsort(-fill, kind="stable")
    fill, line = fill[by], [d for s in by for d in streams[s]]
    target = np.concatenate([docs[d] for d in line]).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(lengths[line])[:-1]])
    given, fresh = _given(net, target, first)
    begin = np.concatenate([[0], np.cumsum(fill)[:-1]])
    scores, h, at = np.zeros(len(target)), np.zeros((n, HIDDEN), net.weights[0].dtype), 0
    while at < fill[0]:
        m = int((fill > at).sum())
        step = np.arange(at, min(int(fill[0]), at + max(STEPS, STEPS * STREAMS // m)))
        real = step[:, None] < fill[None, :m]
        place = np.where(real, begin[None, :m] + step[:, None], begin[None, :m])
        h, score, _ = net.window(h[:m], given[place], fresh[place] & real, target[place], real, False)
        scores[place[real]] = score[real]
        at = int(step[-1]) + 1
    total = np.zeros(len(docs))
    total[line] = np.add.reduceat(scores, first)
    return total
