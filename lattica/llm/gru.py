"""A gated recurrent language model in numpy, with a class-factored output.

The vocabulary is a list of words, in classes of near equal frequency mass, and one or more classes for all other words. P(word) =
P(class | state) * P(word in class | state) for listed words; P(class | state) for the rest, whose place within their class is left to the
caller's smoothed counts. Each other class has an input of its own, as each listed word has.
"""

from __future__ import annotations

import numpy as np


def classes(counts: np.ndarray, n: int) -> np.ndarray:
    """Bounds of n classes (or fewer) of near equal mass over words sorted by count."""
    mass = np.cumsum(counts) / max(counts.sum(), 1)
    cut = np.searchsorted(mass, np.arange(1, n) / n) + 1
    return np.unique(np.concatenate([[0], cut[cut < len(counts)], [len(counts)]]))


#: Rows whose classes are worked out at once, in a processor's cache.
ROWS = 1024


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Overwrites x."""
    x -= x.max(axis=1, keepdims=True)
    out = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return out - np.log(x.sum(axis=1))


class Gru:
    """counts: of the listed words, most frequent first; other: count of all other words' tokens, or of each class of them."""

    def __init__(self, counts: np.ndarray, other: int | np.ndarray, hidden: int = 32, n_classes: int = 32, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.k, self.h = len(counts), hidden
        self.bounds = classes(counts, n_classes)
        self.n_classes = len(self.bounds) - 1
        others = np.atleast_1d(other)
        self.class_of = np.append(np.repeat(np.arange(self.n_classes), np.diff(self.bounds)), self.n_classes + np.arange(len(others))).astype(np.int64)
        f = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(s[0])).astype(np.float32)
        mass = np.array([counts[a:b].sum() for a, b in zip(self.bounds, self.bounds[1:], strict=False)] + [*others], dtype=float)
        self.p = {
            "e": (rng.standard_normal((self.k + len(others), 3 * hidden)) * 0.2).astype(np.float32), "b": np.zeros(3 * hidden, np.float32),
            "u": f(hidden, 3 * hidden), "wc": f(hidden, self.n_classes + len(others)), "bc": np.log(mass + 1).astype(np.float32),
            "wo": (rng.standard_normal((self.k, hidden)) * 0.05).astype(np.float32), "bo": np.log(counts + 1.0).astype(np.float32),
        }

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, n = self.p, self.h
        a = p["e"][x] + p["b"]
        g = h @ p["u"]
        zr = 1 / (1 + np.exp(-(a[:, : 2 * n] + g[:, : 2 * n])))
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
        return c + z * (h - c), (x, h, z, r, c, g[:, 2 * n :])

    def log_prob(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of P(y | state), row by row; y = k + j stands for any word of the other class j."""
        p, cls = self.p, self.class_of[y]
        out = np.concatenate([_log_softmax_at(states[a : a + ROWS] @ p["wc"] + p["bc"], cls[a : a + ROWS]) for a in range(0, max(len(y), 1), ROWS)])
        for rows, a, b in self._by_class(cls):
            if b - a > 1:
                out[rows] += _log_softmax_at(states[rows] @ p["wo"][a:b].T + p["bo"][a:b], y[rows] - a)
        return out

    def _by_class(self, cls: np.ndarray):
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(self.n_classes + 1))
        for c in range(self.n_classes):
            if ends[c + 1] > ends[c]:
                yield order[ends[c] : ends[c + 1]], self.bounds[c], self.bounds[c + 1]

    def fit(self, docs: list[np.ndarray], passes: int = 1, end: int = 0, seed: int = 5, **how) -> None:
        """Fits all weights on `docs` here."""
        trainer, rng = Trainer(self, end, **how), np.random.default_rng(seed)
        for k in range(passes):
            trainer.feed([docs[i] for i in rng.permutation(len(docs))], (k + 0.5) / passes)

    def _window(self, x: np.ndarray, h: np.ndarray, end: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        grads, rows, h = self._gradients(x, h, end)
        e = np.zeros_like(self.p["e"])
        e[rows] = grads["e"]
        return grads | {"e": e}, h

    def _gradients(self, x: np.ndarray, h: np.ndarray, end: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of a window's mean loss, of "e" only for the rows that it reads; those rows; the state after it."""
        p, n, steps = self.p, self.h, x.shape[1]
        states, kept = [], []
        for t in range(steps):
            states.append(h)
            h, back = self.step(x[:, t], h)
            live = (x[:, t] != end).astype(np.float32)[:, None]
            h = h * live
            kept.append((back, live))
        r_all, y = np.concatenate(states), x.T.ravel()
        cls = self.class_of[y]
        grads = {k: np.zeros_like(v) for k, v in p.items() if k != "e"}
        d_all, back_wc = np.empty_like(r_all), np.ascontiguousarray(p["wc"].T) / len(y)
        for at in range(0, len(y), ROWS):
            r = r_all[at : at + ROWS]
            d = _softmax(r @ p["wc"] + p["bc"])
            d[np.arange(len(d)), cls[at : at + ROWS]] -= 1
            grads["wc"] += r.T @ d
            grads["bc"] += d.sum(axis=0)
            d_all[at : at + ROWS] = d @ back_wc
        for k in ("wc", "bc"):
            grads[k] /= len(y)
        for rows, a, b in self._by_class(cls):
            if b - a > 1:
                r = r_all[rows]
                q = _softmax(r @ p["wo"][a:b].T + p["bo"][a:b])
                q[np.arange(len(rows)), y[rows] - a] -= 1
                r /= len(y)
                grads["wo"][a:b] = q.T @ r
                grads["bo"][a:b] = q.sum(axis=0) / len(y)
                d_all[rows] += q @ (p["wo"][a:b] / len(y))
        d_all = d_all.reshape(steps, -1, n)
        dh, inputs = np.zeros_like(h), []
        for t in range(steps - 1, -1, -1):
            (xt, h0, z, r, c, gn), live = kept[t]
            dh = dh * live
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h0 - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            dg = np.concatenate([dz, dr, dc * r], axis=1)
            inputs.append(da)
            grads["b"] += da.sum(axis=0)
            grads["u"] += h0.T @ dg
            dh = dh * z + dg @ p["u"].T + d_all[t]
        xs = x[:, ::-1].T.ravel()
        order = np.argsort(xs, kind="stable")
        starts = np.flatnonzero(np.diff(xs[order], prepend=-1))
        grads["e"] = np.add.reduceat(np.concatenate(inputs)[order], starts, axis=0)
        return grads, xs[order][starts], h

    def score(self, docs: list[np.ndarray], window: int = 64) -> np.ndarray:
        """Natural log of each document's probability. The state is carried across windows to a document's end;
        documents go in order of length, so that those still running stand together."""
        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lens = np.array([len(docs[i]) for i in order])
        h = np.zeros((len(docs), self.h), np.float32)
        for at in range(0, int(lens.max(initial=0)), window):
            n = int((lens > at).sum())
            x = np.zeros((n, window), np.int64)
            for j in range(n):
                part = docs[order[j]][at : at + window]
                x[j, : len(part)] = part
            states, rows = [], []
            for t in range(min(window, int(lens[0]) - at)):
                live = int((lens > at + t).sum())
                states.append(h[:live])
                rows.append(live)
                h = self.step(x[:live, t], h[:live])[0]
            logs = self.log_prob(np.concatenate(states), np.concatenate([x[:r, t] for t, r in enumerate(rows)]))
            ends = np.concatenate([[0], np.cumsum(rows)])
            for t, r in enumerate(rows):
                out[:r] += logs[ends[t] : ends[t + 1]]
        result = np.zeros(len(docs))
        result[order] = out
        return result


class Trainer:
    """Truncated backpropagation through time with Adam. Documents follow one another in streams; the state is carried across windows and
    cleared after each `end`. There are as many streams as leave some `updates` windows in what is fed at once. Outputs of a class, whose words are about
as frequent as each other, share their second moment: rare words would else drift by a whole step in each window that they aren't in."""

    def __init__(self, model: Gru, end: int = 0, window: int = 32, streams: int = 256, updates: int = 50, rate: float = 1e-2) -> None:
        self.model, self.end, self.window, self.streams, self.updates, self.rate = model, end, window, streams, updates, rate
        self.m = {k: np.zeros_like(w) for k, w in model.p.items()}
        self.v = {k: np.zeros(model.n_classes, np.float32) if k in ("wo", "bo") else np.zeros_like(w) for k, w in model.p.items()}
        self.t = 0

    def feed(self, docs: list[np.ndarray], done: float = 0.0) -> None:
        """`done`: the share of all training that is over; the rate falls with it."""
        flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        if not len(flat):
            return
        s = min(self.streams, max(1, min(len(flat) // self.window, max(16, len(flat) // (self.window * self.updates)))))
        steps = len(flat) // s
        lanes, rest = flat[: steps * s].reshape(s, steps), flat[steps * s :]
        self._over(lanes, done)
        if len(rest):
            self._over(rest[None, :], done)

    def _over(self, lanes: np.ndarray, done: float) -> None:
        h = np.zeros((len(lanes), self.model.h), np.float32)
        for at in range(0, lanes.shape[1], self.window):
            grads, seen, h = self.model._gradients(lanes[:, at : at + self.window], h, self.end)
            self.t += 1
            norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
            less, step = min(1.0, 1.0 / (norm + 1e-12)), self.rate * max(0.1, 1 - done) / (1 - 0.9**self.t)
            for k, g in grads.items():
                rows = seen if k == "e" else slice(None)  # words that a window doesn't read stay as they are
                m, v = self.m[k][rows], self.v[k][rows]
                v += 0.01 * (less * less * (self._mean_squares(g) if k in ("wo", "bo") else g * g) - v)
                g *= 0.1 * less
                m *= 0.9
                m += g
                if k == "e":
                    self.m[k][rows], self.v[k][rows] = m, v
                scale = step / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
                if k in ("wo", "bo"):
                    scale = np.repeat(scale, np.diff(self.model.bounds)).astype(np.float32)
                    scale = scale[:, None] if k == "wo" else scale
                self.model.p[k][rows] -= np.multiply(m, scale, out=g)

    def _mean_squares(self, g: np.ndarray) -> np.ndarray:
        """Of the rows of each class of listed words."""
        own = np.einsum("ij,ij->i", g, g) / g.shape[1] if g.ndim == 2 else g * g
        return np.add.reduceat(own, self.model.bounds[:-1]) / np.diff(self.model.bounds)
