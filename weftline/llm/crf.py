"""A linear-chain conditional random field in numpy: training by gradient, decoding by Viterbi over padded batches."""

from __future__ import annotations

import numpy as np


class Crf:
    """Weights ``w`` (features x labels; row 0 is the absent feature), transitions ``t``, start scores ``s``."""

    def __init__(self, n_features: int, labels: list[str]):
        self.labels = labels
        k = len(labels)
        self.w = np.zeros((n_features, k), np.float32)
        self.t = np.zeros((k, k), np.float32)
        self.s = np.zeros(k, np.float32)
        # an inside label follows only its own beginning or inside
        self.forbid = np.array([[b[0] == "I" and a[1:] != b[1:] for b in labels] for a in labels])
        self.bar = np.array([b[0] == "I" for b in labels])
        self.t[self.forbid] = -1e4
        self.s[self.bar] = -1e4

    def emissions(self, x: np.ndarray) -> np.ndarray:
        out = self.w[x[:, 0]]
        for j in range(1, x.shape[1]):
            out += self.w[x[:, j]]
        return out

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int = 6, batch: int = 64, rate: float = 0.25, l2: float = 1e-5, seed: int = 7) -> Crf:
        """Maximise the conditional likelihood by Adagrad; sentences of like length share a batch."""
        rng = np.random.default_rng(seed)
        k = len(self.labels)
        gw, gt, gs = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2), np.full_like(self.s, 1e-2)
        size = np.array([len(y) for y in ys])
        for _ in range(epochs):
            order = np.argsort(size + rng.random(len(size)) * 4)
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            rng.shuffle(groups)
            for g in groups:
                b, n = len(g), int(size[g].max())
                flat = np.concatenate([xs[i] for i in g])
                em = np.zeros((b, n, k))
                mask = np.arange(n) < size[g][:, None]
                em[mask] = self.emissions(flat)
                gold = np.zeros((b, n), np.int64)
                gold[mask] = np.concatenate([ys[i] for i in g])
                t, s = self.t.astype(float), self.s.astype(float)
                al = np.zeros((b, n, k))
                al[:, 0] = em[:, 0] + s
                for i in range(1, n):
                    m = al[:, i - 1].max(1)[:, None, None]
                    nxt = np.log(np.exp(al[:, i - 1][:, :, None] - m + t).sum(1) + 1e-300) + m[:, :, 0] + em[:, i]
                    al[:, i] = np.where(mask[:, i][:, None], nxt, al[:, i - 1])
                top = al[:, -1].max(1, keepdims=True)
                z = np.log(np.exp(al[:, -1] - top).sum(1)) + top[:, 0]
                be = np.zeros((b, n, k))
                dt = np.zeros((k, k))
                for i in range(n - 2, -1, -1):
                    v = em[:, i + 1] + be[:, i + 1]
                    live = mask[:, i + 1]
                    q = al[:, i][:, :, None] + t + v[:, None, :] - z[:, None, None]
                    dt += np.exp(np.minimum(q[live], 0)).sum(0)
                    m = v.max(1)[:, None]
                    r = np.log(np.exp(v - m) @ np.exp(t).T + 1e-300) + m
                    be[:, i] = np.where(live[:, None], r, 0)
                p = np.exp(np.minimum(al + be - z[:, None, None], 0))
                d = p.copy()
                d[np.arange(b)[:, None], np.arange(n), gold] -= 1
                ds = d[:, 0].sum(0)
                pair = mask[:, 1:]
                np.add.at(dt, (gold[:, :-1][pair], gold[:, 1:][pair]), -1)
                d = d[mask].astype(np.float32)
                cols, inv = np.unique(flat, return_inverse=True)
                inv = inv.reshape(flat.shape)
                grad = np.zeros((len(cols), k), np.float32)
                for j in range(flat.shape[1]):
                    np.add.at(grad, inv[:, j], d)
                grad += l2 * b * self.w[cols]
                gw[cols] += grad**2
                self.w[cols] -= rate * grad / np.sqrt(gw[cols])
                self.w[0] = 0
                gt += dt**2
                self.t -= (rate * dt / np.sqrt(gt)).astype(np.float32)
                gs += ds**2
                self.s -= (rate * ds / np.sqrt(gs)).astype(np.float32)
                self.t[self.forbid] = -1e4
                self.s[self.bar] = -1e4
        return self

    def viterbi(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best labels of sentences laid end to end in ``x`` with lengths ``size``; padded batches of like length."""
        em = self.emissions(x) if len(x) else np.zeros((0, len(self.labels)), np.float32)
        first = np.cumsum(size) - size
        out = np.zeros(len(x), np.int8)
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            n = int(size[order[i]])
            j = i
            while j < len(order) and size[order[j]] <= max(n + 4, n * 1.15) and (j - i) * size[order[j]] < 200_000:
                j += 1
            g = order[i:j]
            i = j
            n = int(size[g].max())
            if n == 0:
                continue
            at = first[g][:, None] + np.minimum(np.arange(n), size[g][:, None] - 1)
            live = np.arange(n) < size[g][:, None]
            e = em[at]
            best = (e[:, 0] + self.s).astype(float)  # sums over sentences of any length
            back = np.zeros((len(g), n, len(self.labels)), np.int8)
            for p in range(1, n):
                cand = best[:, :, None] + self.t
                arg = cand.argmax(1)
                back[:, p] = arg
                nxt = np.take_along_axis(cand, arg[:, None, :], 1)[:, 0] + e[:, p]
                best = np.where(live[:, p][:, None], nxt, best)
            now = best.argmax(1)
            path = np.zeros((len(g), n), np.int8)
            for p in range(n - 1, -1, -1):
                path[:, p] = now
                if p:
                    now = np.where(live[:, p], back[np.arange(len(g)), p, now], now)
            out[at[live]] = path[live]
        return out
