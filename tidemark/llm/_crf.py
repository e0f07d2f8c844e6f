"""A linear-chain conditional random field on dense features, in numpy: training, Viterbi and marginals."""

from __future__ import annotations

import numpy as np


class CRF:
    """Scores: ``x @ weight`` for each place and label, ``step`` between neighbours, ``first`` and ``last`` at the ends."""

    def __init__(self, features: int, labels: int):
        self.weight = np.zeros((features, labels))
        self.step = np.zeros((labels, labels))
        self.first, self.last = np.zeros(labels), np.zeros(labels)

    def _sums(self, e: np.ndarray, size: np.ndarray):
        """Log forward and backward sums of padded sequences (n, length, labels), and the log partition."""
        n, length, _ = e.shape
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + self.first
        for t in range(1, length):
            a[:, t] = np.where((t < size)[:, None], _lse(a[:, t - 1, :, None] + self.step, 1) + e[:, t], a[:, t - 1])
        b[:, -1] = self.last
        for t in range(length - 2, -1, -1):
            b[:, t] = np.where((t + 1 < size)[:, None], _lse(self.step + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), self.last)
        return a, b, _lse(a[:, -1] + self.last, 1)

    def marginals(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probability of each label at each place; places beyond ``size`` mean nothing."""
        a, b, z = self._sums(x @ self.weight, size)
        return np.exp(a + b - z[:, None, None])

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best labels of sequences of one length (n, length, features)."""
        e = x @ self.weight
        score, back = e[:, 0] + self.first, []
        for t in range(1, e.shape[1]):
            every = score[:, :, None] + self.step
            back.append(every.argmax(1))
            score = every.max(1) + e[:, t]
        out = [(score + self.last).argmax(1)]
        for k in reversed(back):
            out.append(k[np.arange(len(k)), out[-1]])
        return np.stack(out[::-1], 1)

    def decode(self, e: np.ndarray, heads: np.ndarray, block: int = 256) -> np.ndarray:
        """Viterbi over sequences that stand one after another in ``e`` (places, labels); ``heads`` is true where one begins.

        The places are cut into blocks that advance together. A first pass has the best score from each label before a block to
        each at its end, which carries scores over the cuts; a second has the ways back. The result is that of whole sequences.
        """
        n, k = e.shape
        own = n // block + 1  # the padding, of one place or more, is a sequence of its own
        e = np.vstack((e, np.zeros((own * block - n, k)))).reshape(own, block, k).transpose(1, 2, 0).copy()
        heads = np.append(heads, np.arange(own * block - n) == 0).reshape(own, block)
        heads = [np.flatnonzero(h) for h in heads.T]

        def forward(a: np.ndarray, ways: np.ndarray | None = None) -> np.ndarray:
            for t, h in enumerate(heads):
                new = a[..., 0, None, :] + self.step[0][:, None]
                for i in range(1, k):
                    other = a[..., i, None, :] + self.step[i][:, None]
                    if ways is not None:
                        ways[t][other > new] = i
                    new = np.maximum(new, other)
                if len(h):
                    close = a[..., h] + self.last[:, None]
                    new[..., h] = close.max(-2)[..., None, :] + self.first[:, None]
                    if ways is not None:
                        ways[t][:, h] = close.argmax(0)
                a = new + e[t]
            return a

        through = forward(np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[:, :, None] + np.zeros(own))
        entry = np.zeros((k, own))
        for j in range(1, own):
            entry[:, j] = (entry[:, j - 1, None] + through[:, :, j - 1]).max(0)
            entry[:, j] -= entry[:, j].max()
        ways = np.zeros((block, k, own), np.int8)
        end = forward(entry, ways)[:, -1].argmax()
        by_end = np.zeros((block, k, own), np.int8)  # the label of a place, by that of the block's last
        now = np.arange(k)[:, None] + np.zeros((1, own), int)
        for t in range(block - 1, -1, -1):
            by_end[t] = now
            now = np.take_along_axis(ways[t], now, 0).astype(int)
        out = np.zeros((own, block), np.int8)
        for j in range(own - 1, -1, -1):
            out[j], end = by_end[:, end, j], now[end, j]
        return out.ravel()[:n]

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.1, penalty: float = 1e-3) -> CRF:
        """Adam on the mean penalised log likelihood of (features, labels); no random numbers are drawn."""
        sequences = sorted(sequences, key=lambda s: len(s[1]))
        batches = []
        at = 0
        while at < len(sequences):  # of 512 sequences, or fewer where they are long, so that padding stays bounded
            end = at + 1
            while end < len(sequences) and end - at < 512 and (end + 1 - at) * len(sequences[end][1]) <= 1 << 18:
                end += 1
            own, at = sequences[at:end], end
            size = np.array([len(y) for _, y in own])
            x = np.zeros((len(own), size.max(), self.weight.shape[0]))
            y = np.zeros(x.shape[:2], int)
            for i, (u, v) in enumerate(own):
                x[i, : len(v)], y[i, : len(v)] = u, v
            batches.append((x, y, size))
        names, k = ("weight", "step", "first", "last"), self.step.shape[0]
        m = {c: np.zeros_like(getattr(self, c)) for c in names}
        v = {c: np.zeros_like(getattr(self, c)) for c in names}
        total = sum(int(s.sum()) for _, _, s in batches) or 1
        for r in range(1, rounds + 1):
            g = {c: np.zeros_like(getattr(self, c)) for c in names}
            for x, y, size in batches:
                e = x @ self.weight
                a, b, z = self._sums(e, size)
                real = np.arange(x.shape[1]) < size[:, None]
                p = np.exp(a + b - z[:, None, None]) * real[:, :, None]
                hot = np.eye(k)[y] * real[:, :, None]
                d = hot - p
                g["weight"] += np.einsum("nlf,nlk->fk", x, d)
                g["first"] += d[:, 0].sum(0)
                rows = np.arange(len(y))
                g["last"] += d[rows, size - 1].sum(0)
                for t in range(1, x.shape[1]):
                    on = t < size
                    if on.any():
                        both = np.exp(a[on, t - 1, :, None] + self.step + (e[on, t] + b[on, t])[:, None, :] - z[on, None, None])
                        g["step"] += np.einsum("na,nb->ab", hot[on, t - 1], hot[on, t]) - both.sum(0)
            for c in names:
                own = getattr(self, c)
                grad = g[c] / total - penalty * own
                m[c] = 0.9 * m[c] + 0.1 * grad
                v[c] = 0.999 * v[c] + 0.001 * grad**2
                setattr(self, c, own + rate * (m[c] / (1 - 0.9**r)) / (np.sqrt(v[c] / (1 - 0.999**r)) + 1e-8))
        return self


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))
