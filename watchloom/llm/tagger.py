"""A character tagger in numpy: embeddings, a bidirectional LSTM and CRF transitions; training and decoding."""

from __future__ import annotations

import numpy as np

#: Characters the network tells apart: ASCII, other letters, other characters, and the padding.
LETTER, OTHER, PAD, CHARS = 128, 129, 130, 131


def codes(text: str) -> np.ndarray:
    """One number per code point."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    out = points.astype(np.int64)
    for at in np.flatnonzero(points > 127):
        out[at] = LETTER if text[at].isalpha() else OTHER
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Weights by name; arrays are (time, batch, units)."""

    def __init__(self, tags: int, embed: int = 12, hidden: int = 24, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden

        def start(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.w = {"embed": start(CHARS, embed) * 3, "out": start(2 * hidden, tags), "bias": np.zeros(tags, np.float32),
                  "moves": np.zeros((tags, tags), np.float32)}
        for side in ("f", "b"):
            self.w[f"x{side}"] = start(embed, 4 * hidden)
            self.w[f"h{side}"] = start(hidden, 4 * hidden)
            self.w[f"c{side}"] = np.zeros(4 * hidden, np.float32)
            self.w[f"c{side}"][hidden:2 * hidden] = 1  # remember at first

    def _run(self, side: str, x: np.ndarray, keep: bool):
        """One direction over x (time, batch, embed), in the order of x; the states, and what backpropagation needs."""
        H, (steps, batch, _) = self.hidden, x.shape
        ahead = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        h = np.zeros((batch, H), np.float32)
        c = np.zeros((batch, H), np.float32)
        out = np.empty((steps, batch, H), np.float32)
        tape = []
        for t in range(steps):
            z = ahead[t] + h @ self.w[f"h{side}"]
            gates = _sigmoid(z[:, :3 * H])
            i, f, o = gates[:, :H], gates[:, H:2 * H], gates[:, 2 * H:]
            g = np.tanh(z[:, 3 * H:])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                tape.append((i, f, o, g, before, tc, h))
            h = o * tc
            out[t] = h
        return out, tape

    def scores(self, ids: np.ndarray, keep: bool = False):
        """Tag scores (time, batch, tags) of ids (time, batch)."""
        x = self.w["embed"][ids]
        ahead, tape_f = self._run("f", x, keep)
        back, tape_b = self._run("b", x[::-1], keep)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        found = both @ self.w["out"] + self.w["bias"]
        return (found, (x, both, tape_f, tape_b)) if keep else found

    def loss(self, ids: np.ndarray, gold: np.ndarray, grads: dict[str, np.ndarray]) -> float:
        """Mean negative log likelihood per sequence; gradients are added to ``grads``."""
        s, (x, both, tape_f, tape_b) = self.scores(ids, keep=True)
        steps, batch, _ = s.shape
        m = self.w["moves"]
        a = np.empty_like(s)
        a[0] = s[0]
        for t in range(1, steps):
            a[t] = s[t] + _logsum(a[t - 1][:, :, None] + m[None], axis=1)
        total = _logsum(a[-1], axis=1)
        b = np.zeros_like(s)
        for t in range(steps - 2, -1, -1):
            b[t] = _logsum(m[None] + (s[t + 1] + b[t + 1])[:, None, :], axis=2)
        where = np.arange(batch)
        d = np.exp(a + b - total[None, :, None])
        path = np.take_along_axis(s, gold[:, :, None], axis=2)[:, :, 0].sum() + m[gold[:-1], gold[1:]].sum()
        for t in range(steps):
            d[t, where, gold[t]] -= 1
        pairs = np.zeros_like(m, dtype=np.float64)
        for t in range(1, steps):
            pairs += np.exp(
                a[t - 1][:, :, None] + m[None] + (s[t] + b[t])[:, None, :] - total[:, None, None]
            ).sum(axis=0)
        np.add.at(pairs, (gold[:-1].ravel(), gold[1:].ravel()), -1)
        d = (d / batch).astype(np.float32)
        grads["moves"] += (pairs / batch).astype(np.float32)
        grads["out"] += np.einsum("tbh,tbk->hk", both, d, optimize=True)
        grads["bias"] += d.sum(axis=(0, 1))
        dboth = d @ self.w["out"].T
        H = self.hidden
        dx = self._back("f", x, tape_f, dboth[:, :, :H], grads)
        dx += self._back("b", x[::-1], tape_b, dboth[::-1, :, H:], grads)[::-1]
        np.add.at(grads["embed"], ids, dx)
        return float((total.sum() - path) / batch)

    def _back(self, side: str, x, tape, dout, grads) -> np.ndarray:
        H, steps = self.hidden, len(tape)
        dh_next = np.zeros_like(dout[0])
        dc = np.zeros_like(dout[0])
        dz = np.empty((steps, dout.shape[1], 4 * H), np.float32)
        wh = self.w[f"h{side}"]
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, tc, h = tape[t]
            dh = dout[t] + dh_next
            dc = dc + dh * o * (1 - tc * tc)
            z = dz[t]
            z[:, :H] = dc * g * i * (1 - i)
            z[:, H:2 * H] = dc * before * f * (1 - f)
            z[:, 2 * H:3 * H] = dh * tc * o * (1 - o)
            z[:, 3 * H:] = dc * i * (1 - g * g)
            grads[f"h{side}"] += h.T @ z
            dh_next = z @ wh.T
            dc = dc * f
        grads[f"x{side}"] += np.einsum("tbe,tbk->ek", x, dz, optimize=True)
        grads[f"c{side}"] += dz.sum(axis=(0, 1))
        return dz @ self.w[f"x{side}"].T

    def fit(self, ids: np.ndarray, gold: np.ndarray, rounds: int, batch: int = 32, rate: float = 0.03, seed: int = 7) -> float:
        """Adam over ids and gold (sequence, time); the mean loss of the last tenth of the batches."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for n in range(1, rounds + 1):
            pick = rng.integers(0, len(ids), batch)
            grads = {k: np.zeros_like(v) for k, v in self.w.items()}
            losses.append(self.loss(ids[pick].T, gold[pick].T, grads))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            now = rate * min(1.0, n / 20) * (1 - n / (rounds + 1)) ** 0.5
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= now * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
        return float(np.mean(losses[-max(1, rounds // 10):]))

    def decode(self, scores: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best tag path of each sequence of scores (time, tags), and the probability of each of its tags.

        Sequences of like length run side by side.
        """
        none = (np.empty(0, int), np.empty(0, np.float32))
        out: list[tuple[np.ndarray, np.ndarray]] = [none] * len(scores)
        order = sorted((k for k in range(len(scores)) if len(scores[k])), key=lambda k: len(scores[k]))
        m = self.w["moves"]
        for group in (order[k:k + 256] for k in range(0, len(order), 256)):
            sizes = np.array([len(scores[k]) for k in group])
            steps = int(sizes.max())
            s = np.zeros((steps, len(group), self.tags), np.float32)
            for col, k in enumerate(group):
                s[:sizes[col], col] = scores[k]
            came = np.zeros(s.shape, np.int8)
            best, ahead, back = s.copy(), s.copy(), np.zeros_like(s)
            for t in range(1, steps):
                reach = best[t - 1][:, :, None] + m[None]
                came[t] = reach.argmax(axis=1)
                best[t] = s[t] + reach.max(axis=1)
                ahead[t] = s[t] + _logsum(ahead[t - 1][:, :, None] + m[None], axis=1)
            for t in range(steps - 2, -1, -1):
                inner = (t < sizes - 1)[:, None]
                back[t] = np.where(inner, _logsum(m[None] + (s[t + 1] + back[t + 1])[:, None, :], axis=2), 0)
            for col, k in enumerate(group):
                n = sizes[col]
                path = np.empty(n, int)
                path[-1] = best[n - 1, col].argmax()
                for t in range(n - 1, 0, -1):
                    path[t - 1] = came[t, col, path[t]]
                total = _logsum(ahead[n - 1, col], axis=0)
                rows = np.arange(n)
                out[k] = path, np.exp(ahead[rows, col, path] + back[rows, col, path] - total)
        return out
