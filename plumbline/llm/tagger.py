"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

# Characters the tagger tells apart; others fall into classes by kind.
_OWN = "@.-+()_%:/,;='\"#*|[]<>!?&\n"
CLASSES = len(_OWN) + 8
_TABLE = np.full(128, len(_OWN) + 6, np.int64)
_TABLE[[ord(c) for c in _OWN]] = np.arange(len(_OWN))
_TABLE[97:123] = len(_OWN)
_TABLE[65:91] = len(_OWN) + 1
_TABLE[48:58] = len(_OWN) + 2
_TABLE[49:51] = len(_OWN) + 3
_TABLE[32] = len(_OWN) + 4
_TABLE[9] = len(_OWN) + 4
PADDING = CLASSES - 1


def classes(text: str) -> np.ndarray:
    """The class of every character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], len(_OWN) + 5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Tags are 0 for outside, then begin and inside of each kind."""

    def __init__(self, kinds: int, width: int = 8, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tags = 1 + 2 * kinds
        scale = 1 / np.sqrt(width + hidden)
        self.p = {"embed": rng.normal(0, 0.3, (CLASSES, width)), "out": rng.normal(0, 0.2, (2 * hidden, self.tags))}
        self.p |= {"bias": np.zeros(self.tags), "moves": np.zeros((self.tags, self.tags)), "start": np.zeros(self.tags)}
        for way in "fb":
            self.p[f"x{way}"] = rng.normal(0, scale, (width, 4 * hidden))
            self.p[f"h{way}"] = rng.normal(0, scale, (hidden, 4 * hidden))
            self.p[f"c{way}"] = np.concatenate((np.ones(hidden), np.zeros(3 * hidden)))
        self.hidden = hidden
        # Inside follows begin or inside of its own kind only.
        self.banned = np.zeros((self.tags, self.tags))
        self.banned_start = np.zeros(self.tags)
        for kind in range(kinds):
            inside = 2 + 2 * kind
            self.banned[:, inside] = -1e4
            self.banned[[inside - 1, inside], inside] = 0
            self.banned_start[inside] = -1e4

    # -- scores --------------------------------------------------------------
    def _run(self, e: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        n, t, _ = e.shape
        size = self.hidden
        inputs = e @ self.p[f"x{way}"] + self.p[f"c{way}"]
        h, c, out, kept = np.zeros((n, size)), np.zeros((n, size)), np.empty((n, t, size)), []
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            gates = inputs[:, i] + h @ self.p[f"h{way}"]
            f, g_in, g_out = (_sigmoid(gates[:, k * size : (k + 1) * size]) for k in range(3))
            new = np.tanh(gates[:, 3 * size :])
            before, before_h = c, h
            c = f * c + g_in * new
            squashed = np.tanh(c)
            h = g_out * squashed
            out[:, i] = h
            if keep:
                kept.append((i, f, g_in, g_out, new, before, squashed, before_h))
        return out, kept

    def scores(self, x: np.ndarray, keep: bool = False):
        e = self.p["embed"][x]
        forward, kept_f = self._run(e, "f", keep)
        backward, kept_b = self._run(e, "b", keep)
        both = np.concatenate((forward, backward), axis=2)
        return both @ self.p["out"] + self.p["bias"], (e, both, kept_f, kept_b)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of every window (Viterbi)."""
        s, _ = self.scores(x)
        n, t, _ = s.shape
        moves = self.p["moves"] + self.banned
        best = s[:, 0] + self.p["start"] + self.banned_start
        back = np.zeros((n, t, self.tags), np.int64)
        for i in range(1, t):
            options = best[:, :, None] + moves
            back[:, i] = options.argmax(1)
            best = options.max(1) + s[:, i]
        out = np.zeros((n, t), np.int64)
        out[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[np.arange(n), i, out[:, i]]
        return out

    # -- training ------------------------------------------------------------
    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """The mean negative log-likelihood of the tag sequences, and its slopes."""
        s, (e, both, kept_f, kept_b) = self.scores(x, keep=True)
        n, t, k = s.shape
        moves, start = self.p["moves"] + self.banned, self.p["start"] + self.banned_start
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0] + start
        for i in range(1, t):
            alpha[:, i] = _log_sum(alpha[:, i - 1][:, :, None] + moves, 1) + s[:, i]
        for i in range(t - 2, -1, -1):
            beta[:, i] = _log_sum(moves[None] + (s[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        total = _log_sum(alpha[:, -1], 1)
        ds = np.exp(alpha + beta - total[:, None, None])
        rows, steps = np.arange(n)[:, None], np.arange(t)[None, :]
        gold = s[rows, steps, y].sum(1) + start[y[:, 0]] + moves[y[:, :-1], y[:, 1:]].sum(1)
        d_start = ds[:, 0].sum(0) - np.bincount(y[:, 0], minlength=k)
        d_moves = np.zeros((k, k))
        for i in range(t - 1):
            d_moves += np.exp(alpha[:, i][:, :, None] + moves + (s[:, i + 1] + beta[:, i + 1])[:, None, :] - total[:, None, None]).sum(0)
        np.add.at(d_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        ds[rows, steps, y] -= 1
        ds /= n
        g = {"bias": ds.sum((0, 1)), "moves": d_moves / n, "start": d_start / n}
        g["out"] = both.reshape(-1, both.shape[2]).T @ ds.reshape(-1, k)
        d_both = ds @ self.p["out"].T
        size, d_e = self.hidden, np.zeros_like(e)
        for way, kept, d_h in (("f", kept_f, d_both[:, :, :size]), ("b", kept_b, d_both[:, :, size:])):
            d_wh, d_gates = np.zeros_like(self.p[f"h{way}"]), np.zeros((n, t, 4 * size))
            carry_h, carry_c = np.zeros((n, size)), np.zeros((n, size))
            for i, f, g_in, g_out, new, before, squashed, before_h in reversed(kept):
                dh = d_h[:, i] + carry_h
                dc = carry_c + dh * g_out * (1 - squashed**2)
                step = np.concatenate(
                    (
                        dc * before * f * (1 - f),
                        dc * new * g_in * (1 - g_in),
                        dh * squashed * g_out * (1 - g_out),
                        dc * g_in * (1 - new**2),
                    ),
                    axis=1,
                )
                d_gates[:, i] = step
                d_wh += before_h.T @ step
                carry_h, carry_c = step @ self.p[f"h{way}"].T, dc * f
            g[f"h{way}"] = d_wh
            g[f"x{way}"] = e.reshape(-1, e.shape[2]).T @ d_gates.reshape(-1, 4 * size)
            g[f"c{way}"] = d_gates.sum((0, 1))
            d_e += d_gates @ self.p[f"x{way}"].T
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], x.ravel(), d_e.reshape(-1, e.shape[2]))
        return float((total - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> "Tagger":
        """Adam over shuffled batches, with the slopes clipped."""
        rng = np.random.default_rng(seed)
        first = {name: np.zeros_like(value) for name, value in self.p.items()}
        second = {name: np.zeros_like(value) for name, value in self.p.items()}
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                _, g = self.gradients(x[pick], y[pick])
                norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
                step += 1
                pace = rate * (1 - 0.9 * step / steps)
                for name, value in g.items():
                    value = value * min(1, 5 / max(norm, 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * value
                    second[name] = 0.999 * second[name] + 0.001 * value**2
                    self.p[name] = self.p[name] - pace * (first[name] / (1 - 0.9**step)) / (
                        np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8
                    )
        return self

    def single(self) -> "Tagger":
        """The same weights in 32 bits, for decoding."""
        self.p = {name: value.astype(np.float32) for name, value in self.p.items()}
        self.banned, self.banned_start = self.banned.astype(np.float32), self.banned_start.astype(np.float32)
        return self
