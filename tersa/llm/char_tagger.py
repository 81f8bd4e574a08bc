"""A character-level bidirectional LSTM with CRF transitions, in NumPy.

Both directions run as one batch with a matrix each; the emission of a character
comes from both states, and a linear chain over the tags scores the sequence. All
parameters are fitted together by backpropagation of the chain's log-likelihood.

Tags: outside, then begin and inside of each kind. Inside follows begin or inside
of its kind only.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 20
#: Where a move between two tags is impossible.
NEVER = -1e4

# Characters ---------------------------------------------------------------
#: Digits are one symbol, and capitals; other ASCII characters stand for themselves.
_ASCII = np.arange(128)
_ASCII[48:58], _ASCII[65:91] = 48, 65
LETTER, SPACE, OTHER, PAD = 128, 129, 130, 131
SYMBOLS = 132


def symbols(text: str) -> np.ndarray:
    """One symbol for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _ASCII[np.minimum(points, 127)]
    high = np.flatnonzero(points > 127)
    if len(high):
        kinds, at = np.unique(points[high], return_inverse=True)
        named = [LETTER if c.isalpha() else SPACE if c.isspace() else 48 if c.isdigit() else OTHER
                 for c in map(chr, kinds.tolist())]
        out[high] = np.array(named)[at]
    return out.astype(np.uint8)


def allowed(kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Zero for moves between tags, and first tags, that are possible; else ``NEVER``."""
    n = 1 + 2 * kinds
    moves, first = np.zeros((n, n)), np.zeros(n)
    for k in range(kinds):
        inside = 2 + 2 * k
        moves[:, inside], first[inside] = NEVER, NEVER
        moves[inside - 1, inside] = moves[inside, inside] = 0.0
    return moves, first


class Tagger:
    """Parameters by name; ``wx`` and ``wh`` hold a matrix for each direction."""

    def __init__(self, kinds: int, hidden: int = HIDDEN, seed: int = 11, dtype=np.float32):
        rng, tags = np.random.default_rng(seed), 1 + 2 * kinds
        self.hidden, self.dtype = hidden, dtype
        self.moves_allowed, self.first_allowed = allowed(kinds)
        bias = np.zeros((2, 4 * hidden))
        bias[:, hidden:2 * hidden] = 1.0  # remember at first
        self.params = {
            "wx": rng.normal(0, 0.3, (2, SYMBOLS, 4 * hidden)),
            "wh": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)),
            "bias": bias,
            "out": rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, tags)),
            "base": np.zeros(tags), "moves": np.zeros((tags, tags)), "first": np.zeros(tags)}
        self.params = {k: v.astype(dtype) for k, v in self.params.items()}

    def _states(self, ids: np.ndarray, keep: bool):
        """States of both directions, ``(2, window, place, hidden)``; the second one reversed."""
        p, h = self.params, self.hidden
        both = np.stack([ids, ids[:, ::-1]])
        width, size = ids.shape[1], ids.shape[0]
        out = np.empty((2, size, width, h), self.dtype)
        state, cell = (np.zeros((2, size, h), self.dtype) for _ in range(2))
        trace = []
        for t in range(width):
            a = np.stack([p["wx"][0][both[0, :, t]], p["wx"][1][both[1, :, t]]])
            a += p["bias"][:, None]
            a += state @ p["wh"]
            a[..., :3 * h] *= 0.5
            np.tanh(a, out=a)
            a[..., :3 * h] = a[..., :3 * h] * 0.5 + 0.5
            before = cell
            cell = a[..., h:2 * h] * before + a[..., :h] * a[..., 3 * h:]
            top = np.tanh(cell)
            last, state = state, a[..., 2 * h:3 * h] * top
            out[:, :, t] = state
            if keep:
                trace.append((a, before, top, last))
        return out, both, trace

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Score of every tag at every place of the windows ``ids``; padding is outside."""
        states, _, _ = self._states(ids, False)
        return self._emit(states, ids)

    def _emit(self, states, ids):
        p, h = self.params, self.hidden
        e = states[0] @ p["out"][:h] + states[1][:, ::-1] @ p["out"][h:] + p["base"]
        e = e.astype(np.float64)
        e[..., 1:][ids == PAD] = NEVER
        return e

    def chain(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.params["moves"] + self.moves_allowed, self.params["first"] + self.first_allowed)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the windows, and its gradients."""
        p, h, size = self.params, self.hidden, len(ids)
        states, both, trace = self._states(ids, True)
        e = self._emit(states, ids)
        loss, d_e, d_moves, d_first = chain_gradients(e, *self.chain(), tags)
        d_e[..., 1:][ids == PAD] = 0.0
        d_e = (d_e / size).astype(self.dtype)
        flat = d_e.reshape(-1, d_e.shape[-1])
        grads = {"moves": d_moves / size, "first": d_first / size, "base": flat.sum(axis=0)}
        ahead, back = states[0], states[1][:, ::-1]
        grads["out"] = np.concatenate([ahead.reshape(-1, h).T @ flat, back.reshape(-1, h).T @ flat])
        d_out = np.stack([d_e @ p["out"][:h].T, (d_e @ p["out"][h:].T)[:, ::-1]])
        d_state, d_cell = np.zeros_like(d_out[:, :, 0]), np.zeros_like(d_out[:, :, 0])
        d_wh, d_a = np.zeros_like(p["wh"]), np.empty((*d_out.shape[:3], 4 * h), self.dtype)
        for t in range(ids.shape[1] - 1, -1, -1):
            a, before, top, last = trace[t]
            i, f, o, g = (a[..., k * h:(k + 1) * h] for k in range(4))
            d_state = d_state + d_out[:, :, t]
            d_cell = d_cell + d_state * o * (1 - top * top)
            da = d_a[:, :, t]
            da[..., :h] = d_cell * g * i * (1 - i)
            da[..., h:2 * h] = d_cell * before * f * (1 - f)
            da[..., 2 * h:3 * h] = d_state * top * o * (1 - o)
            da[..., 3 * h:] = d_cell * i * (1 - g * g)
            d_wh += last.transpose(0, 2, 1) @ da
            d_state, d_cell = da @ p["wh"].transpose(0, 2, 1), d_cell * f
        grads["wh"], grads["bias"] = d_wh, d_a.sum(axis=(1, 2))
        grads["wx"] = np.zeros_like(p["wx"])
        for way in range(2):
            order = np.argsort(both[way], axis=None, kind="stable")
            seen, begin = np.unique(both[way].ravel()[order], return_index=True)
            grads["wx"][way, seen] = np.add.reduceat(
                d_a[way].reshape(-1, 4 * h)[order], begin, axis=0)
        return loss / size, grads

    def fit(self, ids: np.ndarray, tags: np.ndarray, rounds: int, batch: int = 64,
            rate: float = 0.012, penalty: float = 1e-5, seed: int = 5) -> float:
        """Adam over shuffled batches with a falling rate; returns the last round's mean loss."""
        rng, step, total = np.random.default_rng(seed), 0, 0.0
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        steps = rounds * -(-len(ids) // batch)
        for _ in range(rounds):
            order, losses = rng.permutation(len(ids)), []
            for a in range(0, len(ids), batch):
                some = order[a:a + batch]
                loss, grads = self.gradients(ids[some], tags[some])
                losses.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                clip, now = min(1.0, 5.0 / (norm + 1e-9)), rate * (1 - step / steps) + 1e-4
                step += 1
                for k, v in self.params.items():
                    g = grads[k] * clip + penalty * v
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    v -= (now * (mean[k] / (1 - 0.9 ** step))
                          / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)).astype(self.dtype)
            total = float(np.mean(losses))
        return total

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of each window."""
        moves, first = self.chain()
        score, back = first + e[:, 0], np.empty(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            step = score[:, :, None] + moves
            back[:, t] = step.argmax(axis=1)
            score = step.max(axis=1) + e[:, t]
        tags = np.empty(e.shape[:2], np.int8)
        tags[:, -1] = score.argmax(axis=1)
        rows = np.arange(len(e))
        for t in range(e.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[rows, t, tags[:, t]]
        return tags


def chain_gradients(e: np.ndarray, moves: np.ndarray, first: np.ndarray, tags: np.ndarray):
    """Negative log-likelihood of ``tags``, with gradients of emissions, moves and first tags.

    Forward and backward sums, each place scaled to one.
    """
    n, width, k = e.shape
    top = e.max(axis=2, keepdims=True)
    x, step = np.exp(e - top), np.exp(moves)
    ahead, behind = np.empty_like(e), np.ones_like(e)
    start = np.exp(first) * x[:, 0]
    norm = np.empty((n, width))
    for t in range(width):
        a = start if t == 0 else (ahead[:, t - 1] @ step) * x[:, t]
        norm[:, t] = a.sum(axis=1)
        ahead[:, t] = a / norm[:, t, None]
    d_moves = np.zeros_like(moves)
    for t in range(width - 1, 0, -1):
        right = x[:, t] * behind[:, t] / norm[:, t, None]
        behind[:, t - 1] = right @ step.T
        d_moves += (ahead[:, t - 1].T @ right) * step
    d_e = ahead * behind
    loss = np.log(norm).sum() + top.sum()
    rows = np.arange(n)
    for t in range(width):
        loss -= e[rows, t, tags[:, t]].sum()
        d_e[rows, t, tags[:, t]] -= 1
        if t:
            loss -= moves[tags[:, t - 1], tags[:, t]].sum()
            np.add.at(d_moves, (tags[:, t - 1], tags[:, t]), -1)
    loss -= first[tags[:, 0]].sum()
    d_first = d_e[:, 0].sum(axis=0)
    return float(loss), d_e, d_moves, d_first
