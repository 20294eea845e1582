"""A bidirectional gated recurrent network over bytes in numpy, trained by backpropagation through time.

A step reads ``STRIDE`` bytes, each by its own table of 256 rows, so the input needs no product, and labels every one of
them by its own output table; the rows of equal steps are summed once per block of texts. Gates are piecewise linear and the candidate is a softsign: both run at
memory speed in numpy, where exponentials would take most of the time. Both directions are one stacked product.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32
STRIDE = 4


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid, in place."""
    x *= F32(0.2)
    x += F32(0.5)
    np.maximum(x, F32(0), out=x)
    return np.minimum(x, F32(1), out=x)


class ByteGRU:
    """Parameters: X (2, STRIDE, 256, 3H) input rows, U (2, H, 3H) recurrence, V (2H, STRIDE C) and c (STRIDE C) output."""

    def __init__(self, classes: int, hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h, self.c = hidden, classes
        self.p = {
            "X": (0.3 * rng.standard_normal((2, STRIDE, 256, 3 * hidden))).astype(F32),
            "U": (rng.standard_normal((2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype(F32),
            "V": (rng.standard_normal((2 * hidden, STRIDE * classes)) / np.sqrt(2 * hidden)).astype(F32),
            "c": np.zeros(STRIDE * classes, F32),
        }

    def states(self, data: np.ndarray, keep: bool = False, directions: tuple[int, ...] = (0, 1), state: np.ndarray | None = None):
        """data (B, T, STRIDE) of bytes -> hidden states (directions, T, B, H) in reading order of each direction; with what BPTT needs.

        ``state`` (directions, B, H) goes on from the end of what each direction read before.
        """
        b, t = data.shape[:2]
        h, d = self.h, len(directions)
        x, u = self.p["X"][list(directions)], self.p["U"][list(directions)]
        steps = np.ascontiguousarray(data).view(np.uint32).reshape(b, t)
        kinds, index = np.unique(steps, return_inverse=True)
        parts = kinds.view(np.uint8).reshape(-1, STRIDE)
        table = sum(x[:, i, parts[:, i]] for i in range(STRIDE))  # (directions, kinds, 3H)
        index = index.reshape(b, t).T
        # one contiguous table, product and array per gate: numpy then runs over flat memory
        flat = [np.ascontiguousarray(table[..., k * h : (k + 1) * h]).reshape(-1, h) for k in range(3)]
        part_u = [np.ascontiguousarray(u[..., k * h : (k + 1) * h]) for k in range(3)]
        both = np.stack([(index if way == 0 else index[::-1]) + i * len(kinds) for i, way in enumerate(directions)])  # rows of the flat tables
        out = np.zeros((d, t, b, h), F32)
        state = np.zeros((d, b, h), F32) if state is None else state.copy()
        kept = []
        rec, work = np.empty((d, b, h), F32), np.empty((d, b, h), F32)
        for i in range(t):
            rows = both[:, i]
            z, r, n = (np.take(f, rows, axis=0) for f in flat)
            z += np.matmul(state, part_u[0], out=rec)
            _gate(z)
            r += np.matmul(state, part_u[1], out=rec)
            _gate(r)
            np.matmul(state, part_u[2], out=rec)
            n += np.multiply(r, rec, out=work)
            np.abs(n, out=work)
            work += F32(1)
            n /= work
            if keep:
                kept.append((state, z, r, n, rec.copy()))
                state = n + z * (state - n)
            else:
                state -= n
                state *= z
                state += n
            out[:, i] = state
        return out, kept, (both, parts)

    def _scores(self, forth: np.ndarray, back: np.ndarray) -> np.ndarray:
        """(n, C) from hidden states (n, H) of both directions: log probabilities of each byte of a step, pooled over the step."""
        v = self.p["V"]
        logits = forth @ v[: self.h]
        logits += back @ v[self.h :]
        logits += self.p["c"]
        np.clip(logits, F32(-30), F32(30), out=logits)
        each = logits.reshape(-1, self.c)
        each -= np.log(np.exp(each) @ np.ones((self.c, 1), F32))
        return logits.reshape(-1, STRIDE, self.c).mean(axis=1)

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        """(T, B, C) log probability of every class, pooled over the bytes of every step."""
        out, _, _ = self.states(data)
        t, b = out.shape[1:3]
        return self._scores(out[0].reshape(t * b, -1), out[1, ::-1].reshape(t * b, -1)).reshape(t, b, -1)

    def long_log_probabilities(self, data: np.ndarray, chunk: int) -> np.ndarray:
        """(T, C) of one text (T, STRIDE) read in chunks of steps; each direction takes its state over from chunk to chunk."""
        at = range(0, len(data), chunk)
        forth, state = [], None
        for i in at:
            out, _, _ = self.states(data[None, i : i + chunk], directions=(0,), state=state)
            forth.append(out[0, :, 0])
            state = out[:, -1]
        scores, state = [], None
        for i, ahead in zip(reversed(at), reversed(forth)):
            out, _, _ = self.states(data[None, i : i + chunk], directions=(1,), state=state)
            scores.append(self._scores(ahead, out[0, ::-1, 0]))
            state = out[:, -1]
        return np.concatenate(scores[::-1])

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes of steps with label (B, T) >= 0, and its gradient by backpropagation through time."""
        h = self.h
        out, kept, both = self.states(data, keep=True)
        t, b = out.shape[1:3]
        v = self.p["V"]
        joined = np.concatenate([out[0], out[1, ::-1]], axis=2).reshape(t * b, 2 * h)
        logits = (joined @ v + self.p["c"]).reshape(-1, self.c)
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        target = np.repeat(labels.T.reshape(-1), STRIDE)
        known = target >= 0
        count = max(1, int(known.sum()))
        loss = -float(np.log(prob[known, target[known]] + 1e-9).sum()) / count
        d = prob
        d[known, target[known]] -= 1
        d[~known] = 0
        d /= F32(count)
        d = d.reshape(t * b, -1)
        grads = {"V": joined.T @ d, "c": d.sum(axis=0)}
        dj = (d @ v.T).reshape(t, b, 2 * h)
        dout = np.stack([dj[..., :h], dj[::-1, :, h:]])  # (2, T, B, H)
        rows, parts = both
        gflat, gu = np.zeros((2 * len(parts), 3 * h), F32), np.zeros_like(self.p["U"])
        ut = np.ascontiguousarray(self.p["U"].transpose(0, 2, 1))
        dh = np.zeros((2, b, h), F32)
        given_all = np.empty((t, 2, b, 3 * h), F32)
        for i in range(t - 1, -1, -1):
            state, z, r, n, rn = kept[i]
            dh = dh + dout[:, i]
            slope = 1 - np.abs(n)
            dn = dh * (1 - z) * slope * slope
            dz = dh * (state - n) * F32(0.2) * ((z > 0) & (z < 1))
            dr = dn * rn * F32(0.2) * ((r > 0) & (r < 1))
            given_all[i] = np.concatenate([dz, dr, dn], axis=2)
            rec = np.concatenate([dz, dr, dn * r], axis=2)
            gu += np.matmul(state.transpose(0, 2, 1), rec)
            dh = dh * z + np.matmul(rec, ut)
        _scatter(gflat, rows.transpose(1, 0, 2).reshape(-1), given_all.reshape(-1, 3 * h))
        gx = np.zeros_like(self.p["X"])
        per_kind = gflat.reshape(2, len(parts), 3 * h)
        for d in range(2):
            for i in range(STRIDE):
                _scatter(gx[d, i], parts[:, i], per_kind[d])
        grads["X"], grads["U"] = gx, gu
        return loss, grads


def _scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to rows, repeated rows summed, by one sort."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    into[rows[first]] += np.add.reduceat(values[order], first, axis=0)


def train(model: ByteGRU, batches, rate: float = 0.02, clip: float = 1.0) -> list[float]:
    """Adam with a falling rate and clipped gradients over (data, labels) batches; returns the losses."""
    batches = list(batches)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    losses = []
    for step, (data, labels) in enumerate(batches, 1):
        loss, grads = model.gradients(data, labels)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, clip / (norm + 1e-9))
        now = rate * (1 - 0.9 * step / len(batches))
        for k, g in grads.items():
            g = g * F32(scale)
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            model.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(F32)
        losses.append(loss)
    return losses
