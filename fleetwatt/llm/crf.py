"""A linear-chain conditional random field over hashed features, and Viterbi decoding of many chains at once.

Tag 0 is "outside". A token's features are slots of one weight table; a chain is (slots, tags), slots a row a token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Feature slots (a power of two).
SLOTS = 1 << 16

#: Rounds over the labelled chains, chains in a batch, and the share of features left out at random while fitting.
ROUNDS = 8
BATCH = 64
DROPPED = 0.5

#: Tokens (padding included) decoded at once.
DECODED = 1 << 15


@dataclass
class Field:
    weights: np.ndarray  # SLOTS x tags
    moves: np.ndarray  # tags x tags, from tag to tag

    @property
    def n_tags(self) -> int:
        return self.weights.shape[1]

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        out = np.zeros((len(slots), self.n_tags), np.float32)
        # in blocks that stay in the processor's cache
        for i in range(0, len(slots), 4096):
            part = out[i : i + 4096]
            for k in range(slots.shape[1]):
                part += self.weights[slots[i : i + 4096, k]]
        return out

    def unsure(self, e: np.ndarray) -> np.ndarray:
        """Places of tokens that the best path may tag; between them chains fall apart without loss.

        A run of tags gains over outside at most the sum of its tokens' leads, the best transition between them, and
        entry and exit. Where no run around a token can gain, the token is outside; the sums of all runs follow from running minima.
        """
        t = self.moves
        inner = float((t[1:, 1:] - t[0, 0]).max())
        ends = max(0.0, float((t[0, 1:] - t[0, 0]).max())) + max(0.0, float((t[1:, 0] - t[0, 0]).max()))
        gain = (e[:, 1:].max(1) - e[:, 0]).astype(np.float64) + inner

        def best_before(g: np.ndarray) -> np.ndarray:
            """The best sum of a run that ends right before each place, or nothing."""
            upto = np.concatenate([[0.0], np.cumsum(g)])
            return (upto - np.minimum.accumulate(upto))[:-1]

        slack = 1e-6 + 1e-12 * np.abs(gain).sum()
        return np.flatnonzero(best_before(gain) + gain + best_before(gain[::-1])[::-1] + ends - inner >= -slack)

    def decode(self, e: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The best tags of stretches [start, end) of emissions; left and right tell whether an outside token is beside a stretch."""
        out = np.zeros(len(e), np.int8)
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        i = 0
        while i < len(order):
            longest = int(size[order[i]])
            part = order[i : i + max(1, DECODED // longest)]
            i += len(part)
            self._decode(e, starts[part], size[part], left[part], right[part], out)
        return out

    def _decode(self, e: np.ndarray, starts: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
        t = self.moves
        s = e[starts] + np.where(left[:, None], t[0], 0)
        back = []
        n = len(starts)
        # stretches come by descending length, so those that go on are the first ones
        for k in range(1, int(size[0])):
            n = int(np.searchsorted(-size[:n], -k, "left"))
            way = s[:n, :, None] + t
            back.append(way.argmax(1).astype(np.int8))
            s[:n] = way.max(1) + e[starts[:n] + k]
        tag = (s + np.where(right[:, None], t[:, 0], 0)).argmax(1)
        out[starts + size - 1] = tag
        for k in range(len(back), 0, -1):
            b = back[k - 1]
            m = len(b)
            tag[:m] = b[np.arange(m), tag[:m]]
            out[starts[:m] + k - 1] = tag[:m]

    def tags(self, slots: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best tags of all tokens; each text is one chain."""
        e = self.emissions(slots)
        unsure = self.unsure(e)
        if not len(unsure):
            return np.zeros(len(e), np.int8)
        cut = np.flatnonzero((np.diff(unsure) > 1) | (doc[unsure[1:]] != doc[unsure[:-1]])) + 1
        starts, ends = unsure[np.concatenate([[0], cut])], unsure[np.append(cut, len(unsure)) - 1] + 1
        left = (starts > 0) & (doc[starts - 1] == doc[starts])
        right = (ends < len(doc)) & (doc[np.minimum(ends, len(doc) - 1)] == doc[ends - 1])
        return self.decode(e.astype(np.float64), starts, ends, left, right)


def _soft(v: np.ndarray, axis: int) -> np.ndarray:
    m = v.max(axis, keepdims=True)
    return m.squeeze(axis) + np.log(np.exp(v - m).sum(axis))


def fit(chains: list[tuple[np.ndarray, np.ndarray]], n_tags: int, rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-4, seed: int = 7, dropped: float = DROPPED) -> Field:
    """Conditional likelihood of the chains, climbed by adaptive gradients in batches of chains."""
    chains = [c for c in chains if len(c[1])]
    w, t = np.zeros((SLOTS, n_tags)), np.zeros((n_tags, n_tags))
    gw, gt = np.full(w.shape, 1e-6), np.full(t.shape, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(chains))
        for k in range(0, len(order), BATCH):
            part = [chains[i] for i in order[k : k + BATCH]]
            size = max(len(y) for _, y in part)
            x = np.zeros((len(part), size, part[0][0].shape[1]), np.int64)
            y = np.zeros((len(part), size), np.int64)
            on = np.zeros((len(part), size), bool)
            for i, (a, b) in enumerate(part):
                x[i, : len(b)], y[i, : len(b)], on[i, : len(b)] = a, b, True
            # features left out at random, so that shape has to do where words are new
            kept = rng.random(x.shape) > dropped
            e = np.zeros((*y.shape, n_tags))
            for f in range(x.shape[2]):
                e += w[x[..., f]] * kept[..., f, None]
            f, g = np.zeros_like(e), np.zeros_like(e)
            f[:, 0] = e[:, 0]
            for i in range(1, size):
                f[:, i] = np.where(on[:, i, None], _soft(f[:, i - 1, :, None] + t, 1) + e[:, i], f[:, i - 1])
            for i in range(size - 2, -1, -1):
                g[:, i] = np.where(on[:, i + 1, None], _soft(t[None] + (e[:, i + 1] + g[:, i + 1])[:, None, :], 2), 0.0)
            z = _soft(f[:, -1], 1)
            de = -np.exp(f + g - z[:, None, None])
            np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) + 1.0, 2)
            de *= on[:, :, None] / len(part)
            both = on[:, 1:] & on[:, :-1]
            pair = np.exp(f[:, :-1, :, None] + t + (e[:, 1:] + g[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
            dt = -pair.sum((0, 1))
            np.add.at(dt, (y[:, :-1][both], y[:, 1:][both]), 1.0)
            dt /= len(part)
            # only the slots of this batch move
            slots, place = np.unique(x[on].ravel(), return_inverse=True)
            dw = np.zeros((len(slots), n_tags))
            np.add.at(dw, place, (de[on][:, None, :] * kept[on][..., None]).reshape(-1, n_tags))
            dw -= decay * w[slots]
            gw[slots] += dw * dw
            gt += dt * dt
            w[slots] += rate * dw / np.sqrt(gw[slots])
            t += rate * dt / np.sqrt(gt)
    return Field((w * (1 - dropped)).astype(np.float32), t)
