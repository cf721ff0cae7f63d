"""A small bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input joins an embedding of the word and the mean embedding of its character n-grams, both in hashed
tables. Two GRUs read a window of words in both directions, attention pools their states, and a linear layer gives
the window's logit. Both directions run side by side as one batched product.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np

WINDOW, STRIDE = 32, 16
WIDTH = 8  # of each embedding and of each direction's state
BUCKETS = 1 << 15
WORD_RE = re.compile(r"\w+")
#: Words and n-grams of fewer texts aren't learned.
FEWEST_TEXTS = 4
#: The most words whose inputs a worker keeps; beyond it the store is started afresh.
MOST_WORDS = 250_000


def tokens(text: str | None) -> list[str]:
    return WORD_RE.findall((text or "").lower())


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3- and 4-byte n-grams of all words, and where each word's begin."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    text = np.frombuffer(b"".join(raw) + b"\0\0\0", np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    tri = text[:-3] * np.uint64(0x9E3779B1) + text[1:-2] * np.uint64(0x85EBCA77) + text[2:-1] * np.uint64(0xC2B2AE3D)
    four = tri * np.uint64(31) + text[3:] * np.uint64(0x27D4EB2F) + np.uint64(7)
    mix = lambda h: (((h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) >> np.uint64(12)) % np.uint64(BUCKETS)
    n3, n4 = np.maximum(sizes - 2, 0), np.maximum(sizes - 3, 0)
    count = n3 + n4  # a word has a character at least, so it has a trigram
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(words)), count)
    nth = np.arange(int(count.sum())) - begin[owner]
    is3 = nth < n3[owner]
    at = starts[owner] + np.where(is3, nth, nth - n3[owner])
    return np.where(is3, mix(tri)[at], mix(four)[at]).astype(np.int64), begin


def word_buckets(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words], dtype=np.int64)


def windows_of(ids: np.ndarray) -> np.ndarray:
    """All windows of one text, WINDOW ids each; the last one ends with the text, short texts are padded with -1."""
    n = len(ids)
    if n <= WINDOW:
        return np.concatenate([ids, np.full(WINDOW - n, -1, ids.dtype)])[None, :]
    starts = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)
    return ids[starts[:, None] + np.arange(WINDOW)]


@dataclass
class Network:
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    _known: dict[str, int] = field(default_factory=dict, repr=False)
    _inputs: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r, k = np.random.default_rng(seed), WIDTH
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        return cls(
            {
                "word": np.zeros((BUCKETS, k), np.float32), "char": np.zeros((BUCKETS, k), np.float32), "wx": f(2, 2 * k, 3 * k), "u": f(2, k, 3 * k),
                "b": np.zeros((2, 1, 3 * k), np.float32), "v": np.zeros(2 * k, np.float32), "w": f(2 * k, 1)[:, 0], "bo": np.zeros(1, np.float32),
            }
        )

    def forget(self) -> None:
        """Empty the store of inputs, which isn't to be sent to tasks."""
        self._known, self._inputs = {}, None

    def embed(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        grams, begin = char_grams(words)
        count = np.diff(np.append(begin, len(grams)))
        buckets = word_buckets(words)
        chars = np.add.reduceat(self.p["char"][grams], begin, axis=0) / np.sqrt(count)[:, None]
        return np.concatenate([self.p["word"][buckets], chars.astype(np.float32)], axis=1), (buckets, grams, count)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Row of each word in ``_inputs``, the words' projected inputs; new words are added."""
        known = self._known
        if len(known) > MOST_WORDS or self._inputs is None:
            known.clear()
            self._inputs = np.empty((1 << 14, 2, 3 * WIDTH), np.float32)
        new = list({w for w in words if w not in known})
        if new:
            x, _ = self.embed(new)
            rows = np.swapaxes(x @ self.p["wx"] + self.p["b"], 0, 1)
            while len(known) + len(new) > len(self._inputs):
                self._inputs = np.concatenate([self._inputs, np.empty_like(self._inputs)])
            self._inputs[len(known) : len(known) + len(new)] = rows
            known.update(zip(new, range(len(known), len(known) + len(new))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def run(self, inputs: np.ndarray, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows of rows of ``inputs`` (rows, 2, 3*WIDTH); ``keep`` gets what the gradient needs."""
        n, k, u = len(windows), WIDTH, self.p["u"]
        mask = windows >= 0
        padded = not mask.all()
        forward, backward = inputs[:, 0], inputs[:, 1]
        h = np.zeros((2, n, k), np.float32)
        states = np.zeros((WINDOW, 2, n, k), np.float32)
        for t in range(WINDOW):
            x = np.stack([forward[windows[:, t]], backward[windows[:, WINDOW - 1 - t]]])
            a = h @ u
            an = a[:, :, 2 * k :]
            zr = x[:, :, : 2 * k]
            zr += a[:, :, : 2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1.0
            zr *= 0.5
            z, r = zr[:, :, :k], zr[:, :, k:]
            c = r * an
            c += x[:, :, 2 * k :]
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            if padded:
                m = np.stack([mask[:, t], mask[:, WINDOW - 1 - t]])[:, :, None]
                new = np.where(m, new, h)
            if keep is not None:
                keep.append((h, z, r, c, an))
            h = new
            states[t, 0], states[WINDOW - 1 - t, 1] = h[0], h[1]
        both = np.concatenate([states[:, 0], states[:, 1]], axis=2)  # (WINDOW, n, 2k)
        s = both @ self.p["v"]
        s[~mask.T] = -30.0
        e = np.exp(s - s.max(axis=0))
        att = e / e.sum(axis=0)
        pooled = (att[:, :, None] * both).sum(axis=0)
        if keep is not None:
            keep.append((both, att, pooled, mask))
        return pooled @ self.p["w"] + self.p["bo"][0]

    def gradients(self, words: list[str], windows: np.ndarray, labels: np.ndarray, drop: np.ndarray) -> tuple[dict, tuple]:
        """Gradients of the mean logistic loss; ``drop`` (words, 2) scales each word's two embeddings."""
        k, p = WIDTH, self.p
        x, (buckets, grams, count) = self.embed(words)
        x *= np.repeat(drop, k, axis=1)
        inputs = np.swapaxes(x @ p["wx"] + p["b"], 0, 1)
        kept: list = []
        logit = self.run(inputs, windows, kept)
        both, att, pooled, mask = kept.pop()
        weight = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
        d_logit = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * weight).astype(np.float32)
        g = {"w": pooled.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["w"]
        d_att = (d_pool * both).sum(axis=2)
        d_s = att * (d_att - (att * d_att).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", d_s, both)
        d_both = att[:, :, None] * d_pool + d_s[:, :, None] * p["v"]
        d_in = np.zeros_like(inputs)
        d_h, d_u = np.zeros((2, len(windows), k), np.float32), np.zeros_like(p["u"])
        for t in reversed(range(WINDOW)):
            h, z, r, c, an = kept[t]
            m = np.stack([mask[:, t], mask[:, WINDOW - 1 - t]])[:, :, None]
            d = d_h + np.stack([d_both[t, :, :k], d_both[WINDOW - 1 - t, :, k:]])
            dm = d * m
            dc = dm * (1 - z) * (1 - c * c)
            dz = dm * (h - c) * z * (1 - z)
            dr = dc * an * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r], axis=2)
            dx = np.concatenate([dz, dr, dc], axis=2)
            for way, col in ((0, t), (1, WINDOW - 1 - t)):
                here = mask[:, col]
                np.add.at(d_in, (windows[here, col], way), dx[way][here])
            d_u += np.swapaxes(h, 1, 2) @ da
            d_h = d * ~m + dm * z + da @ np.swapaxes(p["u"], 1, 2)
        g["u"], g["b"] = d_u, d_in.sum(axis=0)[:, None, :]
        d_pre = np.swapaxes(d_in, 0, 1)
        g["wx"] = np.swapaxes(x[None], 1, 2) @ d_pre
        d_x = (d_pre @ np.swapaxes(p["wx"], 1, 2)).sum(axis=0)
        d_x *= np.repeat(drop, k, axis=1)
        d_char = np.repeat(d_x[:, k:] / np.sqrt(count)[:, None], count, axis=0)
        return g, (buckets, d_x[:, :k], grams, d_char)

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))

    def text_logits(self, texts: list[str | None], most_words: int = 60_000, batch: int = 2048) -> np.ndarray:
        """The largest logit over all overlapping windows of each whole text."""
        out, held, owners, size = np.full(len(texts), -np.inf, np.float32), [], [], 0

        def flush() -> None:
            if held:
                w, o = np.concatenate(held), np.concatenate(owners)
                for at in range(0, len(w), batch):
                    np.maximum.at(out, o[at : at + batch], self.run(self._inputs, w[at : at + batch]))
                held.clear()
                owners.clear()

        for i, text in enumerate(texts):
            words = tokens(text)
            if size > most_words or len(self._known) + len(words) > MOST_WORDS:
                flush()  # the store of inputs may be started afresh now
                size = 0
            if not words:
                self.lookup(["\x02"])
                held.append(np.full((1, WINDOW), -1, np.int64))
                owners.append(np.array([i]))
                continue
            step = 200_000  # words of one very long text at a time, windows overlapping across the cut
            for at in range(0, len(words), step):
                w = windows_of(self.lookup(words[max(0, at - WINDOW) : at + step]))
                held.append(w)
                owners.append(np.full(len(w), i))
                size += w.size // 2
                if len(words) > step:
                    flush()
        flush()
        return out


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: dict[str, np.ndarray], rows: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.t += 1
        fix = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self._move(k, slice(None), g, fix)
        for k, (at, g) in rows.items():
            some, inverse = np.unique(at, return_inverse=True)
            total = np.zeros((len(some), g.shape[1]), np.float32)
            np.add.at(total, inverse, g)
            self._move(k, some, total, fix)

    def _move(self, k: str, at, g: np.ndarray, fix: float) -> None:
        self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
        self.s[k][at] = 0.999 * self.s[k][at] + 0.001 * g * g
        self.p[k][at] -= fix * self.m[k][at] / (np.sqrt(self.s[k][at]) + 1e-8)


def fit(texts: list[str], labels: np.ndarray, epochs: int = 14, batch: int = 96, steps: int = 300, rate: float = 0.02, seed: int = 7) -> Network:
    """Multiple-instance training: of a positive text the window that scores highest now counts as positive (at
    first one with words that positive texts have more often), of a negative text its highest and a random window count as negative. Small samples
    are gone through more often: ``steps`` updates at least. Scores are uncalibrated; see ``platt``. Without texts, or
    with one label only, all windows have the logit 0 and the shift is the smoothed log odds of the label, below 0.
    """
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    if not len(texts) or labels.sum() in (0, len(labels)):
        net.p["w"][:] = 0
        net.shift = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 1.5)))
        return net
    words = [tokens(t) for t in texts]
    place = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws} | {"\x02"}))}
    vocabulary = list(place)
    wins = [windows_of(np.array([place[w] for w in ws], dtype=np.int64)) for ws in words]
    fit_on = list(range(len(texts)))
    # Words and n-grams of a few texts would be learned by heart: their embeddings stay zero.
    # The rest give each word a log odds of standing in positive texts. It starts no weight: it only picks the windows
    # of long positive texts in the first epochs, until the network can.
    odds, common, taught = _word_odds(vocabulary, [np.unique(w[w >= 0]) for w in wins], labels)
    top = {i: np.where(wins[i] >= 0, odds[wins[i]], -1.0).max(axis=1) for i in fit_on if labels[i]}
    first = {i: np.flatnonzero(x >= x.max() - 1.0) for i, x in top.items()}
    adam = Adam(net.p, rate)
    windows = sum(1 if labels[i] else 2 for i in fit_on)
    epochs = max(epochs, -(-steps * batch // windows))
    for epoch in range(epochs):
        best = _best_windows(net, vocabulary, wins, fit_on) if epoch >= max(2, epochs // 5) else {}
        chosen, target = [], []
        for i in fit_on:
            n = len(wins[i])
            if labels[i]:
                picks = [best.get(i, int(r.choice(first[i])))]
            else:
                picks = [int(r.integers(n)), *([best[i]] if i in best else [int(r.integers(n))])]
            for w in picks:
                chosen.append(wins[i][w])
                target.append(labels[i])
        order = r.permutation(len(chosen))
        adam.rate = rate * (1 - epoch / epochs) + 1e-3
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            w = np.stack([chosen[j] for j in part])
            used, inverse = np.unique(w, return_inverse=True)
            inverse = inverse.reshape(w.shape)
            if used[0] == -1:
                used, inverse = used[1:], inverse - 1
            if not len(used):
                continue
            # Now a word loses its own embedding, now its characters, now both: neither is leaned on alone.
            there = r.random((len(used), 1)) > 0.05
            drop = ((r.random((len(used), 2)) > (0.3, 0.1)) & there).astype(np.float32)
            drop[:, 0] *= common[used]
            grads, (wb, dw, cb, dc) = net.gradients([vocabulary[j] for j in used], inverse, np.array([target[j] for j in part], np.float32), drop)
            for k in ("wx", "u", "w"):
                grads[k] = grads[k] + 1e-4 * net.p[k]
            adam.step(grads, {"word": (wb, dw), "char": (cb, dc * taught[cb][:, None])})
    return net


def _word_odds(vocabulary: list[str], sets: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's highest log odds, its own or an n-gram's; whether enough texts have it; the same of n-gram buckets."""
    grams, begin = char_grams(vocabulary)
    ends = np.append(begin[1:], len(grams))
    n = np.array([(labels == c).sum() for c in (0, 1)])
    words, chars = np.zeros((2, len(vocabulary))), np.zeros((2, BUCKETS))
    for s, label in zip(sets, labels):
        words[int(label), s] += 1
        if len(s):
            chars[int(label), np.unique(np.concatenate([grams[begin[w] : ends[w]] for w in s]))] += 1

    def log_odds(df: np.ndarray) -> np.ndarray:
        return np.where(df[1] >= 2, np.log((df[1] + 0.1) / (n[1] + 1)) - np.log((df[0] + 0.1) / (n[0] + 1)) + 0.5 * np.log1p(df[1]), -9.0)

    best = np.maximum(log_odds(words), np.maximum.reduceat(log_odds(chars)[grams], begin) - 0.5)
    return best, words.sum(axis=0) >= FEWEST_TEXTS, (chars.sum(axis=0) >= FEWEST_TEXTS).astype(np.float32)


def _best_windows(net: Network, vocabulary: list[str], wins: list[np.ndarray], rows: list[int]) -> dict[int, int]:
    x, _ = net.embed(vocabulary)
    inputs = np.swapaxes(x @ net.p["wx"] + net.p["b"], 0, 1)
    every, sizes = np.concatenate([wins[i] for i in rows]), [len(wins[i]) for i in rows]
    logits = np.concatenate([net.run(inputs, every[at : at + 2048]) for at in range(0, len(every), 2048)])
    ends = np.cumsum(sizes)
    return {i: int(logits[e - n : e].argmax()) for i, n, e in zip(rows, sizes, ends)}


def platt(net: Network, z: np.ndarray, y: np.ndarray, rounds: int = 60, prior: float = 0.1) -> None:
    """Set the network's scale and shift so that scores of these logits are probabilities.

    Both are drawn toward what they were with the weight ``prior``, which many rows outweigh: few rows, none, or rows of
    one label only move them little.
    """
    z, target = z.astype(np.float64), np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = a0, b0 = net.scale, net.shift
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((target - p) * z).sum() - prior * (a - a0), (target - p).sum() - prior * (b - b0)
        haa, hab, hbb = (w * z * z).sum() + prior, (w * z).sum(), w.sum() + prior
        det = haa * hbb - hab * hab
        a, b = a + np.clip((hbb * ga - hab * gb) / det, -0.5, 0.5), b + np.clip((haa * gb - hab * ga) / det, -1, 1)
    net.scale, net.shift = float(max(a, 1e-3)), float(b)
