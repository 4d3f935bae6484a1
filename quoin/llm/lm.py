"""Document likelihoods by a gated recurrent language model, trained here in numpy.

The vocabulary is counted over all documents: the ``words`` most frequent tokens
and all others that occur at least ``least`` times, so that it grows with the corpus,
in classes of up to ``SIDE`` words of like frequency and groups of classes; the output
softmax factors into the group, the class within it and the word within that, so that
the outputs of a token grow with the cube root of the vocabulary. All documents are shuffled to shards of token streams;
training passes over them once, in ``rounds`` parts by a hash of the text. A shard has
at least ``WORD_TOKENS`` tokens for each word, so that the weights that shards send stay
less than the tokens; it is read in bounded pieces. In each round
every shard trains on its part from the common weights by truncated backpropagation over
windows of ``window`` steps, the state carried from window to window, and the
shards' weights are averaged by key in Spark; a window's gradient stops at its
start. Scoring reads every document whole: documents of a batch advance together,
window by window, and each carries its state from its first token to its last.

Semantics
  * A token is a run of letters and digits, lower-cased. Tokens out of the
    vocabulary are one word, "unknown", for the network; their probability is that
    of "unknown" times that of their spelling, by the pairs of characters (or start
    and end) of all unknown tokens of the corpus, smoothed by single characters and
    these by all code points. log_likelihood is the sum of the natural
    logs of the probabilities of all tokens of the document, each given all before
    it; per_token divides it by n_tokens.
  * One row per row of the input, repeated ones included (they score alike). A
    null text has null figures; a text without tokens 0 tokens, log_likelihood 0
    and null per_token. An empty corpus gives no rows; one without tokens trains
    nothing. Ties of counts are broken by the word. Extra columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import written

LEAST = 50
WORDS, HIDDEN, WINDOW, LANES, ROUNDS = 4000, 16, 20, 256, 3
#: Tokens that a shard trains on at once; shards grow in number.
SHARD_TOKENS, LANE_TOKENS, WORD_TOKENS = 1_600_000, 1000, 100
#: Rows whose outputs by class are worked on at once, so that they stay in the processor's cache.
CACHED = 1024
#: Words of a class; a class that more rows ask for is multiplied by itself, others together, so many at once.
SIDE, MANY, TOGETHER = 32, 32, 256
#: Numbers of a matrix that are updated at once.
UPDATED = 50_000


def counter():
    """Documents to the distinct tokens of a batch with their counts."""

    def run(batches):
        for batch in tokens.bounded(batches):
            ids, _, words = tokens.encode(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"word": words.cast(pa.string()), "n": pa.array(np.bincount(ids, minlength=len(words)).astype(np.int64))})

    return run


def pairs_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first << 32 | second, number of the word) of all pairs of characters of words; the start and end of a word are 0, characters count from 1."""
    marked = pc.binary_join_element_wise(words.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("", pa.large_string()))
    size = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    offs = np.frombuffer(marked.buffers()[1], np.int64)
    text = bytes(memoryview(marked.buffers()[2] or b"")[offs[marked.offset] : offs[marked.offset + len(marked)]]).decode("utf-8", "surrogatepass")
    ends = np.concatenate(([0], np.cumsum(size)))
    code = np.zeros(int(ends[-1]) + len(size) + 1, np.int64)
    # a mark before each word, and one at the end
    owner = np.repeat(np.arange(len(size)), size)
    code[np.arange(int(ends[-1])) + owner + 1] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    return code[:-1] << 32 | code[1:], np.repeat(np.arange(len(size)), size + 1)


def spelling_counter(shared):
    """Words and their counts to the pairs of characters of the unknown ones."""

    def run(batches):
        for batch in tokens.bounded(batches, "word"):
            rare = pc.is_null(pc.index_in(batch.column("word").cast(pa.large_string()), value_set=shared.value))
            words, n = batch.column("word").filter(rare), batch.column("n").filter(rare).to_numpy()
            codes, of = pairs_of(words)
            found, at = np.unique(codes, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(found, pa.int64()), "n": pa.array(np.bincount(at, n[of], len(found)).astype(np.int64))})

    return run


class Spelling:
    """Probabilities of words by their pairs of characters."""

    def __init__(self, pairs: dict[int, int]):
        self.keys = np.array(sorted(pairs), np.int64)
        self.counts = np.array([pairs[k] for k in self.keys.tolist()], np.float64)
        self.before, self.n_before = self._sums(self.keys >> 32)
        self.after, self.n_after = self._sums(self.keys & 0xFFFFFFFF)
        self.total = float(self.counts.sum())

    def _sums(self, key: np.ndarray):
        found, at = np.unique(key, return_inverse=True)
        return found, np.bincount(at, self.counts, len(found))

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def logs(self, words: pa.Array) -> np.ndarray:
        """Natural logs of the probabilities of words."""
        codes, of = pairs_of(words)
        single = (self._found(self.after, self.n_after, codes & 0xFFFFFFFF) + 1 / 0x110001) / (self.total + 1)
        p = (self._found(self.keys, self.counts, codes) + single) / (self._found(self.before, self.n_before, codes >> 32) + 1)
        return np.bincount(of, np.log(p), len(words))

    def log(self, word: str) -> float:
        return float(self.logs(pa.array([word], pa.large_string()))[0])


def classes_of(counts: np.ndarray) -> np.ndarray:
    """First word of each class, and the end: words are in order of frequency, classes of ``SIDE`` words, fewer if words are few; the last, "unknown", is alone."""
    known = len(counts) - 1
    size = min(SIDE, max(1, round(known**0.5)))
    return np.unique(np.concatenate((np.arange(0, known, size), [0, known, known + 1]))).astype(np.int64)


def groups_of(mass: np.ndarray) -> np.ndarray | None:
    """First class of each group of classes, and the end, by the counts of classes; the last is alone. None if classes are few: then they are one group."""
    known = len(mass) - 1
    if known <= SIDE:
        return None
    k = round((known / 2) ** 0.5)
    total = np.cumsum(np.sqrt(mass[:-1] + 1.0))
    return np.unique(np.concatenate(([0], np.searchsorted(total, total[-1] * np.arange(1, k) / k), [known, known + 1]))).astype(np.int64)


def start(words: int, classes: int, hidden: int, seed: int = 1, groups: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"emb": (words + 1, hidden), "wx": (hidden, 3 * hidden), "wh": (hidden, 3 * hidden), "b": (3 * hidden,), "wc": (hidden, classes), "bc": (classes,), "ww": (words, hidden), "bw": (words,)}
    shapes |= {"wg": (hidden, groups), "bg": (groups,)} if groups else {}
    return {n: (rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for n, s in shapes.items()}


def sigmoid(x):
    out = np.minimum(-x, 60)
    np.exp(out, out=out)
    out += 1
    return np.divide(1, out, out=out)


def cell(p, x, h, i=None):
    """One step of the gated unit: (new state, what backpropagation needs); ``i`` is what the input gives, if it is known."""
    d = h.shape[1]
    if i is None:
        i = x @ p["wx"] + p["b"]
    gates = h @ p["wh"][:, : 2 * d]
    gates += i[:, : 2 * d]
    gates = sigmoid(gates)
    z, r = gates[:, :d], gates[:, d:]
    rh = r * h
    c = rh @ p["wh"][:, 2 * d :]
    c += i[:, 2 * d :]
    c = np.tanh(c, out=c)
    new = c - h
    new *= z
    new += h
    return new, (x, h, z, r, rh, c)


def softmax_log(x):
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def shifted(x):
    """Rows of outputs, moved by their greatest ones if exponentials of some would be too large or small; x may be overwritten."""
    if not (x.max() < 60 and x.min() > -60):
        x -= x.max(-1, keepdims=True)
    return x


def sums(x):
    return x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)


def log_picked(x, at):
    """The log of the softmax of each row at one place; x is overwritten."""
    x = shifted(x)
    own = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return own - np.log(sums(x))


def runs_of(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, firsts and ends of the runs of sorted integers."""
    at = np.flatnonzero(np.diff(k, prepend=-1))
    return k[at], at, np.append(at[1:], len(k))


def spans(k: np.ndarray) -> list[tuple[int, int, int]]:
    return list(zip(*(x.tolist() for x in runs_of(k))))


def shared_out(k: np.ndarray, n: int):
    """Runs of sorted classes: (those of few rows of the first n classes, the others)."""
    runs = runs_of(k)
    few = (runs[2] - runs[1] <= MANY) & (runs[0] < n)
    return tuple(x[few] for x in runs), list(zip(*(x[~few].tolist() for x in runs)))


def ordered(k: np.ndarray, most: int) -> np.ndarray:
    """The order of integers below ``most``."""
    return np.argsort(k.astype(np.uint16) if most < 65_536 else k, kind="stable")


def even(cuts: np.ndarray) -> tuple[int, int]:
    """(number, size) of the first classes, which are of one size."""
    size = np.diff(cuts)
    return int(np.argmax(np.append(size != size[0], True))), int(size[0])


def blocks(x: np.ndarray, n: int, size: int) -> np.ndarray:
    """The rows of the first classes, class by class."""
    return x[: n * size].reshape(n, size, *x.shape[1:])


def gathered(k: np.ndarray, first: np.ndarray, end: np.ndarray):
    """Classes with runs of few rows each, those of about as many together: (classes, places for rows in each, rows, class and place of each)."""
    n = end - first
    width = np.maximum(2, 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        for a in range(0, len(own), TOGETHER):
            c = own[a : a + TOGETHER]
            at = np.repeat(np.arange(len(c)), n[c])
            slot = np.arange(len(at)) - np.repeat(np.cumsum(n[c]) - n[c], n[c])
            yield k[c], w, first[c][at] + slot, at, slot


def log_probability(p, cuts, of, h, word, groups=None):
    """ln P(word | state), by the group of the class, if there are groups, by the class and by the word within its class."""
    order = ordered(of[word], len(cuts))
    h, word = h[order], word[order]
    k = of[word]
    top = k if groups is None else np.repeat(np.arange(len(groups) - 1), np.diff(groups))[k]
    w, b = ("wc", "bc") if groups is None else ("wg", "bg")
    out = np.empty(len(k))
    for a in range(0, len(k), CACHED):
        x = h[a : a + CACHED] @ p[w]
        x += p[b]
        out[a : a + CACHED] = log_picked(x, top[a : a + CACHED])
    for g, i, j in [] if groups is None else spans(top):
        s, e = groups[g], groups[g + 1]
        for a in range(i, j, CACHED) if e - s > 1 else ():
            to = min(j, a + CACHED)
            x = h[a:to] @ p["wc"][:, s:e]
            x += p["bc"][s:e]
            out[a:to] += log_picked(x, k[a:to] - s)
    n, size = even(cuts)
    few, many = shared_out(k, n)
    for c, i, j in many:
        s, e = cuts[c], cuts[c + 1]
        for a in range(i, j, CACHED) if e - s > 1 else ():
            to = min(j, a + CACHED)
            x = h[a:to] @ p["ww"][s:e].T
            x += p["bw"][s:e]
            out[a:to] += log_picked(x, word[a:to] - s)
    weights, bias = blocks(p["ww"], n, size), blocks(p["bw"], n, size)
    for classes, width, rows, at, slot in gathered(*few):
        own = np.zeros((len(classes), width, h.shape[1]), h.dtype)
        own[at, slot] = h[rows]
        x = own @ weights[classes].transpose(0, 2, 1)
        x += bias[classes][:, None]
        out[rows] += log_picked(x[at, slot], word[rows] - cuts[k[rows]])
    total = np.empty(len(k))
    total[order] = out
    return total


def errors(h, weights, bias, at, g_weights, g_bias):
    """The gradient of states, by softmax outputs of which those of ``at`` are right; adds those of the outputs."""
    y = h @ weights
    y += bias
    y = np.exp(shifted(y), out=y)
    # the softmax is y / total, so that the rows of few numbers are divided
    total = sums(y)
    y[np.arange(len(y)), at] -= total
    share = 1 / total
    g_weights += (h * share[:, None]).T @ y
    g_bias += share @ y
    out = y @ weights.T
    out *= share[:, None]
    return out


def backward(p, cuts, of, steps, g, groups=None):
    """Adds the gradients of a window; ``steps`` has (cell's memory, new state, target, previous word, live) of each step."""
    dh = np.zeros_like(steps[0][1])
    lanes, d = dh.shape
    # the outputs of all steps at once, class by class
    states = np.concatenate([h for _, h, _, _, _ in steps])
    douts = np.zeros_like(states)
    rows_all = np.flatnonzero(np.concatenate([live for _, _, _, _, live in steps]))
    if len(rows_all):
        w = np.concatenate([word for _, _, word, _, _ in steps])[rows_all]
        order = ordered(of[w], len(cuts))
        rows_all, w = rows_all[order], w[order]
        hw, k = states[rows_all], of[w]
        do = np.empty_like(hw)
        top = k if groups is None else np.repeat(np.arange(len(groups) - 1), np.diff(groups))[k]
        m, n = ("wc", "bc") if groups is None else ("wg", "bg")
        for a in range(0, len(w), CACHED):
            do[a : a + CACHED] = errors(hw[a : a + CACHED], p[m], p[n], top[a : a + CACHED], g[m], g[n])
        for c, i, j in [] if groups is None else spans(top):
            s, e = groups[c], groups[c + 1]
            if e - s > 1:
                do[i:j] += errors(hw[i:j], p["wc"][:, s:e], p["bc"][s:e], k[i:j] - s, g["wc"][:, s:e], g["bc"][s:e])
        n, size = even(cuts)
        few, many = shared_out(k, n)
        for c, i, j in many:
            s, e = cuts[c], cuts[c + 1]
            if e - s > 1:
                do[i:j] += errors(hw[i:j], p["ww"][s:e].T, p["bw"][s:e], w[i:j] - s, g["ww"][s:e].T, g["bw"][s:e])
        all_weights, bias, g_weights, g_bias = (blocks(x[name], n, size) for x in (p, g) for name in ("ww", "bw"))
        for classes, width, rows, at, slot in gathered(*few):
            own = np.zeros((len(classes), width, d), hw.dtype)
            own[at, slot] = hw[rows]
            weights = all_weights[classes]
            y = own @ weights.transpose(0, 2, 1)
            y += bias[classes][:, None]
            y = np.exp(shifted(y), out=y)
            total = sums(y).reshape(y.shape[:2])
            y[at, slot, w[rows] - cuts[k[rows]]] -= total[at, slot]
            # places without a row give no gradient
            share = np.zeros_like(total)
            share[at, slot] = 1 / total[at, slot]
            own *= share[:, :, None]
            g_weights[classes] += y.transpose(0, 2, 1) @ own
            g_bias[classes] += (share[:, None] @ y)[:, 0]
            y = y @ weights
            y *= share[:, :, None]
            do[rows] += y[at, slot]
        douts[rows_all] = do
    x, h0, z, r, rh, c = (np.stack([m[k] for m, _, _, _, _ in steps]) for k in range(6))
    keep = 1 - z
    by_c, by_z, by_r = z * (1 - c * c), (c - h0) * z * keep, h0 * r * (1 - r)
    whole = np.empty((len(steps), lanes, 3 * d), states.dtype)
    wh_c, wh_g = p["wh"][:, 2 * d :].T, p["wh"][:, : 2 * d].T
    for t in range(len(steps) - 1, -1, -1):
        dh += douts[t * lanes : (t + 1) * lanes]
        dc = np.multiply(dh, by_c[t], out=whole[t, :, 2 * d :])
        drh = dc @ wh_c
        np.multiply(dh, by_z[t], out=whole[t, :, :d])
        np.multiply(drh, by_r[t], out=whole[t, :, d : 2 * d])
        dh *= keep[t]
        drh *= r[t]
        dh += drh
        dh += whole[t, :, : 2 * d] @ wh_g
    whole = whole.reshape(-1, 3 * d)
    x, h0, rh = (m.reshape(-1, d) for m in (x, h0, rh))
    g["wh"][:, : 2 * d] += h0.T @ whole[:, : 2 * d]
    g["wh"][:, 2 * d :] += rh.T @ whole[:, 2 * d :]
    g["wx"] += x.T @ whole
    g["b"] += whole.sum(0)
    prev = np.concatenate([x for _, _, _, x, _ in steps])
    order = np.argsort(prev, kind="stable")
    cut = np.flatnonzero(np.diff(prev[order], prepend=-1))
    g["emb"][prev[order][cut]] += np.add.reduceat((whole @ p["wx"].T)[order], cut)


def fit_stream(p, cuts, of, stream, fresh, window=WINDOW, lanes=LANES, rate=0.2, seen=None, groups=None):
    """Trains on a token stream, cut into parallel lanes; ``fresh`` marks first tokens, before which the state is 0."""
    # a lane has LANE_TOKENS at least, so that short streams make enough steps
    words, lanes = len(of), max(1, min(lanes, len(stream) // LANE_TOKENS))
    n = -(-len(stream) // lanes)
    # what the last lane lacks is no target
    x, f, real = np.zeros(lanes * n, np.int64), np.ones(lanes * n, bool), np.arange(lanes * n) < len(stream)
    x[: len(stream)], f[: len(stream)] = stream, fresh
    x, f, real = x.reshape(lanes, n), f.reshape(lanes, n), real.reshape(lanes, n)
    h = np.zeros((lanes, p["wh"].shape[0]), p["wh"].dtype)
    seen = {k: np.full_like(v, 1e-3) for k, v in p.items()} if seen is None else seen
    before = np.full(lanes, words)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    n_even, size = even(cuts)
    # the words before, step by step; a step's lanes lie side by side
    x, f, real = (np.ascontiguousarray(v.T) for v in (x, f, real))
    previous = np.where(f, words, np.concatenate((before[None], x[:-1])))
    for a in range(0, n, window):
        steps, here = [], previous[a : a + window]
        inputs = p["emb"][here]
        gates = inputs @ p["wx"]
        gates += p["b"]
        for t in range(a, min(a + window, n)):
            h[f[t]] = 0
            new, memory = cell(p, inputs[t - a], h, gates[t - a])
            steps.append((memory, new, x[t], previous[t], real[t]))
            h = new.copy() if t + 1 < n and f[t + 1].any() else new
        backward(p, cuts, of, steps, g, groups)
        # words that the window doesn't touch have no gradient
        targets = np.flatnonzero(np.bincount(of[x[a : a + window].ravel()], minlength=len(cuts) - 1)[:n_even])
        emb = np.unique(here)
        for k in p:
            if k in ("ww", "bw"):
                update(*(blocks(v[k], n_even, size) for v in (p, g, seen)), targets, lanes, rate)
                update(*(v[k][n_even * size :] for v in (p, g, seen)), None, lanes, rate)
            else:
                update(p[k], g[k], seen[k], emb if k == "emb" else None, lanes, rate)
    return p


def update(p, g, seen, at, lanes, rate):
    """Takes a step by a matrix's gradient, which is 0 but at ``at``, and sets it to 0; so many numbers at once that they stay in the processor's cache."""
    # what has no gradient stays as it is in a whole update too, which copies nothing
    whole = at is None or 2 * len(at) > len(p)
    some = max(1, UPDATED * len(p) // max(1, p.size))
    for a in range(0, len(p) if whole else len(at), some):
        rows = slice(a, a + some) if whole else at[a : a + some]
        d, s = g[rows], seen[rows]
        d /= lanes
        np.clip(d, -1, 1, out=d)
        s += d * d
        d *= rate
        d /= np.sqrt(s)
        p[rows] -= d
        g[rows] = 0
        if not whole:
            seen[rows] = s


def score(p, cuts, of, ids: np.ndarray, offsets: np.ndarray, groups=None) -> np.ndarray:
    """Log-likelihood of each document of a batch: all advance together, the long ones go on alone."""
    words = len(of)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    total = np.zeros(len(size))
    h = np.zeros((len(size), p["wh"].shape[0]), np.float32)
    live = int((size > 0).sum())
    prev = np.full(len(size), words)
    t, first = 0, offsets[:-1][order]
    negative = -size[order]
    emb = p["emb"] @ p["wx"] + p["b"]
    held_h, held_w, held_who, held = [], [], [], 0
    while live:
        now = ids[first[:live] + t]
        new, _ = cell(p, None, h[:live], emb[prev[:live]])
        h[:live] = new
        held_h.append(new)
        held_w.append(now)
        held_who.append(order[:live])
        held += live
        prev[:live] = now
        t += 1
        live = int(np.searchsorted(negative, -t, "left"))
        # states of a window of steps are scored at once
        if held > 100_000 or not live:
            total += np.bincount(np.concatenate(held_who), log_probability(p, cuts, of, np.concatenate(held_h), np.concatenate(held_w), groups), len(total))
            held_h, held_w, held_who, held = [], [], [], 0
    return total


def streamer(shared):
    """Documents to their token ids, packed, the last number for unknown tokens."""

    def run(batches):
        known = shared.value["known"]
        for batch in tokens.bounded(batches):
            ids, offsets, _ = tokens.encode(batch.column("text"), known)
            short = np.where(ids < 0, len(known), ids).astype(np.int32 if len(known) > 65_535 else np.uint16)
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "ids": pa.array([short[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())})

    return run


def trainer(shared, piece: int = SHARD_TOKENS):
    """A shard's streams, read in pieces of so many tokens, to its weights, a row for each matrix."""

    def run(batches):
        model, parts, held, total, p, seen = shared.value, [], 0, 0, None, None

        def learn():
            stream = np.concatenate(parts)
            fresh = np.zeros(len(stream), bool)
            fresh[np.cumsum([0, *map(len, parts[:-1])])] = True
            fit_stream(p, model["cuts"], model["of"], stream, fresh, seen=seen, groups=model["groups"])

        for batch in batches:
            for b in batch.column("ids").to_pylist():
                if not b:
                    continue
                parts.append(np.frombuffer(b, np.int32 if len(model["known"]) > 65_535 else np.uint16).astype(np.int64))
                held += len(parts[-1])
                if held >= piece:
                    if p is None:
                        p = {k: v.copy() for k, v in model["p"].items()}
                        seen = {k: np.full_like(v, 1e-3) for k, v in p.items()}
                    learn()
                    parts, total, held = [], total + held, 0
        if held:
            if p is None:
                p = {k: v.copy() for k, v in model["p"].items()}
                seen = {k: np.full_like(v, 1e-3) for k, v in p.items()}
            learn()
            total += held
        if total:
            for k in p:
                yield pa.RecordBatch.from_pydict({"name": [k], "weight": pa.array([total], pa.int64()), "w": pa.array([p[k].tobytes()], pa.binary())})

    return run


def average(table: pa.Table) -> pa.Table:
    """The mean of a matrix over shards, weighted by their tokens."""
    weight = table.column("weight").to_numpy().astype(np.float64)
    total = sum(np.frombuffer(b, np.float32).astype(np.float64) * w for b, w in zip(table.column("w").to_pylist(), weight))
    return pa.table({"name": [table.column("name")[0].as_py()], "weight": pa.array([int(weight.sum())], pa.int64()), "w": [(total / weight.sum()).astype(np.float32).tobytes()]})


def fit(docs: DataFrame, words: int = WORDS, hidden: int = HIDDEN, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS, least: int = LEAST) -> dict:
    """The model: vocabulary, classes, weights and spelling; it grows with the words that occur ``least`` times."""
    spark = docs.sparkSession
    counts = written(docs.select("text").mapInArrow(counter(), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    all_tokens = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(max(words, counts.filter(F.col("n") >= least).count())).collect()
    known = pa.array([r.word for r in top], pa.large_string())
    pairs = counts.mapInArrow(spelling_counter(spark.sparkContext.broadcast(known)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    spelling = Spelling({r.pair: r.n for r in pairs.collect()})
    n = np.array([*(r.n for r in top), max(1, all_tokens - sum(r.n for r in top))], np.float64)
    cuts = classes_of(n)
    of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    mass = np.add.reduceat(n, cuts[:-1])
    groups = groups_of(mass)
    model = {"known": known, "cuts": cuts, "of": of, "groups": groups, "spelling": spelling, "p": start(len(n), len(cuts) - 1, hidden, groups=0 if groups is None else len(groups) - 1)}
    if not all_tokens:
        return model
    # words start at their frequencies
    model["p"]["bw"] = np.log(n + 1).astype(np.float32)
    model["p"]["bc"] = np.log(mass + 1).astype(np.float32)
    if groups is not None:
        model["p"]["bg"] = np.log(np.add.reduceat(mass, groups[:-1]) + 1).astype(np.float32)
    shared = spark.sparkContext.broadcast(model)
    chosen = docs.filter("text is not null").select(F.xxhash64("text").alias("key"), "text")
    shards = max(1, int(all_tokens / max(shard_tokens, WORD_TOKENS * len(n))))
    part = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(rounds))
    streams = written(chosen.mapInArrow(streamer(shared), "key long, ids binary").withColumn("part", part), "streams")
    schema = "name string, weight long, w binary"
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        trained = streams.filter(F.col("part") == k).repartition(shards, "key").sortWithinPartitions("key").mapInArrow(trainer(shared, shard_tokens), schema)
        # averaged in two steps, so that no task holds the weights of all shards
        salted = trained.withColumn("salt", (F.rand(1) * max(1, shards // 16)).cast("int"))
        rows = salted.groupBy("name", "salt").applyInArrow(average, schema).groupBy("name").applyInArrow(average, schema).collect()
        model = model | {"p": model["p"] | {r.name: np.frombuffer(r.w, np.float32).reshape(model["p"][r.name].shape).copy() for r in rows}}
    return model


def scorer(shared):
    def run(batches):
        model = shared.value
        known = model["known"]
        for batch in tokens.bounded(batches):
            column = batch.column("text")
            raw, offsets, words = tokens.encode(column)
            at = pc.fill_null(pc.index_in(words, value_set=known), len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
            spelt, rare = np.zeros(len(words)), np.flatnonzero(at == len(known))
            spelt[rare] = model["spelling"].logs(words.take(pa.array(rare)))
            total = score(model["p"], model["cuts"], model["of"], at[raw], offsets, model["groups"])
            total += np.bincount(np.repeat(np.arange(len(total)), np.diff(offsets)), spelt[raw], len(total))
            size, null = np.diff(offsets), np.asarray(column.is_null())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(size.astype(np.int64), mask=null),
                    "log_likelihood": pa.array(np.round(total, 3), mask=null),
                    "per_token": pa.array(np.round(total / np.maximum(size, 1), 5), mask=null | (size == 0)),
                }
            )

    return run


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, per_token: see the module's docstring."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return clean.mapInArrow(scorer(shared), "doc_id long, n_tokens long, log_likelihood double, per_token double")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs))
