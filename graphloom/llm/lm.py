"""Language-model scores of whole documents: a gated recurrent network with a class-factored softmax (operator 4).

Tokens are lower-cased words and one end per document. Exact token counts come from all training documents. The most
frequent words are the head; every other word belongs to one of the tail classes, told by its form (last character,
letters beyond ASCII, length). With the network's state h before a token,

    P(token | h) = P(class | h) * P(word | class, h)         for a word of the head (both softmaxes)
    P(token | h) = P(class | h) * (c + 1) / (N_k + V_k + 1)  for a word of tail class k with training count c,

where N_k and V_k are the tokens and distinct words of the class in training: each class keeps one share for unseen
words, as the base score does for all of them. Weights are fitted in numpy by truncated backpropagation through time on
all training documents: each is learned from once, in one of the rounds (by hash), by local steps of each trainer and
averaging between rounds, so the fit grows with the corpus. Scoring carries the state across windows to a document's end; nothing is cut off.

Texts are cut into tokens twice: to count, and to write token codes (two bytes a token), from which the network learns and
scores. Counts of rare words are joined as a distributed table. Sent to tasks: the network (about 1 MB) and the `cached`
most frequent counts (5 MB). Token hashes are 64-bit (the low bits name the tail class).

Defined cases: null and empty texts are an end token alone; null ids never train and are scored as seen; an empty
training set, or one that fits nothing, gives every document the base score as its score; rows with equal ids are
scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore, work

TAILS = 32
END_HASH = 0x456E64 << 8  # not a word's hash but with negligible chance; its class bits are 0
F32 = np.float32
_KIND = np.full(256, 3)  # of last bytes: letters, commas, full stops, others
_KIND[97:123] = _KIND[0x80:] = 0
_KIND[[0x2C, 0x2E]] = 1, 2
_CUE = np.zeros(256, np.int64)  # second bytes of two-byte letters: French, German, Spanish first of all
_CUE[[0xA9, 0xA8, 0xAA, 0xA7, 0xA0, 0xA2, 0xAE, 0xB4, 0xBB, 0xB9]] = 1
_CUE[[0xBC, 0xB6, 0xA4, 0x9F]] = 2
_CUE[[0xB1, 0xB3, 0xAD, 0xA1, 0xBA]] = 3


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token with END_HASH after each document, tokens in each document); low bits: tail class."""
    w = textcore.Words(texts, lower=True)
    n = w.counts()
    out = np.full(len(w) + len(n), END_HASH, np.int64)
    ends = np.cumsum(n + 1) - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    if len(w):
        data = w.data
        cue_at = np.flatnonzero(data[:-1] == 0xC3) + 1  # a letter's second byte, so in the same word
        cue_at = cue_at[_CUE[data[cue_at]] > 0]
        cue = np.zeros(len(w), np.int64)
        np.maximum.at(cue, np.searchsorted(w.start, cue_at, "right") - 1, _CUE[data[cue_at]])
        form = _KIND[data[w.end - 1]] * 8 + cue * 2 + (w.end - w.start > 8)
        out[body] = (w.hashes().view(np.int64) & ~np.int64(TAILS - 1)) | form
    return out, n + 1


class Network:
    """Gated recurrent unit with one gate and a class-factored softmax; weights in one flat array of float32.

    z = sigmoid(x W_z + h U_z), n = tanh(x W_n + h U_n), h' = n + z (h - n): the gate decides how much of the state stays.
    """

    def __init__(self, inputs: int, classes: int, members: int, hidden: int, flat: np.ndarray | None = None):
        self.classes, self.members, self.hidden = classes, members, hidden
        self.shapes = {"x": (inputs, 2 * hidden), "u": (hidden, 2 * hidden), "b": (2 * hidden,), "c": (hidden, classes + TAILS), "cb": (classes + TAILS,), "m": (classes, hidden, members), "mb": (classes, members)}
        size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.flat = np.zeros(size, F32) if flat is None else np.array(flat, F32)
        self.p = self._views(self.flat)

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    def start(self, class_log: np.ndarray, member_log: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        for k in ("x", "u", "c", "m"):
            self.p[k][...] = rng.normal(0, {"x": 0.3, "u": 1 / np.sqrt(self.hidden), "c": 0.05, "m": 0.02}[k], self.shapes[k])
        self.p["b"][: self.hidden] = 1.0  # keep the state at first
        self.p["cb"][...] = class_log - class_log.max()
        self.p["mb"][...] = member_log - member_log.max(axis=1, keepdims=True)

    def run(self, idx: np.ndarray, reset: np.ndarray, h: np.ndarray, gates: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States before each of T x B tokens, and the state after the last; gates (2 x T x B x hidden): gets z and n of each."""
        d, p = self.hidden, self.p
        steps, lanes = idx.shape
        states = np.empty((steps + 1, lanes, d), F32)
        states[0] = h
        # sigmoid(a) = (1 + tanh(a / 2)) / 2, so one tanh serves both; z and n lie apart, so that every array is contiguous
        x, u = _halves(p["x"]), _halves(p["u"])
        x += p["b"].reshape(2, 1, d)
        x[0] *= F32(0.5)
        u[0] *= F32(0.5)
        g, of_input, any_reset = np.empty((2, lanes, d), F32), np.empty((2, lanes, d), F32), reset.any(axis=1)
        for t in range(steps):
            h, after = states[t], states[t + 1]
            if any_reset[t]:
                h[reset[t]] = 0
            if gates is not None:
                g = gates[:, t]
            np.matmul(h, u, out=g)
            np.take(x, idx[t], axis=1, out=of_input, mode="clip")
            g += of_input
            np.tanh(g, out=g)
            z, n = g
            z += F32(1)
            z *= F32(0.5)
            np.subtract(h, n, out=after)
            after *= z
            after += n
        return states[:steps], states[steps].copy()

    def by_class(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(class of each token, order that sorts the tokens by class, cuts between the classes of the head)."""
        heads = self.classes * self.members
        cls = np.where(idx < heads, idx // self.members, idx - heads + self.classes).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        return cls, order, np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()

    def log_probs(self, h: np.ndarray, idx: np.ndarray, grad: dict | None = None, scale: float = 1.0, block: int = 2048) -> np.ndarray:
        """Natural log of P(class | h), times P(word | class, h) for the head, of tokens idx; grad: gets gradients of the
        negative sum times scale, and grad['h'] of the states. `block`: rows worked on at a time, so work arrays stay in cache."""
        p = self.p
        cls, order, cuts = self.by_class(idx)  # the work is done class by class
        heads, rows = cuts[-1], np.take(h, order, axis=0)
        cls, member, got = cls[order], idx[order[:heads]] % self.members, np.empty(len(idx))
        back = None if grad is None else np.empty_like(rows)
        scale = None if grad is None else F32(scale)
        for a in range(0, len(idx), block):
            part = slice(a, a + block)
            e = rows[part] @ p["c"]
            e += p["cb"]
            got[part] = _softmax(e, cls[part], scale)
            if grad is not None:
                grad["c"] += _products(rows[part], e)
                grad["cb"] += np.ones(len(e), F32) @ e
                np.matmul(e, p["c"].T, out=back[part])
        words = np.empty((heads, self.members), F32)
        parts = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        for c, part in parts:
            np.matmul(rows[part], p["m"][c], out=words[part])
            words[part] += p["mb"][c]
        for a in range(0, heads, block):
            part = slice(a, min(a + block, heads))
            got[part] += _softmax(words[part], member[part], scale)
        out = np.empty(len(idx))
        out[order] = got
        if grad is not None:
            for c, part in parts:
                grad["m"][c] += _products(rows[part], words[part])
                grad["mb"][c] += np.ones(part.stop - part.start, F32) @ words[part]
                back[part] += words[part] @ p["m"][c].T
            grad["h"] = np.empty_like(back)
            grad["h"][order] = back
        return out

    def gradient(self, idx: np.ndarray, live: np.ndarray, reset: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(flat gradient of the mean loss of a window, state after it, loss): truncated backpropagation through time."""
        d = self.hidden
        flat = np.zeros_like(self.flat)
        g = self._views(flat)
        gates = np.empty((2, *idx.shape, d), F32)
        states, after = self.run(idx, reset, h, gates)
        use, tokens = live.ravel(), idx.ravel()
        count = max(1, int(use.sum()))
        every = count == idx.size
        flat_states = states.reshape(-1, d)
        loss = -self.log_probs(flat_states if every else flat_states[use], tokens if every else tokens[use], g, 1 / count).sum() / count
        if every:
            dh_out = g.pop("h").reshape(states.shape)
        else:
            dh_out = np.zeros((idx.size, d), F32)
            dh_out[use] = g.pop("h")
            dh_out = dh_out.reshape(states.shape)
        back, any_reset = np.ascontiguousarray(self.p["u"].T), reset.any(axis=1)
        dx, dh, part, keep, through = np.empty((*idx.shape, 2 * d), F32), np.zeros_like(h), np.empty_like(h), np.empty_like(h), np.empty_like(h)
        for t in range(len(idx) - 1, -1, -1):
            z, n = gates[:, t]
            np.subtract(F32(1), z, out=keep)
            keep *= dh
            np.subtract(states[t], n, out=part)
            part *= z
            np.multiply(part, keep, out=dx[t, :, :d])
            dh *= z
            n *= n
            np.subtract(F32(1), n, out=n)
            np.multiply(n, keep, out=dx[t, :, d:])
            g["u"] += states[t].T @ dx[t]
            np.matmul(dx[t], back, out=through)
            dh += through
            dh += dh_out[t]
            if any_reset[t]:
                dh[reset[t]] = 0
        # an input's sum is a product with ones in its column, class by class and with the tails last
        dx = dx.reshape(-1, 2 * d)
        g["b"] += np.ones(len(dx), F32) @ dx
        _, order, cuts = self.by_class(tokens)
        dx, place, width = np.take(dx, order, axis=0), tokens[order], max(self.members, TAILS)
        place[: cuts[-1]] %= self.members
        place[cuts[-1] :] -= self.classes * self.members
        holds = np.zeros((len(place), width), F32)
        holds.reshape(-1)[np.arange(0, holds.size, width) + place] = 1
        for c, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(place)], strict=True)):
            if a < b:
                x = g["x"][c * self.members : (c + 1) * self.members if c < self.classes else None]
                x += _products(holds[a:b, : len(x)], dx[a:b])
        return flat, after, float(loss)


def _halves(x: np.ndarray) -> np.ndarray:
    """A copy of x whose left and right halves of the columns lie one after the other."""
    return np.ascontiguousarray(x.reshape(len(x), 2, -1).transpose(1, 0, 2))


def _products(x: np.ndarray, y: np.ndarray, rows: int = 256) -> np.ndarray:
    """x.T @ y, added up over runs of rows that stay in cache: one product of long, narrow tables takes twice the time."""
    whole = len(x) // rows * rows
    out = x[whole:].T @ y[whole:]
    if whole:
        out += np.matmul(x[:whole].reshape(-1, rows, x.shape[1]).transpose(0, 2, 1), y[:whole].reshape(-1, rows, y.shape[1])).sum(axis=0)
    return out


def _softmax(logits: np.ndarray, which: np.ndarray, scale: float | None) -> np.ndarray:
    """Log of the chosen probability of each row. Replaces logits, with `scale` by their gradient of the negative sum of
    those logs times scale."""
    flat, at = logits.reshape(-1), np.arange(0, logits.size, logits.shape[1]) + which
    if not (logits.max() < 60 and logits.min() > -60):  # far from 0: shifted by the greatest of each row
        logits -= logits.max(axis=1, keepdims=True)
    chosen = flat[at]
    np.exp(logits, out=logits)
    s = logits @ np.ones(logits.shape[1], logits.dtype)
    if scale is not None:
        logits *= (scale / s)[:, None]
        flat[at] -= scale
    return (chosen - np.log(s)).astype(np.float64)


def lanes_of(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to at most `lanes` lanes, longest first to the shortest lane; longest lane first."""
    import heapq

    lanes = max(1, min(lanes, len(sizes)))
    heap = [(0, k) for k in range(lanes)]
    out: list[list[int]] = [[] for _ in range(lanes)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (n + int(sizes[d]), k))
    return sorted((x for x in out if x), key=lambda x: -sum(int(sizes[d]) for d in x))


def windows(off: np.ndarray, lanes: int, steps: int):
    """Cuts documents laid end to end into windows of steps x lanes: (tokens' places, live, reset), lanes shrinking."""
    rows = lanes_of(np.diff(off), lanes)
    place = [np.concatenate([np.arange(off[d], off[d + 1]) for d in lane]) for lane in rows]
    first = [np.concatenate([np.arange(off[d + 1] - off[d]) == 0 for d in lane]) for lane in rows]
    size = np.array([len(x) for x in place])
    for t in range(0, int(size[0]) if len(size) else 0, steps):
        active = int((size > t).sum())
        depth = min(steps, int(size[0]) - t)
        at = np.zeros((depth, active), np.int64)
        live, reset = np.zeros((depth, active), bool), np.zeros((depth, active), bool)
        for k in range(active):
            m = min(depth, int(size[k]) - t)
            at[:m, k] = place[k][t : t + m]
            live[:m, k] = True
            reset[:m, k] = first[k][t : t + m]
        yield at, live, reset


def document_scores(net: Network, idx: np.ndarray, off: np.ndarray, lanes: int = 384, steps: int = 64) -> np.ndarray:
    """Natural log of each document's network part: its state runs from its first token to its last."""
    token = np.zeros(len(idx))
    h = None
    for at, live, reset in windows(off, lanes, steps):
        tokens = idx[at]
        h = np.zeros((at.shape[1], net.hidden), F32) if h is None else h[: at.shape[1]]
        states, h = net.run(tokens, reset, h)
        use = live.ravel()
        token[at.ravel()[use]] = net.log_probs(states.reshape(-1, net.hidden)[use], tokens.ravel()[use])
    sums = np.zeros(len(idx) + 1)
    np.cumsum(token, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def train_local(net: Network, idx: np.ndarray, off: np.ndarray, *, lanes: int | None = None, steps: int = 32, rate: float = 0.005, done: int = 0) -> Network:
    """One pass of Adam over the documents, laid end to end and dealt in equal parts to so many lanes as leave about 250
    updates. A state runs on from window to window and starts anew with each document (and with each lane)."""
    lanes = lanes or max(4, min(256, len(idx) // (250 * steps)))
    each = -(-len(idx) // lanes)
    reset = np.zeros(each * lanes, bool)
    reset[off[:-1]] = True
    live = np.arange(each * lanes) < len(idx)
    tokens = np.concatenate([idx, np.zeros(each * lanes - len(idx), idx.dtype)]).reshape(lanes, each).T
    reset, live = reset.reshape(lanes, each).T.copy(), live.reshape(lanes, each).T
    reset[0] = True
    m, v, h = np.zeros_like(net.flat), np.zeros_like(net.flat), np.zeros((lanes, net.hidden), F32)
    step = F32(rate / (1 + 0.5 * done))
    for k, t in enumerate(range(0, each, steps), 1):
        g, h, _ = net.gradient(np.ascontiguousarray(tokens[t : t + steps]), live[t : t + steps], reset[t : t + steps], h)
        norm = float(np.sqrt(np.dot(g, g)))
        if norm > 1:
            g *= F32(1 / norm)
        for a in range(0, len(g), 1 << 14):  # pieces that stay in cache
            part = slice(a, a + (1 << 14))
            gp, mp, vp = g[part], m[part], v[part]
            mp *= F32(0.9)
            mp += F32(0.1) * gp
            gp *= gp
            vp *= F32(0.99)
            vp += F32(0.01) * gp
            size = np.sqrt(vp)
            size *= F32(1 / np.sqrt(1 - 0.99**k))
            size += F32(1e-8)
            np.divide(mp, size, out=size)
            size *= step / F32(1 - 0.9**k)
            net.flat[part] -= size
    return net


def counts_of(docs: DataFrame, most: int = 3_000_000) -> DataFrame:
    """(h, c): exact counts of all tokens of docs(text); each task sends one row a distinct token (or more than one
    where it holds over `most` of them)."""

    def count(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h = np.concatenate([p[0] for p in parts])
            c = np.concatenate([p[1] for p in parts])
            u, inverse = np.unique(h, return_inverse=True)
            return u, np.bincount(inverse, c, len(u)).astype(np.int64)

        for batch in batches:
            for part in textcore.slices(batch, 0):
                parts.append(np.unique(token_hashes(part.column(0))[0], return_counts=True))
                size += len(parts[-1][0])
            if size > 4_000_000:
                u, c = merged()
                parts, size = [(u, c)], 0
                if len(u) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], ["h", "c"])
                    parts = []
        if parts:
            u, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], ["h", "c"])

    return work.map_arrow(docs.select("text"), count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _order_head(seen: np.ndarray, groups: int = 12) -> np.ndarray:
    """Order of the head words that puts words of like documents together: k-means of co-occurrence with the first words.
    seen: documents that hold each head word (most frequent first) beside each of the first ones."""
    n = len(seen)
    seen = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
    centre = seen[np.linspace(0, n - 1, min(groups, n)).astype(int)].copy()
    for _ in range(15):
        near = np.argmin(((seen[:, None, :] - centre[None]) ** 2).sum(-1), axis=1)
        for g in range(len(centre)):
            if (near == g).any():
                centre[g] = seen[near == g].mean(axis=0)
    return np.lexsort((np.arange(n), near))


def coded(docs: DataFrame, head: np.ndarray, heads: int, known: np.ndarray | None = None, known_count: np.ndarray | None = None) -> DataFrame:
    """docs(doc_id, text) as tokens: (doc_id, n, w, known, sure, sure_tail, tail).

    w: codes of the tokens, a head word's place in `head`, or `heads` + tail class; known: tokens among `known`; sure: the
    sum of log10(count + 1) of those, sure_tail: of those outside the head; tail: hashes of the other tokens.
    """
    known = np.zeros(0, np.int64) if known is None else known
    keys = np.unique(np.concatenate([head, known]).astype(np.int64))
    place, logs = np.full(len(keys) + 1, -1, np.int32), np.full(len(keys) + 1, np.nan)  # the last: of a hash that isn't there
    place[np.searchsorted(keys, head)] = np.arange(len(head))
    if len(known):
        logs[np.searchsorted(keys, known)] = np.log10(known_count + 1.0)
    sent = docs.sparkSession.sparkContext.broadcast((keys, place, logs))
    kind = _code(heads)

    def run(batches):
        keys, place, logs = sent.value
        find = Places(keys)
        for batch in batches:
            for part in textcore.slices(batch, 1):
                h, n = token_hashes(part.column(1))
                off = np.concatenate([[0], np.cumsum(n)])
                at = find(h)
                code, log = place[at].astype(np.int64), logs[at]
                in_head, hit = code >= 0, ~np.isnan(log)
                code = np.where(in_head, code, (h & (TAILS - 1)) + heads)
                log[~hit] = 0
                rest = np.flatnonzero(~hit)
                w = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((off * kind.itemsize).astype(np.int32)), pa.py_buffer(code.astype(kind))])
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, off).astype(np.int32)), pa.array(h[rest]))
                cols = [part.column(0), pa.array(n.astype(np.int64)), w, pa.array(_per_doc(hit, off).astype(np.int64)), pa.array(_per_doc(log, off)), pa.array(_per_doc(np.where(in_head, 0.0, log), off)), tail]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "w", "known", "sure", "sure_tail", "tail"])

    return work.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, w binary, known long, sure double, sure_tail double, tail array<long>")


class Places:
    """Finds the places of hashes among sorted distinct keys, len(keys) for those that aren't there. A table by the first
    bits leads to a key or two of each hash, where a binary search would read eighteen of them."""

    def __init__(self, keys: np.ndarray, bits: int | None = None):
        bits = bits or max(1, len(keys).bit_length())
        self.keys, self.half, self.shift = np.append(keys, np.iinfo(np.int64).max), 1 << (bits - 1), 64 - bits
        self.first = np.searchsorted(keys, np.arange(-self.half, self.half) << self.shift)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at, last = self.first[(h >> self.shift) + self.half], len(self.keys) - 1
        low = np.flatnonzero(self.keys[at] < h)
        for _ in range(64):
            if not len(low):
                break
            at[low] += 1
            low = low[self.keys[at[low]] < h[low]]
        else:  # many keys alike
            at[low] = np.searchsorted(self.keys[:-1], h[low])
        at[self.keys[at] != h] = last
        return at


def _per_doc(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(x) + 1, np.float64)
    np.cumsum(x, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def _code(heads: int) -> np.dtype:
    return np.dtype("<u2" if heads + TAILS <= 1 << 16 else "<i4")


def co_occurrence(rows: DataFrame, n: int, heads: int, anchors: int = 128) -> np.ndarray:
    """Documents of rows(w) that hold head word i (row) and one of the first words j (column), over all rows."""
    anchors, kind = min(anchors, n), _code(heads)

    def count(batches):
        total = np.zeros((n, anchors), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), 256):
                some = texts[a : a + 256]
                code = np.frombuffer(b"".join(some), kind).astype(np.int64)
                doc = np.repeat(np.arange(len(some)), [len(x) // kind.itemsize for x in some])
                holds = np.zeros((len(some), n), F32)
                holds[doc[code < n], code[code < n]] = 1
                total += (holds.T @ holds[:, :anchors]).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["pair", "c"])

    sums = work.map_arrow(rows.select("w"), count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # at most n * anchors rows
    out = np.zeros(n * anchors)
    out[sums["pair"].to_numpy()] = sums["c"].to_numpy()
    return out.reshape(n, anchors)


def tail_counts(counts: DataFrame, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(tokens, distinct words) of each tail class without the head words h of counts c; all tokens, all distinct words."""
    tokens, words = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.groupBy(F.col("h").bitwiseAND(TAILS - 1).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r.k], words[r.k] = r.n, r.v
    total, distinct = int(tokens.sum()), int(words.sum())
    np.subtract.at(tokens, h & (TAILS - 1), c)
    np.subtract.at(words, h & (TAILS - 1), 1)
    return tokens, words, total, distinct


def fold_of(col: str, folds: int) -> F.Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % folds


def score(documents: DataFrame, *, folds: int = 7, held_out: int = 2, classes: int = 32, members: int = 64, hidden: int = 32, cached: int = 1 << 18, rounds: int = 2, tokens_each: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    `rounds`: parts the training documents are learned in, with averaging between; `tokens_each`: about so many tokens a
    trainer, so the number of trainers follows the corpus; `cached`: how many of the most frequent words' counts are sent.
    """
    spark = documents.sparkSession
    work.ship(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train = docs.where(fold_of("doc_id", folds) != held_out)
    counts = work.saved(counts_of(train), "lm-counts")
    top = counts.orderBy(F.desc("c"), "h").limit(cached).toArrow()
    h, c = top["h"].to_numpy(), top["c"].to_numpy()
    heads, n = classes * members, min(len(h), classes * members)
    rows = coded(docs, h[:n], heads, h, c).withColumn("held_out", F.coalesce(fold_of("doc_id", folds) == held_out, F.lit(False)))
    rows = work.saved(rows.withColumn("rid", F.monotonically_increasing_id()), "lm-coded")
    learned = rows.where("not held_out and doc_id is not null").select("doc_id", "n", "w")
    index = np.empty(n, np.int64)
    if n:
        index[_order_head(co_occurrence(learned, n, heads))] = np.arange(n)
    tokens, words, total, distinct = tail_counts(counts, h[:n], c[:n])
    head_counts = np.zeros(heads)
    head_counts[index] = c[:n]
    head_counts = head_counts.reshape(classes, members)
    net = Network(heads + TAILS, classes, members, hidden)
    net.start(np.log(np.concatenate([head_counts.sum(axis=1), tokens]) + 1), np.log(head_counts + 0.1))
    fitted = learned.agg(F.sum("n")).first()[0] or 0
    number = np.concatenate([index, np.arange(n, heads + TAILS)])  # input number of each code
    if fitted:
        trainers = max(1, round(fitted / rounds / tokens_each))
        # both by hash of the document, so reruns deal alike
        dealt = learned.select("w", F.pmod(F.xxhash64(F.lit(5), "doc_id", "w"), F.lit(rounds)).alias("part"), F.expr(f"cast(pmod(xxhash64(6, doc_id, w), {trainers}) as int)").alias("trainer"))
        for done in range(rounds):
            net = _round(spark, dealt.where(F.col("part") == done).drop("part"), trainers, net, number, _code(heads), done)
        rows = work.saved(_network_part(rows, net, number, _code(heads), -np.log10(tokens + words + 1)), "lm-rows")
    unseen = rows.select("rid", F.explode("tail").alias("h"))
    counted = counts.select(F.col("h").alias("h0"), F.log10(F.col("c") + 1).alias("l"))
    sums = unseen.join(counted, F.col("h") == F.col("h0")).groupBy(F.col("rid").alias("rid0")).agg(F.sum("l").alias("l"), F.count(F.lit(1)).alias("k"))
    out = rows.drop("tail").join(sums, F.col("rid") == F.col("rid0"), "left")
    rest, found = F.coalesce("l", F.lit(0.0)), F.coalesce("k", F.lit(0))
    base = F.col("sure") + rest - F.col("n") * F.lit(float(np.log10(total + distinct + 1)))
    full = F.col("net") + F.col("sure_tail") + rest if fitted else base
    return out.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + found).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))


def _round(spark, dealt: DataFrame, trainers: int, net: Network, number: np.ndarray, kind: np.dtype, done: int) -> Network:
    """The mean of the trainers' networks, each after its own documents of dealt(w, trainer), weighted by their tokens."""
    shape = (net.shapes["x"][0], net.classes, net.members, net.hidden)
    sent = spark.sparkContext.broadcast((net.flat, number))

    def fit(batches):
        docs, trainer = [], None
        for batch in batches:
            docs += batch.column(0).to_pylist()
            trainer = batch.column(1)[0].as_py() if batch.num_rows else trainer
        if not docs:
            return
        docs.sort()  # so that reruns take the same steps, however the rows arrive
        flat, number = sent.value
        off = np.concatenate([[0], np.cumsum([len(w) // kind.itemsize for w in docs])])
        idx = number[np.frombuffer(b"".join(docs), kind)].astype(np.int32)
        del docs
        local = train_local(Network(*shape, flat=flat), idx, off, done=done)
        yield pa.RecordBatch.from_arrays([pa.array([trainer], pa.int32()), pa.array([len(idx)], pa.int64()), pa.array([local.flat.tobytes()], pa.binary())], ["trainer", "n", "w"])

    each = work.saved(work.map_arrow(dealt.repartitionById(trainers, F.col("trainer")), fit, "trainer int, n long, w binary"), "lm-weights")

    def total(batches):
        sums, weight = np.zeros(0), 0
        for batch in batches:
            for n, w in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x = np.frombuffer(w, F32) * float(n)
                sums, weight = (sums + x if len(sums) else x.astype(np.float64)), weight + n
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["n", "w"])

    # Groups of 64 trainers are added up by tasks, so the driver reads one row a group.
    groups = each.select("n", "w", "trainer").repartitionById(-(-trainers // 64), F.expr("cast(trainer div 64 as int)")).sortWithinPartitions("trainer").select("n", "w")
    sums, weight = np.zeros(len(net.flat)), 0
    parts = work.saved(work.map_arrow(groups, total, "n long, w binary"), "lm-sums")
    for r in sorted(parts.toLocalIterator(), key=lambda r: (r.n, bytes(r.w))):
        sums += np.frombuffer(r.w, np.float64)
        weight += r.n
    work.discard(each, parts)
    return Network(*shape, flat=(sums / weight).astype(F32)) if weight else net


def _network_part(rows: DataFrame, net: Network, number: np.ndarray, kind: np.dtype, shares: np.ndarray, buffer: int = 2_000_000) -> DataFrame:
    """rows without w, with net: log10 probability the network gives a row's head words and tail classes, and the tail
    words' common share of their class."""
    shape = (net.shapes["x"][0], net.classes, net.members, net.hidden)
    sent = rows.sparkSession.sparkContext.broadcast((net.flat, number))
    heads = net.classes * net.members
    names = [c for c in rows.columns if c != "w"]

    def run(batches):
        flat, number = sent.value
        model, waiting, size = Network(*shape, flat=flat), [], 0

        def flush():
            codes = np.frombuffer(b"".join(x for b in waiting for x in b.column("w").to_pylist()), kind)
            n = np.concatenate([b.column("n").to_numpy() for b in waiting])
            off = np.concatenate([[0], np.cumsum(n)])
            idx = number[codes].astype(np.int32)
            net10 = document_scores(model, idx, off) / np.log(10) + _per_doc(np.append(np.zeros(heads), shares)[idx], off)
            at = 0
            for b in waiting:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(net10[at : at + b.num_rows])], [*names, "net"])
                at += b.num_rows

        for batch in batches:
            count = batch.column("n").to_numpy()
            a = 0
            while a < len(count):  # whole documents up to `buffer` tokens at a time
                upto = np.cumsum(count[a:])
                b = a + max(1, int(np.searchsorted(upto, buffer - size, "right")))
                waiting.append(batch.slice(a, b - a))
                size += int(upto[b - a - 1])
                a = b
                if size >= buffer or a < len(count):
                    yield from flush()
                    waiting, size = [], 0
        if waiting:
            yield from flush()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "w")
    return work.map_arrow(rows, run, f"{kinds}, net double")


def op4(documents: DataFrame) -> DataFrame:
    return score(documents)
