"""Language-model scores: a gated recurrent network over words, with an add-one unigram base.

Words are what lies between ASCII white space, A-Z lower-cased; each document ends with an end token.  Counts are over all
training documents (crc32 of the id modulo ``HOLDOUT`` isn't ``HELD``).

The network's output is factored: a softmax over classes, then one within the class.  The most frequent words are symbols,
the number of distinct words to the power of 0.54, in as many classes as a class has symbols; so both grow with the corpus.  Every other word, seen or not, belongs to one of ``SPELLINGS`` classes by its last two bytes, and within that it has
its add-one share of the class's counts.  All counts are over all training documents.

The network is trained by truncated backpropagation through windows of ``WINDOW`` tokens, many documents in lockstep, each
carrying its state from window to window; a score carries it through the complete document likewise.  Texts are cut into
words twice: to count them, and to write each document's symbols as a table, from which all training and scoring reads.

Training is distributed: the training documents are dealt into as many parts as there are ``RATES``, by a hash of the id.  In
each round every task trains on its documents of one part from common parameters, and parameters and second moments are
averaged, weighted by tokens.  Whole vectors are summed in a tree, so what reaches the driver doesn't grow.  A task trains
on fewer documents at a time where it has few, so that it makes enough steps.  The parameters depend on how rows are dealt
to tasks; counts and base scores don't.

Counts of the ``HOT`` most frequent words are bounded and go to every task; all other words of a document are joined with
the full table of counts, so no key of that join is frequent.

Null and empty texts are one end token.  A text may have any length: its words are in one task's memory, its windows are
not.  Words with equal counts are ordered by their bytes.  Repeated rows are scored alike and counted as often as they
occur.  Input columns besides the id and the text aren't read, so their names can't clash.  Without training documents all
counts are zero and every token of the base has probability one.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import common

HOLDOUT, HELD = 7, 2
SPELLINGS = 32
WIDTH = 16
WINDOW = 32
#: Gradients of fewer tokens weigh less in a step.
FEW = 256
LANES = 256
#: Longer documents are trained on in pieces of so many tokens, each from a zero state; scores carry the state on.
PIECE = 4096
#: Positions whose outputs are computed at once in scoring.
BATCH = 1 << 13
#: Positions whose class outputs are computed at once.
CHUNK = 512
#: Positions whose words' outputs are computed at once.
GROUP = 2048
#: Steps that a task should make on its part at least; it runs fewer lanes for that.
STEPS = 24
#: Tokens that a task gathers before it trains on their documents.
POOL = 1 << 21
#: The learning rate of each round; the training documents are dealt to as many parts.
RATES = (8e-3, 8e-3, 6e-3, 6e-3, 4e-3, 4e-3, 2e-3, 1e-3)
HOT = 100_000
END = b""
#: Bytes of text whose words are taken apart at once, and words of which counts are gathered before they go on.
SLICE, GATHERED = 1 << 23, 1 << 20
#: Ends of words: one byte, two bytes.
ENDS = [*(bytes([b]) for b in range(256)), *(bytes([a, b]) for a in range(256) for b in range(256))]


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").translate(common.LOWER).split(), END]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``SLICE`` bytes of text in a column."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // SLICE
    edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), batch.num_rows]
    return (batch.slice(i, j - i) for i, j in itertools.pairwise(edges) if i < j)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The :func:`tokens` of all texts but their ends, one text after the other, and how many each text has."""
    texts = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[edges[0] : edges[-1]]  # Arrow's functions of ASCII lose words of a slice, so it gets its own bytes
    texts = pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer(edges - edges[0]), pa.py_buffer(bytes(data).translate(common.LOWER))])
    texts = pc.ascii_trim_whitespace(texts)
    lists = pc.ascii_split_whitespace(texts)
    words, n = lists.flatten().cast(pa.large_binary()), np.diff(lists.offsets.to_numpy())
    empty = pc.binary_length(texts).to_numpy() == 0
    return (words.filter(pc.not_equal(words, END)), n - empty) if empty.any() else (words, n)


def spelling(word: bytes) -> int:
    """The class of a word that isn't a symbol, by its last two bytes."""
    return zlib.crc32(word[-2:]) % SPELLINGS


def spellings(words: pa.Array, made: np.ndarray) -> np.ndarray:
    """:func:`spelling` of each word of one byte or more; made: those of all ends, by their bytes (see ``ENDS``)."""
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    last, size = data[edges[1:] - 1].astype(np.int32), np.diff(edges)
    return made[np.where(size > 1, 256 + 256 * data[np.maximum(edges[1:] - 2, 0)].astype(np.int32), 0) + last]


def spelling_of(word: Column) -> Column:
    """:func:`spelling` of a column of bytes."""
    return (F.crc32(F.substring(word, -2, 2)) % SPELLINGS).cast("int")


@dataclass
class Vocabulary:
    """Ids of the network: first the frequent words, in classes of ``size``, then the classes by spelling."""

    symbols: dict[bytes, int]
    size: int
    counts: np.ndarray  # tokens of each symbol
    rest: np.ndarray  # tokens of each class by spelling
    kinds: np.ndarray  # its distinct words

    @property
    def known(self) -> int:
        return len(self.symbols)

    @property
    def n(self) -> int:
        return self.known + len(self.rest)

    @property
    def learned(self) -> int:
        """Classes of symbols."""
        return -(-self.known // self.size)

    @property
    def type(self) -> np.dtype:
        return np.dtype("<u2" if self.n <= 1 << 16 else "<u4")

    def kind(self, ids: np.ndarray) -> np.ndarray:
        """The class of each id."""
        return np.where(ids < self.known, ids // self.size, ids + (self.learned - self.known))

    def shares(self) -> np.ndarray:
        """The log10 of what a word's count, plus one, is divided by within its class by spelling."""
        return np.log10(self.rest + self.kinds + 1)


NAMES = ("inputs", "recur", "bias_n", "to_class", "to_word")


def start(v: Vocabulary, width: int = WIDTH, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters at the beginning: small random weights, output biases (the last rows) at the add-one frequencies."""
    rng, c = np.random.default_rng(seed), v.learned
    freq = np.zeros(c * v.size)
    freq[: v.known] = v.counts + 1.0
    freq = freq.reshape(c, v.size)
    every = np.concatenate([freq.sum(axis=1), v.rest + v.kinds + 1.0])
    bias = np.log(np.maximum(freq, 1e-13) / freq.sum(axis=1, keepdims=True))  # some places may have no symbol
    out = {
        "inputs": rng.normal(0, 0.3, (v.n, 3 * width)),
        "recur": rng.normal(0, 1 / np.sqrt(width), (width, 3 * width)),
        "bias_n": np.zeros(width),
        "to_class": np.vstack([rng.normal(0, 0.1, (width, len(every))), np.log(every / every.sum())]),
        "to_word": np.concatenate([rng.normal(0, 0.1, (c, width, v.size)), bias[:, None]], axis=1),
    }
    return {k: x.astype(np.float32) for k, x in out.items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES])


def shaped(x: np.ndarray, v: Vocabulary, width: int = WIDTH) -> dict[str, np.ndarray]:
    """Views of a flat array of all parameters, by name."""
    out, at = {}, 0
    for k, like in start(v, width).items():
        out[k] = x[at : at + like.size].reshape(like.shape)
        at += like.size
    return out


class Room:
    """Arrays by name that are written again in each window, as fresh ones cost as much as what is done with them."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size = math.prod(shape)
        own = self.held.get(name)
        if own is None or len(own) < size or own.dtype != kind:
            own = self.held[name] = np.empty(size, kind)
        return own[:size].reshape(shape)


def _turned(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """A copy with the last two axes exchanged."""
    if out is None:
        return np.ascontiguousarray(x.transpose(0, 2, 1))
    np.copyto(out, x.transpose(0, 2, 1))
    return out


def _taken(rows: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.take(rows, at, axis=0, out=out, mode="clip")  # unlike the default mode, it writes in place


def forward(p: dict, ids: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, room: Room | None = None) -> tuple[np.ndarray, tuple]:
    """States (steps, lanes, width) after each of the input ids (steps, lanes), and what the way back needs (lanes last).

    fresh: where a document begins; the state is zero before it.  What is returned lies in the room, up to its next use here.
    """
    (steps, lanes), d, kind = ids.shape, h.shape[1], p["inputs"].dtype
    room = Room() if room is None else room
    shape = steps, d, lanes
    given = _taken(p["inputs"], ids, room("given", (steps, lanes, 3 * d), kind))
    x = _turned(given, room("x", (steps, 3 * d, lanes), kind))  # lanes last, so that what belongs to a gate lies together
    before, s, n, states = (room(k, shape, kind) for k in ("before", "s", "n", "states"))
    gates, a = room("gates", (steps, 2 * d, lanes), kind), room("a", (3 * d, lanes), kind)
    recur, bias, h = np.ascontiguousarray(p["recur"].T), p["bias_n"][:, None], h.T
    recur[: 2 * d] *= -1
    begins = fresh.any(axis=1) if fresh is not None else np.zeros(steps, bool)
    with np.errstate(over="ignore"):
        for t in range(steps):
            np.copyto(before[t], h)
            if begins[t]:
                before[t][:, fresh[t]] = 0
            h, g, m, to = before[t], gates[t], n[t], states[t]
            np.matmul(recur, h, out=a)
            np.subtract(a[: 2 * d], x[t, : 2 * d], out=g)
            np.exp(g, out=g)
            g += 1
            np.divide(1, g, out=g)
            np.add(a[2 * d :], bias, out=s[t])
            np.multiply(g[:d], s[t], out=m)
            m += x[t, 2 * d :]
            np.tanh(m, out=m)
            np.subtract(h, m, out=to)
            to *= g[d:]
            to += m
            h = to
    return _turned(states, room("out", (steps, lanes, d), kind)), (before, gates, s, n, fresh, begins)


def _powers(x: np.ndarray, bound: float, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials in place of the outputs x; the logarithms of their sums, and what turns them into probabilities."""
    top = x.max(axis=1) if bound > 80 else np.zeros(len(x), x.dtype)  # otherwise none is too large
    if bound > 80:
        x -= top[:, None]
    np.exp(x, out=x)
    total = x @ ones
    return np.log(total) + top, 1 / total[:, None]


def _sums(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the sorted keys once, and the sums of its rows."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if rows.shape[1] % 2 == 0:  # two columns in one complex number are added at once
        return keys[first], np.add.reduceat(rows.view(f"c{2 * rows.itemsize}"), first, axis=0).view(rows.dtype)
    return keys[first], np.add.reduceat(rows, first, axis=0)


def _groups(edges: list[int]) -> Iterator[list[tuple[int, slice]]]:
    """The classes that have rows, and which, in groups of about ``GROUP`` rows."""
    group: list[tuple[int, slice]] = []
    for c, (i, j) in enumerate(itertools.pairwise(edges)):
        if i < j:
            group.append((c, slice(i, j)))
            if j - group[0][1].start >= GROUP:
                yield group
                group = []
    if group:
        yield group


def outputs(p: dict, v: Vocabulary, states: np.ndarray, targets: np.ndarray, grads: dict | None = None, room: Room | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each target; with grads, adds the parameters' gradients of minus their sum and returns the states'.

    A target that is a class by spelling has the class's probability only.  The states' gradients lie in the room.
    """
    order, (size, d), kind, slope = np.argsort(targets.astype(v.type), kind="stable"), states.shape, states.dtype, grads is not None
    room = Room() if room is None else room
    narrow = d + 1
    targets, s = targets[order], room("with_one", (size, narrow), kind)
    s[:, :d] = _taken(states, order, room("ordered", (size, d), kind))
    s[:, d] = 1
    classes, words = v.kind(targets), int(np.searchsorted(targets, v.known))
    by_class, by_word = np.ascontiguousarray(p["to_class"].T), _turned(p["to_word"])
    own = _taken(by_class, classes, room("own", (size, narrow), kind))
    logp, bound, ones = np.einsum("td,td->t", s, own).astype(np.float64), np.abs(p["to_class"]).sum(axis=0).max(), np.ones(len(by_class), kind)
    back = room("back", (size, narrow), kind) if slope else None
    every, scaled = room("every", (min(CHUNK, size), len(by_class)), kind), room("scaled", (min(CHUNK, size), narrow), kind)
    for at in range(0, size, CHUNK):  # so that a chunk's outputs stay in the cache
        rows = slice(at, at + CHUNK)
        x = np.matmul(s[rows], p["to_class"], out=every[: size - at])
        logz, inv = _powers(x, bound, ones)
        logp[rows] -= logz
        if slope:
            grads["to_class"] += (x.T @ np.multiply(s[rows], inv, out=scaled[: size - at])).T
            np.matmul(x, by_class, out=back[rows])
            back[rows] *= inv
    if slope:
        back -= own
        at, sums = _sums(s, classes)
        grads["to_class"][:, at] -= sums.T
    if words:
        own = _taken(by_word.reshape(-1, narrow), targets[:words], room("own", (words, narrow), kind))
        logp[:words] += np.einsum("td,td->t", s[:words], own)
        bound, ones = np.abs(p["to_word"]).sum(axis=1).max(), np.ones(v.size, kind)
        for group in _groups(np.searchsorted(targets, np.minimum(np.arange(v.learned + 1) * v.size, v.known)).tolist()):
            first, rows = group[0][1].start, slice(group[0][1].start, group[-1][1].stop)
            x = room("words", (rows.stop - first, v.size), kind)
            for c, at in group:
                np.matmul(s[at], p["to_word"][c], out=x[at.start - first : at.stop - first])
            logz, inv = _powers(x, bound, ones)
            logp[rows] -= logz
            if slope:
                scaled, more = np.multiply(s[rows], inv, out=room("scaled_words", (len(x), narrow), kind)), room("more", (len(x), narrow), kind)
                for c, at in group:
                    mine = slice(at.start - first, at.stop - first)
                    grads["to_word"][c] += scaled[mine].T @ x[mine]
                    np.matmul(x[mine], by_word[c], out=more[mine])
                more *= inv
                back[rows] += more
        if slope:
            back[:words] -= own
            at, sums = _sums(s[:words], targets[:words])
            grads["to_word"][at // v.size, :, at % v.size] -= sums
    given = np.empty_like(logp)
    given[order] = logp
    if not slope:
        return given, None
    out = room("states_back", (size, d), kind)
    out[order] = back[:, :d]
    return given, out


def backward(p: dict, ids: np.ndarray, kept: tuple, back: np.ndarray, grads: dict, room: Room | None = None) -> None:
    """Adds the gradients through a window; back: the gradients of its states (steps, lanes, width)."""
    before, gates, s, n, fresh, begins = kept
    (steps, lanes, d), kind = back.shape, back.dtype
    room = Room() if room is None else room
    shape = steps, d, lanes
    r, z, back = gates[:, :d], gates[:, d:], _turned(back, room("back_turned", shape, kind))
    left, by_n, by_z, by_r, dn = (room(k, shape, kind) for k in ("left", "by_n", "by_z", "by_r", "dn"))
    np.subtract(1, z, out=left)
    np.multiply(n, n, out=by_n)
    np.subtract(1, by_n, out=by_n)
    by_n *= left
    np.subtract(before, n, out=by_z)
    by_z *= z
    by_z *= left
    np.subtract(1, r, out=by_r)
    by_r *= r
    by_r *= s
    da, dh, more, recur = room("da", (steps, 3 * d, lanes), kind), np.zeros((d, lanes), kind), np.empty((d, lanes), kind), p["recur"]
    for t in range(steps - 1, -1, -1):
        dh += back[t]
        np.multiply(dh, by_n[t], out=dn[t])
        np.multiply(dn[t], by_r[t], out=da[t, :d])
        np.multiply(dh, by_z[t], out=da[t, d : 2 * d])
        np.multiply(dn[t], r[t], out=da[t, 2 * d :])
        dh *= z[t]
        dh += np.matmul(recur, da[t], out=more)
        if begins[t]:
            dh[:, fresh[t]] = 0
    rows = _turned(da, room("given", (steps, lanes, 3 * d), kind)).reshape(-1, 3 * d)
    grads["recur"] += (rows.T @ _turned(before, room("out", (steps, lanes, d), kind)).reshape(-1, d)).T
    grads["bias_n"] += da[:, 2 * d :].sum(axis=(0, 2))
    rows[:, 2 * d :] = dn.transpose(0, 2, 1).reshape(-1, d)
    ids = ids.ravel().astype(np.uint16 if len(p["inputs"]) <= 1 << 16 else np.uint32)
    order = np.argsort(ids, kind="stable")
    at, sums = _sums(_taken(rows, order, room("x", rows.shape, kind)), ids[order])
    grads["inputs"][at] += sums


def windows(docs: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(where documents begin, documents, inputs, targets, mask), each (steps, lanes); each input is the token before its target.

    Lanes run in lockstep, each through document after document; the longest documents are dealt first, each to the
    shortest lane, and lanes that have ended leave.
    """
    loads, dealt = [(0, k) for k in range(min(lanes, len(docs)))], [[] for _ in range(min(lanes, len(docs)))]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        load, k = loads[0]
        heapq.heapreplace(loads, (load + len(docs[i]), k))
        dealt[k].append(i)
    loads.sort(key=lambda x: -x[0])
    sizes = np.array([load for load, _ in loads], np.int64)
    every = [i for _, k in loads for i in dealt[k]]
    target, lengths = np.concatenate([docs[i] for i in every]).astype(np.int32), np.array([len(docs[i]) for i in every])
    of = np.repeat(np.array(every, np.int32), lengths)
    begins = np.cumsum(lengths) - lengths
    fresh = np.zeros(len(target), bool)
    fresh[begins] = True
    given = np.concatenate([target[:1], target[:-1]])
    given[begins] = target[begins + lengths - 1]  # a document begins after an end token
    tops = np.cumsum(sizes) - sizes
    for at in range(0, int(sizes.max(initial=0)), window):
        live = int((sizes > at).sum())
        nth = np.arange(at, min(at + window, int(sizes[0])))[:, None]
        mask = nth < sizes[None, :live]
        place = np.where(mask, nth + tops[None, :live], 0)
        yield *(x[place] if mask.all() else np.where(mask, x[place], x.dtype.type(0)) for x in (fresh, of, given, target)), mask


def score_documents(p: dict, v: Vocabulary, docs: list[np.ndarray], lanes: int = LANES, window: int = 2 * WINDOW) -> np.ndarray:
    """The natural log probability of each document's ids, the state carried through all of its windows."""
    total, h = np.zeros(len(docs)), np.zeros((lanes, p["recur"].shape[0]), p["recur"].dtype)
    held: list[tuple] = []
    room = Room()

    def done() -> None:
        own, states, target = map(np.concatenate, zip(*held, strict=True))
        total[:] += np.bincount(own, outputs(p, v, states, target, room=room)[0], len(docs))
        held.clear()

    for fresh, own, given, target, mask in windows(docs, lanes, window):
        states, _ = forward(p, given, h[: given.shape[1]], fresh, room)
        h = states[-1].copy()
        held.append((own[mask], states[mask], target[mask]))
        if sum(len(x[0]) for x in held) >= BATCH:  # few lanes are left where long documents go on
            done()
    if held:
        done()
    return total


class Trainer:
    """Adam over truncated windows; parameters, gradients and moments are flat arrays.

    second: the second moments to go on with, from the rounds before.  Moments are kept as sums, without the share of the
    newest in them (0.1, 0.005), so fewer passes over all parameters are needed.
    """

    def __init__(self, x: np.ndarray, v: Vocabulary, rate: float, second: np.ndarray | None = None):
        self.v, self.rate, self.t, self.tokens = v, rate, 0, 0
        self.x, self.fixed = np.array(x, np.float32), second is not None
        self.g, self.m = np.zeros_like(self.x), np.zeros_like(self.x)
        self.second = np.array(second, np.float32) if self.fixed else np.zeros_like(self.x)
        self.p, self.grads, self.room = shaped(self.x, v), shaped(self.g, v), Room()

    def train(self, docs: list[np.ndarray], lanes: int = LANES, steps: int = STEPS) -> None:
        docs = [d[k : k + PIECE] for d in docs for k in range(0, len(d), PIECE)]
        lanes = min(lanes, max(8, sum(map(len, docs)) // (WINDOW * steps)))
        h = np.zeros((lanes, self.p["recur"].shape[0]), np.float32)
        for fresh, _, given, target, mask in windows(docs, lanes):
            states, kept = forward(self.p, given, h[: given.shape[1]], fresh, self.room)
            h = states[-1].copy()
            if mask.all():
                back = outputs(self.p, self.v, states.reshape(-1, states.shape[2]), target.ravel(), self.grads, self.room)[1].reshape(states.shape)
            else:
                back = np.zeros_like(states)
                back[mask] = outputs(self.p, self.v, states[mask], target[mask], self.grads, self.room)[1]
            backward(self.p, given, kept, back, self.grads, self.room)
            self.step(int(mask.sum()))

    def step(self, n: int) -> None:
        """One step down the summed gradients of n tokens, which are then cleared."""
        self.t += 1
        self.tokens += n
        g = self.g
        g *= 1 / max(n, FEW)
        np.clip(g, -1, 1, out=g)
        self.m *= 0.9
        self.m += g
        self.second *= 0.995
        g *= g
        self.second += g
        np.sqrt(self.second, out=g)
        root = math.sqrt(0.005 / (1 if self.fixed else 1 - 0.995**self.t))
        g += 1e-6 / root
        np.divide(self.m, g, out=g)
        g *= 0.1 * self.rate / (1 - 0.9**self.t) / root
        self.x -= g
        g.fill(0)


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over one column of texts: each task sums its slices, then words meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: pa.Table) -> Iterator[pa.RecordBatch]:
            return c.select(["word", "n"]).cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).to_batches()

        held, rows, ends = [], 0, 0
        for batch in batches:
            for part in slices(batch, 0):
                c = cut(part.column(0))[0].value_counts()
                held.append(pa.table({"word": c.field("values"), "n": c.field("counts")}))
                rows, ends = rows + len(c), ends + len(part)
                if rows > GATHERED:
                    held = [_summed_counts(held)]
                    rows = len(held[0])
                    if rows > GATHERED // 2:
                        yield from out(held[0])
                        held, rows = [], 0
        if ends:
            held.append(pa.table({"word": pa.array([END], pa.large_binary()), "n": pa.array([ends], pa.int64())}))
            yield from out(_summed_counts(held))

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed_counts(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words by falling count: those of the highest classes of counts (64 to a doubling) that hold ``most`` words or fewer.

    One sum for each class and the words themselves reach the driver, whatever the number of partitions.
    """
    rows = counts.withColumn("class", F.floor(F.log2("n") * 64).cast("int"))
    held, least = 0, None
    for r in sorted(rows.groupBy("class").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["class"]):
        held += r.words
        if held > most:
            break
        least = r["class"]
    if least is None:
        return []
    found = rows.filter(F.col("class") >= least).select("word", "n").collect()
    return sorted(((bytes(r.word), r.n) for r in found), key=lambda x: (-x[1], x[0]))


@dataclass
class Words:
    """Counts of all training words; n tokens, v distinct; the frequent ones and the network's vocabulary."""

    counts: DataFrame
    n: int
    v: int
    hot: dict[bytes, int]
    vocabulary: Vocabulary


def count(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT) -> Words:
    """The words of the documents that aren't held out."""
    own = docs.filter(common.with_crc_bucket(id_col, HOLDOUT) != HELD)
    counts = common.written(token_counts(own.select(F.col(text).cast("string").alias("t"))))
    kinds = counts.groupBy(spelling_of(F.col("word")).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n, v = sum(r.n for r in kinds), sum(r.v for r in kinds)
    top = frequent(counts, hot)
    if n and not any(w == END for w, _ in top):  # every document has one, so it goes with the hot words in any case
        top = [*top[: hot - 1], (END, own.count())]
    size = max(8, round(v**0.27))
    known = top[: size * size]
    if n and not any(w == END for w, _ in known):
        known = [*known[:-1], next(x for x in top if x[0] == END)]
    rest, left = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    for r in kinds:
        rest[r.s], left[r.s] = r.n, r.v
    for w, k in known:
        rest[spelling(w)] -= k
        left[spelling(w)] -= 1
    known = known or [(END, 0)]
    return Words(counts, int(n), int(v), dict(top), Vocabulary({w: k for k, (w, _) in enumerate(known)}, size, np.array([k for _, k in known], np.float64), rest, left))


MADE = "n_tokens long, n_known long, logs double, rest_logs double, shares double, rare array<struct<word:binary,k:int>>, ids binary"


def encoded(docs: DataFrame, words: Words, id_col: str = "doc_id", text: str = "text", parts: int = len(RATES)) -> DataFrame:
    """A written table, one row for each document: row, id, held_out, part, its ids in the network, and sums over its words.

    n_known and logs (of counts plus one) are of the hot words, rest_logs of those of them that aren't symbols, shares of
    all words that aren't; ``rare`` has the words that aren't hot.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words.vocabulary, words.hot))
    part = F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(parts)).cast("int")
    source = docs.select(F.col(id_col).alias("id"), (common.with_crc_bucket(id_col, HOLDOUT) == HELD).alias("held_out"), part.alias("part"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([*source.schema.fields[:3], *T._parse_datatype_string(MADE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        v, hot = shared.value
        fields = list(to_arrow_schema(schema))
        # one look-up a word: the hot words by place, all others at the last one
        last, listed = len(hot), pa.array(hot, pa.large_binary())
        symbol = np.array([*[v.symbols.get(w, v.known + spelling(w)) for w in hot], 0], v.type)
        logs, shares = np.append(np.log10(np.array(list(hot.values()), np.float64) + 1), 0.0), np.append(np.zeros(v.known), v.shares())
        by_end = np.array([v.known + spelling(w) for w in ENDS], v.type)
        end = next((k for k, w in enumerate(hot) if w == END), last)

        def made(texts: pa.Array) -> list:
            words, n = cut(texts)
            place = pc.index_in(words, value_set=listed).fill_null(last).to_numpy()
            missing = place == last
            coded = words.filter(pa.array(missing)).dictionary_encode()
            others, code = coded.dictionary, coded.indices.to_numpy()
            symbols = symbol[place]
            symbols[missing] = spellings(others, by_end)[code]
            edges = np.concatenate([[0], np.cumsum(n + 1)])
            starts, ends = edges[:-1], edges[1:] - 1
            word = np.ones(edges[-1], bool)
            word[ends] = False
            at, ids = np.full(len(word), end, np.int32), np.full(len(word), v.symbols[END], v.type)
            at[word], ids[word] = place, symbols
            value = logs[at]
            sums = [np.add.reduceat(x, starts, dtype=x.dtype if x.dtype == np.float64 else np.int64) for x in (at < last, value, value * (ids >= v.known), shares[ids])]
            pairs, times = np.unique(np.repeat(np.arange(len(n)), n)[missing] * len(others) + code, return_counts=True)
            kind = fields[8].type
            found = pa.StructArray.from_arrays([others.take(pa.array(pairs % max(len(others), 1))).cast(kind.value_type[0].type), pa.array(times, kind.value_type[1].type)], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * len(others)), pa.int32()), found, type=kind)
            held = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges * v.type.itemsize), pa.py_buffer(ids)])
            return [pa.array(x) for x in (n + 1, *sums)] + [lists, held]

        for batch in batches:
            for part in slices(batch, 3):
                columns = [*part.columns[:3], *made(part.column(3))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema([pa.field(f.name, f.type) for f in fields]))

    return common.written(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def summed(vectors: DataFrame, most: int = 4) -> tuple[int, np.ndarray | None]:
    """The sums of n and of the vectors p, weighted by n already: whole vectors in a tree, so at most ``most`` reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[k].as_buffer(), np.float64)
                n, total = n + batch.column(0)[k].as_py(), x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "p"])

    tasks = vectors.rdd.getNumPartitions()
    while tasks > most:
        tasks = max(most, -(-tasks // 64))
        vectors = vectors.repartition(tasks).mapInArrow(run, "n long, p binary")
    n, total = 0, None
    for r in vectors.collect():
        x = np.frombuffer(r.p, np.float64)
        n, total = n + r.n, x if total is None else total + x
    return n, total


def averaged(table: DataFrame, vocabulary, x: np.ndarray, second: np.ndarray | None, rate: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Every task trains on its ids from the same parameters; the means, by tokens, of parameters and second moments."""
    shared = table.sparkSession.sparkContext.broadcast((vocabulary, x, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, x, second = shared.value
        trainer, pool, size = Trainer(x, v, rate, second), [], 0
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                pool.append(np.frombuffer(ids, v.type))
                size += len(pool[-1])
                if size >= POOL:
                    trainer.train(pool)
                    pool, size = [], 0
        if pool:
            trainer.train(pool)
        if n := trainer.tokens:
            made = np.concatenate([trainer.x, trainer.second]).astype(np.float64) * n
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([made.tobytes()], pa.binary())], names=["n", "p"])

    n, total = summed(table.select("ids").mapInArrow(run, "n long, p binary"))
    shared.unpersist()
    return (x, second) if total is None else tuple((total / n).astype(np.float32).reshape(2, -1))


def fit(table: DataFrame, words: Words, rates: tuple[float, ...] = RATES) -> np.ndarray:
    """The network's parameters from the encoded documents that aren't held out, one part after the other."""
    x, second = flat(start(words.vocabulary)), None
    shared = table.sparkSession.sparkContext.broadcast(words.vocabulary).value
    for k, rate in enumerate(rates):
        x, second = averaged(table.filter(~F.col("held_out") & (F.col("part") == k)), shared, x, second, rate)
    return x


@dataclass
class LanguageModel:
    words: Words
    parameters: np.ndarray


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT, rates: tuple[float, ...] = RATES) -> LanguageModel:
    """Counts and network from the documents that aren't held out."""
    words = count(docs, id_col, text, hot)
    return LanguageModel(words, fit(encoded(docs, words, id_col, text, len(rates)), words, rates))


def scored(table: DataFrame, model: LanguageModel, id_col: str = "doc_id") -> DataFrame:
    """One row for each encoded document: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    words = model.words
    shared = table.sparkSession.sparkContext.broadcast((words.vocabulary, model.parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, x = shared.value
        p = shaped(x, v)
        rows, places, found, size = [], [], {}, 0

        def done() -> pa.RecordBatch:
            network = score_documents(p, v, [np.frombuffer(ids, v.type) for ids in found])
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(network[places], pa.float64())], names=["row", "network"])

        for batch in batches:
            for row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids not in found:
                    size += len(ids) // v.type.itemsize
                rows.append(row)
                places.append(found.setdefault(ids, len(found)))
                if size >= POOL or len(rows) >= POOL:
                    yield done()
                    rows, places, found, size = [], [], {}, 0
        if rows:
            yield done()

    network = table.select("row", "ids").mapInArrow(run, "row long, network double")
    rare = table.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.k").alias("k"))
    # no key is frequent and each task's share of the counts fits in its memory, so neither side is sorted
    met = rare.join(words.counts.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("l"))
    out = table.drop("ids", "rare", "part").join(network, "row").join(met, "row", "left").fillna(0, ["k", "l"])
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("k")).alias("n_known"),
        F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("l") - F.col("n_tokens") * float(np.log10(words.n + words.v + 1))).alias("base_score"),
        (F.col("network") / float(np.log(10)) + F.col("rest_logs") + F.col("l") - F.col("shares")).alias("score"),
    )


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    return scored(encoded(docs, model.words, id_col, text), model, id_col)


def score_all(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT, rates: tuple[float, ...] = RATES) -> DataFrame:
    """Train on the documents that aren't held out, then score all; the texts are encoded once for both."""
    words = count(docs, id_col, text, hot)
    table = encoded(docs, words, id_col, text, len(rates))
    return scored(table, LanguageModel(words, fit(table, words, rates)), id_col)
