"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a trained vector of its hash, the mean of trained vectors of
the hashes of its character n-grams, and three counts learnt from the training
rows: the log odds of the word and the mean and largest log odds of its
n-grams. The network reads windows of words forwards and backwards, pools the
states by attention and gives a logit. A text's score is that of its highest
overlapping window.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import id_text, lean, small_batches, text_steps

#: Bound of the training sample: rows of each label, with their whole texts.
TRAIN_ROWS = 1_200
WINDOW = 32
STRIDE = 16
HIDDEN = 8
SLOTS = 1 << 14
EMBED = 4
GRAMS = (3, 4, 5)
CACHE_WORDS = 200_000
_STRIP = ".,;:!?()[]{}\"'`*#%<>"


def tokens(text: str) -> list[str]:
    """Lower-case words of a text, without punctuation around them."""
    return [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of ``^word$`` (UTF-8), and where each word's begin."""
    raw = [b"^" + w.encode("utf-8", "surrogatepass") + b"$$$$" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw) + b"$" * max(GRAMS), np.uint8).astype(np.uint64)
    n = int(size.sum())
    h, parts = np.zeros(n, np.uint64), []
    for k in range(max(GRAMS)):
        h = h * np.uint64(0x100000001B3) + data[k : k + n] + np.uint64(1)
        if k + 1 in GRAMS:
            x = h * np.uint64(0x9E3779B97F4A7C15)
            parts.append((x >> np.uint64(64 - 14)).astype(np.int64))
    # the n-grams that begin at the ^ or in the word, of every size
    keep = np.ones(n, bool)
    ends = np.cumsum(size)
    for k in (1, 2, 3, 4):
        keep[ends - k] = False
    slots = np.stack(parts, axis=1)[keep].ravel()
    counts = (size - 4) * len(GRAMS)
    return slots, np.cumsum(counts) - counts


def word_slots(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % SLOTS for w in words), np.int64, len(words))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters are float32 arrays in ``p``; counts in ``word_odds`` and ``gram_odds``."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        n_in, h = 2 * EMBED + 3, HIDDEN
        init = lambda *s, scale=0.3: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": init(SLOTS, EMBED, scale=0.1), "gram": init(SLOTS, EMBED, scale=0.1), "query": init(2 * h), "out": init(2 * h), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(n_in, 3 * h), f"h{d}": init(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
        self.word_odds: dict[str, float] = {}
        self.gram_odds = np.zeros(SLOTS, np.float32)
        self.shift = 0.0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Row 0 is padding; row i + 1 is word i."""
        x = np.zeros((len(words) + 1, 2 * EMBED + 3), np.float32)
        slots = word_slots(words)
        grams, starts = char_grams(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if words:
            counts = np.diff(np.concatenate((starts, [len(grams)])))
            x[1:, :EMBED] = self.p["word"][slots]
            x[1:, EMBED : 2 * EMBED] = np.add.reduceat(self.p["gram"][grams], starts) / counts[:, None]
            odds = self.gram_odds[grams]
            x[1:, -3] = [self.word_odds.get(w, 0.0) for w in words]
            x[1:, -2] = np.add.reduceat(odds, starts) / counts
            x[1:, -1] = np.maximum.reduceat(odds, starts)
        return x, (slots, grams, starts)

    def _run(self, gx: np.ndarray, ids: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction over windows; gx: projected inputs by word row."""
        h, (n, steps) = HIDDEN, ids.shape
        state = np.zeros((n, h), np.float32)
        out, tape = np.zeros((steps, n, h), np.float32), []
        w = self.p[f"h{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = gx[ids[:, t]]
            b = state @ w
            zr = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            cand = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            m = mask[:, t : t + 1]
            new = state + m * (1 - z) * (cand - state)
            if keep:
                tape.append((t, state, z, r, cand, b[:, 2 * h :], m))
            state = out[t] = new
        return out, tape

    def logits(self, projected: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        mask = (ids > 0).astype(np.float32)
        runs = {d: self._run(projected[d], ids, mask, d, keep) for d in "fb"}
        states = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)  # steps, n, 2h
        raw = states @ self.p["query"] + (mask.T - 1) * 1e9
        e = np.exp(raw - raw.max(axis=0)) * mask.T
        weight = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, pooled, weight, states, mask, runs) if keep else logit

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def step(self, words: list[str], ids: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss over a batch of windows."""
        h = HIDDEN
        x, (slots, grams, starts) = self.inputs(words)
        logit, pooled, weight, states, mask, runs = self.logits(self.project(x), ids, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dlogit = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["bias"][0] = dlogit.sum()
        g["out"] = pooled.T @ dlogit
        dpool = dlogit[:, None] * self.p["out"]
        dweight = (states * dpool).sum(axis=2)
        draw = weight * (dweight - (weight * dweight).sum(axis=0))
        g["query"] = np.tensordot(draw, states, axes=([0, 1], [0, 1]))
        dstates = weight[:, :, None] * dpool + draw[:, :, None] * self.p["query"]
        dx = np.zeros_like(x)
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            carry, dgx, w = np.zeros((len(y), h), np.float32), np.zeros((len(x), 3 * h), np.float32), self.p[f"h{d}"]
            for t, before, z, r, cand, bc, m in reversed(runs[d][1]):
                carry = carry + dstates[t][:, part]
                dcand = carry * m * (1 - z) * (1 - cand * cand)
                dz = -carry * m * (cand - before) * z * (1 - z)
                dr = dcand * bc * r * (1 - r)
                da = np.concatenate((dz, dr, dcand), axis=1)
                db = np.concatenate((dz, dr, dcand * r), axis=1)
                np.add.at(dgx, ids[:, t], da)
                g[f"h{d}"] += before.T @ db
                carry = carry * (1 - m * (1 - z)) + db @ w.T
            g[f"x{d}"], g[f"c{d}"] = x.T @ dgx, dgx.sum(axis=0)
            dx += dgx @ self.p[f"x{d}"].T
        np.add.at(g["word"], slots, dx[1:, :EMBED])
        counts = np.diff(np.concatenate((starts, [len(grams)])))
        np.add.at(g["gram"], grams, np.repeat(dx[1:, EMBED : 2 * EMBED] / counts[:, None], counts, axis=0))
        return g

    # ---- scoring

    def window_logits(self, texts_ids: list[np.ndarray], projected: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows, and the text that each belongs to."""
        ids, owner = windows(texts_ids)
        out = np.empty(len(ids), np.float32)
        for i in range(0, len(ids), 2048):
            out[i : i + 2048] = self.logits(projected, ids[i : i + 2048])
        return out, owner


def window_starts(n: int) -> list[int]:
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def windows(texts_ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of each text as rows of word ids, padded with 0."""
    size = np.fromiter(map(len, texts_ids), np.int64, len(texts_ids))
    many = np.where(size <= WINDOW, 1, -(-(size - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(k * STRIDE, np.maximum(size[owner] - WINDOW, 0))
    flat = np.concatenate([*texts_ids, np.zeros(WINDOW, np.int64)])
    base = (np.cumsum(size) - size)[owner]
    at = (base + start)[:, None] + np.arange(WINDOW)
    inside = (start[:, None] + np.arange(WINDOW)) < size[owner][:, None]
    return np.where(inside, flat[np.minimum(at, len(flat) - 1)], 0), owner


class Scorer:
    """Remembers the projected inputs of the words it has met, up to a bound."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.reset()

    def reset(self) -> None:
        x, _ = self.net.inputs([])
        self.known: dict[str, int] = {}
        self.rows = {d: [v] for d, v in self.net.project(x).items()}
        self.table = {d: v[0] for d, v in self.rows.items()}

    def ids(self, lists: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.reset()
        known = self.known
        fresh = list(dict.fromkeys(w for ws in lists for w in ws if w not in known))
        if fresh:
            for i in range(0, len(fresh), 20_000):
                part = fresh[i : i + 20_000]
                x, _ = self.net.inputs(part)
                for d, v in self.net.project(x).items():
                    self.rows[d].append(v[1:])
                known.update(zip(part, range(len(known) + 1, len(known) + 1 + len(part)), strict=True))
            self.table = {d: np.concatenate(v) for d, v in self.rows.items()}
            self.rows = {d: [v] for d, v in self.table.items()}
        return [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in lists]

    def scores(self, texts: list[str]) -> np.ndarray:
        lists = [tokens(t) for t in texts]
        logit, owner = self.net.window_logits(self.ids(lists), self.table)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, logit)
        return _sigmoid(top.astype(np.float64) + self.net.shift)


def _fit(net: Network, words: list[str], picked: np.ndarray, target: np.ndarray, epochs: int, r: np.random.Generator) -> None:
    """Adam over shuffled batches of windows; ids are places in ``words`` plus one."""
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    t = 0
    for _ in range(epochs):
        order = r.permutation(len(picked))
        for i in range(0, len(order), 64):
            part = order[i : i + 64]
            own, inverse = np.unique(picked[part], return_inverse=True)
            if own[0] != 0:
                own, inverse = np.concatenate(([0], own)), inverse + 1
            g = net.step([words[k - 1] for k in own[1:]], inverse.reshape(len(part), WINDOW), target[part])
            t += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
                net.p[k] -= (0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)


def train(rows: list[tuple[str, int]], epochs: int = 4, seed: int = 7) -> Network:
    """Fit on (text, label) rows. Rows of one label only give a constant score."""
    net, r = Network(seed), np.random.default_rng(seed)
    one: dict[str, str] = {}  # equal words are one string
    lists = [[one.setdefault(w, w) for w in tokens(t)] for t, _ in rows]
    y = np.array([label for _, label in rows], np.int64)
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    seen: dict[str, list[int]] = {}
    for ws, label in zip(lists, y.tolist(), strict=True):
        for w in set(ws):
            seen.setdefault(w, [0, 0])[label] += 1
    net.word_odds = {w: float(np.clip(np.log((b / n1 + 0.002) / (a / n0 + 0.002)), -4, 4)) for w, (a, b) in seen.items() if a + b >= 2}
    docs = np.zeros((2, SLOTS))
    for ws, label in zip(lists, y.tolist(), strict=True):
        if ws:
            docs[label, np.unique(char_grams(list(set(ws)))[0])] += 1
    net.gram_odds = np.clip(np.log((docs[1] / n1 + 0.01) / (docs[0] / n0 + 0.01)), -4, 4).astype(np.float32)
    if not 0 < y.sum() < len(y):
        net.p["out"][:] = 0
        net.shift = 3.0 if y.sum() else -3.0
        return net

    # windows to learn from: of a toxic text the one with the highest odds, of others that one and one at random
    words = sorted({w for ws in lists for w in ws})
    row = {w: i + 1 for i, w in enumerate(words)}
    hint = [np.zeros(1, np.float32)]
    for i in range(0, len(words), 20_000):
        x, _ = net.inputs(words[i : i + 20_000])
        hint.append(np.maximum(x[1:, -3], 0) + np.maximum(x[1:, -1], 0))
    hint = np.concatenate(hint)
    picked, target = [], []
    for ws, label in zip(lists, y.tolist(), strict=True):
        ids, _ = windows([np.array([row[w] for w in ws], np.int64)])
        order = np.argsort(-hint[ids].sum(axis=1), kind="stable")
        picked.append(ids[order[0]])
        target.append(label)
        if not label:
            picked.append(ids[r.integers(len(ids))])
            target.append(0)
    clean = [ws for ws, label in zip(lists, y.tolist(), strict=True) if not label]
    for sweep in range(2):
        _fit(net, words, np.array(picked), np.array(target, np.float32), epochs if not sweep else epochs // 2, r)
        if not sweep:  # learn again with the windows of clean texts that score highest
            scorer = Scorer(net)
            for i in range(0, len(clean), 200):
                part = clean[i : i + 200]
                logit, owner = net.window_logits(scorer.ids(part), scorer.table)
                own, _ = windows([np.array([row[w] for w in ws], np.int64) for ws in part])
                order = np.lexsort((-logit, owner))
                first = order[np.unique(owner[order], return_index=True)[1]]
                hard = first[np.argsort(-logit[first], kind="stable")[: max(1, len(part) // 4)]]
                picked += list(own[hard])
                target += [0] * len(hard)
    # place the threshold where whole training texts are told apart best
    scorer = Scorer(net)
    top = np.concatenate([scorer.scores([x for x, _ in rows[i : i + 100]]) for i in range(0, len(rows), 100)])
    raw = np.log(np.clip(top, 1e-9, 1 - 1e-9) / (1 - np.clip(top, 1e-9, 1 - 1e-9)))
    cuts = np.unique(raw)
    cuts = np.concatenate(([cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]))
    order = np.sort(raw[y == 1]), np.sort(raw[y == 0])
    right = (len(order[0]) - np.searchsorted(order[0], cuts)) / n1 + np.searchsorted(order[1], cuts) / n0
    best = np.flatnonzero(right >= right.max() - 1e-12)
    cut = float(cuts[best[len(best) // 2]])
    low, high = np.quantile(raw[y == 0], 0.995), np.quantile(raw[y == 1], 0.01)
    # clean texts far outnumber the sample, so their tail reaches beyond it
    net.shift = -float(low + 0.75 * (high - low)) if low < high else -cut
    return net


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """A bounded sample of labelled rows outside the held-out fold, by hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(4 * per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = {r[0]: r[1] for r in chosen.collect()}  # at most eight times per_label numbers
    if not ids:
        return []
    few = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, toxic int")
    texts = id_text(docs).where("text is not null").join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"])
    out = []
    for label in (0, 1):
        rows = texts.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(per_label).select("text", "toxic").collect()
        out += [(r[0], r[1]) for r in rows]
    return out


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only labelled rows outside the fold crc32(doc_id) mod 5 = 0 are learnt
    from, at most ``TRAIN_ROWS`` of each label, by a hash of the id and whatever
    their length; every text is scored whole. Null and empty texts have
    one empty window. Without labels of both kinds the score is constant. A
    null doc_id has held_out null. Other columns are ignored.
    """
    net = train(sorted(training_rows(docs, labels)))
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))  # a few MB, fixed by SLOTS and TRAIN_ROWS

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(sent.value))
        for piece, texts in text_steps(batches):
            score = scorer.scores(texts)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    out = id_text(docs).mapInArrow(lean(of), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text the network does not reject, all columns kept."""
    net = train(sorted(training_rows(docs, labels)))
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(sent.value))
        for piece, texts in text_steps(batches):
            yield piece.filter(pa.array(scorer.scores(texts) < 0.5))

    return small_batches(docs).mapInArrow(lean(keep), docs.schema)
