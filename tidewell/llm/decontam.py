"""Benchmark decontamination with an FM-index over each shard of documents.

A shard is a bounded piece of a partition's texts. Its words become symbols:
words that no benchmark item uses cannot be part of a hit, so the index holds
only the runs of benchmark words that are as long as the shortest window,
with separators between them. Windows are searched backwards, all together,
through ranks in a wavelet matrix; occurrences are located by walking to
sampled suffix positions; overlapping occurrences merge to removal spans.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import id_text, lean, small_batches, staged, text_steps

WINDOW = 10
#: Characters of text in a shard, and benchmark words sent to the executors at once.
SHARD_CHARS = 6_000_000
ITEMS_WORDS = 1_000_000
#: Every so many suffix positions are kept.
SAMPLE = 16

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane per level."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.planes = bits, []
        for level in range(bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view("<u8")
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.planes.append((level, packed, ones, len(seq) - int(bit.sum())))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends among its symbol's rows on the last level."""
        for level, packed, ones, zeros in self.planes:
            word, off = at >> 6, (at & 63).astype(np.uint64)
            one = ones[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << off) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + one, at - one)
        return at


class FmIndex:
    """Over symbols above 0; 0 separates runs and ends the sequence."""

    def __init__(self, seq: np.ndarray, n_symbols: int) -> None:
        n = len(seq)
        ends = seq == 0
        rank = np.where(ends, np.cumsum(ends) - 1, seq + int(ends.sum()))
        step = 1
        while True:  # prefix doubling; each separator is a symbol of its own, so order is total
            ahead = np.full(n, 0)
            ahead[: max(0, n - step)] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + ahead
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[suffixes] = fresh
            if fresh[-1] == n - 1:
                break
            step *= 2
        self.last = seq[suffixes - 1]  # the symbol before each suffix
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=n_symbols + 1))))
        self.tree = WaveletMatrix(self.last, max(1, int(n_symbols).bit_length()))
        self.base = self.tree.descend(np.arange(n_symbols + 1), np.zeros(n_symbols + 1, np.int64))
        starts = np.concatenate(([True], ends[:-1]))
        kept = (suffixes % SAMPLE == 0) | starts[suffixes]
        self.sampled = np.where(kept, suffixes, -1)
        self.n = n

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.descend(symbol, at) - self.base[symbol]

    def search(self, words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with the ``length`` words at each of ``starts``."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n)
        alive = np.arange(len(starts))
        for k in range(length - 1, -1, -1):
            symbol = words[starts[alive] + k]
            lo[alive], hi[alive] = self.before(symbol, lo[alive]), self.before(symbol, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        dead = lo >= hi
        lo[dead] = hi[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        todo = np.arange(len(rows))
        while len(todo):
            known = self.sampled[at[todo]]
            done = known >= 0
            out[todo[done]] = known[done] + walked[todo[done]]
            todo = todo[~done]
            at[todo] = self.before(self.last[at[todo]], at[todo])
            walked[todo] += 1
        return out


class Windows:
    """The windows of some runs of benchmark words, by length.

    Windows are places in the words they share, and their items lists in one
    array, so a block takes a few times the bytes of its words as numbers.
    """

    def __init__(self, runs: list[tuple[int | None, list[bytes]]], size: int = WINDOW) -> None:
        self.symbols: dict[bytes, int] = {}
        runs = [(item, words) for item, words in runs if words]
        many = np.fromiter((len(words) for _, words in runs), np.int64, len(runs))
        self.words = np.fromiter((self.symbols.setdefault(w, len(self.symbols) + 1) for _, words in runs for w in words), np.int32, int(many.sum()))
        length = np.minimum(many, size)
        count = many - length + 1
        run = np.repeat(np.arange(len(runs)), count)
        starts = np.arange(len(run)) + np.repeat(np.cumsum(many) - many - np.cumsum(count) + count, count)
        named = np.array([item is not None for item, _ in runs], bool)  # without an id it hits, but has no name
        names = np.array([item if item is not None else 0 for item, _ in runs], np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # places, and where each one's items begin among the items
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length[run] == n)
            first, which = np.unique(self.words[starts[own][:, None] + np.arange(n)], axis=0, return_index=True, return_inverse=True)[1:]
            pairs = np.unique(np.stack((which.ravel(), names[run[own]]))[:, named[run[own]]], axis=1)
            self.by_length[n] = (starts[own][first], np.searchsorted(pairs[0], np.arange(len(first) + 1)), pairs[1])
        self.shortest = min(self.by_length, default=0)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[int]]]:
        """Word counts and, over all words of the shard, a 0/1 hit mark; the first word of each text; its items."""
        lists = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        firsts = np.concatenate(([0], np.cumsum(counts + 1)))[:-1]
        total = int((counts + 1).sum())
        ids = np.fromiter(chain.from_iterable(chain(map(self.symbols.get, ws, repeat(0)), (0,)) for ws in lists), np.int64, total)
        found: list[set[int]] = [set() for _ in texts]
        marks = np.zeros(total + 1, np.int64)
        if self.shortest and total:
            inside = np.concatenate(([False], ids > 0, [False]))
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            begin, end = edge[::2], edge[1::2]
            long = end - begin >= self.shortest
            begin, end = begin[long], end[long]
            if len(begin):
                sizes = end - begin + 1  # with the separator after it
                place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
                index = FmIndex(ids[place], len(self.symbols))
                for n, (windows, begin_items, items) in self.by_length.items():
                    lo, hi = index.search(self.words, windows, n)
                    which = np.flatnonzero(hi > lo)
                    if not len(which):
                        continue
                    many = hi[which] - lo[which]
                    rows = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[which], many)
                    at = place[index.locate(rows)]
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + n, -1)
                    doc = np.searchsorted(firsts, at, side="right") - 1
                    pairs = np.unique(np.stack((doc, np.repeat(which, many))), axis=1)
                    for d, w in pairs.T.tolist():
                        found[d].update(items[begin_items[w] : begin_items[w + 1]].tolist())
        return counts, np.cumsum(marks[:-1]) > 0, firsts, found


def _blocks(bench: DataFrame, size: int) -> Iterator[Broadcast]:
    """The windows of the benchmark in blocks of at most ``ITEMS_WORDS`` words and one window.

    An item that goes over a block's end goes on in the next one with all
    windows that the first lacks, so that blocks have a size however long an
    item is. A block is sent to the executors once.
    """
    send = bench.sparkSession.sparkContext.broadcast
    runs: list[tuple[int | None, list[bytes]]] = []
    held, sent = 0, False
    for r in bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        words, at = words_of(r[1]), 0
        while True:
            end = min(len(words), at + max(1, ITEMS_WORDS - held) + size - 1)
            runs.append((r[0], words[at:end]))
            held += end - at
            if held >= ITEMS_WORDS:
                yield send(Windows(runs, size))
                runs, held, sent = [], 0, True
            if end == len(words):
                break
            at = end - size + 1
    if runs or not sent:
        yield send(Windows(runs, size))


def contamination(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted array), spans.

    spans are the merged hit words as ``first:end`` word numbers, end
    exclusive, comma-joined. Null or empty texts have no words and no hits;
    items without words have no windows; words of items with a null id are
    hit, and only the id is left out of items; an empty benchmark hits nothing. Repeated rows are scored each.
    A benchmark beyond ``ITEMS_WORDS`` is applied in blocks, one staged pass
    for each, so what is sent to executors is bounded.
    """
    out = None
    for windows in _blocks(bench, size):
        if out is None:
            source = id_text(docs).select("doc_id", "text", F.array().cast("array<long>").alias("items"), F.lit("").alias("spans"))
        else:
            source = staged(out, docs)

        def scan(batches: Iterator[pa.RecordBatch], windows=windows) -> Iterator[pa.RecordBatch]:
            for piece, texts in text_steps(batches, SHARD_CHARS):
                counts, hit, firsts, found = windows.value.hits(texts)
                spans, n_hit = [], []
                for c, f, earlier in zip(counts.tolist(), firsts.tolist(), piece.column("spans").to_pylist(), strict=True):
                    own = hit[f : f + c]
                    if earlier:
                        own = own.copy()
                        for s in earlier.split(","):
                            a, b = map(int, s.split(":"))
                            own[a:b] = True
                    n_hit.append(int(own.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).tolist() if n_hit[-1] else []
                    spans.append(",".join(f"{a}:{b}" for a, b in zip(edge[::2], edge[1::2], strict=True)))
                items = [sorted(x | set(old)) for x, old in zip(found, piece.column("items").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text"), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.string()), pa.array(counts), pa.array(n_hit, pa.int64())], names=["doc_id", "text", "items", "spans", "n_words", "n_hit"])

        out = source.select("doc_id", "text", "items", "spans").mapInArrow(lean(scan), "doc_id long, text string, items array<long>, spans string, n_words long, n_hit long")
    return out.select("doc_id", "n_words", "n_hit", "items", "spans")


def cut(text: str, hit: np.ndarray) -> str:
    """``text`` without its hit words and what stands between neighbouring ones."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
    at = [m.span() for m in _WORD.finditer(text)]
    kept, last = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*kept, text[last:]])


def decontaminated(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs``, all columns and rows, with every removal span cut from ``text``.

    A text is cut again while words on both sides of a cut form a window.
    n_chars, where there is one, follows the text. Texts without a hit come
    back as they are, nulls as nulls. A benchmark beyond ``ITEMS_WORDS`` is
    marked block by block and cut once by the union, in staged rounds until
    no block hits.
    """
    blocks = _blocks(bench, size)
    windows = next(blocks)
    if next(blocks, None) is not None:
        return _cut_by_blocks(docs, bench, size)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_steps(batches, SHARD_CHARS):
            todo = list(range(len(texts)))
            changed = set()
            while todo:
                counts, hit, firsts, _ = windows.value.hits([texts[i] for i in todo])
                own = [hit[f : f + c] for f, c in zip(firsts.tolist(), counts.tolist(), strict=True)]
                again = [k for k, x in enumerate(own) if x.any()]
                for k in again:
                    texts[todo[k]] = cut(texts[todo[k]], own[k])
                todo = [todo[k] for k in again]
                changed.update(todo)
            yield _with_texts(piece, texts, changed)

    return small_batches(docs).mapInArrow(lean(clean), docs.schema)


def _with_texts(piece: pa.RecordBatch, texts: list[str], changed: set[int]) -> pa.RecordBatch:
    """``piece`` with the texts of the ``changed`` rows, and n_chars with them."""
    if not changed:
        return piece
    names, columns = piece.schema.names, list(piece.columns)
    for name, value in (("text", lambda t: t), ("n_chars", len)):
        if name in names:
            k = names.index(name)
            columns[k] = pa.array([value(texts[i]) if i in changed else old for i, old in enumerate(columns[k].to_pylist())], piece.schema.field(name).type)
    return pa.RecordBatch.from_arrays(columns, schema=piece.schema)


def _cut_by_blocks(docs: DataFrame, bench: DataFrame, size: int) -> DataFrame:
    """Rounds of marking the words that any block hits and cutting them.

    The marks are a column of spans, null where a text is done.
    """
    spans = "spans"
    while spans in docs.columns:
        spans += "_"

    def cut_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_steps(batches, SHARD_CHARS):
            marks, changed = piece.column(spans).to_pylist(), set()
            for i, said in enumerate(marks):
                if said:
                    texts[i] = cut(texts[i], _marked(len(words_of(texts[i])), said))
                    changed.add(i)
            piece = _with_texts(piece, texts, changed)
            k = piece.schema.names.index(spans)
            yield piece.set_column(k, piece.schema.field(k), pa.array(["" if said else None for said in marks], piece.schema.field(k).type))

    now = small_batches(docs).withColumn(spans, F.when(F.lit(True), F.lit("")))
    while True:
        for windows in _blocks(bench, size):

            def mark(batches: Iterator[pa.RecordBatch], windows=windows) -> Iterator[pa.RecordBatch]:
                for piece, texts in text_steps(batches, SHARD_CHARS):
                    marks = piece.column(spans).to_pylist()
                    live = [i for i, said in enumerate(marks) if said is not None]
                    counts, hit, firsts, _ = windows.value.hits([texts[i] for i in live])
                    for i, c, f in zip(live, counts.tolist(), firsts.tolist(), strict=True):
                        own = hit[f : f + c] | _marked(c, marks[i])
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).tolist()
                        marks[i] = ",".join(f"{a}:{b}" for a, b in zip(edge[::2], edge[1::2], strict=True))
                    k = piece.schema.names.index(spans)
                    yield piece.set_column(k, piece.schema.field(k), pa.array(marks, piece.schema.field(k).type))

            now = staged(now.mapInArrow(lean(mark), now.schema))
        if now.where(F.col(spans) != "").isEmpty():
            return now.drop(spans)
        now = staged(now.mapInArrow(lean(cut_marked), now.schema))


def _marked(n: int, spans: str) -> np.ndarray:
    """Marks of the words of ``first:end`` spans among ``n`` words."""
    own = np.zeros(n, bool)
    for s in spans.split(",") if spans else ():
        a, b = map(int, s.split(":"))
        own[a:b] = True
    return own
