"""Packing token pieces into sequences by swap-based local search.

Texts are tokenised once, in place. Only (doc_id, piece, start, length, crc)
moves: pieces are dealt by hash into groups of bounded expected size, each
group starts from best fit and is then improved by moves and exchanges between
underfull bins that raise the sum of squared fills until bins run empty.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import id_text, lean, staged, text_steps

CAPACITY = 4096
END_ID = 1
#: Expected documents in a packing group, and chunks, and parts of chunks, whose ids a worker remembers.
GROUP_DOCS = 20_000
CACHE = 900_000
PARTS = 300_000
#: Characters encoded at a time; few enough that their chunks stay in the processor's cache.
STEP = 100_000
_PLAIN = re.compile(r"([^\w\s'<]*)([^\W\d_]+)([^\w\s'<]*)")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _apart(chunk: str, word: str, trail: str) -> bool:
    """Whether no mark of ``trail`` joins ``word``, nor one that lower case makes of it joins ``trail``."""
    return unicodedata.is_normalized("NFC", chunk) and "İ" not in word and not (trail and unicodedata.category(trail[0])[0] == "M")


@lru_cache(maxsize=1)
def chunk_encoder(path: str):
    """Function texts -> list of little-endian id bytes; one per worker process.

    The tokenizer drops white space and never joins across it, so texts are
    cut at blanks and each distinct chunk is encoded once while remembered.
    Chunks of letters with other signs around them are cut into those parts,
    which are encoded many to a text and told apart by the tokens that end a
    word; chunks whose letters and signs the tokenizer's normalizers may join
    are encoded whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        ends_word[i] = token.endswith("</w>")
    known: dict[str, bytes] = {}
    parts: dict[str, bytes] = {"": b""}

    def apart(chunks: list[str], into: dict[str, bytes]) -> None:
        into.update(zip(chunks, (np.array(e.ids, "<u4").tobytes() for e in encode(chunks, add_special_tokens=False)), strict=True))

    def together(words: list[str]) -> None:
        ids = np.array(encode([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ends_word[ids])
        if len(ends) != len(words):  # some has more words than it shows
            return apart(words, parts)
        cuts, raw = [0, *((ends + 1) * 4).tolist()], ids.tobytes()
        parts.update(zip(words, (raw[a:b] for a, b in pairwise(cuts)), strict=True))

    def learn(chunks: set[str]) -> None:
        plain, rest = [], []
        for c in chunks:
            if (m := _PLAIN.fullmatch(c)) and (c.isascii() or _apart(c, m[2], m[3])):
                lead, word, trail = m.groups()
                low = word.lower()
                plain.append((c, lead, low if len(low) == len(word) and "Σ" not in word else word, trail))
            else:
                rest.append(c)
        fresh = list({x for p in plain for x in p[1:] if x not in parts})
        for i in range(0, len(fresh), 5_000):
            together(fresh[i : i + 5_000])
        known.update({c: parts[a] + parts[b] + parts[d] for c, a, b, d in plain})
        for i in range(0, len(rest), 20_000):
            apart(rest[i : i + 20_000], known)

    def ids(texts: list[str]) -> list[bytes]:
        if len(known) > CACHE:
            known.clear()
        if len(parts) > PARTS:
            parts.clear()
            parts[""] = b""
        lists = [t.replace("\n", " ").split(" ") for t in texts]
        found = [list(map(known.get, cs)) for cs in lists]
        gaps = [[k for k, v in enumerate(vs) if v is None] if None in vs else () for vs in found]
        learn({cs[k] for cs, g in zip(lists, gaps, strict=True) for k in g})
        for cs, vs, g in zip(lists, found, gaps, strict=True):
            for k in g:
                vs[k] = known[cs[k]]
        return [b"".join(vs) for vs in found]

    return ids


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and a final 1, cut at ``capacity``."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(path)
        for piece, texts in text_steps(batches, STEP):
            rows: list[tuple[int | None, int, int, int, int]] = []
            for doc, ids in zip(piece.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(lean(of, chunk_encoder), _PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if n >= capacity:
            bins.append([i])
            continue
        k = bisect_left(free, (n, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            insort(free, (room - n, b))
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty the emptiest underfull bins by moves, 1-1 and 2-1 exchanges.

    Every step raises the sum of squared fills: items go from the emptiest
    bin to a fuller one, or the fuller one swaps for a larger item, or for two
    that are larger together. That sum is bounded, so the search ends: at the
    bound of total length over capacity, or when no step is left.
    """
    bins = [list(b) for b in bins]
    size = np.array(lengths, np.int64)
    where = np.zeros(len(size), np.int64)
    for b, items in enumerate(bins):
        where[items] = b
    fill = np.bincount(where, size, len(bins)).astype(np.int64) if len(size) else np.zeros(len(bins), np.int64)
    least, live = -(-int(size.sum()) // capacity), sum(map(bool, bins))
    open_items = np.flatnonzero(fill[where] < capacity)  # bins that are full stay as they are
    stuck, moved = np.zeros(len(bins), bool), False
    while live > least:
        free = np.where((fill > 0) & (fill < capacity) & ~stuck, fill, capacity)
        small = int(free.argmin()) if len(free) else 0
        if not len(free) or free[small] == capacity:
            if not moved:
                break
            stuck[:], moved = False, False  # steps may have made room for others
            continue
        step = _step(bins, size, where, fill, open_items, small, capacity)
        if step is None:
            stuck[small] = True
            continue
        into, give, take = step
        moved = True
        for source, to, items in ((small, into, give), (into, small, take)):
            moved = set(items)
            bins[source] = [i for i in bins[source] if i not in moved]
            bins[to] += items
            where[items] = to
            fill[source] -= size[items].sum()
            fill[to] += size[items].sum()
        if not bins[small]:
            live -= 1
            stuck[:] = False
    return [b for b in bins if b]


def _step(bins, size, where, fill, open_items, small: int, capacity: int) -> tuple[int, list[int], list[int]] | None:
    """What ``small`` gives to the fullest bin that allows a step, and takes back; None without any."""
    mine: dict[int, list[int]] = {}
    for i in bins[small]:  # items of one length serve alike, and few lengths fit in a bin
        mine.setdefault(int(size[i]), []).append(i)
    room = np.where((fill >= fill[small]) & (fill < capacity), capacity - fill, 0)
    room[small] = 0
    fits = np.where(room >= min(mine), fill, -1)
    if len(fits) and fits[into := int(fits.argmax())] >= 0:
        return into, [mine[max(n for n in mine if n <= room[into])][0]], []
    ns = sorted(mine)
    give = {x + y: [mine[x][0], mine[y][x == y]] for i, x in enumerate(ns) for y in ns[i:] if x != y or len(mine[x]) > 1}
    give |= {n: [mine[n][0]] for n in ns}
    most = np.zeros(capacity + 1, np.int64)  # the largest sum up to a bound
    most[list(give)] = list(give)
    most = np.maximum.accumulate(most)
    theirs = size[open_items]
    space = room[where[open_items]]
    gain = np.where(space > 0, most[np.minimum(theirs + space, capacity)] - theirs, 0)
    if not len(gain) or gain.max() <= 0:
        return None
    best = int(np.where(gain > 0, fill[where[open_items]] * (capacity + 1) + gain, 0).argmax())
    return int(where[open_items[best]]), give[int(theirs[best] + gain[best])], [int(open_items[best])]


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the final id alone. Pieces of
    ``capacity`` ids fill a sequence each. Rows with the same doc_id are
    packed as documents of their own. An empty table gives no pieces. The
    number of groups follows the number of rows, so a group stays about as
    large; each costs at most one underfull sequence.
    """
    cut = staged(pieces(docs, tokenizer, capacity), docs)
    groups = max(1, -(-cut.count() // GROUP_DOCS))

    def pack(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        lengths = one["length"].tolist()
        sequence, offset = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        for k, b in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in b:
                sequence[i], offset[i] = k, at
                at += lengths[i]
        one["sequence_id"] = one["g"].astype("int64") * (1 << 32) + sequence
        one["offset"] = offset
        return one.drop(columns="g")

    dealt = cut.withColumn("g", F.expr(f"cast(pmod(xxhash64(doc_id, piece, ids_crc32), {groups}) as int)"))
    return dealt.groupBy("g").applyInPandas(pack, _PIECES + ", sequence_id long, offset long")
