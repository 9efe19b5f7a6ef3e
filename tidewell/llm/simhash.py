"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Distinct fingerprints are ordered by the population counts of their four
16-bit quarters and cut into blocks. Every pair of blocks is one row of work:
numpy exclusive-or and bit counts over tiles, skipping tile pairs (and whole
block pairs) whose population counts differ by more than the radius, which no
pair within the radius can do. Each block pair yields a spanning forest of its
links, never the links themselves, and the forests are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import id_text, lean, small_batches, staged, text_steps
from tidewell.llm.components import components, local_roots

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a block (8 bytes each) and in a tile.
BLOCK = 32_768
TILE = 512
#: Pairs of blocks in a task at least, where there are thousands of tasks.
PAIRS = 64

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text.

    A-Z is folded, words are runs without ASCII white space, a feature is
    each run of ``shingle`` words (all words where there are fewer) under
    XXH64 with seed 42. No word at all: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    run = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(run[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_steps(batches):
            fp = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return id_text(docs).mapInArrow(lean(of), "doc_id long, fp long")


def quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view("<u2").reshape(-1, 4)).astype(np.int16)


def _gap(lo_a, hi_a, lo_b, hi_b):
    """Least difference of population counts between boxes, summed over quarters."""
    return np.maximum(0, np.maximum(lo_b - hi_a, lo_a - hi_b)).sum(axis=-1)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within ``a``, or between a and b.

    Exact: every pair is compared unless its tiles' counts rule it out.
    """
    same = b is None
    b = a if same else b
    qa, qb = quarters(a), quarters(b)
    cut_a, cut_b = np.arange(0, len(a), tile), np.arange(0, len(b), tile)
    lo_a, hi_a = np.minimum.reduceat(qa, cut_a), np.maximum.reduceat(qa, cut_a)
    lo_b, hi_b = np.minimum.reduceat(qb, cut_b), np.maximum.reduceat(qb, cut_b)
    at_a, at_b, held = [], [], 0
    root = np.arange(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)

    def fold() -> None:
        nonlocal root, held
        if at_a:
            x, y = np.concatenate(at_a), np.concatenate(at_b) + shift
            root = local_roots(np.concatenate((x, np.arange(len(root)))), np.concatenate((y, root)), len(root))
            at_a.clear()
            at_b.clear()
            held = 0

    for i, s in enumerate(cut_a):
        near = np.nonzero(_gap(lo_a[i], hi_a[i], lo_b, hi_b) <= radius)[0]
        for j in near[near >= i] if same else near:
            x, y = a[s : s + tile], b[cut_b[j] : cut_b[j] + tile]
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if same and i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                at_a.append(p + s)
                at_b.append(q + cut_b[j])
                held += len(p)
                if held > 2_000_000:
                    fold()
    fold()
    tied = np.nonzero(root != np.arange(len(root)))[0]
    every = a if same else np.concatenate((a, b))
    return every[tied], every[root[tied]]


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK, docs: DataFrame | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> (u, v): edges that span all their links."""
    quarter = [F.expr(f"bit_count(shiftrightunsigned(fp, {16 * k}) & 65535)").cast("int").alias(f"q{k}") for k in range(4)]
    n = distinct.count()
    blocks_wanted = max(1, -(-n // block))
    ordered = distinct.select("fp", *quarter).repartitionByRange(blocks_wanted, "q0", "q1", "q2", "q3", "fp").sortWithinPartitions("q0", "q1", "q2", "q3", "fp")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(fp: np.ndarray) -> pa.RecordBatch:
            q = quarters(fp)
            return pa.RecordBatch.from_pydict({"fps": [fp.tobytes()], "lo": [q.min(axis=0).tolist()], "hi": [q.max(axis=0).tolist()]}, schema=pa.schema([("fps", pa.binary()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))]))

        for batch in batches:
            held.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            while sum(map(len, held)) >= block:
                every = np.concatenate(held)
                yield out(every[:block])
                held = [every[block:]]
        if held and len(every := np.concatenate(held)):
            yield out(every)

    blocks = ordered.select("fp").mapInArrow(lean(pack), "fps binary, lo array<int>, hi array<int>").withColumn("b", F.monotonically_increasing_id())
    blocks = staged(blocks)
    # block pairs that the counts allow: equal values of the first quarter's count meet, the rest is a filter
    heads = blocks.select("b", "lo", "hi")
    ours = heads.select("b", "lo", "hi", F.explode(F.sequence(F.expr("lo[0]"), F.expr("hi[0]"))).alias("z"))
    theirs = heads.select(F.col("b").alias("c"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(F.expr(f"greatest(lo[0] - {radius}, 0)"), F.expr(f"least(hi[0] + {radius}, 16)"))).alias("z"))
    gap = " + ".join(f"greatest(0, lo2[{k}] - hi[{k}], lo[{k}] - hi2[{k}])" for k in range(4))
    pairs = staged(ours.join(theirs, "z").where(f"b <= c and {gap} <= {radius}").select("b", "c").distinct(), docs)
    x, y = blocks.select("b", F.col("fps").alias("x")), blocks.select(F.col("b").alias("c"), F.col("fps").alias("y"))
    work = pairs.join(x, "b").join(y, "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pydict()
                x = np.frombuffer(one["x"][0], np.uint64)
                u, v = forest(x, None if one["b"] == one["c"] else np.frombuffer(one["y"][0], np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    many = pairs.count()
    tasks = min(many, max(4096, many // PAIRS))  # a pair is a second's work at most, so a task stays short at any size
    return small_batches(work).select("b", "c", "x", "y").repartition(max(1, tasks), "b", "c").mapInArrow(lean(compare), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits. Null and empty texts have the zero fingerprint
    and link like any other. Repeated rows keep their repeats. A null doc_id
    never names a component unless nothing else is in it (then it is null).
    Further columns are ignored; an empty table gives an empty table.
    """
    fps = staged(fingerprints(docs), docs)
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), docs)
    roots = components(links(distinct.select("fp"), radius, docs=docs), docs)
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = member.join(named, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents that name their own component, all columns kept.

    One document of each group stays, the one of the smallest doc_id. Rows
    that repeat a doc_id count as the same document and all stay; a row with
    a null doc_id stays only where its group holds nothing else.
    """
    names = near_duplicates(docs, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept"))
    return docs.join(names, docs["doc_id"].cast("long").eqNullSafe(names["__kept"]), "left_semi")
