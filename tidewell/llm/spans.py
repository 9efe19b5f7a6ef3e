"""What the span finders share: turning located spans into columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import id_text, lean, text_steps

Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def folded(text: str) -> str:
    """Lower case of the same length, so places in it are places in ``text``."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def span_table(docs: DataFrame, find: Callable[[], Callable[[str], list[Span]]], base: Sequence[str], order: Callable[[Span], tuple]) -> DataFrame:
    """doc_id, n_<kind> for each base kind, base_sha256, spans; one row per row.

    ``find`` is called once in each task and gives the finder of a text.
    """
    base = list(base)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = find()
        for piece, texts in text_steps(batches):
            counts: dict[str, list[int]] = {k: [] for k in base}
            digests, every = [], []
            for text in texts:
                spans = sorted(finder(text), key=order)
                own = [x for x in spans if x[0] in counts]
                for k in base:
                    counts[k].append(sum(x[0] == k for x in own))
                digests.append(hashlib.sha256(joined(own).encode()).hexdigest())
                every.append(joined(spans))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in base), pa.array(digests, pa.string()), pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])

    return id_text(docs).mapInArrow(lean(of), "doc_id long, " + "".join(f"n_{k} long, " for k in base) + "base_sha256 string, spans string")
