"""Token counts under a unigram tokenizer by dynamic programming on a trie.

Distinct pre-tokens are inserted in a trie. A node is a prefix, and the best
segmentation of a prefix depends on nothing after it, so its forward score is
computed once, when the node is made, however many pre-tokens pass through it.
Terminal nodes hold the pre-token's token count.

The pieces are those of a public sentencepiece file, which lists them by
merit; the score of the piece of rank r is -log(r + 1) (Zipf's law). Nothing
is trained. A character that no piece covers costs one token for each of its
UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import id_text, lean, text_steps

#: Trie nodes that a worker keeps before it begins a new trie, pre-tokens whose
#: counts it remembers, and bytes of text in a step.
NODES = 300_000
KNOWN = 900_000
STEP = 100_000
#: Characters of a pre-token in the trie; of a longer one only the states within reach of a piece are held on.
DEPTH = 64
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece model and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: -math.log(r + 1) for r, p in enumerate(plain, 1)}


class Trie:
    """Prefixes of pre-tokens with (forward score, tokens, state) of their best segmentation.

    The trie is hashed: a node is found by its prefix, so a new pre-token
    begins at the longest prefix it shares with any before. A better
    segmentation has the higher score, then the fewer tokens. The state is
    that of an Aho-Corasick automaton of the pieces after the prefix; it knows
    all pieces that end there.
    """

    def __init__(self, pieces: dict[str, float]) -> None:
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=-1.0) * 2
        self.go: list[dict[str, int]] = [{}]
        self.ending: list[tuple[tuple[int, float], ...]] = [()]
        for piece, score in pieces.items():
            at = 0
            for c in piece:
                if c not in self.go[at]:
                    self.go[at][c] = len(self.go)
                    self.go.append({})
                    self.ending.append(())
                at = self.go[at][c]
            self.ending[at] = ((len(piece), score),)
        self.fail = [0] * len(self.go)
        order = list(self.go[0].values())
        for at in order:  # grows by what follows, so shorter prefixes come first
            for c, to in self.go[at].items():
                order.append(to)
                self.fail[to] = self.follow(self.fail[at], c)
                self.ending[to] += self.ending[self.fail[to]]
        self.known: dict[str, int] = {}
        self.clear()

    def follow(self, state: int, c: str) -> int:
        row = self.go[state]
        while state and c not in row:
            state = self.fail[state]
            row = self.go[state]
        return row.get(c, 0)

    def clear(self) -> None:
        self.nodes: dict[str, tuple[float, int, int]] = {"": (0.0, 0, 0)}

    def insert(self, word: str) -> int:
        """Tokens of a pre-token, without the leading mark in ``word``."""
        text = MARK + word
        nodes, go, fail, ending, byte = self.nodes, self.go, self.fail, self.ending, self.byte
        known = deep = min(len(text), DEPTH)
        while (node := nodes.get(text[:known])) is None:
            known -= 1
        score, count, state = node
        path: list[tuple[float, int, int]] = []  # beyond the trie: the states of the last prefixes
        for i in range(known, len(text)):
            c = text[i]
            row = go[state]
            while state and c not in row:
                state = fail[state]
                row = go[state]
            state = row.get(c, 0)
            width = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
            if i == deep:
                path = [nodes[text[:k]] for k in range(max(0, deep + 1 - self.longest), deep + 1)]
            score, count = score + byte * width, count + width
            for length, own in ending[state]:
                before = nodes[text[: i + 1 - length]] if i < deep else path[-length]
                s = before[0] + own
                if s > score or s == score and before[1] + 1 < count:
                    score, count = s, before[1] + 1
            if i < deep:
                nodes[text[: i + 1]] = (score, count, state)
            else:
                path.append((score, count, state))
                if len(path) > 8 * self.longest:
                    del path[: -self.longest]
        if len(text) <= DEPTH:
            self.known[word] = count
        return count

    def counts(self, words: list[str]) -> int:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.nodes) > NODES:
                self.clear()
            if len(self.known) > KNOWN:
                self.known.clear()
            known = self.known
            found = [(known[w] if w in known else self.insert(w)) if n is None else n for w, n in zip(words, found, strict=True)]
        return sum(found)


@lru_cache(maxsize=1)
def worker_trie(path: str) -> Trie:
    """One trie per worker process."""
    return Trie(load_pieces(path))


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pretokens, n_tokens (long).

    Pre-tokens are runs without Unicode white space, each read with a leading
    mark for the blank before it. Null and empty texts have none. Other
    columns are ignored.
    """
    path = model or default_model()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_trie(path)
        for piece, texts in text_steps(batches, STEP):
            pre, tokens = [], []
            for t in texts:
                words = t.split()
                pre.append(len(words))
                tokens.append(trie.counts(words))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return id_text(docs).mapInArrow(lean(of, worker_trie), "doc_id long, n_pretokens long, n_tokens long")
