"""Token counts: a linear longest-match automaton over a word-piece vocabulary.

A word (a run of characters other than the six ASCII white space characters) is read as its UTF-8 bytes
after one space, the way the byte-level vocabulary marks the start of a word. Greedy longest match cuts it
into pieces. The automaton is the vocabulary's trie; a node's failure link leads to where matching goes on
once the pieces that are certain by then are popped, and the node keeps *how many* pieces that pops. A word
is then counted in time linear in its bytes, without any piece being built. Every single byte is in the
vocabulary, so each word has a segmentation.

Null and empty texts have 0 words and 0 pieces. Repeated rows are each counted; greedy matching leaves no ties. Words and
texts of any length are counted whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkrank.llm.common import ddl, documents, per_batch, texts

COUNTS = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_bytes": pa.int64(), "n_pieces": pa.int64()}
#: Counted words a Python worker remembers; a full memory is emptied, which changes no count.
REMEMBERED = 200_000


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def vocabulary(file: str) -> list[bytes]:
    with open(file, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f]


class LongestMatch:
    """Counts the pieces of greedy longest match. ``pieces`` must hold every byte that a word can have."""

    def __init__(self, pieces: list[bytes]):
        step: dict[int, int] = {}  # node << 8 | byte -> node
        is_piece, edges = [False], [[]]
        for piece in pieces:
            at = 0
            for byte in piece:
                to = step.get(at << 8 | byte)
                if to is None:
                    to = step[at << 8 | byte] = len(is_piece)
                    is_piece.append(False)
                    edges.append([])
                    edges[at].append((byte, to))
                at = to
            is_piece[at] = bool(at) or is_piece[at]
        fail, popped = [0] * len(is_piece), [0] * len(is_piece)
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for byte, node in edges[parent]:
                todo.append(node)
                if is_piece[node]:
                    popped[node] = 1  # the whole of it is one piece; what follows starts afresh
                    continue
                if not parent:
                    raise ValueError(f"byte {byte} starts pieces but is none itself")
                count, at = popped[parent], fail[parent]
                while (to := step.get(at << 8 | byte)) is None:
                    if not at:
                        raise ValueError(f"byte {byte} is no piece")
                    count, at = count + popped[at], fail[at]
                popped[node], fail[node] = count, to
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: bytes) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        at = count = 0
        for byte in word:
            while (to := step.get(at << 8 | byte)) is None:
                if not at:
                    raise ValueError(f"byte {byte} is no piece")
                count += popped[at]
                at = fail[at]
            at = to
        while at:
            count += popped[at]
            at = fail[at]
        return count


def token_counts(docs: DataFrame, file: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_words, n_bytes, n_pieces."""
    file = file or vocabulary_file()

    def run(batches):
        automaton, known = LongestMatch(vocabulary(file)), {}

        def measure(ids, whole):
            out = []
            for text in whole:
                raw = text.encode()
                words = raw.split()  # bytes split at the six ASCII white space characters alone
                total = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        n = automaton.count(b" " + word)
                        if len(word) <= 64:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[word] = n
                    total += n
                out.append((len(words), len(raw), total))
            return ids, *(zip(*out, strict=True))

        yield from per_batch(measure, COUNTS)(batches)

    return texts(docs).mapInArrow(run, ddl(COUNTS))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
