"""Token counts by greedy longest match in linear time.

The vocabulary is a trie. Every node has a failure link: where the automaton goes on when the
node's string can't be extended, after the longest tokens in front have been popped. Only the
number of popped tokens is kept, so counting makes no pieces.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CACHED_WORDS = 500_000
#: A vocabulary is read on the driver and sent to the tasks; larger ones are refused.
MAX_PIECES = 1_000_000
_WORD = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^\s0-9a-z\x80-\xff]+")


class Automaton:
    """Tries of word-start pieces and of continuation pieces with failure links.

    ``start`` and ``rest`` are the pieces allowed at and after the beginning of a word.
    ``step`` maps (node << 8 | byte) to a node, ``fail`` and ``popped`` are lists by node.
    Node 0 is the root, node 1 the root of continuation pieces, -1 no node.
    """

    def __init__(self, start: set[bytes], rest: set[bytes]):
        if len(start) + len(rest) > 2 * MAX_PIECES:
            raise ValueError(f"more than {MAX_PIECES} pieces")
        self.step: dict[int, int] = {}
        strings, final = [b"", b""], [False, False]
        for root, pieces in ((0, start), (1, rest)):
            for piece in sorted(pieces):
                node = root
                for i, c in enumerate(piece):
                    nxt = self.step.get(node << 8 | c)
                    if nxt is None:
                        nxt = self.step[node << 8 | c] = len(strings)
                        strings.append(piece[: i + 1])
                        final.append(False)
                    node = nxt
                final[node] = True
        n = len(strings)
        self.fail, self.popped = [-1] * n, [0] * n
        # Parents come before children, shorter strings before longer ones.
        parents = sorted(((child, key >> 8, key & 255) for key, child in self.step.items()), key=lambda x: len(strings[x[0]]))
        for node, parent, c in parents:
            if final[node]:
                self.fail[node], self.popped[node] = 1, 1
                continue
            # Pop what the parent would pop, then what its successors must, until c fits.
            at, count = self.fail[parent], self.popped[parent]
            while at != -1 and (at << 8 | c) not in self.step:
                count += self.popped[at]
                at = self.fail[at]
            if at != -1:
                self.fail[node], self.popped[node] = self.step[at << 8 | c], count

    def count(self, word: bytes) -> int:
        """Tokens of the greedy longest-match split; 1 (unknown) where there is none; 0 if empty."""
        if not word:
            return 0
        step, fail, popped = self.step, self.fail, self.popped
        node, tokens = 0, 0
        for c in word:
            nxt = step.get(node << 8 | c)
            while nxt is None:
                tokens += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = step.get(node << 8 | c)
            node = nxt
        # What is left in the node must end exactly at the root of continuations.
        while node != 1:
            tokens += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return tokens


def greedy_count(word: bytes, start: set[bytes], rest: set[bytes]) -> int:
    """The same by cutting the longest piece again and again: slow, for tests."""
    at, tokens = 0, 0
    while at < len(word):
        pieces = rest if at else start
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, tokens = end, tokens + 1
    return tokens


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(other)}}


def load_vocabulary(path: str, word_end: str = "</w>") -> tuple[set[bytes], set[bytes]]:
    """Pieces of a tokenizer file (JSON with model.vocab) whose word-final pieces carry a mark.

    A word is looked up with a zero byte behind it, which stands for the mark. Words may start
    with any piece, so both sets are the same.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet, pieces = _byte_alphabet(), set()
    for piece in vocab:
        ends = piece.endswith(word_end)
        body = piece[: -len(word_end)] if ends else piece
        if body and all(c in alphabet for c in body):
            pieces.add(bytes(alphabet[c] for c in body) + (b"\0" if ends else b""))
    return pieces, pieces


def split_words(text: bytes | None) -> list[bytes]:
    """Runs of letters (A-Z lower-cased; all non-ASCII bytes count as letters), single digits,
    runs of other signs. Zero bytes are blanks."""
    return _WORD.findall(text.lower().replace(b"\0", b" ")) if text else []


def token_counts(documents: DataFrame, start: set[bytes], rest: set[bytes], end: bytes = b"\0") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_bytes (long).

    Whole texts are counted; null and empty texts have 0 of all. A word that can't be split
    into pieces counts one token. Repeated rows each get a row; a null doc_id stays null;
    other columns are ignored. The automaton, of bounded size, is broadcast.
    """
    automaton = documents.sparkSession.sparkContext.broadcast(Automaton(start, rest))

    class Counts(dict):
        def __missing__(self, word):
            if len(self) >= _CACHED_WORDS:
                self.clear()
            n = self[word] = automaton.value.count(word + end)
            return n

    def run(batches):
        counts = Counts()
        for batch in batches:
            words, tokens, size = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                own = split_words(text)
                words.append(len(own))
                tokens.append(sum(map(counts.__getitem__, own)))
                size.append(len(text) if text else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(size, pa.int64())],
                names=["doc_id", "n_words", "n_tokens", "n_bytes"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_bytes long")
