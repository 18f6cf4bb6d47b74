"""Exact encoding and decoding with merge-type piece vocabularies, by backtracking.

A merge-type encoder starts from single characters and joins, again and again, the adjacent
pair whose union is the best-scored piece (the leftmost of equals). A sequence of pieces is its
result exactly if every two neighbours, joined and merged anew, come out as the same two: the
first merge across a boundary would already happen within the two pieces beside it. So the
encoder walks forward with longest matches, checks only the new boundary, and on failure tries
shorter pieces or takes the last piece back. The pieces in front of a position are the same
whichever way it was reached, so a position that failed once is never tried again.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import math
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNKNOWN = " ⁇ "
NONE = -math.inf
#: Words and pairs remembered per process before the memory is emptied, and the longest such word.
_CACHED, _CACHED_LENGTH = 400_000, 48
#: Rows whose ids a task holds at once.
_ROWS = 256


class Vocabulary:
    """Pieces with scores, byte pieces and silent pieces of one merge-type model.

    ``scores``: piece -> (score, id) of the pieces that merging may form. ``byte_ids``: the id
    of each byte, for characters without a piece. ``silent``: ids that decode to nothing.
    """

    def __init__(self, scores: dict[str, tuple[float, int]], byte_ids: list[int], silent: Iterable[int], unknown: int,
                 prefix: bool):
        self.scores, self.byte_ids, self.silent, self.unknown, self.prefix = scores, byte_ids, frozenset(silent), unknown, prefix
        # A piece that its own characters do not merge into is never a result.
        self.results = {p for p in scores if self.merge(p) == [p]}
        # Where blanks stand at the front of pieces only, no merge crosses from a word to a blank.
        inner = any(BLANK in p.lstrip(BLANK) for p in scores)
        self.words = re.compile("(?s).+" if inner else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self._tables = self._encoder = None

    def merge(self, text: str) -> list[str]:
        """The encoder by its definition: join the best adjacent pair until none is left."""
        parts, get = list(text), self.scores.get
        # Scores of each part joined with the next one; only those beside a merge change.
        joined = [found[0] if (found := get(a + b)) else NONE for a, b in itertools.pairwise(parts)]
        while joined and (best := max(joined)) > NONE:
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            for j in (i - 1, i):
                if 0 <= j < len(joined):
                    found = get(parts[j] + parts[j + 1])
                    joined[j] = found[0] if found else NONE
        return parts

    def __getstate__(self):
        return self.__dict__ | {"_tables": None, "_encoder": None}

    @property
    def encoder(self) -> Encoder:
        """One per process, so that tasks share what it remembers."""
        self._encoder = self._encoder or Encoder(self)
        return self._encoder

    @property
    def tables(self):
        """Automaton, sizes, next shorter pieces and strings by id, decoded strings, bytes; built where they are used."""
        if self._tables is None:
            automaton = ahocorasick.Automaton()
            top = 1 + max([*self.byte_ids, *self.silent, self.unknown, *(i for _, i in self.scores.values())])
            size, shorter, text = [0] * top, [None] * top, [""] * top
            for p in self.results:
                i = self.scores[p][1]
                automaton.add_word(p, i)
                size[i], text[i] = len(p), p
                ends = (p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.results or k == 1)
                less = next(ends, None)
                if less is not None:
                    shorter[i] = self.scores[less][1] if less in self.results else top + ord(less)
            automaton.make_automaton()
            surface = {i: p.replace(BLANK, " ") for p, (_, i) in self.scores.items()}
            surface |= dict.fromkeys(self.silent, "") | {self.unknown: UNKNOWN}
            # An ASCII byte is a character whatever stands beside it.
            surface |= {self.byte_ids[b]: chr(b) for b in range(128)}
            self._tables = automaton, size, shorter, text, surface, {b: n for n, b in enumerate(self.byte_ids)}
        return self._tables


class Encoder(dict):
    """Encodes and decodes with a Vocabulary. As a dict it remembers the ids of short words."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.pairs = vocabulary, {}

    def text(self, piece: int) -> str:
        """A piece's string; numbers above the ids stand for characters without a piece."""
        strings = self.v.tables[3]
        return strings[piece] if piece < len(strings) else chr(piece - len(strings))

    def fits(self, left: int, right: int) -> bool:
        """Whether the two, merged anew from their characters, are the same two again."""
        if len(self.pairs) >= _CACHED:
            self.pairs.clear()
        a, b = self.text(left), self.text(right)
        out = self.pairs[left << 24 | right] = self.v.merge(a + b) == [a, b]
        return out

    def split(self, word: str) -> list[int]:
        """Ids of a word's pieces; a character without a piece is its code point above the ids."""
        automaton, size, shorter, _, _, _ = self.v.tables
        n, top, known = len(word), len(size), self.pairs.get
        longest = [None] * n
        if self.v.results:
            for end, piece in automaton.iter(word):
                longest[end - size[piece] + 1] = piece  # ends come in order, so the longest is written last
        failed, bad = bytearray(n // 8 + 1), False  # one bit a position; whether any is set
        out, at, last, piece = [], 0, None, None
        while at < n:
            if piece is None:
                piece = longest[at]
                if piece is None:
                    piece = top + ord(word[at])
            while piece is not None:
                end = at + (size[piece] if piece < top else 1)
                if not (bad and failed[end >> 3] >> (end & 7) & 1):
                    if last is None:
                        break
                    fits = known(last << 24 | piece)
                    if fits or fits is None and self.fits(last, piece):
                        break
                piece = shorter[piece] if piece < top else None
            if piece is not None:
                out.append(piece)
                at, last, piece = end, piece, None
                continue
            while piece is None:  # nothing fits here: back to a piece that has a shorter one
                if not out:
                    raise AssertionError("merging gives every text a result")
                bad = True
                failed[at >> 3] |= 1 << (at & 7)
                at -= size[last] if last < top else 1
                out.pop()
                piece = shorter[last] if last < top else None
                last = out[-1] if out else None
        return out

    def __missing__(self, word: str) -> tuple[int, ...]:
        own = self.v.scores.get(word) if word in self.v.results else None
        ids = [own[1]] if own else self.split(word)
        top = len(self.v.tables[1])
        if max(ids, default=0) >= top:
            ids = [j for i in ids for j in ([i] if i < top else [self.v.byte_ids[b] for b in chr(i - top).encode()])]
        found = tuple(ids)
        if len(word) <= _CACHED_LENGTH:
            if len(self) >= _CACHED:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = (BLANK if self.v.prefix else "") + text.replace(" ", BLANK)
        return list(itertools.chain.from_iterable(map(self.__getitem__, self.v.words.findall(text))))

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: bytes that are no UTF-8 become U+FFFD one by one; the blank in front goes."""
        *_, surface, byte_of = self.v.tables
        silent, front = self.v.silent, self.v.prefix
        first = next((i for i in ids if i not in silent), None) if front else None
        strip = first is not None and first not in byte_of and first != self.v.unknown and surface[first].startswith(" ")
        try:
            out = "".join(map(surface.__getitem__, ids))
        except KeyError:  # parts of longer characters
            runs = itertools.groupby(ids, byte_of.__contains__)
            out = "".join(_utf8(bytes(map(byte_of.__getitem__, own))) if is_byte else "".join(map(surface.__getitem__, own))
                          for is_byte, own in runs)
        return out[1:] if strip else out


def _utf8(run: bytes) -> str:
    return run.decode(errors="tapeflow-one-byte")


codecs.register_error("tapeflow-one-byte", lambda e: ("�", e.start + 1))


@functools.lru_cache(maxsize=2)
def load_model(path: str) -> Vocabulary:
    """Vocabulary of a model file; at most some tens of thousands of short pieces.

    Taken are merge-type models with byte fallback, no rewriting of the text but the marks of
    blanks, and no pieces set by hand; others are refused, since they encode by other rules.
    """
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    model = model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    how, kind, normal = model.normalizer_spec, model_pb2.ModelProto.SentencePiece, model_pb2.ModelProto.SentencePiece.NORMAL
    if (model.trainer_spec.model_type != model_pb2.TrainerSpec.BPE or how.precompiled_charsmap or how.remove_extra_whitespaces
            or not how.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix):
        raise ValueError(f"{path} is not a merge-type model that leaves texts as they are")
    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    of = {t: [i for i, p in enumerate(model.pieces) if p.type == t] for t in {p.type for p in model.pieces}}
    if kind.USER_DEFINED in of or kind.UNUSED in of or len(of.get(kind.BYTE, [])) != 256:
        raise ValueError(f"{path} holds pieces set by hand or lacks byte pieces")
    scores = {model.pieces[i].piece: (model.pieces[i].score, i) for i in of[normal]}
    byte_ids = [reader.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Vocabulary(scores, byte_ids, of.get(kind.CONTROL, []), reader.unk_id(), how.add_dummy_prefix)


def encode_documents(documents: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """One row per row of ``documents``: its id, ``ids`` (array of int), ``decoded``.

    Whole texts, without begin or end ids. Null and empty texts have no ids; bytes that are no
    UTF-8 are read as U+FFFD; repeated rows each get a row; a null id stays null; other columns
    are ignored. The vocabulary is broadcast, the words of a text are encoded one at a time.
    """
    rows = documents.select(F.col(id_column), F.col(text_column).cast("binary"))
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = shared.value.encoder
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                ids = [own.encode(t.as_py().decode(errors="replace") if t.is_valid else "") for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())],
                    names=[id_column, "ids", "decoded"])

    kind = documents.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, decoded string")


def digest(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Count of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text."""
    return encoded.select(
        id_column, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
