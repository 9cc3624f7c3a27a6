"""SentencePiece encoding by unigram Viterbi over a double-array trie of pieces, and decoding.

Spaces become the marker U+2581; a marker goes before the text. Each path of pieces has the sum of their log
scores; the best path wins (ties: the longer last piece). A character that no piece covers, and a literal
U+2581, falls back to its UTF-8 bytes. Decoding joins pieces and bytes, turns markers into spaces and drops
the first one, so every text comes back exactly.

No piece of a vocabulary that was split by whitespace holds a marker after another character, and
characters that no piece holds stand alone; texts are cut there, exactly, and each worker remembers the best
paths of the segments it has met (a bounded memory).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, text_slices

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments that a worker remembers.
REMEMBERED = 300_000


class DoubleArray:
    """Trie of byte strings in two arrays: the child of node s by byte b is base[s] + b, if check there is s."""

    def __init__(self, keys: dict[bytes, int]):
        root: dict = {}
        for key, value in keys.items():
            node = root
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 15
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        low, wide, queue = 1, 4096, [(root, 0)]
        for node, s in queue:
            if -1 in node:
                self.value[s] = node[-1]
            children = np.array(sorted(b for b in node if b >= 0))
            if not len(children):
                continue
            at = low
            while True:  # the first place from low on where all children fit, a window at a time
                if at + wide + 256 > len(free):
                    more = len(free)
                    free = np.concatenate([free, np.ones(more, bool)])
                    self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
                    self.check, self.value = (np.concatenate([x, np.full(more, -1, np.int32)]) for x in (self.check, self.value))
                fits = free[at + children[0] : at + children[0] + wide].copy()
                for b in children[1:]:
                    fits &= free[at + b : at + b + wide]
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += wide
            self.base[s] = at
            for b in children.tolist():
                t = at + b
                free[t], self.check[t] = False, s
                queue.append((node[b], t))
            if at > low + wide and free[low : low + wide].mean() < 0.1:
                low += wide  # a nearly full stretch isn't searched again


class Pieces:
    """A vocabulary: pieces with log scores, byte pieces, and its trie. Built once, on the driver."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        normal = {p.encode(): i for i, p in enumerate(pieces) if p is not None}
        self.scores = scores
        self.fallback = min([s for p, s in zip(pieces, scores) if p is not None], default=0.0) - 10.0
        trie = DoubleArray(normal)
        self.base, self.check, self.value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        letters = sorted({c for p in pieces if p is not None for c in p if c != MARK})
        # a piece with a marker after another character forbids cutting before markers
        self.whole = any(p and MARK in p.lstrip(MARK) for p in pieces)
        inside = "".join(map(re.escape, letters))
        self.cut = f"[{inside}{MARK}]+|[^{inside}{MARK}]" if self.whole else (f"{MARK}*[{inside}]+|{MARK}+|[^{inside}{MARK}]" if inside else f"{MARK}+|[^{MARK}]")
        self.bytes_of = [b""] * len(pieces)
        for i, p in enumerate(pieces):
            if p is not None:
                self.bytes_of[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])

    def best(self, segment: bytes) -> list[int]:
        """Ids of the best path over UTF-8 bytes of a segment without literal markers."""
        base, check, value, scores, n = self.base, self.check, self.value, self.scores, len(segment)
        top, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        top[0] = 0.0
        limit = len(check)
        for s in range(n):
            if top[s] == -math.inf:
                continue
            node, e, here = 0, s, top[s]
            while e < n:
                t = base[node] + segment[e]
                if t >= limit or check[t] != node:
                    break
                node = t
                e += 1
                piece = value[node]
                if piece >= 0 and here + scores[piece] > top[e]:
                    top[e], back[e] = here + scores[piece], (s, piece)
            first = segment[s]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            if here + width * self.fallback > top[s + width]:
                top[s + width], back[s + width] = here + width * self.fallback, (s, -1)
        ids: list[int] = []
        at = n
        while at:
            s, piece = back[at]
            ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(segment[s:at])]
            at = s
        return ids[::-1]

    def encoder(self):
        """text -> ids as int32 bytes, with a memory of segments."""
        memory: dict[str, bytes] = {}
        cut = re.compile(self.cut, re.S)
        literal = np.array([self.byte_ids[b] for b in MARK.encode()], np.int32).tobytes() if self.byte_ids else b""

        def part(text: str) -> list[bytes]:
            out = []
            for segment in cut.findall(text):
                got = memory.get(segment)
                if got is None:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    got = np.array(self.best(segment.encode()), np.int32).tobytes()
                    if len(segment) <= 64:
                        memory[segment] = got
                out.append(got)
            return out

        def encode(text: str) -> bytes:
            if not text:
                return b""
            if MARK not in text:
                return b"".join(part(MARK + text.replace(" ", MARK)))
            first, *rest = text.split(MARK)  # literal markers: bytes between the parts
            out = part(MARK + first.replace(" ", MARK))
            for x in rest:
                out += [literal, *part(x.replace(" ", MARK))]
            return b"".join(out)

        return encode

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def load(path: str = MODEL) -> Pieces:
    """Pieces of a SentencePiece model file with byte fallback. A merge-ranked (BPE) file holds -rank as score:
    a rank becomes the log score of Zipf's law, -ln(rank + 1) less a constant."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    odd = set(byte_ids)
    pieces = [None if i in odd or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(n)]
    scores = [sp.get_score(i) for i in range(n)]
    if all(s == int(s) for s in scores):
        constant = math.log(sum(1 / (r + 1) for r in range(n)))
        scores = [-math.log(1 - s) - constant for s in scores]
    return Pieces(pieces, scores, byte_ids)


_encoders: dict = {}


def _encode(batches, shared, key: str):
    vocabulary = shared.value
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = vocabulary.encoder()
    encode = _encoders[key]
    is_byte = np.zeros(len(vocabulary.pieces), bool)
    is_byte[vocabulary.byte_ids] = True
    for whole in batches:
        for batch in text_slices(whole, "text"):
            rows = [encode(t or "") for t in batch.column(1).to_pylist()]
            ids = np.frombuffer(b"".join(rows), np.int32)
            cut = np.cumsum([0, *(len(r) // 4 for r in rows)])
            fell = np.concatenate([[0], np.cumsum(is_byte[ids])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(ids)), pa.array(fell[cut[1:]] - fell[cut[:-1]])], names=["doc_id", "text", "ids", "n_fallback"])


def _decode(batches, shared):
    vocabulary = shared.value
    for batch in batches:
        column = batch.column(batch.schema.names.index("ids"))
        texts = [vocabulary.decode(ids.values.to_numpy(zero_copy_only=False).tolist()) if ids.is_valid else "" for ids in column]
        yield batch.append_column("decoded", pa.array(texts, pa.string()))


def encoded(docs: DataFrame, vocabulary: Pieces) -> DataFrame:
    """doc_id, text, ids and n_fallback (byte pieces) of every row of docs. A null or empty text has no ids.

    Repeated rows are encoded row by row; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary, whatever the input
    own = docs.select("doc_id", "text")
    key = str(shared.id) if hasattr(shared, "id") else repr(shared)
    kind = own.select("doc_id").dtypes[0][1]
    return own.mapInArrow(lambda it: _encode(it, shared, key), f"doc_id {kind}, text string, ids array<int>, n_fallback long")


def decoded(rows: DataFrame, vocabulary: Pieces) -> DataFrame:
    """rows with a column ids, and what they say in ``decoded``; null ids say nothing. A column of that name is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    rows = rows.drop("decoded")
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(lambda it: _decode(it, shared), f"{kinds}, decoded string")


def tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text, ids, n_fallback and the decoded text of every row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    own = docs.select("doc_id", "text")
    key, kind = str(getattr(shared, "id", repr(shared))), own.select("doc_id").dtypes[0][1]
    # one worker encodes and decodes
    return own.mapInArrow(lambda it: _decode(_encode(it, shared, key), shared), f"doc_id {kind}, text string, ids array<int>, n_fallback long, decoded string")
