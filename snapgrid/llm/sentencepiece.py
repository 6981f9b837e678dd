"""SentencePiece encoding and decoding as a weighted finite-state transducer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.llm.common import slices

SPACE = "▁"
#: Model files above this size are not shipped to the tasks.
MAX_MODEL_BYTES = 64 << 20
#: Chunks that a worker process remembers (about 230 bytes each), pairs of pieces, and the longest such chunk.
CHUNKS, PAIRS, CHUNK_LENGTH = 500_000, 500_000, 64
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2


class Transducer:
    """Normaliser, pieces and byte fallback of a model, composed with one input at a time.

    Arcs read a piece and write its id; a symbol that no piece covers is read by an arc
    that writes its UTF-8 bytes. For a unigram model an arc weighs the negative score of
    its piece. For a merge model the state also holds the last piece: the weight of two
    pieces in a row is 0 if merging their joined text gives these two back, else
    infinite, and what merging never makes has no arc. A sequence all of whose
    neighbours stand up to that is what merging the whole text gives, so exactly one path
    is finite. ``encode`` takes the path of least weight.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        self.kind = spec.trainer_spec.model_type
        if self.kind not in (_UNIGRAM, _BPE) or spec.normalizer_spec.precompiled_charsmap:
            raise ValueError("only unigram and merge models with the identity normaliser")
        self.prefix = SPACE if spec.normalizer_spec.add_dummy_prefix else ""
        self.squeeze = spec.normalizer_spec.remove_extra_whitespaces
        self.score = {p.piece: p.score for p in spec.pieces if p.type in (_NORMAL, _USER)}
        self.ids = {p.piece: k for k, p in enumerate(spec.pieces) if p.type in (_NORMAL, _USER)}
        self.unknown = next((k for k, p in enumerate(spec.pieces) if p.type == _UNKNOWN), 0)
        bytes_at = {p.piece: k for k, p in enumerate(spec.pieces) if p.type == _BYTE}
        self.bytes = [bytes_at.get(f"<0x{b:02X}>") for b in range(256)] if bytes_at else None
        self.worst = min((s for s in self.score.values() if s > -1e8), default=0.0) - 10.0
        # What the ids read as; control pieces read as nothing.
        self.reads = [
            p.piece.replace(SPACE, " ").encode() if p.type in (_NORMAL, _USER)
            else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE
            else " ⁇ ".encode() if p.type == _UNKNOWN
            else b""
            for p in spec.pieces
        ]
        joined = "\n".join(p for p in self.score if len(p) > 1)
        alone = "" if any("\n" in p for p in self.score if len(p) > 1) else "\\n"
        apart = not re.search(f"[^{SPACE}\n]{SPACE}", joined)
        #: Stretches that no piece reaches across; the whole text where pieces may hold spaces.
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + ("|\\n" if alone else "") if apart else "(?s:.+)")
        # What was met lately, and before that: common chunks move on when the older ones go.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces = [p.piece for p in spec.pieces]
        #: The pieces letter by letter, each with its id; of a merge model those that merging makes.
        self.trie: dict = {}
        for piece, k in self.ids.items():
            if self.kind == _UNIGRAM or self.merged(piece) == [piece]:
                node = self.trie
                for symbol in piece:
                    node = node.setdefault(symbol, {})
                node[""] = k
        self.joins = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(
                ((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score),
                default=None,
            )
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stands(self, a: int, b: int) -> bool:
        """Whether the piece ``b`` after the piece ``a`` has weight 0."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        one, other = self.pieces[a], self.pieces[b]
        got = self.pairs[a << 20 | b] = self.merged(one + other) == [one, other]
        return got

    def fallback(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """(end, id) of the pieces that can be read at a place, the longest last.

        A symbol that is no piece has an arc of its own, with a negative id.
        """
        found, node, size, end = [], self.trie, len(text), at
        while end < size:
            node = node.get(text[end])
            if node is None:
                break
            end += 1
            if "" in node:
                found.append((end, node[""]))
        if not found or found[0][0] > at + 1:
            found.insert(0, (at + 1, ~ord(text[at])))
        return found

    def shortest(self, text: str) -> list[int]:
        """Ids on the path of least weight through a normalised text."""
        path = self._finite_path(text) if self.kind == _BPE else self._best_path(text)
        if min(path, default=0) >= 0:
            return path
        return list(chain.from_iterable([k] if k >= 0 else self.fallback(chr(~k)) for k in path))

    def _finite_path(self, text: str) -> list[int]:
        """The path without an infinite weight: all others weigh 0, so it is the shortest.

        Goes ahead by the longest arc whose weight is 0, and back where none is left; a
        state found to lead nowhere is not entered again.
        """
        path: list[int] = []
        back: list[tuple[int, int, list[tuple[int, int]]]] = []
        dead: set[tuple[int, int]] = set()
        at, last, size, pairs = 0, -1, len(text), self.pairs
        open_ = self.arcs(text, 0) if text else []
        while at < size:
            while open_:
                end, piece = open_.pop()
                if piece >= 0 and last >= 0:
                    fits = pairs.get(last << 20 | piece)
                    if not (self.stands(last, piece) if fits is None else fits):
                        continue
                if dead and (end, piece) in dead:
                    continue
                back.append((at, last, open_))
                path.append(piece)
                at, last = end, piece
                open_ = self.arcs(text, at) if at < size else []
                break
            else:
                dead.add((at, last))
                at, last, open_ = back.pop()
                path.pop()
        return path

    def _best_path(self, text: str) -> list[int]:
        """The path of least summed weight, by position."""
        best: list[tuple[float, int, int]] = [(0.0, -1, 0), *[(float("inf"), -1, 0)] * len(text)]
        for at in range(len(text)):
            for end, piece in self.arcs(text, at):
                cost = best[at][0] - (self.score[self.pieces[piece]] if piece >= 0 else self.worst)
                if cost < best[end][0]:
                    best[end] = (cost, at, piece)
        path, at = [], len(text)
        while at:
            _, at, piece = best[at]
            path.append(piece)
        return path[::-1]

    def coded(self, chunk: str) -> bytes:
        """Ids of a chunk. No piece reaches across two letters that stand together in none, so it is cut there."""
        if found := self.known.get(chunk) or self.older.get(chunk):
            return self.keep(chunk, found)
        joins = self.joins
        cuts = [k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in joins]
        parts = [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)]
        found = b"".join([self.known.get(p) or self.older.get(p) or self.read(p) for p in parts]) if cuts else self.read(chunk)
        return self.keep(chunk, found)

    def read(self, chunk: str) -> bytes:
        return self.keep(chunk, np.array(self.shortest(chunk), dtype="<i4").tobytes())

    def keep(self, chunk: str, found: bytes) -> bytes:
        if len(chunk) <= CHUNK_LENGTH:
            if len(self.known) >= CHUNKS // 2:
                self.known, self.older = {}, self.known
            self.known[chunk] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for an empty or null one."""
        known, coded = self.known, self.coded
        parts = [known.get(c) or coded(c) for c in self.chunk.findall(self.normalise(text or ""))]
        return np.frombuffer(b"".join(parts), dtype="<i4")

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text that the ids read as, without the space put before it."""
        out = b"".join(map(self.reads.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        text = out.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def load_model(path: str) -> bytes:
    with open(path, "rb") as file:
        model = file.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return model


_BROADCAST: dict[tuple[str, bytes], Broadcast] = {}


def _shared(spark: SparkSession, model: bytes) -> Broadcast:
    """One broadcast of a model for the whole application, so that a worker holds one transducer."""
    key = (spark.sparkContext.applicationId, hashlib.sha256(model).digest())
    if key not in _BROADCAST:
        _BROADCAST.clear()
        _BROADCAST[key] = spark.sparkContext.broadcast({"model": model})
    return _BROADCAST[key]


def _machine(held: dict) -> Transducer:
    """The transducer of a broadcast model; a worker process compiles it once and keeps what it has read."""
    if "machine" not in held:
        held["machine"] = Transducer(held["model"])
    return held["machine"]


def encode(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), text: str = "text", check: bool = False) -> DataFrame:
    """``keep``, ids (array of int) and n_tokens of every row, read by the model's transducer.

    Null and empty texts have no ids. Texts come back from their ids exactly, but for
    those with the model's own space sign, which reads as a space. ``check`` adds
    ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 (of the text
    decoded from them, UTF-8) and round_trip (whether that is the text).
    """
    shared = _shared(docs.sparkSession, model)
    slim = docs.select(F.col(text).alias("text"), *keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:]]
    fields += ["ids array<int>", "n_tokens long"]
    names = [*keep, "ids", "n_tokens"]
    if check:
        fields += ["ids_sha256 string", "decoded_sha256 string", "round_trip boolean"]
        names += ["ids_sha256", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared.value)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column(0).to_pylist()
            found = [machine.encode(t) for t in texts]
            sizes = np.array([len(x) for x in found], dtype=np.int64)
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                pa.array(np.concatenate(found) if found else np.zeros(0, "<i4"), pa.int32()),
            )
            columns = [*batch.columns[1:], ids, pa.array(sizes)]
            if check:
                decoded = [machine.decode(x) for x in found]
                columns += [
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                    pa.array([a == (b or "") for a, b in zip(decoded, texts, strict=True)]),
                ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return slim.mapInArrow(run, ", ".join(fields))


def decode(coded: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` and text of every row; null ids read as an empty text."""
    shared = _shared(coded.sparkSession, model)
    slim = coded.select(F.col(ids).alias("ids"), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared.value)
        for batch in batches:
            texts = pa.array([machine.decode(x or []) for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], [*keep, "text"])

    return slim.mapInArrow(run, f"{kept}, text string")
