"""SentencePiece encoding and decoding of whole texts, giant ones through a max-plus parallel scan.

A BPE segmentation is the one path through the lattice of pieces on which every two neighbouring pieces
stay apart when their joint text is merged alone. So a chunk of a text acts on the states at its borders
(the piece that covers a border) as a max-plus matrix with entries 0 (a path exists) and minus infinity.
Giant texts are cut at fixed places; every chunk yields its matrix; matrices are combined associatively
over blocks of chunks and then over blocks; what is alive both from the left and from the right is the true
state at each border; and each chunk is backtraced on its own between its two states.

No piece crosses from a letter to a following space mark, so words within a text or chunk are
encoded by the library once and remembered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from memberlens.llm.common import map_batches
from memberlens.session import stage

#: code points in a chunk; longer texts are giant
CHUNK = 65_536
#: chunks whose matrices one task combines
BLOCK = 256
REMEMBERED_WORDS = 150_000
REMEMBERED_PAIRS = 100_000
MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
State = tuple[int, int]  # a piece over a border: how far it started before it, and its length


class Pieces:
    """A BPE model with identity normalisation, as the library reads it from ``path``."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            raw = file.read()
        model.ParseFromString(raw)
        how = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or how.precompiled_charsmap or how.remove_extra_whitespaces:
            raise ValueError("a BPE model with identity normalisation is needed")
        if not (how.add_dummy_prefix and how.escape_whitespaces and model.trainer_spec.byte_fallback):
            raise ValueError("a model with a dummy prefix, escaped spaces and byte fallback is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        normal = [(k, p) for k, p in enumerate(model.pieces) if p.type == p.NORMAL]
        self.scores = {p.piece: p.score for _, p in normal}
        self.ids = {p.piece: k for k, p in normal}
        self.longest = max(len(p) for p in self.ids)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces must not cross into the next word")
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == p.BYTE}
        self.raw = [p.piece.encode() if p.type == p.NORMAL else b"" for p in model.pieces]
        for byte, k in self.byte_ids.items():
            self.raw[k] = bytes([byte])
        self.words = _Words(self)
        self.pairs: dict[tuple[str, str], bool] = {}

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers; an empty text has none."""
        if not text:
            return b""
        return self.encode_marked(MARK + text.replace(" ", MARK))

    def encode_marked(self, marked: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORD.findall(marked)))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that make no character are replaced."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode(errors="replace").replace(MARK, " ")[1:]

    def ids_of(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        return [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours are joined first, the left of equals."""
        parts = list(text)
        while len(parts) > 1:
            options = [(-self.scores[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not options:
                break
            at = min(options)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: str, b: str) -> bool:
        """Whether two neighbouring pieces stay as they are (and are pieces at all)."""
        if b[0] == MARK and a[-1:] != MARK:
            return len(b) == 1 or self.merged(b) == [b]
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces that may start at a place; a character that is no piece stands for its bytes."""
        return [text[at]] + [text[at : at + n] for n in range(2, self.longest + 1) if text[at : at + n] in self.ids and at + n <= len(text)]


class _Words(dict):
    """Word with its leading space marks to its ids."""

    def __init__(self, owner: Pieces):
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        body = word.lstrip(MARK)
        marks = len(word) - len(body)
        # the library puts the first mark in front itself
        if marks and len(word) > 1:
            ids = self.owner.library.encode(" " * (marks - 1) + body)
        else:  # of a word without a mark, and of a mark alone, the library has no encoding of its own
            ids = [i for piece in self.owner.merged(word) for i in self.owner.ids_of(piece)]
        packed = self[word] = self.owner.packed(ids)
        return packed


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One model for each file and Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


class Chunk:
    """A chunk with so many characters of the text before and after it as a piece may reach."""

    def __init__(self, model: Pieces, text: str, begin: int, end: int):
        """``text`` from ``begin`` to ``end`` is the chunk; the rest of ``text`` is its surroundings."""
        self.model, self.text, self.begin, self.end = model, text, begin, end
        cuts = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", text) if begin <= m.start() < end]
        #: words from the first cut to the last one are the same on every path
        self.cuts = (cuts[0], cuts[-1]) if cuts else None

    def entries(self) -> list[State]:
        """States at the chunk's start: every piece that covers the last place before it."""
        if not self.begin:
            return [(0, 0)]
        found = []
        for start in range(max(0, self.begin - self.model.longest), self.begin):
            found += [(self.begin - start, len(p)) for p in self.model.starting(self.text, start) if start + len(p) >= self.begin]
        return found

    def _paths(self, begin: int, end: int, alive: dict[tuple[int, str], int]) -> list[dict[str, tuple[int, list]]]:
        """From pieces (end place, piece) with marks of where they come from: by place, the pieces that end there.

        Each has its marks and the pieces before it. Pieces start at places from ``begin`` to ``end``.
        """
        ending: list[dict[str, tuple[int, list]]] = [{} for _ in range(len(self.text) + 1)]
        for (place, piece), marks in alive.items():
            old = ending[place].get(piece, (0, []))
            ending[place][piece] = (old[0] | marks, old[1])
        for at in range(begin, end):
            if not ending[at]:
                continue
            for piece in self.model.starting(self.text, at):
                before = [(p, marks) for p, (marks, _) in ending[at].items() if marks and self.model.apart(p, piece)]
                if before:
                    marks = 0
                    for _, m in before:
                        marks |= m
                    old = ending[at + len(piece)].get(piece, (0, []))
                    ending[at + len(piece)][piece] = (old[0] | marks, old[1] + [(at, p) for p, _ in before])
        return ending

    def _piece(self, state: State, border: int) -> tuple[int, str]:
        start = border - state[0]
        return start + state[1], self.text[start : start + state[1]]

    def _leaving(self, ending: list[dict]) -> dict[State, int]:
        """States at the chunk's end with their marks: pieces that start before it and end at or after it."""
        found: dict[State, int] = {}
        for place in range(self.end, len(ending)):
            for piece, (marks, _) in ending[place].items():
                start = place - len(piece)
                if start < self.end and marks:
                    state = (self.end - start, len(piece))
                    found[state] = found.get(state, 0) | marks
        return found

    def matrix(self) -> list[tuple[State, State]]:
        """Pairs of states at both ends that a path joins: the entries 0 of the max-plus matrix."""
        entries = self.entries()
        alive = {self._piece(state, self.begin): 1 << k for k, state in enumerate(entries)}
        if self.cuts is None:
            leaving = self._leaving(self._paths(self.begin, self.end, alive))
            return [(e, out) for out, marks in leaving.items() for k, e in enumerate(entries) if marks >> k & 1]
        first, last = self.cuts
        reached = 0
        for marks, _ in self._paths(self.begin, first, alive)[first].values():
            reached |= marks
        leaving = self._leaving(self._paths(last, self.end, {(last, ""): 1}))
        return [(e, out) for out in leaving for k, e in enumerate(entries) if reached >> k & 1]

    def _trace(self, begin: int, end: int, alive: dict, place: int, piece: str) -> list[str]:
        ending, path = self._paths(begin, end, alive), []
        while place - len(piece) >= begin and piece:
            path.append(piece)
            place, piece = ending[place][piece][1][0]
        return path[::-1]

    def ids(self, entry: State, leave: State) -> bytes:
        """Ids of the pieces that start in the chunk, between its two true states."""
        at, piece = self._piece(entry, self.begin)
        out = self._piece(leave, self.end)
        if self.cuts is None:
            path = self._trace(self.begin, self.end, {(at, piece): 1}, *out)
            return self.model.packed([i for p in path for i in self.model.ids_of(p)])
        first, last = self.cuts
        head = self._paths(self.begin, first, {(at, piece): 1})[first]
        path = self._trace(self.begin, first, {(at, piece): 1}, first, next(p for p, (m, _) in head.items() if m))
        tail = self._trace(last, self.end, {(last, ""): 1}, *out)
        own = [self.model.packed([i for p in part for i in self.model.ids_of(p)]) for part in (path, tail)]
        return own[0] + self.model.encode_marked(self.text[first:last]) + own[1]


def joined(left: list, right: list) -> list:
    """The max-plus product of two matrices; associative."""
    by_entry: dict = {}
    for a, b in right:
        by_entry.setdefault(tuple(a), []).append(tuple(b))
    return sorted({(tuple(a), c) for a, b in left for c in by_entry.get(tuple(b), ())})


def true_states(matrices: list[list]) -> list[State]:
    """The state at every border, from the start of the first matrix to the end of the last.

    At each border it is the one alive from the left and from the right.
    """
    left = [{tuple(a) for a, _ in matrices[0]}]
    for m in matrices:
        left.append({tuple(b) for a, b in m if tuple(a) in left[-1]})
    right = [left[-1]]
    for m in reversed(matrices):
        right.append({tuple(a) for a, b in m if tuple(b) in right[-1]})
    return [min(a & b) for a, b in zip(left, reversed(right), strict=True)]


_KEY = ["doc_id", "text_key"]


def encode(
    docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """(doc_id, ids, n_chunks) for every row: ids as in the library, little-endian 32-bit in one binary.

    Missing and empty texts have no ids. Repeated rows are encoded as often as they stand there. Texts of up
    to ``chunk`` code points are encoded where they are; giant ones chunk by chunk. Other columns are ignored.
    """
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = pieces(model_file)
        ids = [model.encode(t) for t in batch.column("text").to_pylist()]
        return pa.record_batch({
            "doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary()), "n_chunks": pa.array([1] * len(ids), pa.int32()),
        })

    schema = "doc_id long, ids binary, n_chunks int"
    short = map_batches(named.where(F.length("text") <= chunk), whole, schema)
    giant = named.where(F.length("text") > chunk).withColumn("text_key", F.xxhash64("text"))
    rows = giant.select(*_KEY)
    encoded = _giants(giant.dropDuplicates(_KEY), model_file, chunk)
    same = rows["doc_id"].eqNullSafe(encoded["doc_id"]) & (rows["text_key"] == encoded["text_key"])
    return short.unionByName(rows.join(encoded, same).select(rows["doc_id"], "ids", "n_chunks"))


def _giants(giant: DataFrame, model_file: str, chunk: int) -> DataFrame:
    reach = 64  # more than any piece is long; checked below

    def check() -> None:
        if pieces(model_file).longest > reach:
            raise ValueError("pieces are longer than the surroundings of a chunk")

    marked = giant.withColumn("marked", F.concat(F.lit(MARK), F.translate("text", " ", MARK))).drop("text")
    begin = F.col("number") * chunk
    chunks = stage(
        marked.withColumn("number", F.explode(F.sequence(F.lit(0), F.floor((F.length("marked") - 1) / chunk).cast("int"))))
        .withColumn("from", F.greatest(F.lit(0), begin - reach))
        .select(
            *_KEY, "number", (begin - F.col("from")).alias("begin"),
            F.substring("marked", F.col("from") + 1, F.lit(chunk + reach) + begin - F.col("from")).alias("part"),
            F.least(F.lit(chunk), F.length("marked") - begin).alias("size"),
        )
    )

    def opened(batch: pa.RecordBatch) -> Iterator[Chunk]:
        check()
        for text, start, size in zip(*(batch.column(k).to_pylist() for k in ("part", "begin", "size")), strict=True):
            yield Chunk(pieces(model_file), text, start, start + size)

    def matrices(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [json.dumps(c.matrix()) for c in opened(batch)]
        return pa.record_batch({k: batch.column(k) for k in (*_KEY, "number")} | {"matrix": pa.array(told)})

    made = stage(map_batches(chunks, matrices, "doc_id long, text_key long, number int, matrix string"))
    made = made.withColumn("block", F.floor(F.col("number") / BLOCK).cast("int"))

    def combined(frame):
        frame = frame.sort_values("number")
        total = None
        for told in frame["matrix"]:
            own = [tuple(map(tuple, pair)) for pair in json.loads(told)]
            total = own if total is None else joined(total, own)
        return frame.head(1)[[*_KEY, "block"]].assign(matrix=json.dumps(total))

    def borders(frame, number: str):
        frame = frame.sort_values(number)
        states = true_states([[tuple(map(tuple, pair)) for pair in json.loads(told)] for told in frame["matrix"]])
        return frame[[*_KEY, number]].assign(
            entry=[json.dumps(s) for s in states[:-1]], leave=[json.dumps(s) for s in states[1:]]
        )

    by_block = made.groupBy(*_KEY, "block").applyInPandas(combined, "doc_id long, text_key long, block int, matrix string")
    blocks = by_block.groupBy(*_KEY).applyInPandas(
        lambda f: borders(f, "block"), "doc_id long, text_key long, block int, entry string, leave string"
    )

    def within(frame):
        entry, leave = (tuple(json.loads(frame[c].iloc[0])) for c in ("entry", "leave"))
        frame = frame.sort_values("number").reset_index(drop=True)
        told = [[tuple(map(tuple, pair)) for pair in json.loads(m)] for m in frame["matrix"]]
        told[0] = [p for p in told[0] if p[0] == entry]
        told[-1] = [p for p in told[-1] if p[1] == leave]
        return borders(frame.assign(matrix=[json.dumps(m) for m in told]), "number")

    def matched(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
        right = right.select(*(F.col(k).alias(f"_{k}") for k in (*_KEY, column)), "entry", "leave")
        same = left["doc_id"].eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
        return left.join(right, same & (F.col(column) == F.col(f"_{column}"))).drop("_doc_id", "_text_key", f"_{column}")

    states = matched(made, blocks, "block").groupBy(*_KEY, "block").applyInPandas(
        within, "doc_id long, text_key long, number int, entry string, leave string"
    )

    def traced(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends = zip(*(batch.column(k).to_pylist() for k in ("entry", "leave")), strict=True)
        ids = [c.ids(tuple(json.loads(a)), tuple(json.loads(b))) for c, (a, b) in zip(opened(batch), ends, strict=True)]
        return pa.record_batch({k: batch.column(k) for k in (*_KEY, "number")} | {"ids": pa.array(ids, pa.binary())})

    done = map_batches(matched(chunks, states, "number"), traced, "doc_id long, text_key long, number int, ids binary")

    def whole(frame):
        frame = frame.sort_values("number")
        return frame.head(1)[_KEY].assign(ids=b"".join(frame["ids"]), n_chunks=len(frame))

    return done.groupBy(*_KEY).applyInPandas(whole, "doc_id long, text_key long, ids binary, n_chunks int")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of ``ids``."""

    @F.pandas_udf("string")
    def of(ids):
        model = pieces(model_file)
        return ids.map(lambda own: model.decode(own or b""))

    return encoded.withColumn("decoded", of(F.col("ids")))
