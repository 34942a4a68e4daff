"""Removal of long strings that stand at several places of the corpus, by sorted suffixes.

A string of ``length`` bytes is cut out wherever it stands if it starts at two places. Suffixes are sorted in two
stages: those smaller than their successor directly, the others by one scan over the buckets of first bytes; a
string that repeats shows as a common prefix of two neighbours.

One sort of all suffixes fits no task, so places are first dealt to groups that can share a string. Every
window of ``length`` bytes names the smallest hash of its grams as its anchor, which depends on the window alone: equal
windows have equal anchors. The windows of one anchor place make a segment. Equal segments of a text, as a short period
makes them in great numbers, are one row with the runs they cover. Anchors that stand once are done; of
those that stand more often, equal segments repeat as a whole and are counted, not moved; one text of each
different segment is sorted with the others of its anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import bound_batches, map_batches, mixed, only_ids, texts_of
from memberlens.session import stage

LENGTH = 400
#: bytes hashed at once; longer texts go through in pieces
BLOCK = 1 << 18
#: bytes whose suffixes are sorted at once; an anchor with more is split by whole windows
SORT_BYTES = 4 << 20
#: suffixes whose leading bytes are held as strings at once
DIRECT = 2_000
#: texts whose key a task remembers, so that copies within it are looked at once
REMEMBERED_TEXTS = 200_000
#: bits of a place within a block of hashes
PLACE_BITS = np.uint64(21)
_ODD = 0x9E3779B97F4A7C15


# -- two-stage sorting ---------------------------------------------------------------------------------


def _directly_sorted(text: str, symbols: np.ndarray, places: np.ndarray, depth: int, start: int = 0) -> np.ndarray:
    """``places`` by the ``depth`` symbols from each on, the first ``start`` of which are equal."""
    if start >= depth or len(places) < 2:
        return places
    if len(places) <= DIRECT:
        keys = [text[i + start : i + depth] for i in places.tolist()]
        return places[np.array(sorted(range(len(keys)), key=keys.__getitem__))]
    at = np.minimum(places + start, len(symbols))
    heads = np.lib.stride_tricks.sliding_window_view(np.append(symbols, np.zeros(8, np.uint8)), 8)[at].view(">u8")[:, 0].astype(np.uint64)
    order = np.argsort(heads, kind="stable")
    places, heads = places[order], heads[order]
    ends = [*(np.flatnonzero(heads[1:] != heads[:-1]) + 1).tolist(), len(places)]
    out, low, last = [], 0, 0
    for end in ends:  # neighbouring runs together, as long as they fit
        if end - low > DIRECT:
            if last > low:
                out.append(_directly_sorted(text, symbols, places[low:last], depth, start))
                low = last
            if end - low > DIRECT:
                out.append(_directly_sorted(text, symbols, places[low:end], depth, start + 8))
                low = end
        last = end
    out.append(_directly_sorted(text, symbols, places[low:], depth, start))
    return np.concatenate(out)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes of ``symbols`` (bytes, 0 last) by their first ``depth`` symbols.

    A suffix smaller than its successor is sorted directly. Any other suffix starts with a symbol no smaller
    than the next one, so it is met as the predecessor of a suffix that a scan of the buckets in ascending order
    has placed before; the scan appends it to the front part of its own bucket.
    """
    n = len(symbols)
    differs = np.flatnonzero(symbols[1:] != symbols[:-1])
    decided = np.full(n, n - 1)
    if len(differs):
        at = np.searchsorted(differs, np.arange(n))
        decided = np.where(at < len(differs), differs[np.minimum(at, len(differs) - 1)], n - 1)
    smaller = np.ones(n, bool)  # so is the closing symbol
    inner = decided < n - 1
    smaller[inner] = symbols[decided[inner]] < symbols[decided[inner] + 1]
    text = symbols.tobytes().decode("latin-1")
    direct = _directly_sorted(text, symbols, np.flatnonzero(smaller), depth)
    heads = symbols[direct]
    direct = direct[np.argsort(heads, kind="stable")]
    bounds = np.searchsorted(symbols[direct], np.arange(257))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    buckets = []
    for c in np.unique(symbols).tolist():
        own = waiting[c]
        layer = np.concatenate(own) if own else np.empty(0, np.int64)
        scanned = [layer]
        while len(layer):  # predecessors with the same symbol stand in the same bucket, behind
            before = layer[layer > 0] - 1
            layer = before[symbols[before] == c]
            scanned.append(layer)
        bucket = np.concatenate([*scanned, direct[bounds[c] : bounds[c + 1]]])
        buckets.append(bucket)
        before = bucket[bucket > 0] - 1
        first = symbols[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting[symbols[part[0]]].append(part)
    return np.concatenate(buckets) if buckets else np.empty(0, np.int64)


def adjacent_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each place of ``order`` with the one before, ``length`` at most.

    From every place on, ``length`` symbols have to follow.
    """
    common = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return common
    windows = np.lib.stride_tricks.sliding_window_view(symbols, length)
    a, b = order[:-1], order[1:]
    # most neighbours differ early or agree in full
    like = np.flatnonzero((symbols[a] == symbols[b]) & (symbols[a + length // 2] == symbols[b + length // 2]))
    rest = np.setdiff1d(np.arange(len(a)), like, assume_unique=True)
    for some in (like, rest):
        step = max(1, (4 << 20) // length)
        for at in range(0, len(some), step):
            here = some[at : at + step]
            differ = windows[a[here]] != windows[b[here]]
            first = differ.argmax(axis=1)
            common[here + 1] = np.where(differ[np.arange(len(here)), first], first, length)
    return common


def repeated_windows(pieces: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its windows of ``length`` bytes stand in the pieces more than once.

    Sorted as one text in which a 0 ends each piece; UTF-8 leaves room for it below every byte.
    """
    joined = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8) + np.uint8(1)
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    is_window = np.zeros(len(joined) + 1, np.int8)
    np.add.at(is_window, starts, 1)
    np.add.at(is_window, starts + counts, -1)
    is_window = np.cumsum(is_window[:-1]).astype(bool)
    order = suffix_order(joined, length)
    order = order[is_window[order]]
    same = adjacent_prefixes(joined, order, length) == length
    repeated = np.zeros(len(joined), bool)
    repeated[order[same]] = True
    repeated[order[np.flatnonzero(same) - 1]] = True
    return [repeated[s : s + n] for s, n in zip(starts, counts, strict=True)]


# -- anchors -------------------------------------------------------------------------------------------


class _Anchors:
    """Rolling hashes of grams and the smallest of each window."""

    def __init__(self, length: int):
        self.length = length
        self.gram = max(1, length // 2)
        size = BLOCK + 2 * length + 1
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        self.powers, self.inverses = np.ones(size, np.uint64), np.ones(size, np.uint64)
        np.cumprod(np.full(size - 1, _ODD, np.uint64), out=self.powers[1:])
        np.cumprod(np.full(size - 1, pow(_ODD, -1, 1 << 64), np.uint64), out=self.inverses[1:])

    def places(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor place of every window, hash of the gram at every place)."""
        n, gram = len(raw), self.gram
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[:n], out=sums[1:])
        grams = (sums[gram:] - sums[:-gram]) * self.inverses[: n - gram + 1]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
        least = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        width, reach = self.length - gram + 1, 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        return (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64), grams


def _segments(block: list[tuple[int, int, bytes]], anchors: _Anchors) -> Iterator[tuple]:
    """(item, start, windows, anchor hash, segment hash) of the pieces (item, start in its text, bytes) of a block."""
    length = anchors.length
    joined = b"".join([piece for _, _, piece in block])
    places, grams = anchors.places(np.frombuffer(joined, np.uint8))
    sizes = np.array([len(piece) for _, _, piece in block])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(block)), sizes)[: len(places)]
    inside = np.arange(len(places)) + length <= ends[owner]
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1]) | (owner[1:] != owner[:-1])
    new[1:] |= inside[1:] & ~inside[:-1]
    firsts = np.flatnonzero(new & inside)
    # a segment ends where the next one starts or where the windows of its piece end
    stops = np.minimum(np.append(np.flatnonzero(new), len(places))[np.searchsorted(np.flatnonzero(new), firsts, "right")],
                       ends[owner[firsts]] - length + 1)
    hashes = grams[places[firsts]].view(np.int64)
    view = memoryview(joined)
    for first, stop, mine, value in zip(firsts.tolist(), stops.tolist(), owner[firsts].tolist(), hashes.tolist(), strict=True):
        item, start, _ = block[mine]
        content = xxhash.xxh3_64_intdigest(view[first : stop + length - 1])
        yield item, start + first - int(ends[mine] - sizes[mine]), stop - first, value, content - (1 << 63)


def merged(spans: np.ndarray) -> np.ndarray:
    """(start, stop) rows as maximal runs that neither meet nor overlap."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    ends = np.append(np.flatnonzero(first)[1:], len(spans)) - 1
    return np.stack([spans[first, 0], reach[ends]], axis=1)


def _folded(segments: Iterator[tuple], length: int) -> Iterator[tuple]:
    """(item, start, windows, anchor hash, segment hash, times, runs): equal segments of an item as one row.

    ``start`` is that of one of them, ``runs`` what all of them cover, or None for a single one.
    """
    starts: dict[tuple, list[int]] = {}
    for item, start, *rest in segments:
        starts.setdefault((item, *rest), []).append(start)
    for (item, windows, anchor, content), at in starts.items():
        runs = None
        if len(at) > 1:
            edges = np.array(at)
            runs = [{"start": a, "stop": b} for a, b in merged(np.stack([edges, edges + windows + length - 1], axis=1)).tolist()]
        yield item, at[0], windows, anchor, content, len(at), runs


def _blocks(texts: Iterator[tuple[int, bytes]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces of texts in blocks of about BLOCK bytes; a longer text is cut into pieces that overlap by a window."""
    block, size = [], 0
    for item, text in texts:
        for start in range(0, len(text) - length + 1, BLOCK):
            piece = text[start : start + BLOCK + length - 1]
            if size and size + len(piece) > BLOCK + length:
                yield block
                block, size = [], 0
            block.append((item, start, piece))
            size += len(piece)
    if block:
        yield block


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text, sha, ka, kb): the digest of the text and 120 of its bits as two numbers."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    named = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))

    def part(at: int) -> Column:
        return F.conv(F.substring("sha", at, 15), 16, 10).cast("long")

    return named.withColumn("ka", part(1)).withColumn("kb", part(17))


def _occurrences(keyed: DataFrame, length: int) -> DataFrame:
    """(anchor, content, ka, kb, start, windows, times, runs) of all segments; a task looks at copies of a text once."""
    bound_batches(keyed.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors(length)
        known: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), strict=True))

            def fresh(batch: pa.RecordBatch = batch, keys: list = keys) -> Iterator[tuple[int, bytes]]:
                for item, text in enumerate(texts_of(batch.column("text"))):
                    if len(text) >= length and keys[item] not in known:
                        if len(known) >= REMEMBERED_TEXTS:
                            known.clear()
                        known.add(keys[item])
                        yield item, text

            for block in _blocks(fresh(), length):
                rows = list(_folded(_segments(block, anchors), length))
                if rows:
                    item, start, windows, anchor, content, times, runs = zip(*rows, strict=True)
                    yield pa.record_batch({
                        "anchor": pa.array(anchor, pa.int64()), "content": pa.array(content, pa.int64()),
                        "ka": pa.array([keys[i][0] for i in item], pa.int64()),
                        "kb": pa.array([keys[i][1] for i in item], pa.int64()),
                        "start": pa.array(start, pa.int32()), "windows": pa.array(windows, pa.int32()),
                        "times": pa.array(times, pa.int32()), "runs": pa.array(runs, kind),
                    })

    schema = "anchor long, content long, ka long, kb long, start int, windows int, times int, runs array<struct<start: int, stop: int>>"
    return keyed.select("ka", "kb", "text").mapInArrow(run, schema)


# -- repeats -------------------------------------------------------------------------------------------


def _pieces(chosen: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    """``chosen`` segments with their bytes as ``piece``; one row of each text is read."""
    lists = chosen.groupBy("ka", "kb").agg(
        F.collect_list(F.struct("anchor", "start", "windows", "n", "hot")).alias("segments")  # within one text
    )
    texts = only_ids(keyed.select("ka", "kb", "text"), "ka", chosen.select("ka"))
    one = texts.groupBy("ka", "kb").agg(F.first("text").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("segments")
        owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
        flat = pa.RecordBatch.from_struct_array(lists.flatten())
        texts = list(texts_of(batch.column("text")))
        spans = zip(owner.tolist(), flat.column("start").to_pylist(), flat.column("windows").to_pylist(), strict=True)
        pieces = [texts[o][s : s + w + length - 1] for o, s, w in spans]
        own = [batch.column(k).take(pa.array(owner)) for k in ("ka", "kb")]
        return pa.RecordBatch.from_arrays([*flat.columns, *own, pa.array(pieces, pa.binary())], schema.names)

    schema = pa.schema([(n, pa.int64()) for n in ("anchor", "start", "windows", "n", "hot", "ka", "kb", "piece")])
    return map_batches(
        lists.join(one, ["ka", "kb"]), run,
        "anchor long, start int, windows int, n long, hot boolean, ka long, kb long, piece binary",
    )


SPANS = "ka long, kb long, start int, stop int"


def _sorted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated stretches of segments that stand once, by suffix sorting all segments of an anchor together.

    Rows come ordered by anchor; whole anchors are gathered up to SORT_BYTES and sorted at once.
    """
    ordered = pieces.repartition("anchor").sortWithinPartitions("anchor")
    bound_batches(pieces.sparkSession)

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        counts = np.array([r[2] for r in rows], np.int64)
        out = []
        for (_, start, _, n, ka, kb, _), marks in zip(rows, repeated_windows([r[6] for r in rows], counts, length), strict=True):
            if n == 1 and marks.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
                for low, high in edges.reshape(-1, 2).tolist():
                    out.append((ka, kb, start + low, start + high - 1 + length))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["ka", "kb", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole anchors
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "start", "windows", "n", "ka", "kb", "piece")), strict=True):
                if group and group[0][0] != row[0]:
                    held += group
                    group = []
                    if size >= SORT_BYTES:
                        yield from solve(held)
                        held, size = [], 0
                group.append(row)
                size += len(row[6])
        held += group
        if held:
            yield from solve(held)

    return ordered.mapInArrow(run, SPANS)


def _counted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """As ``_sorted_spans`` for anchors too large for one sort: their windows are counted by a 128-bit hash.

    Nothing shorter than the whole window separates the places of such an anchor.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, owner, at = [], [], []
        rows = zip(batch.column("piece"), batch.column("windows").to_pylist(), batch.column("start").to_pylist(), strict=True)
        for k, (piece, windows, start) in enumerate(rows):
            view = memoryview(piece.as_buffer())
            hashes += [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(windows)]
            owner += [k] * windows
            at += range(start, start + windows)
        halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), *(batch.column(c).take(pa.array(owner, pa.int64())) for c in ("ka", "kb", "n")),
             pa.array(at, pa.int32())], ["wa", "wb", "ka", "kb", "n", "start"],
        )

    windows = map_batches(pieces, run, "wa long, wb long, ka long, kb long, n long, start int")
    often = windows.groupBy("wa", "wb").agg(F.sum("n").alias("places")).where("places > 1").select("wa", "wb")
    return windows.where("n = 1").join(often, ["wa", "wb"]).selectExpr("ka", "kb", "start", f"start + {length} AS stop")


def repeats(keyed: DataFrame, length: int = LENGTH, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """(ka, kb, spans) of texts that stand once and hold a repeated string: its covered stretches, in no order.

    ``keyed`` has (ka, kb, text), as ``_keyed`` gives it.
    """
    occurrences = stage(_occurrences(keyed, length))
    # staged, so that the join with it is split where an anchor is frequent
    often = stage(occurrences.groupBy("anchor").agg(F.sum("times").alias("places")).where("places > 1").select("anchor"))
    shared = stage(occurrences.join(often, "anchor"))
    segments = stage(shared.groupBy("anchor", "content").agg(
        F.sum("times").alias("n"), F.min(F.struct("ka", "kb", "start", "windows")).alias("at")
    ))
    # an anchor needs sorting if it has different segments, of which one stands once
    size = F.sum(F.col("at.windows") + (length - 1))
    contested = stage(
        segments.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), size.alias("size"))
        .where("kinds > 1 AND least = 1").select("anchor", (F.col("size") > sort_bytes).alias("hot"))
    )
    chosen = stage(segments.join(contested, "anchor").select("anchor", "n", "hot", "at.*"))
    pieces = stage(_pieces(chosen, keyed, length))
    single = F.array(F.struct("start", F.expr(f"start + windows + {length - 1}").alias("stop")))
    whole = shared.join(segments.where("n > 1").select("anchor", "content"), ["anchor", "content"]).select(
        "ka", "kb", F.inline(F.coalesce("runs", single))
    )
    spans = (
        whole.unionByName(_sorted_spans(pieces.where("NOT hot"), length))
        .unionByName(_counted_spans(pieces.where("hot"), length))
    )
    return spans.groupBy("ka", "kb").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # within one text


def _runs_of(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    for text, spans in zip(texts_of(batch.column("text")), batch.column("spans"), strict=True):
        if spans.as_py() is None:
            yield text, np.empty((0, 2), np.int64)
        else:
            start, stop = (spans.values.field(k).to_numpy().astype(np.int64) for k in range(2))
            yield text, merged(np.stack([start, stop], axis=1))


def _without(text: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def _copied(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("ka", "kb").agg(F.count("*").alias("copies")).where("copies > 1")


def without_repeats(
    docs: DataFrame, length: int = LENGTH, sort_bytes: int = SORT_BYTES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, spans, kept) of every row: removed byte ranges in ascending order, and the bytes left.

    A byte goes if a string of ``length`` bytes that covers it starts at another place as well, in any row. So a
    text of that length that stands in several rows goes whole, and shorter or missing texts stay. Repeated rows
    and rows without an id are rows like others. What is left need not be UTF-8. Other columns are ignored.
    """
    keyed = _keyed(docs, id_column, text_column)
    copies = _copied(keyed)
    found = stage(repeats(keyed, length, sort_bytes).join(copies, ["ka", "kb"], "left_anti"))
    whole = F.struct(F.lit(0).alias("start"), F.octet_length("text").alias("stop"))
    all_of_it = F.when((F.col("copies") > 1) & (F.octet_length("text") >= length), F.array(whole))
    marked = keyed.join(copies, ["ka", "kb"], "left").join(found, ["ka", "kb"], "left").withColumn(
        "spans", F.coalesce(all_of_it, "spans")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        spans, kept = [], []
        for text, runs in _runs_of(batch):
            spans.append([{"start": a, "stop": b} for a, b in runs.tolist()])
            kept.append(_without(text, runs))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "spans", "kept"]
        )

    schema = "id long, spans array<struct<start: int, stop: int>>, kept binary"
    return map_batches(marked.select("id", "text", "spans"), run, schema).withColumnRenamed("id", id_column)


def digests(docs: DataFrame, length: int = LENGTH, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, by the rules of ``without_repeats``.

    Only texts that stand once and hold a repeat are exchanged; the others are decided by their digest.
    """
    keyed = _keyed(docs, "doc_id", "text")
    copies = stage(_copied(keyed))
    found = stage(repeats(keyed, length, sort_bytes).join(copies, ["ka", "kb"], "left_anti"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, spans, kept = [], [], []
        for text, runs in _runs_of(batch):
            removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
            spans.append(len(runs))
            kept.append(hashlib.sha256(_without(text, runs)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("ka"), batch.column("kb"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
            ["ka", "kb", "removed", "spans", "kept"],
        )

    texts = only_ids(keyed.select("ka", "kb", "text"), "ka", found.select("ka")).join(found, ["ka", "kb"])
    cut = stage(map_batches(texts, run, "ka long, kb long, removed long, spans long, kept string"))
    rows = keyed.select("id", "ka", "kb", "sha", F.octet_length("text").cast("long").alias("n_bytes"))
    joined = rows.join(copies, ["ka", "kb"], "left").join(cut, ["ka", "kb"], "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return joined.select(
        F.col("id").alias("doc_id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
