"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments; each covers about a million words of whole documents and holds, for
every term, the ascending word positions at which it stands. Test phrases are looked up in every segment:
the list of a phrase's rarest term there, moved by the term's place in the phrase, gives the candidate
starts; each next rarer list, moved likewise, is intersected with them until the phrase is complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from memberlens.llm.common import bound_batches, texts_of, word_hashes
from memberlens.session import stage

#: words of an item that make a test phrase
PHRASE = 10
#: words of documents in one segment of the index
SEGMENT_WORDS = 1_000_000
#: empty places between the documents of a segment, more than any phrase or proximity reaches
GAP = 64
#: bits of the fixed-size filter of terms that are worth an index entry
TERM_BITS = 22
#: words of the benchmark that are searched in one run over the index
BLOCK_WORDS = 500_000
#: candidate starts held at once
CANDIDATES = 2_000_000
#: proximity: all words of a phrase stand in one stretch of 2 * SLOP + 1 words
SLOP = 20
#: candidates whose stretches are looked at together
STRETCHES = 100_000

#: fixed: ASCII other than digits and letters separates words, A-Z become a-z
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def benchmark_terms(benchmark: DataFrame, text_column: str = "text") -> np.ndarray:
    """A bitmap of 2**TERM_BITS flags for the terms of all items; at most that many numbers are gathered."""
    mask = np.uint64((1 << TERM_BITS) - 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for text in texts_of(batch.column("text")) for w in words_of(text)]
            yield pa.record_batch({"bit": pa.array(np.unique(word_hashes(words) & mask).astype(np.int64))})

    flags = np.zeros(1 << TERM_BITS, bool)
    bits = benchmark.select(F.col(text_column).alias("text")).mapInArrow(of, "bit long").distinct()
    flags[bits.toPandas()["bit"].to_numpy(np.int64)] = True
    return flags


INDEX = (
    "segment long, doc_ids array<long>, text_hashes array<long>, n_words array<long>, starts array<long>, "
    "terms array<long>, ends array<long>, positions array<int>"
)


def build_index(
    docs: DataFrame, flags: np.ndarray | None = None, id_column: str = "doc_id", text_column: str = "text",
    segment_words: int = SEGMENT_WORDS,
) -> DataFrame:
    """Write the index of all ``docs`` to the shared folder; one row for each segment.

    With ``flags`` only terms whose hash is flagged are entered, since no phrase asks for another.
    Documents are never cut; one longer than a segment makes a segment of its own.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def segment(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids, hashes, words = zip(*held, strict=True)
        counts = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts + GAP)[:-1]])
        terms = word_hashes([w for own in words for w in own])
        places = (np.arange(len(terms)) + np.repeat(GAP * np.arange(len(counts)), counts)).astype(np.int32)
        if shared.value is not None:
            wanted = shared.value[(terms & np.uint64((1 << TERM_BITS) - 1)).astype(np.int64)]
            terms, places = terms[wanted], places[wanted]
        terms = terms.view(np.int64)
        order = np.argsort(terms, kind="stable")
        listed, first = np.unique(terms[order], return_index=True)
        return pa.record_batch({
            "segment": pa.array([number], pa.int64()),
            "doc_ids": pa.array([list(ids)], pa.list_(pa.int64())),
            "text_hashes": pa.array([list(hashes)], pa.list_(pa.int64())),
            "n_words": pa.array([counts], pa.list_(pa.int64())),
            "starts": pa.array([starts], pa.list_(pa.int64())),
            "terms": pa.array([listed], pa.list_(pa.int64())),
            "ends": pa.array([np.append(first[1:], len(terms)) if len(listed) else np.empty(0, np.int64)], pa.list_(pa.int64())),
            "positions": pa.array([places[order]], pa.list_(pa.int32())),
        })

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids, hashes = batch.column("id").to_pylist(), batch.column("text_hash").to_pylist()
            for own, digest, text in zip(ids, hashes, texts_of(batch.column("text")), strict=True):
                words = words_of(text)
                held.append((own, digest, words))
                size += len(words)
                if size >= segment_words:
                    yield segment(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield segment(number, held)

    named = docs.select(
        F.col(id_column).cast("long").alias("id"), F.xxhash64(F.col(text_column)).alias("text_hash"),
        F.col(text_column).alias("text"),
    )
    return stage(named.mapInArrow(build, INDEX))


def indexed_documents(index: DataFrame) -> DataFrame:
    """(segment, doc_no, doc_id, text_hash, n_words): every row that the index holds."""
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "n_words")).alias("doc_no", "d"))
    return rows.select(
        "segment", "doc_no", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_hashes").alias("text_hash"),
        F.col("d.n_words").alias("n_words"),
    )


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, phrase: int) -> Iterator[dict[int, tuple]]:
    """Blocks of items as {phrase length: (term hashes of each phrase, item of each, whether that has no id)}."""
    held: dict[int, list] = {}
    size = 0
    for row in benchmark.select(F.col(id_column).cast("long"), text_column).toLocalIterator():
        words = words_of((row[1] or "").encode())
        if not words:
            continue
        terms = word_hashes(words).view(np.int64)
        n = min(phrase, len(terms))
        windows = np.lib.stride_tricks.sliding_window_view(terms, n)
        held.setdefault(n, []).append((windows, np.full(len(windows), row[0] or 0), np.full(len(windows), row[0] is None)))
        size += len(terms)
        if size >= BLOCK_WORDS:
            yield {n: tuple(map(np.concatenate, zip(*own, strict=True))) for n, own in held.items()}
            held, size = {}, 0
    if held:
        yield {n: tuple(map(np.concatenate, zip(*own, strict=True))) for n, own in held.items()}


class _Postings:
    """The lists of one segment; ``keys`` are (term number, position) as one ascending number."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray):
        self.terms, self.ends, self.positions = terms, ends, positions.astype(np.int64)
        self.lengths = np.diff(ends, prepend=0)
        self.span = int(self.positions.max()) + 2 * GAP if len(positions) else 1
        self.keys = np.repeat(np.arange(len(terms)), self.lengths) * self.span + self.positions

    def numbers(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers of each phrase, and which phrases have all their terms here."""
        if not len(self.terms):
            return np.zeros(phrases.shape, np.int64), np.zeros(len(phrases), bool)
        at = np.minimum(np.searchsorted(self.terms, phrases), len(self.terms) - 1)
        return at, (self.terms[at] == phrases).all(axis=1)

    def searched(self, phrases: np.ndarray, slop: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start) of every occurrence; with ``slop`` (phrase, place of the rarest word in the stretch) instead."""
        at, whole = self.numbers(phrases)
        which = np.flatnonzero(whole)
        if not len(which):
            return
        at = at[which]
        order = np.argsort(self.lengths[at], axis=1, kind="stable")
        rarest = np.take_along_axis(at, order, axis=1)
        reach = np.cumsum(self.lengths[rarest[:, 0]])
        block = reach // CANDIDATES
        for number in np.unique(block):
            own = np.flatnonzero(block == number)
            counts = self.lengths[rarest[own, 0]]
            row = np.repeat(own, counts)
            within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            lists = rarest[row, 0]
            place = self.positions[self.ends[lists] - self.lengths[lists] + within]
            start = place - (order[row, 0] if slop is None else 0)
            for k in range(1, phrases.shape[1]):
                term = rarest[row, k]
                keep = self._holds(term, start + order[row, k]) if slop is None else self._near(term, start, 2 * slop)
                row, start = row[keep], start[keep]
                if not len(row):
                    break
            if slop is not None and len(row):
                keep = [self._together(at[row[k : k + STRETCHES]], start[k : k + STRETCHES], 2 * slop) for k in range(0, len(row), STRETCHES)]
                keep = np.concatenate(keep)
                row, start = row[keep], start[keep]
            if len(row):
                yield which[row], start

    def _holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term * self.span + place
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[found] == key) & (place >= 0)

    def _near(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        low = term * self.span + np.maximum(place - slop, 0)
        found = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
        key = self.keys[found]
        return (key >= low) & (key <= term * self.span + place + slop)

    def _together(self, terms: np.ndarray, place: np.ndarray, reach: int) -> np.ndarray:
        """Whether some stretch [s, s + reach] with ``place`` in it has every one of a row's terms.

        Which term is the rarest one differs between segments; whether there is such a stretch does not.
        """
        found, left, low = np.zeros(len(place), bool), np.arange(len(place)), np.maximum(place - reach, 0)
        while len(left):
            key = terms[left] * self.span + low[:, None]
            at = np.searchsorted(self.keys, key)
            # a term without another place gives one in the next term's range, beyond any stretch
            after = np.where(at < len(self.keys), self.keys[np.minimum(at, len(self.keys) - 1)] - key, self.span)
            last = low + after.max(axis=1)
            whole = last <= low + reach
            found[left[whole]] = True
            more = ~whole & (last - reach <= place[left])
            left, low = left[more], last[more] - reach
        return found


MATCHES = "segment long, doc_no int, kind string, item_id long, start long, length long"


def matches(
    index: DataFrame, benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text",
    phrase: int = PHRASE, slop: int | None = SLOP,
) -> DataFrame:
    """(segment, doc_no, kind, item_id, start, length): where items occur in indexed documents.

    A test phrase is any ``phrase`` consecutive words of an item, or a shorter item as a whole. Kind
    ``exact`` is a run of words covered by overlapping phrases of one item, from word ``start`` of the
    document. Kind ``near`` (unless ``slop`` is None) tells that all words of a phrase stand in one stretch of
    ``2 * slop + 1`` words, in any order, a repeated word at least once; it has one row or a few for each
    document and item. Items without words match nothing. Items are searched in blocks of bounded size, each
    over the whole index.
    """
    if slop is not None and 2 * slop >= GAP:
        raise ValueError(f"2 * slop must be below {GAP}")
    result = None
    for block in _blocks(benchmark, id_column, text_column, phrase):
        found = index.mapInArrow(_search(block, slop), MATCHES)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return index.sparkSession.createDataFrame([], MATCHES)
    return stage(result)


def _search(block: dict[int, tuple], slop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = {c: batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("n_words", "starts", "terms", "ends", "positions")}
                lists = _Postings(part["terms"], part["ends"], part["positions"])
                for length, (phrases, items, unnamed) in block.items():
                    for which, start in lists.searched(phrases, None):
                        yield _rows(batch.column("segment")[k].as_py(), "exact", part["starts"], items[which], unnamed[which], start, length)
                    if slop is not None:
                        for which, start in lists.searched(phrases, slop):
                            yield _rows(batch.column("segment")[k].as_py(), "near", part["starts"], items[which], unnamed[which], start, 1)

    return run


def _rows(segment: int, kind: str, starts: np.ndarray, items: np.ndarray, unnamed: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    doc = np.searchsorted(starts, start, "right") - 1
    start = start - starts[doc]
    if kind == "near":
        order = np.unique(np.stack([doc, items, unnamed]), axis=1, return_index=True)[1]
        ends = start[order] + 1
    else:
        order = np.lexsort((start, unnamed, items, doc))
        doc, items, unnamed, start = doc[order], items[order], unnamed[order], start[order]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (items[1:] != items[:-1]) | (unnamed[1:] != unnamed[:-1]) | (start[1:] > start[:-1] + length)
        order = np.flatnonzero(fresh)
        ends = start[np.append(order[1:], len(start)) - 1] + length
    return pa.record_batch({
        "segment": pa.array(np.full(len(order), segment), pa.int64()), "doc_no": pa.array(doc[order], pa.int32()),
        "kind": pa.array([kind] * len(order)), "item_id": pa.array(items[order], pa.int64(), mask=unnamed[order]),
        "start": pa.array(start[order], pa.int64()), "length": pa.array(ends - start[order], pa.int64()),
    })


def report(index: DataFrame, found: DataFrame) -> DataFrame:
    """Per indexed row: n_words, n_hit (words in exact matches), n_items, item_ids, n_near_items.

    Items without an id count for ``n_hit`` only.
    """
    exact = found.where("kind = 'exact'").withColumn("end", F.col("start") + F.col("length"))
    before = W.partitionBy("segment", "doc_no").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    hits = (
        exact.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), reached)))
        .groupBy("segment", "doc_no")
        .agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    near = found.where("kind = 'near'").groupBy("segment", "doc_no").agg(F.countDistinct("item_id").alias("n_near_items"))
    key = ["segment", "doc_no"]
    return indexed_documents(index).join(hits, key, "left").join(near, key, "left").select(
        *key, "doc_id", "text_hash", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int | None = SLOP) -> DataFrame:
    """``report`` for ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    Missing and empty texts have no words. Repeated rows are reported as often as they stand there.
    """
    index = build_index(docs, benchmark_terms(benchmark))
    return report(index, matches(index, benchmark, slop=slop))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which a test phrase of ``benchmark`` occurs exactly."""
    hit = contamination(docs, benchmark, slop=None).where("n_hit > 0").select("doc_id", "text_hash").distinct()
    hit = hit.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_text"))
    return docs.join(hit, same, "left_anti")
