"""How filters of a corpus interact: what each order of them keeps, and which filter alone rejects what.

Every document becomes one 32-bit word, its truth table: bit S tells whether it survives the set S of the five
filters. Words are counted bit by bit with carry-save adders, so one pass gives the survivors of all
32 sets by part and label; every order, step and share follows from those few counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import map_batches, texts_of

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: fixed values: the bounds of the filters and the characters that D rejects
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_ODD = re.compile(rb"[#$%&*|]")
#: bytes of a text whose words are looked at together
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
COUNTED = ("survivors", "good", "toxic")
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

#: bit S of TRUTH[f] is set where a document failing the filters f survives the set S
TRUTH = np.array([sum(1 << s for s in range(SETS) if not f & s) for f in range(SETS)], np.uint32)


def _word_counts(text: bytes) -> tuple[int, int]:
    """(words, distinct words), by pieces that end at a space, so that a giant text is never split whole."""
    total, seen, at = 0, set(), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        words = text[at:end].split()
        total += len(words)
        seen.update(words)
        at = end
    return total, len(seen)


def failures(text: bytes, chars: int) -> int:
    """Bits 0 to 3: what of A to D the text fails."""
    words, distinct = _word_counts(text)
    raw = np.frombuffer(text, np.uint8)
    capitals = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    return (
        (words < LEAST_WORDS)
        | (100 * distinct < LEAST_DISTINCT * words) << 1
        | (100 * capitals > MOST_CAPITALS * chars) << 2
        | (_ODD.search(text) is not None) << 3
    )


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, fails) of every row: what each document fails of A to E, as a bit set.

    ``text_key`` is a 128-bit digest of the text; only it, not the text, is exchanged. The first id of each
    digest is found by a partially aggregated minimum, and joined back by digest. A row without an id is
    no copy of another one and has no copies; rows of the smallest id all pass E.
    """
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text"
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        chars = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
        keys, fails = [], []
        for text, n in zip(texts_of(column), chars, strict=True):
            keys.append(hashlib.blake2b(text, digest_size=16).digest())
            fails.append(int(failures(text, n)))
        return pa.record_batch({
            "doc_id": batch.column("doc_id"), "part": batch.column("part"),
            "text_key": pa.array(keys, pa.binary()), "fails": pa.array(fails, pa.int32()),
        })

    own = map_batches(named, run, "doc_id long, part string, text_key binary, fails int")
    first = own.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("first_id"))
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int")
    return own.join(first, "text_key", "left").select(
        "doc_id", "part", "text_key", F.col("fails").bitwiseOR(F.shiftleft(copy, 4)).alias("fails")
    )


def positional_counts(words: np.ndarray) -> np.ndarray:
    """For each of the 32 bits, how many of ``words`` have it set.

    Three words of one weight become a sum word of that weight and a carry word of the next, until two at
    most are left of each weight.
    """
    counts, weight = np.zeros(32, np.int64), 1
    bits = np.arange(32, dtype=np.uint32)
    while len(words):
        carried = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c, rest = words[:third], words[third : 2 * third], words[2 * third : 3 * third], words[3 * third :]
            either = a ^ b
            carried.append((a & b) | (c & either))
            words = np.concatenate([either ^ c, rest])
        for word in words:
            counts += weight * ((word >> bits) & 1).astype(np.int64)
        words, weight = np.concatenate(carried) if carried else words[:0], 2 * weight
    return counts


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_set, survivors, good, toxic): documents left by each set of filters, by part.

    ``good`` and ``toxic`` count those that ``labels`` marks with quality 1 and toxic 1; of several labels of
    an id the largest counts. A part has all 32 sets, zeros included. Tasks add up words and hand on 32
    numbers for each part of a batch.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max("quality").alias("_quality"), F.max("toxic").alias("_toxic")
    )
    rows = judged(docs).join(marks, F.col("doc_id") == F.col("_id"), "left").select(
        "part", "fails", F.coalesce(F.col("_quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("_toxic") == 1, F.lit(False)).alias("toxic"),
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = batch.column("part").dictionary_encode()
        code = parts.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        words = TRUTH[batch.column("fails").to_numpy(zero_copy_only=False)][order]
        marked = [batch.column(c).to_numpy(zero_copy_only=False)[order] for c in ("good", "toxic")]
        bounds = np.searchsorted(code[order], np.arange(len(parts.dictionary) + 1))
        counts = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            own = words[low:high]
            counts.append([positional_counts(w) for w in (own, *(own[m[low:high]] for m in marked))])
        stacked = np.array(counts)
        return pa.record_batch({
            "part": parts.dictionary.take(pa.array(np.repeat(np.arange(len(counts)), SETS))),
            "filter_set": pa.array(np.tile(np.arange(SETS, dtype=np.int32), len(counts))),
            **{name: pa.array(stacked[:, k].ravel()) for k, name in enumerate(COUNTED)},
        })

    schema = "part string, filter_set int, " + ", ".join(f"{c} long" for c in COUNTED)
    return map_batches(rows, run, schema).groupBy("part", "filter_set").agg(*(F.sum(c).alias(c) for c in COUNTED))


def _steps() -> Iterator[tuple[str, int, int, int, int]]:
    """(order, step, filter, set before the step, set after it) of every order of the filters."""
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            yield "".join(FILTERS[i] for i in order), step, k, before, before | 1 << k
            before |= 1 << k


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what the filter of that step does.

    ``kept`` and ``removed``: documents after and at the step; ``redundant``: those that fail its filter and are
    gone before; ``unique_fails``: those that fail nothing else; ``good_lost`` and ``toxic_lost``: removed
    documents by label; ``shapley``: what its filter removes, summed over all orders. A part is a value of
    ``lang``, none as the empty string. Missing and empty texts fail A only (and E as copies). An empty
    table has no parts and no rows. Columns besides doc_id, text and lang are not read.
    """
    # 32 sets of a part at most
    tables = survivors(docs, labels).groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("filter_set", *COUNTED))).alias("sets")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        orders, steps, filters, before, after = zip(*_steps(), strict=True)
        filters, before, after = np.array(filters), np.array(before), np.array(after)
        out = {name: [] for name in MEASURES}
        for sets in batch.column("sets").to_pylist():
            n, good, toxic = (np.array([s[c] for s in sets], np.int64) for c in COUNTED)
            removed = n[before] - n[after]
            fails = (n[0] - n[1 << np.arange(len(FILTERS))])[filters]
            unique = (n[SETS - 1 - (1 << np.arange(len(FILTERS)))] - n[SETS - 1])[filters]
            shares = np.bincount(filters, removed, len(FILTERS)).astype(np.int64)[filters]
            values = n[after], removed, fails - removed, unique, good[before] - good[after], toxic[before] - toxic[after], shares
            for name, value in zip(MEASURES, values, strict=True):
                out[name].append(value)
        rows = batch.num_rows
        return pa.record_batch({
            "part": batch.column("part").take(pa.array(np.repeat(np.arange(rows), len(steps)))),
            "filter_order": pa.array(list(orders) * rows), "step": pa.array(list(steps) * rows, pa.int32()),
            **{name: pa.array(np.concatenate(value)) for name, value in out.items()},
        })

    fields = ", ".join(f"{name} long" for name in MEASURES)
    return map_batches(tables, run, f"part string, filter_order string, step int, {fields}")
