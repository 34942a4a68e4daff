"""N-gram Jaccard join: near-duplicate texts through adaptive multi-match prefixes.

A text's set holds its distinct five-word shingles. In one order that holds for all texts, rare
shingles first, two sets of similarity t share at least m shingles among their first
``n - a + m`` ones, for every m, where ``a = ceil(t / (1 + t) * (n + n'))`` is what sets of n and n' must
share. A larger m lengthens the prefix and asks for more shared shingles; each text takes the m with the
least estimated cost and, as the larger of a pair, decides what the pair must share before its texts are
compared. Changed words make rare shingles, which come first, so texts that differ too much share nothing.

Steps: (1) counts of all shingles in a sketch of fixed size, (2) prefixes and m per text, (3) equal
texts become one class, (4) texts that share a smallest shingle are compared with one of them, which
joins large groups of near copies by as many comparisons as they have members, (5) all other pairs
that share enough prefix shingles and are not yet in one component are compared, (6) components,
(7) all links are counted: each lies inside a component, whose texts are compared block by block.

Before the texts of a pair move for a comparison, their profiles meet: counts of shingles by the leading
bits of their hashes, two to four a count. Two sets cannot share more than the smaller counts add up to, so
a pair that stays below its threshold even then is left out, and no similar pair is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from memberlens.llm.common import bound_batches, map_batches, mixed, only_ids, texts_of, without_ids, word_hashes
from memberlens.llm.components import components
from memberlens.session import stage

#: counters of the sketch, and the parts in which they are summed
SKETCH_BITS = 20
SKETCH_PARTS = 64
#: largest m, and what a comparison of two texts costs against a row of the prefix index
MOST_MATCHES = 4
COMPARE_COST = 50
#: smallest hashes of a text that step 4 looks at
SMALLEST = 6
#: a shingle that may be in more texts than this is counted by grouping, not by a window
HOT_TEXTS = 100_000
#: texts and shingles in one of the blocks into which a component is cut for the count of its links
BLOCK_TEXTS = 1_000
BLOCK_SHINGLES = 600_000
#: bytes for each shingle beyond which a text moves as its set
BYTES_PER_SHINGLE = 16
#: shingles of a dense product of two blocks
DENSE_SHINGLES = 4_096
#: a count of a profile takes four bits; this value stands for itself and all above
PROFILE_FULL = 15
#: words handled at once in a task
WORDS_AT_ONCE = 250_000


def shingle_sets(texts: Iterator[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A-Z are lower-cased and words are cut at ASCII white space. Fewer words than ``width`` make one
    shingle, no words an empty set.
    """
    held, counts = [], []

    def flush() -> Iterator[np.ndarray]:
        hashes, at = word_hashes(held), 0
        rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(rolled)]
        rolled = mixed(rolled)
        for n in counts:
            if n >= width:
                yield np.unique(rolled[at : at + n - width + 1])
            elif n:
                short = b" ".join(held[at : at + n])
                yield np.array([xxhash.xxh3_64_intdigest(short, seed=n)], np.uint64)
            else:
                yield np.empty(0, np.uint64)
            at += n
        held.clear()
        counts.clear()

    for text in texts:
        words = text.lower().split()
        held += words
        counts.append(len(words))
        if len(held) >= WORDS_AT_ONCE:
            yield from flush()
    yield from flush()


def similarity_join(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 5,
    percent: int = 80,
    hot_texts: int = HOT_TEXTS,
    with_links: bool = True,
) -> DataFrame:
    """(id, n_shingles, class_id, component_id, n_links) for every distinct id of ``docs``.

    Two texts are linked when ``100 * shared >= percent * united`` shingles. ``class_id`` is the
    smallest id with the same words, ``component_id`` the smallest id reachable over links, ``n_links`` the
    number of other texts (counted by their words) that the text is linked to, not computed unless
    ``with_links``. Missing
    and empty texts have no shingles and no links. Rows without an id are returned alone, with
    themselves as no component (null). Of several rows with one id the id's texts all count: the id
    is linked to what any of them is linked to, ``n_shingles`` is the largest, and ``n_links`` the sum over
    its different texts. Columns other than the two named are ignored, whatever their names.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    known = narrow.where("id is not null")
    bound_batches(docs.sparkSession)
    totals = _sketch(known, width)
    rows = stage(_prefixes(known, totals, width, percent, hot_texts))

    # one id, one class: equal word sequences share the smallest id
    keyed = rows.where("n > 0").select("id", "words_key")
    lowest = keyed.groupBy("words_key").agg(F.min("id").alias("class_id"))
    worded = stage(keyed.join(lowest, "words_key").select("id", "class_id", "words_key").distinct())
    classes = worded.select("id", "class_id").distinct()
    # of equal texts one goes on; the rows with their prefixes are neither moved nor written again
    firsts = classes.select(F.col("class_id").alias("id")).distinct()
    others = stage(classes.select("id").distinct().join(firsts, "id", "left_anti"))
    kept = without_ids(rows.where("n > 0"), "id", others)

    profiles = stage(kept.select("id", "n", "profile").distinct())
    linked = stage(_compared(_stars(kept, percent), profiles, known, width, percent))
    joined = components(linked)
    pairs = stage(_shared_prefixes(kept, joined, percent))
    # first one partner for each text, then whatever is still in different components
    best = W.partitionBy("a").orderBy(F.desc("shared"), "b")
    first = pairs.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select("a", "b")
    linked = linked.unionByName(stage(_compared(first, profiles, known, width, percent)))
    joined = components(linked)
    rest = _apart(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), joined)
    linked = linked.unionByName(stage(_compared(rest, profiles, known, width, percent)))
    # an id with several texts ties the classes of its texts together
    linked = linked.unionByName(classes.select(F.col("id").alias("a"), F.col("class_id").alias("b")))
    final = components(linked)

    sizes = rows.groupBy("id").agg(F.max("n").alias("n_shingles"))
    ties, n_links = worded, []
    if with_links:
        widths = rows.where("n > 0").groupBy("words_key").agg(F.max("n").alias("n"))
        members = worded.where("id = class_id").join(widths, "words_key").select("id", "words_key", "n")
        ties = worded.join(_links(members, final, known, width, percent), "words_key", "left")
        n_links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    own = ties.groupBy("id").agg(F.min("class_id").alias("class_id"), *(F.sum(c).alias(c) for c in ["n_links"] if with_links))
    result = (
        sizes.join(own, "id", "left")
        .join(final, "id", "left")
        .select(
            F.col("id").alias(id_column),
            "n_shingles",
            F.coalesce("class_id", "id").alias("class_id"),
            F.coalesce("component", "id").alias("component_id"),
            *n_links,
        )
    )
    unnamed = map_batches(
        narrow.where("id is null"),
        lambda batch: pa.record_batch(
            {"n_shingles": pa.array([len(s) for s in shingle_sets(texts_of(batch.column("text")), width)], pa.int64())}
        ),
        "n_shingles long",
    )
    none = F.lit(None).cast("long")
    return result.unionByName(
        unnamed.select(none.alias(id_column), "n_shingles", none.alias("class_id"), none.alias("component_id")),
        allowMissingColumns=True,
    )


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many texts hold a shingle of each hash bucket, over all texts: 2**SKETCH_BITS counters."""
    size = (1 << SKETCH_BITS) // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for found in shingle_sets(texts_of(batch.column("text")), width):
                np.add.at(counters, (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        if counters.any():
            task = TaskContext.get().partitionId()
            parts = counters.reshape(SKETCH_PARTS, size)
            yield pa.record_batch({
                "part": pa.array(range(SKETCH_PARTS), pa.int32()),
                "lane": pa.array([task % 32] * SKETCH_PARTS, pa.int32()),
                "counters": pa.array([p.tobytes() for p in parts], pa.binary()),
            })

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, lane, counters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault((part, lane), np.zeros(size, np.int64))
                own += np.frombuffer(counters, np.int64)
        if sums:
            yield pa.record_batch({
                "part": pa.array([k[0] for k in sums], pa.int32()),
                "lane": pa.array([k[1] for k in sums], pa.int32()),
                "counters": pa.array([v.tobytes() for v in sums.values()], pa.binary()),
            })

    schema = "part int, lane int, counters binary"
    counted = docs.select("text").mapInArrow(count, schema)
    laned = counted.repartition("part", "lane").mapInArrow(add, schema).withColumn("lane", F.lit(0))
    summed = laned.repartition("part").mapInArrow(add, schema)
    totals = np.zeros((SKETCH_PARTS, size), np.int64)
    for part, _, counters in summed.collect():  # SKETCH_PARTS rows, 8 MB in all
        totals[part] += np.frombuffer(counters, np.int64)
    return totals.reshape(-1)


def _prefixes(docs: DataFrame, totals: np.ndarray, width: int, percent: int, hot: int) -> DataFrame:
    """Per text: set size, key of its words, its m, prefix shingles for the largest m, smallest hashes, and profile."""
    mean = totals.mean()
    rank = np.log2(totals / max(mean, 1.0) + 1).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(
        (rank, np.maximum(totals - mean, 0).astype(np.float32), totals > hot)
    )

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank, others, is_hot = shared.value
        out: dict[str, list] = {k: [] for k in ("n", "words_key", "m", "tokens", "hot", "smallest", "profile")}
        texts = list(texts_of(batch.column("text")))
        for text, found in zip(texts, shingle_sets(iter(texts), width), strict=True):
            n = len(found)
            need = -(-percent * n // 100)
            at = (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            order = np.argsort(rank[at], kind="stable")[: n - need + MOST_MATCHES]
            spread = np.cumsum(others[at[order]])
            best, least = 1, None
            for m in range(1, min(MOST_MATCHES, need) + 1):
                reach = spread[min(n - need + m, n) - 1]
                cost = reach + COMPARE_COST * reach / m
                if least is None or cost < least:
                    best, least = m, cost
            out["n"].append(n)
            out["words_key"].append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())))
            out["m"].append(best)
            out["tokens"].append(found[order].view(np.int64))
            out["hot"].append(is_hot[at[order]])
            # another order than the prefixes', in which changed words do not come first
            out["smallest"].append(np.sort(mixed(found + np.uint64(1)))[:SMALLEST].view(np.int64))
            out["profile"].append(_profile(found))
        types = {"n": pa.int64(), "words_key": pa.binary(), "m": pa.int32(),
                 "tokens": pa.list_(pa.int64()), "hot": pa.list_(pa.bool_()), "smallest": pa.list_(pa.int64()), "profile": pa.binary()}
        return pa.record_batch({"id": batch.column("id")} | {k: pa.array(v, types[k]) for k, v in out.items()})

    return map_batches(
        docs.select("id", "text"), of,
        "id long, n long, words_key binary, m int, tokens array<long>, hot array<boolean>, smallest array<long>, profile binary",
    )


def _profile(found: np.ndarray) -> bytes:
    """Counts of the shingles by the leading bits of their hashes, four bits each."""
    bits = max(4, (len(found) // 2).bit_length() - 1)
    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    low = np.minimum(counts, PROFILE_FULL).astype(np.uint8)
    return (low[::2] | (low[1::2] << np.uint8(4))).tobytes()


def _most_shared(a: bytes, b: bytes) -> int:
    """No two sets of these profiles share more shingles."""

    def counts(profile: bytes, size: int) -> np.ndarray:
        packed = np.frombuffer(profile, np.uint8)
        both = np.stack([packed & np.uint8(15), packed >> np.uint8(4)], axis=1).reshape(-1).astype(np.int64)
        both[both == PROFILE_FULL] = 1 << 40
        return both.reshape(size, -1).sum(axis=1)

    size = 2 * min(len(a), len(b))
    return int(np.minimum(counts(a, size), counts(b, size)).sum())


def _near_sizes(percent: int, a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _stars(kept: DataFrame, percent: int) -> DataFrame:
    """For every text the one that is the first under most of its smallest hashes: (a, b)."""
    keys = kept.select("id", "n", F.explode("smallest").alias("key"))
    lowest = keys.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("members")).where("members > 1")
    pairs = keys.join(lowest, "key").where("id <> b").groupBy("id", "n", "b").agg(F.count("*").alias("shared"))
    most = F.max_by("b", F.struct("shared", (-F.col("b")).alias("smaller")))
    named = pairs.groupBy(F.col("id").alias("a"), F.col("n").alias("n_a")).agg(most.alias("b"))
    sizes = kept.groupBy(F.col("id").alias("b")).agg(F.max("n").alias("n_b"))
    return named.join(sizes, "b").where(_near_sizes(percent, "n_a", "n_b")).select("a", "b")


def _possible(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose profiles allow as many shared shingles as similar texts have."""
    sides = [
        profiles.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("profile").alias(f"profile_{s}"))
        for s in ("a", "b")
    ]

    def allowed(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        profiles = zip(batch.column("profile_a").to_pylist(), batch.column("profile_b").to_pylist(), strict=True)
        most = np.fromiter((_most_shared(a, b) for a, b in profiles), np.int64, len(n))
        chosen = pa.array((100 + percent) * most >= percent * n)
        return pa.record_batch({k: batch.column(k).filter(chosen) for k in ("a", "b")})

    return map_batches(pairs.join(sides[0], "a").join(sides[1], "b"), allowed, "a long, b long")


def _compared(pairs: DataFrame, profiles: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` whose texts are similar, by their whole sets."""
    pairs = stage(_possible(pairs.select("a", "b"), profiles, percent).distinct())
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    texts = only_ids(docs, "id", ends)
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"
    )

    def similar(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, seen = [], None, None
        lefts, rights = texts_of(batch.column("text_a")), texts_of(batch.column("text_b"))
        for left, right in zip(lefts, shingle_sets(rights, width), strict=True):
            if left != last:
                last, seen = left, next(shingle_sets(iter([left]), width))
            common = len(np.intersect1d(seen, right, assume_unique=True))
            united = len(seen) + len(right) - common
            keep.append(common > 0 and 100 * common >= percent * united)
        chosen = pa.array(keep, pa.bool_())
        return pa.record_batch({k: batch.column(k).filter(chosen) for k in ("a", "b")})

    return map_batches(both, similar, "a long, b long").distinct()


def _shared_prefixes(kept: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that share as many prefix shingles as the larger text asks for."""
    rows = kept.select("id", F.posexplode(F.arrays_zip("tokens", "hot")).alias("at", "entry")).select(
        "id", F.col("entry.tokens").alias("token"), F.col("entry.hot").alias("hot"), "at"
    )
    # a shingle of one text only makes no pair. The sketch bounds the others' texts, so that a window
    # over one shingle is bounded; those beyond the bound are counted by a grouped sum instead
    cold = (
        rows.where("not hot").withColumn("texts", F.count("*").over(W.partitionBy("token")))
        .where("texts > 1").select("token", "id", "at")
    )
    hot = rows.where("hot")
    often = hot.groupBy("token").agg(F.count("*").alias("texts")).where("texts > 1")
    warm = hot.join(often, "token").select("token", "id", "at")
    traits = kept.select("id", "n", "m").join(joined, "id", "left").select(
        "id", "n", "m", F.coalesce("component", "id").alias("component")
    )
    listed = stage(cold.unionByName(warm).join(traits, "id"))
    # within a shingle's texts, those of its largest component need not be paired with each other
    groups = listed.groupBy("token", "component").agg(F.count("*").alias("members"))
    tokens = (
        groups.groupBy("token")
        .agg(F.count("*").alias("parts"), F.max_by("component", F.struct("members", "component")).alias("major"))
        .where("parts > 1")
    )
    open_rows = listed.join(tokens.select("token", "major"), "token")
    left, right = (
        open_rows.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "m", "at", "component")), *extra)
        for s, extra in (("a", ["major"]), ("b", []))
    )
    larger = "(n_a > n_b or (n_a = n_b and id_a > id_b))"
    asked = f"if({larger}, m_a, m_b)"
    must_share = f"ceil({percent} * (n_a + n_b) / {100 + percent})"
    met = (
        left.where("component_a <> major")
        .join(right, "token")
        .where("component_a <> component_b and (component_b = major or id_a < id_b)")
        .where(_near_sizes(percent, "n_a", "n_b"))
        .where(f"at_a < n_a - {must_share} + {asked} and at_b < n_b - {must_share} + {asked}")
        .select(
            F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.expr(asked).alias("asked"),
        )
    )
    # which side is a depends on the shingle; a pair is one pair either way
    swap = "a < b"
    ordered = met.selectExpr(f"if({swap}, a, b) as a", f"if({swap}, b, a) as b", "asked")
    return (
        ordered.groupBy("a", "b", "asked").agg(F.count("*").alias("shared"))
        .where("shared >= asked").select("a", "b", "shared")
    )


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        named = joined.select(F.col("id").alias(side), F.col("component").alias(f"in_{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"in_{side}", F.coalesce(f"in_{side}", side))
    return pairs.where("in_a <> in_b").select("a", "b")


def _links(members: DataFrame, joined: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(words_key, n_links): how many other classes each class is linked to, by their whole sets.

    ``members`` holds one text of each class, as (id, words_key, n): an id may stand for several. No link leaves
    a component. A component is cut into blocks of bounded size by a hash of the class, and every two of
    its blocks are compared in one call. A text moves to a block as it is, unless its set is much smaller,
    so that a block is bounded in bytes too.
    """
    sizes = members.join(joined, "id")
    blocks = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    several = (
        sizes.groupBy("component").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
        .where("texts > 1").select("component", blocks.cast("int").alias("blocks"))
    )
    placed = stage(sizes.join(several, "component").selectExpr(
        "id", "component", "blocks", "words_key", "n", "int(pmod(xxhash64(words_key), blocks)) as block"
    ))
    texts = only_ids(docs, "id", placed.select("id"))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            chosen, texts, found = [], [], []
            keys, counts = batch.column("words_key").to_pylist(), batch.column("n").to_pylist()
            for k, text in enumerate(texts_of(batch.column("text"))):
                # of an id's texts, that of the class; repeated rows come one after another
                if keys[k] != last and xxhash.xxh3_128_digest(b" ".join(text.lower().split())) == keys[k]:
                    last = keys[k]
                    chosen.append(k)
                    repetitive = len(text) > BYTES_PER_SHINGLE * counts[k]
                    texts.append(None if repetitive else text)
                    found.append(next(shingle_sets(iter([text]), width)).tobytes() if repetitive else None)
            kept = batch.take(pa.array(chosen, pa.int64()))
            names = ["component", "blocks", "block", "words_key"]
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in names), pa.array(texts, pa.binary()), pa.array(found, pa.binary())],
                [*names, "text", "shingles"],
            )

    bound_batches(docs.sparkSession)
    dealt = (
        placed.join(texts, "id").select("component", "blocks", "block", "words_key", "n", "text")
        .mapInArrow(narrowed, "component long, blocks int, block int, words_key binary, text binary, shingles binary")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    met = dealt.groupBy("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(
        F.collect_list(F.struct("words_key", "block", "text", "shingles")).alias("members")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, across in zip(batch.column("members"), batch.column("across").to_pylist(), strict=True):
                keys, own, text, shingles = members.values.flatten()
                names, code = np.unique(np.array(keys.to_pylist(), dtype=object), return_inverse=True)
                cut = shingle_sets(texts_of(text), width)
                held = [
                    np.frombuffer(s.as_buffer(), np.uint64) if s.is_valid else own_cut
                    for own_cut, s in zip(cut, shingles, strict=True)
                ]
                codes, links = _links_of(code, own.to_numpy(), held, percent, across)
                if len(codes):
                    yield pa.record_batch({"words_key": pa.array(names[codes].tolist(), pa.binary()), "links": pa.array(links, pa.int64())})

    counted = met.selectExpr("members", "low <> high as across").mapInArrow(count, "words_key binary, links long")
    return stage(counted.groupBy("words_key").agg(F.sum("links").alias("n_links")))


def _links_of(
    classes: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int, across: bool
) -> tuple[np.ndarray, np.ndarray]:
    """(classes, links of each): ``across`` two blocks, or inside one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, term, texts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # shingles of many texts by dense products, the others by their lists
    dense = (texts > 1) & (texts * 32 > len(sets))
    column = (np.cumsum(dense) - 1)[term]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    of_dense = dense[term]
    for start in range(0, int(dense.sum()), DENSE_SHINGLES):
        here = of_dense & (column >= start) & (column < start + DENSE_SHINGLES)
        held = np.zeros((len(sets), min(DENSE_SHINGLES, int(dense.sum()) - start)), np.float32)
        held[owner[here], column[here] - start] = 1
        shared += held @ held.T
    thin = ~of_dense & (texts[term] > 1)
    order = np.argsort(term[thin], kind="stable")
    terms, owners = term[thin][order], owner[thin][order]
    # entry by entry with those that follow at each distance within one list
    for distance in range(1, int(texts[~dense].max(initial=1))):
        same = terms[distance:] == terms[:-distance]
        a, b = owners[:-distance][same], owners[distance:][same]
        np.add.at(shared, (a, b), 1)
        np.add.at(shared, (b, a), 1)
    shared = shared.astype(np.int64)
    similar = (shared > 0) & (100 * shared >= percent * (sizes[:, None] + sizes - shared))
    similar &= classes[:, None] != classes
    if across:
        similar &= blocks[:, None] != blocks
    # a class that came twice counts once
    named, which = np.unique(classes, return_inverse=True)
    linked = np.zeros((len(named), len(named)), bool)
    a, b = np.nonzero(similar)
    linked[which[a], which[b]] = True
    links = linked.sum(axis=1)
    return named[links > 0], links[links > 0]


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id.

    Rows without an id, and rows without words, are kept. Of exactly one id's rows all stay.
    """
    found = similarity_join(docs, id_column, text_column, with_links=False)
    away = found.where(F.col("component_id") != F.col(id_column)).select(id_column)
    return docs.join(away, id_column, "left_anti")
