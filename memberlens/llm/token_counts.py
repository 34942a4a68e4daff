"""Token counts: an exact histogram of encoded lengths, and what suffix sums over it answer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from memberlens.llm.common import map_batches
from memberlens.llm.encoding import encoder
from memberlens.session import stage

#: lengths that share the leading bits are summed together before sums run over them
BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """(n_tokens) of every row; missing and empty texts have 0 tokens."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(tokenizer)
        size = encode.dtype.itemsize
        counts = [len(encode.encode(t or "")) // size for t in batch.column("text").to_pylist()]
        return pa.record_batch({"n_tokens": pa.array(counts, pa.int64())})

    return map_batches(docs.select(F.col(text_column).alias("text")), of, "n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): how many rows have each length. Summed before the shuffle, and staged, since all
    answers read it more than once."""
    return stage(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """Per length L of the histogram, what every longer row adds.

    ``docs_longer`` and ``tokens_longer`` count rows with more than L tokens. Sums run within blocks
    of lengths and over the blocks' totals, of which there are ``longest / BLOCK``; no window holds
    the whole histogram.
    """
    rows = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn(
        "n_all", F.col("n_tokens") * F.col("n_docs")
    )
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("n_all").alias("tokens"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_after"),
    )
    within = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    return rows.join(totals, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_after") + F.coalesce(F.sum("n_all").over(within), F.lit(0))).alias("tokens_longer"),
    )


def context_limits(counts: DataFrame) -> DataFrame:
    """For every length in the histogram as a context limit: what is kept and what is cut.

    Columns: ``context_limit``, ``n_docs`` (rows of just this length), ``docs_within``, ``docs_longer``,
    ``tokens_kept`` (all rows cut to the limit), ``tokens_cut``, ``tokens_total``, ``share_within`` (the
    quantile rank: share of rows no longer than the limit). Between two listed limits the kept tokens
    grow by ``docs_longer`` for each token of limit, so the rows answer every limit. No rows in, none out.
    """
    total = counts.agg(
        F.sum("n_docs").alias("docs_total"),
        F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens_total"),
    )
    limit = F.col("n_tokens")
    kept = F.col("tokens_total") - F.col("tokens_longer") + limit * F.col("docs_longer")
    return (
        with_suffix_sums(counts)
        .join(F.broadcast(total))  # one row
        .select(
            limit.alias("context_limit"), "n_docs",
            (F.col("docs_total") - F.col("docs_longer")).alias("docs_within"),
            "docs_longer",
            kept.alias("tokens_kept"),
            (F.col("tokens_total") - kept).alias("tokens_cut"),
            "tokens_total",
            ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("share_within"),
        )
    )


def kept_at(limits: DataFrame, wanted: list[int]) -> DataFrame:
    """(context_limit, tokens_kept, docs_longer) for any limits, from the rows of ``context_limits``.

    The nearest listed length at or below a limit answers it; below all of them every row is longer.
    """
    spark = limits.sparkSession
    asked = F.broadcast(spark.createDataFrame([(w,) for w in wanted], "asked long"))
    joined = asked.join(limits, F.col("context_limit") <= F.col("asked"), "left").groupBy("asked").agg(
        F.max_by(F.struct("context_limit", "tokens_kept", "docs_longer"), "context_limit").alias("row")
    )
    all_docs = F.broadcast(limits.agg(F.max("docs_within").alias("docs_total")))
    low = F.col("row").isNull()
    return joined.join(all_docs).select(
        F.col("asked").alias("context_limit"),
        F.when(low, F.col("asked") * F.col("docs_total"))
        .otherwise(F.col("row.tokens_kept") + (F.col("asked") - F.col("row.context_limit")) * F.col("row.docs_longer"))
        .alias("tokens_kept"),
        F.when(low, F.col("docs_total")).otherwise(F.col("row.docs_longer")).alias("docs_longer"),
    )


def quantile(limits: DataFrame, share: float) -> int | None:
    """The smallest length within which at least ``share`` of the rows lie; None without rows."""
    return limits.where(F.col("share_within") >= share).agg(F.min("context_limit")).first()[0]
