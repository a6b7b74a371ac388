"""Token counts: an exact histogram of document lengths, and its suffix sums for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopmill.llm.common import grouped_slices, materialize, utf8
from loopmill.llm.tokens import default_path, encoder

BATCH_BYTES = 4 << 20
#: Lengths summed together first, so that no task gets all lengths.
BLOCK_LENGTHS = 1024


def length_histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``n_tokens``, ``n_docs``: how many documents have each encoded length (null and empty texts: 0).

    Every task sends a row for each length it met.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), np.zeros(0, dtype=np.int64)
        many: dict[int, int] = {}
        for batch in grouped_slices(batches, "text", BATCH_BYTES):
            seen, n = np.unique(enc.counts(utf8(batch.column("text"))), return_counts=True)
            for a, b in zip(seen.tolist(), n.tolist()):
                many[a] = many.get(a, 0) + b
        yield pa.RecordBatch.from_arrays([pa.array(list(many), type=pa.int64()), pa.array(list(many.values()), type=pa.int64())], names=["n_tokens", "n_docs"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return found.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK_LENGTHS) -> DataFrame:
    """For each length L of a histogram: docs and tokens at or beyond L and before it, and what stays of all
    documents cut at L tokens (``tokens_at_limit``).

    Sums go in two levels: inside blocks of lengths, and over one row for each block.
    """
    # used twice: written once, so that no text is encoded again
    rows = materialize(histogram).select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / block).alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later, everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_least = rows.withColumns({"docs_in": F.sum("n_docs").over(within), "tokens_in": F.sum("tokens").over(within)}).join(totals, "block")
    docs_ge, tokens_ge = F.col("docs_in") + F.col("later_docs"), F.col("tokens_in") + F.col("later_tokens")
    return at_least.select(
        "n_tokens",
        "n_docs",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        (F.col("all_docs") - docs_ge).alias("docs_lt"),
        (F.col("all_tokens") - tokens_ge).alias("tokens_lt"),
        (F.col("all_tokens") - tokens_ge + docs_ge * F.col("n_tokens")).alias("tokens_at_limit"),
        ((F.col("all_docs") - docs_ge) / F.col("all_docs")).alias("quantile_from"),
        ((F.col("all_docs") - docs_ge + F.col("n_docs")) / F.col("all_docs")).alias("quantile_to"),
    )


def answer_limits(sums: DataFrame, limits: DataFrame, limit: str = "context_limit") -> DataFrame:
    """Totals for any limits: documents longer than each, and tokens that stay when all are cut there.

    The first length at or beyond the limit has the suffix sums that hold at the limit; a limit beyond all
    lengths cuts nothing. Null limits give nulls. One row per distinct limit.
    """
    asked = limits.select(F.col(limit).cast("long").alias("limit")).distinct()
    points = sums.select(F.col("n_tokens").alias("x"), "n_docs", "docs_ge", "tokens_ge", "tokens_lt").unionByName(
        asked.filter("limit IS NOT NULL").select(F.col("limit").alias("x")), allowMissingColumns=True
    )
    points = points.withColumn("block", F.floor(F.col("x") / BLOCK_LENGTHS))
    total = sums.agg(F.coalesce(F.max(F.col("tokens_lt") + F.col("tokens_ge")), F.lit(0)).alias("all_tokens"))
    known = F.when(F.col("n_docs").isNotNull(), F.struct("x", "n_docs", "docs_ge", "tokens_lt"))
    # lengths and limits of a block in one order; the sums of the next length hold for a limit between two lengths,
    # and where a block has none they are those of the next block's first: one row for each block
    following = Window.partitionBy("block").orderBy(F.desc("x"), F.col("n_docs").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = points.groupBy("block").agg(F.min(known).alias("first"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("block", F.last("first", ignorenulls=True).over(later).alias("next"))
    found = points.withColumn("here", F.last(known, ignorenulls=True).over(following)).filter("n_docs IS NULL").join(firsts, "block")
    found = found.withColumn("s", F.coalesce("here", "next")).crossJoin(F.broadcast(total))
    over = F.coalesce(F.when(F.col("s.x") == F.col("x"), F.col("s.docs_ge") - F.col("s.n_docs")).otherwise(F.col("s.docs_ge")), F.lit(0))
    answers = found.select(
        F.col("x").alias("limit"),
        over.alias("docs_longer"),
        F.coalesce(F.col("s.tokens_lt") + F.col("s.docs_ge") * F.col("x"), F.col("all_tokens")).alias("tokens_at_limit"),
    )
    return asked.join(answers, "limit", "left").withColumnRenamed("limit", limit)
