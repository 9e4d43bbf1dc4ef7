"""Token counts by an exact length histogram.

Documents are aggregated by encoded length, before the shuffle. The histogram is as long as the number of different lengths,
and suffix sums over it answer every question about a context limit L without going back to the documents: how many
documents are longer, how many tokens there are, how many are left if each document is cut at L, and any quantile.

The suffix sums are taken in two steps, inside blocks of lengths and over the blocks, so no task gets the whole histogram.

Defined cases: null and empty texts have length 0 and are counted; an empty table gives an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import token_lengths
from .common import materialize

BLOCK = 256


def histogram(lengths: DataFrame) -> DataFrame:
    """lengths: n_tokens. One row a length: n_tokens, docs, docs_longer, tokens, tokens_longer, truncated_total, share_upto.

    docs_longer and tokens_longer: of documents with more tokens. truncated_total: tokens of all documents cut at this
    length. share_upto: share of the documents that are no longer, so the q-quantile is the least length with share >= q.
    """
    counts = materialize(lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")), "length-histogram")
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = counts.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for BLOCK lengths
    blocks = blocks.select(
        "block", F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_after")
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.join(blocks, "block").select(
        "n_tokens", "docs", "tokens",
        (F.coalesce(F.sum("docs").over(inside), F.lit(0)) + F.col("docs_after")).alias("docs_longer"),
        (F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("tokens_after")).alias("tokens_longer"),
    )
    total = counts.agg(F.sum("docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    return rows.crossJoin(F.broadcast(total)).select(  # total is one row
        "n_tokens", "docs", "docs_longer", "tokens", "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("share_upto"),
    )


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    return histogram(token_lengths(docs, path, text))


def answers(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit, whether or not a document has that length: docs_longer and truncated_total."""
    wanted = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    longer = hist.join(F.broadcast(wanted), F.col("n_tokens") > F.col("context"), "right").groupBy("context")  # limits are given
    above = longer.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs_longer"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("over"))
    total = hist.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    return above.crossJoin(F.broadcast(total)).select("context", "docs_longer", (F.col("total") - F.col("over") + F.col("docs_longer") * F.col("context")).alias("truncated_total"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length that a share of q or more of the documents does not exceed."""
    return hist.where(F.col("share_upto") >= q).agg(F.min("n_tokens").alias("n_tokens"))
