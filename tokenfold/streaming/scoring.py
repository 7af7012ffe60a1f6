"""Score a stream of cells with frozen learnt tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenfold.operators import events as E


def stream_events(cells: DataFrame, dialect: str = "em5") -> DataFrame:
    """Tokenise a stream of (sample_id, gene, cell) rows; tokenising is row-local."""
    return E.build_events(cells, dialect)


def stream_hotspots(cells: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Hotspot hits of arriving cells against a frozen hotspot table."""
    return stream_events(cells).join(hotspots.select("gene", "token", "rank"), ["gene", "token"]).select("sample_id", "rank", "gene", "token")


def stream_scores(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, label, weighted, matches) over all cells of a sample that have arrived, in whatever batches.

    The stream state holds the (sample, gene) pairs met, so that a gene counts
    once, and the running sums; frozen weights join as a static table. For update
    output: a batch gives the new totals of the samples that it touches.
    """
    pairs = stream_events(cells).select("sample_id", "gene").dropDuplicates(["sample_id", "gene"])
    scored = pairs.join(weights.select("gene", "label", "w"), "gene")
    return scored.groupBy("sample_id", "label").agg(F.sum("w").alias("weighted"), F.count("*").alias("matches"))


def write_scores(cells: DataFrame, weights: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append the refreshed scores of every micro-batch; a batch that runs again replaces its own rows."""
    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = stream_scores(cells, weights).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_scores(spark: SparkSession, path: str) -> DataFrame:
    """The last written score of every sample and label."""
    rows = spark.read.parquet(path)
    last = F.max_by(F.struct("weighted", "matches"), "batch").alias("s")
    return rows.groupBy("sample_id", "label").agg(last).select("sample_id", "label", "s.*")
