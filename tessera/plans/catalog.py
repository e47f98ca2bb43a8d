"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.plans import batch_queries, detail_queries, evaluation_queries, extra_queries, ingest_queries, io_queries, ledger_queries, metric_queries, record_queries, retrieval_queries, search_queries, story_queries, temporal_queries
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "batch_queries", "detail_queries", "evaluation_queries", "extra_queries", "ingest_queries", "io_queries", "ledger_queries", "metric_queries", "record_queries", "retrieval_queries", "search_queries", "story_queries", "temporal_queries"]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; only local mode without it gets a folder of this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset")
        sc.setCheckpointDir(found or Path(tempfile.gettempdir(), "tessera-checkpoints").as_uri())
