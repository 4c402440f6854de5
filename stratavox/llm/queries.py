"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratavox.llm.archives import OP7_SQL, op7_warc
from stratavox.llm.decontaminate import OP8_SQL, op8_decontaminate
from stratavox.llm.jaccard import OP4_SQL, op4_jaccard_join
from stratavox.llm.language import op9_language
from stratavox.llm.packing import op6_packing
from stratavox.llm.quality import op10_quality
from stratavox.llm.shards import op1_sharding
from stratavox.llm.toxicity import op5_toxicity
from stratavox.llm.urlgraph import OP3_SQL, op3_url_filters
from stratavox.llm.vectors import OP2_SQL, op2_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_vectors": op2_vectors,
    "op3_url_filters": op3_url_filters,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
}

#: The others learn, place or pack by hash or in sequence; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_vectors": OP2_SQL,
    "op3_url_filters": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op7_warc": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
}
