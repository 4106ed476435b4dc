"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, exactdup, langid, lines, mixing, nearcopies, quality, sharding, urls
from .oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_strings": exactdup.query,
    "op2_near_embeddings": embeddings.query,
    "op3_quality": quality.query,
    "op4_language": langid.query,
    "op5_line_dedup": lines.query,
    "op6_near_copies": nearcopies.query,
    "op7_mix_sources": mixing.query,
    "op8_decontaminate": decontaminate.query,
    "op9_url_filter": urls.query,
    "op10_shard": sharding.query,
}
