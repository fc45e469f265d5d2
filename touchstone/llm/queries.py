"""The driver queries of the corpus operators: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchstone.llm.curve_packing import pack
from touchstone.llm.diagonal_votes import OP13_SQL, license_labels
from touchstone.llm.digest_tree import OP9_SQL, exact_groups
from touchstone.llm.katz import katz_scores
from touchstone.llm.line_dedup import OP5_SQL, op5
from touchstone.llm.nb_linear import toxicity
from touchstone.llm.output_codes import language
from touchstone.llm.phrase_graph import OP12_SQL, collocations
from touchstone.llm.pivotal import op2
from touchstone.llm.pruned_graph import neighbours
from touchstone.llm.shingle_product import jaccard_components
from touchstone.llm.span_votes import op10
from touchstone.llm.trie_frontier import spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _on(name: str, operator: Callable[..., DataFrame], *tables: str, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: operator(*[_table(spark, folder, t) for t in tables])
    if sql:
        ORACLES[name] = sql


_on("op9_digest_tree", exact_groups, "documents", sql=OP9_SQL)
_on("op10_span_votes", op10, "documents")
_on("op5_line_bitmaps", op5, "documents", sql=OP5_SQL)
_on("op8_shingle_product", jaccard_components, "documents")
_on("op4_output_codes", language, "documents")
_on("op7_nb_linear", toxicity, "documents", "labels")
_on("op2_pivotal_mix", op2, "documents")
_on("op6_curve_packing", pack, "documents")
_on("op3_pruned_graph", neighbours, "embeddings")
_on("op1_katz", katz_scores, "documents")
_on("op13_diagonal_votes", license_labels, "documents", sql=OP13_SQL)
_on("op11_trie_frontier", spelling_variants, "documents")
_on("op12_phrase_graph", collocations, "documents", sql=OP12_SQL)
