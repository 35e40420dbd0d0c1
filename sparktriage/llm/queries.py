"""Queries of the subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .centroids import ORACLE as OP13_SQL
from .centroids import op13_centroids
from .chat import ORACLE as OP3_SQL
from .chat import op3_chat
from .common import table
from .decontaminate import ORACLE as OP1_SQL
from .decontaminate import op1_decontaminate
from .divergence import ORACLE as OP12_SQL
from .divergence import op12_divergence
from .language import op5_language
from .mtree import ORACLE as OP4_SQL
from .mtree import op4_topk
from .pieces import op6_pieces
from .quality import op9_quality
from .simhash import op8_simhash
from .suffix_dedup import ORACLE as OP2_SQL
from .suffix_dedup import op2_suffix_dedup
from .tokencount import op11_token_counts
from .tokenfile import op10_token_ids
from .toxicity import op7_toxicity

QUERIES = {
    "op1_decontaminate": lambda spark, d: op1_decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_suffix_dedup": lambda spark, d: op2_suffix_dedup(table(spark, d, "documents")),
    "op3_chat": lambda spark, d: op3_chat(spark, table(spark, d, "conversations")),
    "op4_topk": lambda spark, d: op4_topk(table(spark, d, "embeddings")),
    "op5_language": lambda spark, d: op5_language(table(spark, d, "documents")),
    "op6_pieces": lambda spark, d: op6_pieces(table(spark, d, "documents")),
    "op7_toxicity": lambda spark, d: op7_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_simhash": lambda spark, d: op8_simhash(table(spark, d, "documents")),
    "op10_token_ids": lambda spark, d: op10_token_ids(table(spark, d, "documents")),
    "op11_token_counts": lambda spark, d: op11_token_counts(table(spark, d, "documents")),
    "op12_divergence": lambda spark, d: op12_divergence(table(spark, d, "documents")),
    "op13_centroids": lambda spark, d: op13_centroids(table(spark, d, "embeddings")),
    "op9_quality": lambda spark, d: op9_quality(table(spark, d, "documents"), table(spark, d, "labels")),
}

ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op3_chat": OP3_SQL, "op4_topk": OP4_SQL, "op12_divergence": OP12_SQL, "op13_centroids": OP13_SQL}
