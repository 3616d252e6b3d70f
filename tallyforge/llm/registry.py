"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.alignment import op12_token_alignment
from tallyforge.llm.bpe import op9_bpe_backtracking
from tallyforge.llm.conversations import OP8_SQL, op8_snapshot_collapse
from tallyforge.llm.divergence import OP11_SQL, op11_source_divergence
from tallyforge.llm.flac import op6_flac_media
from tallyforge.llm.language import op3_language_crf
from tallyforge.llm.mixing import op1_source_mixing
from tallyforge.llm.ngram_join import op2_ngram_jaccard, op2_ngram_jaccard_links
from tallyforge.llm.quality import OP10_SQL, op10_distribution_divergence
from tallyforge.llm.site_style import op5_site_style_tree
from tallyforge.llm.token_output import op7_token_blocks
from tallyforge.llm.toxicity import op4_toxicity_trees
from tallyforge.llm.vector_dedup import op13_vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op2_ngram_jaccard_links": op2_ngram_jaccard_links,
    "op3_language_crf": op3_language_crf,
    "op4_toxicity_trees": op4_toxicity_trees,
    "op5_site_style_tree": op5_site_style_tree,
    "op6_flac_media": op6_flac_media,
    "op7_token_blocks": op7_token_blocks,
    "op8_snapshot_collapse": op8_snapshot_collapse,
    "op9_bpe_backtracking": op9_bpe_backtracking,
    "op10_distribution_divergence": op10_distribution_divergence,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_dedup": op13_vector_dedup,
}

ORACLES: dict[str, str] = {
    "op8_snapshot_collapse": OP8_SQL,
    "op10_distribution_divergence": OP10_SQL,
    "op11_source_divergence": OP11_SQL,
}
