"""All queries of the training-data operators with their SQL."""

import corpus_pipeline
from logquarry.llm import (cotraining, decontaminate, jaccard_join, language_id, license_scan, line_dedup,
                           mixing, quality_rules, spelling_variants, substring_dedup, syncmers, token_alignment,
                           token_rollup)
from logquarry.llm.common import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES", "cotraining", "decontaminate", "jaccard_join", "language_id", "license_scan", "line_dedup",
           "mixing", "quality_rules", "spelling_variants", "substring_dedup", "syncmers", "token_alignment", "token_rollup"]
