"""All queries of the training-data operators: importing this module registers them."""

from __future__ import annotations

from pageloom.llm import (  # noqa: F401
    canonical_values,
    contributor_caps,
    eval_leaks,
    format_duplicates,
    incremental_dedup,
    name_variants,
    representatives,
    sentences,
    source_mixing,
    template_residue,
)
from pageloom.llm.registry import ORACLES, QUERIES  # noqa: F401
