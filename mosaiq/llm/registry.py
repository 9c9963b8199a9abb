"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from mosaiq.llm.compact_windows import op8_compact_windows
from mosaiq.llm.fertility import op6_fertility_rules
from mosaiq.llm.jaccard_join import OP4_ORACLE, op4_jaccard_join
from mosaiq.llm.licenses import op7_license_scan
from mosaiq.llm.mixing import op10_source_mixing
from mosaiq.llm.ogg import op2_ogg_media
from mosaiq.llm.packing import op5_harmonic_packing
from mosaiq.llm.rule_ensemble import op3_rule_ensemble
from mosaiq.llm.secrets import op1_secret_scan
from mosaiq.llm.token_orc import op9_token_orc

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_ogg_media": op2_ogg_media,
    "op3_rule_ensemble": op3_rule_ensemble,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_fertility_rules": op6_fertility_rules,
    "op7_license_scan": op7_license_scan,
    "op8_compact_windows": op8_compact_windows,
    "op9_token_orc": op9_token_orc,
    "op10_source_mixing": op10_source_mixing,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op4_jaccard_join": OP4_ORACLE}
