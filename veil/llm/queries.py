"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from veil.llm import collocations, hash_tree
from veil.llm.bpe import op2_byte_bpe
from veil.llm.class_lm import op1_class_lm
from veil.llm.contamination import op7_fm_decontamination
from veil.llm.language_id import op4_language_id
from veil.llm.near_dup import op6_order_minhash
from veil.llm.periodic_runs import op11_periodic_runs
from veil.llm.pii import op8_pii_crf
from veil.llm.quality import op3_quality_rules
from veil.llm.secret_scan import op10_secret_scan
from veil.llm.suffix_dedup import op9_suffix_dedup
from veil.llm.token_counts import op5_token_counts

QUERIES = {
    "op1_class_lm": op1_class_lm,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_order_minhash": op6_order_minhash,
    "op7_fm_decontamination": op7_fm_decontamination,
    "op8_pii_crf": op8_pii_crf,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": collocations.op12_collocations,
    "op13_hash_tree": hash_tree.op13_hash_tree,
    "pipeline": corpus_pipeline.run,
}

# The other models, alignments, runs and merges are beyond SQL; tests/llm has brute-force versions.
ORACLES: dict[str, str] = {"op12_collocations": collocations.SQL, "op13_hash_tree": hash_tree.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
