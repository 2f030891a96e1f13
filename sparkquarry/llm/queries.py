"""The queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from sparkquarry.llm import decontaminate, divergence, lexical, minhash
from sparkquarry.llm.language_id import op10_language_id
from sparkquarry.llm.licenses import op4_license_scan
from sparkquarry.llm.pieces import op5_sentencepiece
from sparkquarry.llm.pii import op8_pii
from sparkquarry.llm.quality_rank import op7_quality_classifier
from sparkquarry.llm.quality_rules import op2_quality_rules
from sparkquarry.llm.secrets import op9_secret_scan
from sparkquarry.llm.token_files import op12_token_files
from sparkquarry.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (minhash.op1_minhash_near_dedup, op2_quality_rules, decontaminate.op3_benchmark_decontamination, op4_license_scan, op5_sentencepiece, op6_toxicity, op7_quality_classifier, op8_pii, op9_secret_scan, op10_language_id, divergence.op11_divergence_audit, op12_token_files, lexical.op13_ranked_search)}
SQL = {"op1_minhash_near_dedup": minhash.OP1_SQL, "op3_benchmark_decontamination": decontaminate.OP3_SQL, "op11_divergence_audit": divergence.OP11_SQL, "op13_ranked_search": lexical.OP13_SQL}
