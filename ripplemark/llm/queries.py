"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op13_alignment
from .bpe import op1_bpe
from .decontam import op2_decontamination
from .embeddings import op11_embeddings
from .jaccard import op3_jaccard
from .langid import op7_language_id
from .output import op4_token_output
from .pii import op5_pii
from .prefixes import op12_prefix_trie
from .quality import op8_quality
from .rules import OP9_SQL, op9_quality_rules
from .substrings import op6_substring_dedup
from .toxicity import op10_toxicity

QUERIES = {q.__name__: q for q in (op1_bpe, op2_decontamination, op3_jaccard, op4_token_output, op5_pii, op6_substring_dedup, op7_language_id, op8_quality, op9_quality_rules, op10_toxicity, op11_embeddings, op12_prefix_trie, op13_alignment)}

SQL = {"op9_quality_rules": OP9_SQL}
