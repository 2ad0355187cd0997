"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import line_dedup, prefix_trie, quality_rules, repeats, secrets, turn_repair, warc
from .fingerprints import op5_document_fingerprints
from .line_dedup import op10_line_dedup
from .packing import op4_packing
from .perplexity import op9_quality_classifier
from .pieces import op3_sentencepiece
from .prefix_trie import op13_prefix_trie
from .quality_rules import op8_quality_rules
from .repeats import op11_suffix_dedup
from .secrets import op7_secret_scan
from .simhash_trie import op2_simhash_near_dedup
from .toxicity import op6_toxicity
from .turn_repair import op12_conversation_repair
from .warc import op1_warc_revisits

QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_packing": op4_packing,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_revisits": warc.ORACLE_SQL,
    "op7_secret_scan": secrets.ORACLE_SQL,
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op11_suffix_dedup": repeats.ORACLE_SQL,
    "op12_conversation_repair": turn_repair.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
