"""The queries of this subpackage, one for each numbered operator, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op4_bpe
from .chat import OP2_SQL, op2_chat_format
from .decontam import OP1_SQL, op1_decontaminate
from .jaccard import OP10_SQL, op10_ngram_join
from .langid import op6_language_id
from .lines import OP13_SQL, op13_line_dedup
from .pii import op8_pii
from .quality import op3_quality_classifier
from .rules import op5_quality_rules
from .spelling import OP11_SQL, op11_spelling
from .suffix import op7_suffix_dedup
from .trie import OP12_SQL, op12_prefix_trie
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_format": op2_chat_format,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_bpe": op4_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_ngram_join": op10_ngram_join,
    "op11_spelling": op11_spelling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
}

SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_chat_format": OP2_SQL, "op9_warc": OP9_SQL, "op10_ngram_join": OP10_SQL, "op11_spelling": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_line_dedup": OP13_SQL}
