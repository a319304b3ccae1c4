"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .alignment import op12_align_tokenizers
from .chat_format import OP4_SQL, op4_chat_format
from .decontaminate import op6_decontaminate
from .fill_middle import OP11_SQL, op11_fill_in_middle
from .language_id import op3_language_id
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import OP2_SQL, op2_mix_sources
from .ngram_join import op10_ngram_join
from .quality_model import op8_quality_rules_model
from .quality_rules import OP9_SQL, op9_quality_rules
from .repeats import op7_repeats
from .token_files import op13_token_files
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_language_id": op3_language_id,
    "op4_chat_format": op4_chat_format,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_repeats": op7_repeats,
    "op8_quality_rules_model": op8_quality_rules_model,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_join": op10_ngram_join,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_align_tokenizers": op12_align_tokenizers,
    "op13_token_files": op13_token_files,
}

SQL = {
    "op1_line_dedup": OP1_SQL,
    "op2_mix_sources": OP2_SQL,
    "op4_chat_format": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op9_quality_rules": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
}
