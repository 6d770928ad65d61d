"""The queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from lineweave.llm.best_fit_packing import op4_best_fit_packing
from lineweave.llm.bit_packing import op10_bit_packing
from lineweave.llm.chat_format import op8_chat_format
from lineweave.llm.decontamination import op9_decontamination
from lineweave.llm.language_id import op2_language_id
from lineweave.llm.level_packing import op13_level_packing
from lineweave.llm.ngram_jaccard import OP3_SQL, op3_ngram_jaccard
from lineweave.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from lineweave.llm.quality_rules import op5_quality_rules
from lineweave.llm.suffix_dedup import op1_suffix_dedup
from lineweave.llm.url_templates import op6_sql, op6_url_templates
from lineweave.llm.warc_zip import OP7_SQL, op7_warc_zip
from lineweave.llm.whitening import op12_whitening


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_language_id": op2_language_id,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_quality_rules": op5_quality_rules,
        "op6_url_templates": op6_url_templates,
        "op7_warc_zip": op7_warc_zip,
        "op8_chat_format": op8_chat_format,
        "op9_decontamination": op9_decontamination,
        "op10_bit_packing": op10_bit_packing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_whitening": op12_whitening,
        "op13_level_packing": op13_level_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": OP3_SQL, "op6_url_templates": op6_sql(), "op7_warc_zip": OP7_SQL, "op11_prefix_trie": OP11_SQL}
