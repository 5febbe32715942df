"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from paperloom.llm.huffman import op3_huffman_ids
from paperloom.llm.langid import op9_language_id
from paperloom.llm.line_dedup import OP7_SQL, op7_line_dedup
from paperloom.llm.mixing import OP8_SQL, op8_temperature_mixing
from paperloom.llm.ngram_join import op6_ngram_jaccard
from paperloom.llm.packing import op1_best_fit_packing
from paperloom.llm.phrases import OP11_SQL, op11_phrase_mining
from paperloom.llm.pii import op10_personal_data
from paperloom.llm.quality import OP4_SQL, op4_adaptive_quality
from paperloom.llm.separators import op2_separator_scan
from paperloom.llm.vectors import op5_embedding_near_dups
from paperloom.llm.warc import OP12_SQL, op12_warc_packages
from paperloom.llm.whitening import op13_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_separator_scan, op3_huffman_ids, op4_adaptive_quality, op5_embedding_near_dups, op6_ngram_jaccard, op7_line_dedup, op8_temperature_mixing, op9_language_id, op10_personal_data, op11_phrase_mining, op12_warc_packages, op13_embedding_whitening)
}
ORACLE_SQL = {"op4_adaptive_quality": OP4_SQL, "op7_line_dedup": OP7_SQL, "op8_temperature_mixing": OP8_SQL, "op11_phrase_mining": OP11_SQL, "op12_warc_packages": OP12_SQL}
