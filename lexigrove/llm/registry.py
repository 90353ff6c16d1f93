"""The subpackage's queries and their SQL."""

from __future__ import annotations

from .decontaminate import OP9_SQL, op9_benchmark_decontamination
from .golay_simhash import op8_simhash_near_dedup
from .html_extract import op1_html_extract
from .importance_resampling import op6_quality_classifier
from .language_mixture import op7_language_id
from .piece_codec import op3_sentencepiece
from .piecewise_hash import op4_document_fingerprints
from .suffix_dedup import OP5_SQL, op5_suffix_dedup
from .token_store import op10_token_output
from .turn_repair import op11_turn_repair
from .url_filter import OP2_SQL, op2_url_filter
from .vector_codes import OP12_SQL, op12_vector_codes
from .web_archive import OP13_SQL, op13_warc

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_url_filter": op2_url_filter,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_language_id": op7_language_id,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_token_output": op10_token_output,
    "op11_turn_repair": op11_turn_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_warc": op13_warc,
}
SQL = {"op2_url_filter": OP2_SQL, "op5_suffix_dedup": OP5_SQL, "op9_benchmark_decontamination": OP9_SQL, "op12_vector_codes": OP12_SQL, "op13_warc": OP13_SQL}
