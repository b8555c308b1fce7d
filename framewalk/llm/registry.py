"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from framewalk.llm.decontamination import op5_decontamination
from framewalk.llm.html_text import op1_html_text
from framewalk.llm.line_dedup import OP8_SQL, op8_line_dedup
from framewalk.llm.merkle import OP12_SQL, op12_merkle_manifest
from framewalk.llm.quality_classifier import op9_quality_classifier
from framewalk.llm.quality_rules import OP10_SQL, op10_quality_rules
from framewalk.llm.resampling import OP13_SQL, op13_resampling
from framewalk.llm.sentencepiece_bpe import op6_sentencepiece
from framewalk.llm.sharding import op4_sharding
from framewalk.llm.simhash import op3_simhash
from framewalk.llm.toxicity import op2_toxicity
from framewalk.llm.url_filter import OP7_SQL, op7_url_filter
from framewalk.llm.warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_warc": op11_warc,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL = {"op7_url_filter": OP7_SQL, "op8_line_dedup": OP8_SQL, "op10_quality_rules": OP10_SQL, "op11_warc": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_resampling": OP13_SQL}
