"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tracewell.llm import pipeline, sql
from tracewell.llm.bpe import op5_bpe
from tracewell.llm.decontamination import op6_decontamination
from tracewell.llm.hard_negatives import op13_hard_negatives
from tracewell.llm.html_text import op12_html_text
from tracewell.llm.near_dedup import op1_near_dedup
from tracewell.llm.quality_classifier import op3_quality_classifier
from tracewell.llm.quality_rules import op8_quality_rules
from tracewell.llm.secrets import op2_secret_scan
from tracewell.llm.sharding import op10_rendezvous
from tracewell.llm.suffix_array import op9_suffix_array_dedup
from tracewell.llm.super_kmers import op4_substring_dedup
from tracewell.llm.vector_codes import op11_vector_codes
from tracewell.llm.warc import op7_warc

_OPERATORS = (
    op1_near_dedup,
    op2_secret_scan,
    op3_quality_classifier,
    op4_substring_dedup,
    op5_bpe,
    op6_decontamination,
    op7_warc,
    op8_quality_rules,
    op9_suffix_array_dedup,
    op10_rendezvous,
    op11_vector_codes,
    op12_html_text,
    op13_hard_negatives,
)


def queries():
    return {**{f.__name__: f for f in _OPERATORS}, "pipeline": pipeline.run}


def oracle_sql():
    return dict(sql.ORACLES)
