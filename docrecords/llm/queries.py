"""The registered queries of these operators; SQL where it can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from docrecords.llm.chat_format import op6_chat_format
from docrecords.llm.filter_audit import ORACLE_SQL as AUDIT_SQL
from docrecords.llm.filter_audit import op12_filter_audit
from docrecords.llm.language_hd import op2_language
from docrecords.llm.lexical_search import ORACLE_SQL as SEARCH_SQL
from docrecords.llm.lexical_search import op11_lexical_search
from docrecords.llm.lz_fingerprint import op4_lz_fingerprint
from docrecords.llm.mixing import op9_mixing
from docrecords.llm.pii import op5_pii
from docrecords.llm.quality_fm import op3_quality_fm
from docrecords.llm.quality_rules import op8_quality_rules
from docrecords.llm.repeats import op7_suffix_repeats
from docrecords.llm.sentencepiece_stream import op1_sentencepiece
from docrecords.llm.simhash import op10_simhash
from docrecords.llm.warc import ORACLE_SQL as WARC_SQL
from docrecords.llm.warc import op13_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language": op2_language,
    "op3_quality_fm": op3_quality_fm,
    "op4_lz_fingerprint": op4_lz_fingerprint,
    "op5_pii": op5_pii,
    "op6_chat_format": op6_chat_format,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_lexical_search": op11_lexical_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_warc": op13_warc,
    "pipeline": corpus_pipeline.run,
}

#: hashes, fitted models, fingerprints and a tokenizer have no SQL form; their tests compare with brute force
SQL: dict[str, str] = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
SQL |= {"op11_lexical_search": SEARCH_SQL, "op12_filter_audit": AUDIT_SQL, "op13_warc": WARC_SQL}
