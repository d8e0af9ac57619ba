"""Queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tallyzone.llm.archive import op12_warc_archive
from tallyzone.llm.conversations import op13_conversation_repair
from tallyzone.llm.decontaminate import op3_benchmark_decontamination
from tallyzone.llm.fingerprints import op9_document_fingerprints
from tallyzone.llm.hmm import op8_lm_scoring
from tallyzone.llm.langid import op7_language_id
from tallyzone.llm.mainmatter import op6_html_extraction
from tallyzone.llm.packing import op2_best_fit_packing
from tallyzone.llm.quality import op5_quality_classifier
from tallyzone.llm.secrets import op1_secret_scans
from tallyzone.llm.simhash import op10_simhash_neardup
from tallyzone.llm.substrings import op4_substring_dedup
from tallyzone.llm.whitening import op11_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_secret_scans": op1_secret_scans,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_html_extraction": op6_html_extraction,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_simhash_neardup": op10_simhash_neardup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_warc_archive": op12_warc_archive,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {}
