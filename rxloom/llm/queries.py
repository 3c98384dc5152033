"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from rxloom.llm.chat_format import OP4_SQL, op4_chat_format
from rxloom.llm.decontamination import op8_decontamination
from rxloom.llm.embedding_dedup import op9_embedding_dedup
from rxloom.llm.html_extraction import op11_html_extraction
from rxloom.llm.merkle_manifest import OP12_SQL, op12_merkle_manifest
from rxloom.llm.periodic_runs import op13_periodic_runs
from rxloom.llm.quality_classifier import op6_quality_classifier
from rxloom.llm.secret_scan import OP3_SQL, op3_secret_scan
from rxloom.llm.simhash_dedup import op5_simhash_dedup
from rxloom.llm.source_mixing import OP10_SQL, op10_source_mixing
from rxloom.llm.suffix_dedup import op1_suffix_dedup
from rxloom.llm.token_counts import op2_token_counts
from rxloom.llm.url_filter import op7_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scan": op3_secret_scan,
    "op4_chat_format": op4_chat_format,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_url_filter": op7_url_filter,
    "op8_decontamination": op8_decontamination,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_html_extraction": op11_html_extraction,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": OP3_SQL,
    "op4_chat_format": OP4_SQL,
    "op10_source_mixing": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
