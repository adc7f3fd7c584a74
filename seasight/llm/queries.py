"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from seasight.llm.ann import op4_nn_descent
from seasight.llm.bpe import op8_bpe
from seasight.llm.centroids import OP11_SQL, op11_centroids
from seasight.llm.chat import OP5_SQL, op5_chat_format
from seasight.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from seasight.llm.html import op9_html
from seasight.llm.langid import op3_language_id
from seasight.llm.licenses import op2_license_scan
from seasight.llm.merkle import OP13_SQL, op13_merkle
from seasight.llm.mixing import OP10_SQL, op10_mixing
from seasight.llm.pii import op7_pii
from seasight.llm.simhash import op1_simhash
from seasight.llm.urls import OP12_SQL, op12_url_filters

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_nn_descent": op4_nn_descent,
    "op5_chat_format": op5_chat_format,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pii": op7_pii,
    "op8_bpe": op8_bpe,
    "op9_html": op9_html,
    "op10_mixing": op10_mixing,
    "op11_centroids": op11_centroids,
    "op12_url_filters": op12_url_filters,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL = {"op5_chat_format": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op10_mixing": OP10_SQL, "op11_centroids": OP11_SQL, "op12_url_filters": OP12_SQL, "op13_merkle": OP13_SQL}
