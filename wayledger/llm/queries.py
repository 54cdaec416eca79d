"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bm25 import OP5_DOCUMENTS_SQL, OP5_SQL, op5_bm25, op5_bm25_documents
from .byte_bpe import op13_byte_bpe
from .dual_tree import OP12_SQL, op12_codes
from .gam import op1_quality
from .geometric import OP11_SQL, op11_ranked
from .hmm_lm import op6_hmm
from .jaccard_join import op9_jaccard
from .mixing import OP7_SQL, op7_mixing
from .phrase_index import op2_decontamination
from .pii import op10_pii
from .rlbwt import op4_repeats
from .token_counts import op3_tokens
from .warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_tokens": op3_tokens,
    "op4_repeats": op4_repeats,
    "op5_bm25": op5_bm25,
    "op5_bm25_documents": op5_bm25_documents,
    "op6_hmm": op6_hmm,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_jaccard": op9_jaccard,
    "op10_pii": op10_pii,
    "op11_ranked": op11_ranked,
    "op12_codes": op12_codes,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op5_bm25": OP5_SQL,
    "op5_bm25_documents": OP5_DOCUMENTS_SQL,
    "op7_mixing": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op11_ranked": OP11_SQL,
    "op12_codes": OP12_SQL,
}
