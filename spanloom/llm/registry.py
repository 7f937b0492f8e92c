"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op6_ann
from .byte_bpe import op10_byte_bpe
from .circulant import OP13_SQL, op13_circulant
from .divergence import OP12_SQL, op12_divergence
from .line_dedup import OP4_SQL, op4_line_dedup
from .mixing import OP2_SQL, op2_mixing
from .mtree import OP7_SQL, op7_mtree
from .quality import op1_quality
from .secrets import op9_secrets
from .simhash import op8_simhash
from .spelling import OP11_SQL, op11_spelling
from .token_store import op3_token_store
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_token_store": op3_token_store,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_ann": op6_ann,
    "op7_mtree": op7_mtree,
    "op8_simhash": op8_simhash,
    "op9_secrets": op9_secrets,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_spelling": op11_spelling,
    "op12_divergence": op12_divergence,
    "op13_circulant": op13_circulant,
}
ORACLE_SQL = {
    "op2_mixing": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op7_mtree": OP7_SQL,
    "op11_spelling": OP11_SQL,
    "op12_divergence": OP12_SQL,
    "op13_circulant": OP13_SQL,
}
