"""The numbered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe_chunks import op10_bpe_chunks
from .bucket_digest import op2_bucket_digest
from .chat_format import OP3_SQL, op3_chat_format
from .cover_anchors import op6_cover_anchors
from .gram_scan import OP11_SQL, op11_gram_scan
from .line_variants import op7_line_variants
from .nn_descent import op1_nn_descent
from .repair_shards import op8_repair_shards
from .scalar_tables import OP13_SQL, op13_scalar_tables
from .set_sketch import op9_set_sketch
from .string_kernel import op4_string_kernel
from .survival_words import OP12_SQL, op12_survival_words
from .tier_packing import op5_tier_packing

QUERIES = {
    "op1_nn_descent": op1_nn_descent,
    "op2_bucket_digest": op2_bucket_digest,
    "op3_chat_format": op3_chat_format,
    "op4_string_kernel": op4_string_kernel,
    "op5_tier_packing": op5_tier_packing,
    "op6_cover_anchors": op6_cover_anchors,
    "op7_line_variants": op7_line_variants,
    "op8_repair_shards": op8_repair_shards,
    "op9_set_sketch": op9_set_sketch,
    "op10_bpe_chunks": op10_bpe_chunks,
    "op11_gram_scan": op11_gram_scan,
    "op12_survival_words": op12_survival_words,
    "op13_scalar_tables": op13_scalar_tables,
}

SQL = {
    "op3_chat_format": OP3_SQL,
    "op11_gram_scan": OP11_SQL,
    "op12_survival_words": OP12_SQL,
    "op13_scalar_tables": OP13_SQL,
}
