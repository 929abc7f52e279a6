"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from lumenrank.llm import bpe, collocations, decontaminate, exact_dedup, line_dedup, near_dup, packing, pii, quality, secrets, sharding, spelling, suffix_tree

QUERIES: dict[str, Callable] = {
    "op1_suffix_tree": suffix_tree.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_quality": quality.op4,
    "op5_sharding": sharding.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_pii": pii.op7,
    "op8_near_dup": near_dup.op8,
    "op9_secrets": secrets.op9,
    "op10_decontaminate": decontaminate.op10,
    "op11_collocations": collocations.op11,
    "op12_spelling_variants": spelling.op12,
    "op13_best_fit_packing": packing.op13,
}

SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
}
