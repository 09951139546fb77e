"""The training-data operators' queries, and SQL where there is any."""

from __future__ import annotations

from . import op1_pii, op2_decontamination, op3_token_frames, op4_token_counts, op5_embedding_dedup, op6_language_id, op7_simhash_dedup, op8_quality, op9_line_dedup, op10_bpe_codec

_MODULES = (op1_pii, op2_decontamination, op3_token_frames, op4_token_counts, op5_embedding_dedup, op6_language_id, op7_simhash_dedup, op8_quality, op9_line_dedup, op10_bpe_codec)


def queries() -> dict:
    """Each operator over its table; ``planted_vectors`` runs operator 5 over vectors that have near copies at every scale."""
    return {name: getattr(m, name) for m in _MODULES for name in [m.__name__.rpartition(".")[2]]} | {"planted_vectors": op5_embedding_dedup.planted_vectors}


def oracle_sql() -> dict[str, str]:
    return {m.__name__.rpartition(".")[2]: m.SQL for m in _MODULES if getattr(m, "SQL", None)} | {"planted_vectors": op5_embedding_dedup.PLANTED_SQL}
