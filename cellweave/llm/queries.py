"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op9_bpe
from .chat import OP4_SQL, op4_chat_formatting
from .decontaminate import op6_decontamination
from .embeddings import OP1_SQL, op1_embedding_dedup
from .extract import op11_html_extraction
from .language import op10_language_id
from .minhash import OP8_SQL, op8_minhash_dedup
from .negatives import OP12_SQL, op12_hard_negatives
from .quality import op3_quality
from .repair import op13_conversation_repair
from .secret_scan import op7_secret_scans
from .sharding import op2_sharding
from .token_counts import op5_token_counts

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_sharding": op2_sharding,
    "op3_quality": op3_quality,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scans": op7_secret_scans,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_bpe": op9_bpe,
    "op10_language_id": op10_language_id,
    "op11_html_extraction": op11_html_extraction,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {"op1_embedding_dedup": OP1_SQL, "op4_chat_formatting": OP4_SQL, "op8_minhash_dedup": OP8_SQL, "op12_hard_negatives": OP12_SQL}
