"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import conversations, near_duplicates, resampling, warc
from .bpe import op1_bpe
from .conversations import op12_conversation_repair
from .media import op7_media
from .near_duplicates import op8_near_duplicates
from .packing import op5_packing
from .pieces import op13_sentencepiece
from .quality_classifier import op3_quality_classifier
from .quality_rules import op9_quality_rules
from .resampling import op11_importance_resampling
from .simple8b import op6_token_ids
from .url_filter import op10_url_filter
from .warc import op4_warc
from .wordpiece import op2_token_counts


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_bpe, op2_token_counts, op3_quality_classifier, op4_warc, op5_packing, op6_token_ids, op7_media, op8_near_duplicates, op9_quality_rules, op10_url_filter,
            op11_importance_resampling, op12_conversation_repair, op13_sentencepiece,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE_SQL, "op8_near_duplicates": near_duplicates.ORACLE_SQL, "op11_importance_resampling": resampling.ORACLE_SQL, "op12_conversation_repair": conversations.ORACLE_SQL}
