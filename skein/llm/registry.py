"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP7_SQL, op7_decontaminate
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .line_dedup import OP2_SQL, op2_line_dedup
from .mixing import op6_mixing
from .quality_crf import op3_quality
from .recurrent_lm import op9_lm_scoring
from .simhash import op1_simhash_near_dedup
from .toxicity import op10_toxicity
from .url_filter import OP5_SQL, op5_url_filter
from .warc import OP8_SQL, op8_warc


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality": op3_quality,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_mixing": op6_mixing,
        "op7_decontaminate": op7_decontaminate,
        "op8_warc": op8_warc,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_url_filter": OP5_SQL, "op7_decontaminate": OP7_SQL, "op8_warc": OP8_SQL}
