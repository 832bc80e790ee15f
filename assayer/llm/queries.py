"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat_format
from .leaks import op6_decontaminate
from .mixing import op4_mix_sources
from .neardup import op5_near_duplicates
from .neighbours import op9_nearest
from .quality import op1_quality
from .repeats import op7_repeats
from .tokens import op2_token_counts
from .toxicity import op10_toxicity
from .urls import OP3_SQL, op3_url_filter

QUERIES = {f.__name__: f for f in (op1_quality, op2_token_counts, op3_url_filter, op4_mix_sources, op5_near_duplicates, op6_decontaminate, op7_repeats, op8_chat_format, op9_nearest, op10_toxicity)}
SQL = {"op3_url_filter": OP3_SQL, "op8_chat_format": OP8_SQL}
