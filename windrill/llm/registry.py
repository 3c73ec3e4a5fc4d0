"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .decontam import op5_decontaminate
from .html_main import op1_main_text
from .jaccard import OP3_SQL, op3_jaccard
from .langid import op10_language_id
from .ogg import op4_ogg
from .piece import op6_pieces
from .pii import op7_pii
from .token_file import op2_token_files
from .toxicity import op9_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_token_files": op2_token_files,
    "op3_jaccard": op3_jaccard,
    "op4_ogg": op4_ogg,
    "op5_decontaminate": op5_decontaminate,
    "op6_pieces": op6_pieces,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {"op3_jaccard": OP3_SQL, "op8_warc": OP8_SQL}
