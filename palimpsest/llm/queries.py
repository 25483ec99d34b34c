"""The corpus operators' queries, by the names under which they are registered."""

from __future__ import annotations

from palimpsest.llm.archive import OP9_SQL, op9_warc
from palimpsest.llm.language import op5_language_id
from palimpsest.llm.line_dedup import OP1_SQL, op1_line_dedup
from palimpsest.llm.mixing import OP4_SQL, op4_mixing
from palimpsest.llm.near_dedup import OP8_SQL, op8_near_dedup
from palimpsest.llm.packing import op10_packing
from palimpsest.llm.search import OP3_SQL, op3_search
from palimpsest.llm.secrets import OP7_SQL, op7_secret_scan
from palimpsest.llm.token_files import op6_token_files
from palimpsest.llm.vector_join import OP2_SQL, op2_vector_dedup

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_vector_dedup": op2_vector_dedup,
    "op3_search": op3_search,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_token_files": op6_token_files,
    "op7_secret_scan": op7_secret_scan,
    "op8_near_dedup": op8_near_dedup,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_vector_dedup": OP2_SQL,
    "op3_search": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op7_secret_scan": OP7_SQL,
    "op8_near_dedup": OP8_SQL,
    "op9_warc": OP9_SQL,
}
