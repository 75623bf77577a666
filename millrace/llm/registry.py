"""The package's queries and their SQL."""

from __future__ import annotations

from millrace.llm.byte_bpe import op5_byte_bpe
from millrace.llm.decontamination import OP2_SQL, op2_decontamination
from millrace.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from millrace.llm.licenses import op4_licenses
from millrace.llm.mixing import op12_mix_sources
from millrace.llm.near_duplicates import op3_near_duplicates
from millrace.llm.pseudonyms import op7_pseudonyms
from millrace.llm.quality import op6_quality
from millrace.llm.sharding import op1_shard_by_bytes
from millrace.llm.token_store import op10_token_store
from millrace.llm.top_k import OP9_SQL, op9_top_k
from millrace.llm.url_filter import OP8_SQL, op8_url_filter
from millrace.llm.whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_shard_by_bytes, op2_decontamination, op3_near_duplicates, op4_licenses, op5_byte_bpe, op6_quality,
        op7_pseudonyms, op8_url_filter, op9_top_k, op10_token_store, op11_whitening, op12_mix_sources,
        op13_fill_in_middle,
    )
}
ORACLE_SQL = {"op2_decontamination": OP2_SQL, "op8_url_filter": OP8_SQL, "op9_top_k": OP9_SQL, "op13_fill_in_middle": OP13_SQL}
