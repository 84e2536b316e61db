"""The registered queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pixelweave.llm import chat, shards, warc
from pixelweave.llm.byte_bpe import op9_byte_bpe
from pixelweave.llm.cover_tree import op2_embedding_dedup
from pixelweave.llm.exponion import op12_clusters
from pixelweave.llm.fingerprints import op10_fingerprints
from pixelweave.llm.language_id import op5_language_id
from pixelweave.llm.lm_score import op4_lm_score
from pixelweave.llm.mixing import op6_mixing
from pixelweave.llm.near_dup import op8_near_dup
from pixelweave.llm.token_output import op3_token_output
from pixelweave.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (chat.op1_chat, op2_embedding_dedup, op3_token_output, op4_lm_score, op5_language_id, op6_mixing, shards.op7_sharding, op8_near_dup, op9_byte_bpe, op10_fingerprints, op11_whitening, op12_clusters, warc.op13_warc)}

ORACLES: dict[str, str] = {"op1_chat": chat.OP1_SQL, "op7_sharding": shards.OP7_SQL, "op13_warc": warc.OP13_SQL}
