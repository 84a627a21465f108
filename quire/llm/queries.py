"""The registered queries of the operators."""

from __future__ import annotations

from quire.llm.alignment import op12_alignment
from quire.llm.fingerprints import op2_fingerprints
from quire.llm.language import op3_language
from quire.llm.licenses import op8_licenses
from quire.llm.manifest import op13_manifest
from quire.llm.media import op9_media
from quire.llm.mixing import op4_mixing
from quire.llm.packing import op7_packing
from quire.llm.sharding import op5_sharding
from quire.llm.simhash import op10_simhash
from quire.llm.sql import OP2, OP5, OP11, OP13
from quire.llm.substrings import op6_substrings
from quire.llm.topk import op11_topk
from quire.llm.toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_fingerprints, op3_language, op4_mixing, op5_sharding, op6_substrings, op7_packing, op8_licenses, op9_media, op10_simhash, op11_topk, op12_alignment, op13_manifest)}
#: The others learn, search or decode, which SQL can't tell; tests/llm holds them against brute force.
ORACLE = {"op2_fingerprints": OP2, "op5_sharding": OP5, "op11_topk": OP11, "op13_manifest": OP13}
