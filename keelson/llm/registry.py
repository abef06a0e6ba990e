"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from .decontam import op3_decontam
from .htmltext import op10_html
from .langid import op5_langid
from .packing import op2_packing
from .phrases import OP12_SQL, op12_phrases
from .prefixtrie import OP11_SQL, op11_prefix_trie
from .quality import OP7_SQL, op7_quality
from .signatures import OP8_SQL, op8_jaccard
from .substrings import OP4_SQL, op4_substrings
from .toxicity import op1_toxicity
from .urlfilter import op9_urls
from .variants import OP13_SQL, op13_variants
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_decontam": op3_decontam,
    "op4_substrings": op4_substrings,
    "op5_langid": op5_langid,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_jaccard": op8_jaccard,
    "op9_urls": op9_urls,
    "op10_html": op10_html,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_phrases": op12_phrases,
    "op13_variants": op13_variants,
}
ORACLES = {"op8_jaccard": OP8_SQL, "op4_substrings": OP4_SQL, "op6_warc": OP6_SQL, "op7_quality": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_phrases": OP12_SQL, "op13_variants": OP13_SQL}
