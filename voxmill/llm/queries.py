"""The registered queries of this subpackage: name -> function of (spark, sf_dir), and name -> DuckDB SQL."""

from . import decontaminate, phrases, urls
from .align import op12_alignment
from .html import op9_html
from .langid import op6_langid
from .lm import op7_lm
from .neighbours import op3_neighbours
from .packing import op4_packing
from .quantised import op13_near_vectors
from .simhash import op2_simhash
from .store import op10_store
from .substrings import op8_substrings

QUERIES = {
    "op1_urls": urls.op1_urls,
    "op2_simhash": op2_simhash,
    "op3_neighbours": op3_neighbours,
    "op4_packing": op4_packing,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_langid": op6_langid,
    "op7_lm": op7_lm,
    "op8_substrings": op8_substrings,
    "op9_html": op9_html,
    "op10_store": op10_store,
    "op11_phrases": phrases.op11_phrases,
    "op12_alignment": op12_alignment,
    "op13_near_vectors": op13_near_vectors,
}

#: For a query that SQL can express; the others are held against brute force in the tests.
ORACLES = {
    "op1_urls": urls.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op11_phrases": phrases.ORACLE,
}
