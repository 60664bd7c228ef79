"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .binary import op2
from .fingerprints import op4
from .html import op1
from .kmeans import OP12_SQL, op12
from .langid import op5
from .lattice import op13
from .merkle import OP11_SQL, op11
from .mixing import op9
from .packing import op8
from .quality import op7
from .simhash import op6
from .suffixes import OP3_SQL, op3
from .topk import OP10_SQL, op10

QUERIES = {
    "op1_html": op1,
    "op2_binary": op2,
    "op3_suffixes": op3,
    "op4_fingerprints": op4,
    "op5_langid": op5,
    "op6_simhash": op6,
    "op7_quality": op7,
    "op8_packing": op8,
    "op9_mixing": op9,
    "op10_topk": op10,
    "op11_merkle": op11,
    "op12_clusters": op12,
    "op13_lattice": op13,
}
ORACLE: dict[str, str] = {"op3_suffixes": OP3_SQL, "op10_topk": OP10_SQL, "op11_merkle": OP11_SQL, "op12_clusters": OP12_SQL}
