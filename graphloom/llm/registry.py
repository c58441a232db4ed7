"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from . import op1_nearest as op1
from . import op10_passages as op10
from . import op11_trie as op11
from . import op12_align as op12
from . import op13_extract as op13
from . import op2_jaccard as op2
from . import op4_pieces as op4
from . import op3_tokens as op3
from . import op5_fixity as op5
from . import op6_language as op6
from . import op7_private as op7
from . import op8_lines as op8
from . import op9_decontaminate as op9

QUERIES = {
    "op1_nearest": op1.op1_nearest,
    "op2_jaccard": op2.op2_jaccard,
    "op3_tokens": op3.op3_tokens,
    "op4_pieces": op4.op4_pieces,
    "op5_fixity": op5.op5_fixity,
    "op6_language": op6.op6_language,
    "op7_private": op7.op7_private,
    "op8_lines": op8.op8_lines,
    "op9_decontaminate": op9.op9_decontaminate,
    "op10_passages": op10.op10_passages,
    "op11_trie": op11.op11_trie,
    "op12_align": op12.op12_align,
    "op13_extract": op13.op13_extract,
}

SQL = {
    "op2_jaccard": op2.SQL,
    "op5_fixity": op5.SQL,
    "op9_decontaminate": op9.SQL,
    "op11_trie": op11.SQL,
}
