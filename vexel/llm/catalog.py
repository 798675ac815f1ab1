"""Queries of this subpackage for the entry module, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op8_knn as knn
from .op1_lm import op1_lm
from .op2_bpe import op2_bpe
from .op3_media import op3_media
from .op4_packing import op4_packing
from .op5_quality import op5_quality
from .op6_toxicity import op6_toxicity
from .op7_simhash import op7_simhash
from .op9_lines import op9_lines
from .op10_secrets import op10_secrets

QUERIES = {f.__name__: f for f in (op1_lm, op2_bpe, op3_media, op4_packing, op5_quality, op6_toxicity, op7_simhash, knn.op8_knn, op9_lines, op10_secrets)}

ORACLE_SQL = {"op8_knn": knn.ORACLE}
