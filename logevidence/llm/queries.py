"""The queries of this subpackage for ``__spark_entry__.py`` and the SQL they are checked against."""

from __future__ import annotations

from .codes import OP12_SQL, op12_codes
from .decontaminate import op9_decontamination
from .jaccard import op10_jaccard_join
from .langid import op8_language_id
from .licences import OP6_SQL, op6_licences
from .maintext import op13_maintext
from .neighbours import op1_neighbours
from .packing import op2_packing
from .privacy import op7_privacy
from .quality import op5_quality
from .suffixes import op4_repeats
from .toxicity import op3_toxicity
from .whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_neighbours, op2_packing, op3_toxicity, op4_repeats, op5_quality, op6_licences, op7_privacy, op8_language_id, op9_decontamination,
        op10_jaccard_join, op11_whitening, op12_codes, op13_maintext,
    )
}
ORACLE: dict[str, str] = {"op6_licences": OP6_SQL, "op12_codes": OP12_SQL}
