"""The queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from .decontamination import op5_decontamination
from .embedding_dedup import op10_embedding_dedup
from .language_id import op6_language_id
from .license_scan import OP4_SQL, op4_license_scan
from .packing import op7_best_fit_packing
from .sharding import op8_sharding
from .simhash import op3_simhash
from .token_counts import op2_token_counts
from .token_output import op1_token_output
from .url_filters import OP9_SQL, op9_url_filters

QUERIES = {f.__name__: f for f in (op1_token_output, op2_token_counts, op3_simhash, op4_license_scan, op5_decontamination, op6_language_id, op7_best_fit_packing, op8_sharding, op9_url_filters, op10_embedding_dedup)}
SQL = {"op4_license_scan": OP4_SQL, "op9_url_filters": OP9_SQL}
