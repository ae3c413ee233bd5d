"""The registered queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from .chat import op8_chat_formatting
from .decontamination import op5_benchmark_decontamination
from .html import op6_html_extraction
from .packing import op7_best_fit_packing
from .pii import op3_semi_crf_pii
from .ppm import op1_ppm_scores
from .quality import op4_quality_rules
from .records import op9_token_records
from .sharding import op2_bfd_sharding
from .simhash import op10_simhash_near_dedup
from .spelling import SQL as SPELLING_SQL
from .spelling import op13_spelling_variants
from .timers import SQL as TIMERS_SQL
from .timers import op12_valid_time_sales
from .vantage import SQL as VANTAGE_SQL
from .vantage import op11_vantage_neighbours

QUERIES = {f.__name__: f for f in (op1_ppm_scores, op2_bfd_sharding, op3_semi_crf_pii, op4_quality_rules, op5_benchmark_decontamination, op6_html_extraction, op7_best_fit_packing, op8_chat_formatting, op9_token_records, op10_simhash_near_dedup, op11_vantage_neighbours, op12_valid_time_sales, op13_spelling_variants)}
#: Operators whose rows SQL can express.
ORACLE_SQL: dict[str, str] = {"op11_vantage_neighbours": VANTAGE_SQL, "op12_valid_time_sales": TIMERS_SQL, "op13_spelling_variants": SPELLING_SQL}
