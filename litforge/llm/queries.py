"""The registered queries of this package, and their SQL where SQL can express them."""

from litforge.llm.op1_mix import OP1_SQL, op1_mix
from litforge.llm.op2_suffix_dedup import op2_suffix_dedup
from litforge.llm.op3_decontaminate import op3_decontaminate
from litforge.llm.op4_language_id import op4_language_id
from litforge.llm.op5_jaccard_join import op5_jaccard_join
from litforge.llm.op6_secret_scan import op6_secret_scan
from litforge.llm.op7_quality import op7_quality
from litforge.llm.op8_top_k import OP8_SQL, op8_top_k
from litforge.llm.op9_token_counts import op9_token_counts
from litforge.llm.op10_license_scan import OP10_SQL, op10_license_scan
from litforge.llm.op11_setsketch import OP11_SQL, op11_setsketch
from litforge.llm.op12_ranked_search import OP12_SQL, op12_ranked_search
from litforge.llm.op13_dominance import OP13_SQL, op13_dominance

QUERIES = {f.__name__: f for f in (op1_mix, op2_suffix_dedup, op3_decontaminate, op4_language_id, op5_jaccard_join, op6_secret_scan, op7_quality, op8_top_k, op9_token_counts, op10_license_scan, op11_setsketch, op12_ranked_search, op13_dominance)}
ORACLES: dict[str, str] = {"op1_mix": OP1_SQL, "op8_top_k": OP8_SQL, "op10_license_scan": OP10_SQL, "op11_setsketch": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_dominance": OP13_SQL}
