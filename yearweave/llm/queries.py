"""The registered queries of this subpackage, one per operator, and SQL twins where SQL can say them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from yearweave.llm.decontaminate import op6_decontaminate
from yearweave.llm.embedding_dedup import op8_embedding_dedup
from yearweave.llm.hard_negatives import ORACLE as HARD_NEGATIVES_SQL
from yearweave.llm.hard_negatives import op11_hard_negatives
from yearweave.llm.language_id import op4_language_id
from yearweave.llm.license_scan import op9_license_scan
from yearweave.llm.order_minhash import op10_order_minhash
from yearweave.llm.packing import op5_best_fit_packing
from yearweave.llm.quality import op7_quality
from yearweave.llm.secret_scan import op2_secret_scan
from yearweave.llm.substring_dedup import op3_substring_dedup
from yearweave.llm.token_alignment import op12_token_alignment
from yearweave.llm.token_counts import op13_token_counts
from yearweave.llm.url_filter import ORACLE as URL_FILTER_SQL
from yearweave.llm.url_filter import op1_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_order_minhash": op10_order_minhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_alignment": op12_token_alignment,
    "op13_token_counts": op13_token_counts,
}

ORACLES: dict[str, str] = {"op1_url_filter": URL_FILTER_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL}
