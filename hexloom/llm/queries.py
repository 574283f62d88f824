"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .archives import op2_archive_index
from .decontamination import op5_containment_search
from .jaccard_join import op8_bayesian_jaccard_join
from .language import op10_crf_language
from .lexical import op12_ranked_search
from .licences import op7_license_digests
from .licences import sql as licence_sql
from .lz_dedup import op6_lempel_ziv_dedup
from .oracles import ARCHIVES, BYTE_REPEATS, CONTAINMENT, JACCARD, RANKED, VARIANTS, VECTORS, WORD_REPEATS
from .packing import op1_best_fit_packing
from .sharding import op4_stratified_interleave
from .spelling import op11_spelling_variants
from .suffix_dedup import op9_suffix_array_dedup
from .tokens import op13_token_counts
from .vector_dedup import op3_inverted_multi_index

QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing,
    op2_archive_index,
    op3_inverted_multi_index,
    op4_stratified_interleave,
    op5_containment_search,
    op6_lempel_ziv_dedup,
    op7_license_digests,
    op8_bayesian_jaccard_join,
    op9_suffix_array_dedup,
    op10_crf_language,
    op11_spelling_variants,
    op12_ranked_search,
    op13_token_counts,
)}
SQL = {
    "op2_archive_index": ARCHIVES,
    "op3_inverted_multi_index": VECTORS,
    "op5_containment_search": CONTAINMENT,
    "op6_lempel_ziv_dedup": WORD_REPEATS,
    "op7_license_digests": licence_sql(),
    "op8_bayesian_jaccard_join": JACCARD,
    "op9_suffix_array_dedup": BYTE_REPEATS,
    "op11_spelling_variants": VARIANTS,
    "op12_ranked_search": RANKED,
}
