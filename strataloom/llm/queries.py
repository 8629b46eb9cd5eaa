"""The numbered queries of this subpackage, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from strataloom.llm.best_fit_packing import op13_best_fit_packing
from strataloom.llm.langid_centroid import op9_langid
from strataloom.llm.license_compress import op8_license
from strataloom.llm.minmax_dedup import op7_minmax_dedup
from strataloom.llm.mixing import op3_mixing
from strataloom.llm.phrase_automata import OP11_SQL, op11_phrase_automata
from strataloom.llm.pii_crf import op10_pii
from strataloom.llm.periodic_runs import op12_periodic_runs
from strataloom.llm.prefix_fingerprint import op6_prefix_fingerprint
from strataloom.llm.quality_lines import OP4_SQL, op4_line_quality
from strataloom.llm.sentencepiece_lattice import op1_sentencepiece
from strataloom.llm.toxicity_fm import op5_toxicity
from strataloom.llm.warc_zstd import OP2_SQL, op2_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_line_quality": op4_line_quality,
    "op5_toxicity": op5_toxicity,
    "op6_prefix_fingerprint": op6_prefix_fingerprint,
    "op7_minmax_dedup": op7_minmax_dedup,
    "op8_license": op8_license,
    "op9_langid": op9_langid,
    "op10_pii": op10_pii,
    "op11_phrase_automata": op11_phrase_automata,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_best_fit_packing": op13_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op4_line_quality": OP4_SQL, "op11_phrase_automata": OP11_SQL}
