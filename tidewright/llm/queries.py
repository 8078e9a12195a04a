"""The queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from .decontamination import SQL_OP6, op6_decontamination
from .hard_negatives import SQL_OP11, op11_hard_negatives
from .jaccard_join import op5_jaccard_join
from .language_id import op10_language_id
from .mixing import SQL_OP2, op2_mixing
from .piece_codec import op12_sentencepiece
from .quality_classifier import op4_quality_classifier
from .quality_rules import SQL_OP8, op8_quality_rules
from .suffix_dedup import op7_suffix_dedup
from .tandem_runs import op13_periodic_runs
from .token_counts import op3_token_counts
from .toxicity import op9_toxicity
from .warc import SQL_OP1, op1_warc

QUERIES = {f.__name__: f for f in (op1_warc, op2_mixing, op3_token_counts, op4_quality_classifier, op5_jaccard_join, op6_decontamination, op7_suffix_dedup, op8_quality_rules, op9_toxicity, op10_language_id, op11_hard_negatives, op12_sentencepiece, op13_periodic_runs)}
SQL = {"op1_warc": SQL_OP1, "op2_mixing": SQL_OP2, "op6_decontamination": SQL_OP6, "op8_quality_rules": SQL_OP8, "op11_hard_negatives": SQL_OP11}
