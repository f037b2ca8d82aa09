"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tripspark.llm.op1_substring import OP1_SQL, op1_substring
from tripspark.llm.op2_winnowing import op2_winnowing
from tripspark.llm.op3_token_files import op3_token_files
from tripspark.llm.op4_simhash import op4_simhash
from tripspark.llm.op5_toxicity import op5_toxicity
from tripspark.llm.op6_license import op6_license, op6_sql
from tripspark.llm.op7_decontaminate import OP7_SQL, op7_decontaminate
from tripspark.llm.op8_quality import op8_quality
from tripspark.llm.op9_counts import op9_counts
from tripspark.llm.op10_bpe import op10_bpe
from tripspark.llm.op11_runs import op11_runs
from tripspark.llm.op12_exact import OP12_SQL, op12_exact
from tripspark.llm.op13_collocations import OP13_SQL, op13_collocations

QUERIES = {
    "op1_substring": op1_substring,
    "op2_winnowing": op2_winnowing,
    "op3_token_files": op3_token_files,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_license": op6_license,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_counts": op9_counts,
    "op10_bpe": op10_bpe,
    "op11_runs": op11_runs,
    "op12_exact": op12_exact,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {"op1_substring": OP1_SQL, "op6_license": op6_sql(), "op7_decontaminate": OP7_SQL, "op12_exact": OP12_SQL, "op13_collocations": OP13_SQL}
