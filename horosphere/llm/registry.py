"""The queries of this subpackage by name, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from horosphere.llm.ann import op1_ann
from horosphere.llm.bpe import op3_bpe
from horosphere.llm.html import op2_html
from horosphere.llm.lm import OP5_SQL, op5_lm
from horosphere.llm.neardup import op8_neardup
from horosphere.llm.ogg import op4_ogg
from horosphere.llm.packing import op9_packing
from horosphere.llm.simple8b import op6_simple8b
from horosphere.llm.toxicity import op7_toxicity
from horosphere.llm.substrings import op10_suffix


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"op1_ann": op1_ann, "op2_html": op2_html, "op3_bpe": op3_bpe, "op4_ogg": op4_ogg, "op5_lm": op5_lm, "op6_simple8b": op6_simple8b, "op7_toxicity": op7_toxicity, "op8_neardup": op8_neardup, "op9_packing": op9_packing, "op10_suffix": op10_suffix, "pipeline": pipeline}


def oracle_sql() -> dict:
    return {"op5_lm": OP5_SQL}
