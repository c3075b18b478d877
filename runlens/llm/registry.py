"""The queries of this subpackage by name."""

from __future__ import annotations

import corpus_pipeline
from runlens.llm.language import op3_language
from runlens.llm.lmscore import op4_lmscore
from runlens.llm.media import op9_media
from runlens.llm.mixing import op8_mixing
from runlens.llm.pieces import op1_pieces
from runlens.llm.quality import op6_quality
from runlens.llm.ring import op7_ring
from runlens.llm.simhash import op5_simhash
from runlens.llm.suffixes import op2_suffixes
from runlens.llm.toxicity import op10_toxicity


def queries():
    return {"pipeline": corpus_pipeline.run, "op1_pieces": op1_pieces, "op2_suffixes": op2_suffixes, "op3_language": op3_language, "op4_lmscore": op4_lmscore, "op5_simhash": op5_simhash, "op6_quality": op6_quality, "op7_ring": op7_ring, "op8_mixing": op8_mixing, "op9_media": op9_media, "op10_toxicity": op10_toxicity}


def oracle_sql():
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
