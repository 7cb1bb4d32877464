"""The registered queries of this subpackage; only the filter audit has an SQL form (see each module)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import filters
from tidemark.llm.bpe import op13_bpe
from tidemark.llm.conversations import op11_conversations
from tidemark.llm.decontam import op10_decontamination
from tidemark.llm.filters import op12_filter_audit
from tidemark.llm.gif import op1_gif
from tidemark.llm.html import op5_html
from tidemark.llm.langid import op3_langid
from tidemark.llm.lattice import op9_lattice_lm
from tidemark.llm.licenses import op2_license_scan
from tidemark.llm.packing import op8_packing
from tidemark.llm.pii import op7_pii
from tidemark.llm.quality import op4_quality
from tidemark.llm.simhash import op6_simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_gif": op1_gif,
        "op2_license_scan": op2_license_scan,
        "op3_langid": op3_langid,
        "op4_quality": op4_quality,
        "op5_html": op5_html,
        "op6_simhash": op6_simhash,
        "op7_pii": op7_pii,
        "op8_packing": op8_packing,
        "op9_lattice_lm": op9_lattice_lm,
        "op10_decontamination": op10_decontamination,
        "op11_conversations": op11_conversations,
        "op12_filter_audit": op12_filter_audit,
        "op13_bpe": op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_audit": filters.ORACLE_SQL}
