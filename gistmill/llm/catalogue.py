"""The corpus queries, opN_<name>, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gistmill.llm.decontaminate import OP2_SQL, op2_decontaminate
from gistmill.llm.langid import op10_langid
from gistmill.llm.perspectives import OP8_SQL, op8_perspectives
from gistmill.llm.pieces import op6_pieces
from gistmill.llm.quality import op7_quality
from gistmill.llm.secrets import op9_secrets
from gistmill.llm.sharding import OP3_SQL, op3_sharding
from gistmill.llm.simhash import op1_simhash
from gistmill.llm.tiff import op4_tiff
from gistmill.llm.warc import OP5_SQL, op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_simhash": op1_simhash, "op2_decontaminate": op2_decontaminate, "op3_sharding": op3_sharding, "op4_tiff": op4_tiff, "op5_warc": op5_warc,
        "op6_pieces": op6_pieces, "op7_quality": op7_quality, "op8_perspectives": op8_perspectives, "op9_secrets": op9_secrets, "op10_langid": op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op3_sharding": OP3_SQL, "op5_warc": OP5_SQL, "op8_perspectives": OP8_SQL}
