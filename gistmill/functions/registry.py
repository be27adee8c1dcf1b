"""SQL names for the exact operators: Arrow UDFs and a table function, none of which raises.

After ``register(spark)``:

* ``distill_block(text, family)`` gives struct(out, pass, changed);
* ``classify_block(text)`` gives the kind; ``wire_format(body)`` the wire format;
* ``explode_blocks(body)`` is a lateral table function: turn, block_ix, item_ix, role, is_user, text, byte_start, byte_len.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gistmill import schema as S
from gistmill.functions import bodies as B
from gistmill.functions import exact as E

_BLOCK = "turn int, block_ix int, item_ix int, role string, is_user boolean, text string, byte_start int, byte_len int"


def distill_block(text: pd.Series, family: pd.Series) -> pd.DataFrame:
    rows = []
    for t, f in zip(text, family):
        out, how = E.distill(t, f if f in S.FAMILIES else "generic") if t is not None else (None, "none")
        rows.append((out, how, out != t))
    return pd.DataFrame(rows, columns=["out", "pass", "changed"])


def classify_block(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else E.classify(t))


def wire_format(body: pd.Series) -> pd.Series:
    return body.map(B.detect)


class ExplodeBlocks:
    def eval(self, body: str) -> Iterator[tuple]:
        for b in B.exploded(body):
            yield b["turn"], b["block_ix"], b["item_ix"], b["role"], b["is_user"], b["text"], b["byte_start"], b["byte_len"]


def register(spark: SparkSession) -> None:
    """Types are parsed by a session, so the functions are wrapped here and not where workers import them."""
    for f, kind in ((distill_block, "out string, pass string, changed boolean"), (classify_block, "string"), (wire_format, "string")):
        spark.udf.register(f.__name__, F.pandas_udf(f, kind))
    spark.udtf.register("explode_blocks", F.udtf(ExplodeBlocks, returnType=_BLOCK))
