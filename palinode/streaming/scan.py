"""The passes and the audit log on streams."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palinode.operators.audit import FIELDS, records
from palinode.operators.pipeline import Normalizer
from palinode.sources.corpus import append_lines


def audit_stream(texts: DataFrame, normalizer: Normalizer, path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Analyze a stream of texts and append its audit records to a folder. No state is kept: each row stands for itself."""
    made = records(normalizer.analyze(texts, text), text)

    def write(batch: DataFrame, number: int) -> None:
        append_lines(batch, path)

    return made.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chain_stream(audited: DataFrame, key: bytes, by: str, order: str) -> DataFrame:
    """``by``, ``order``, ``prev_hmac``, ``signature`` of a stream of records, chained within ``by``; the state is the last signature of each chain.

    Records are taken in ``order`` within a batch; one that arrives in a later batch than its successors is chained after them.
    """
    head = F.to_json(F.struct(*[f for f in FIELDS if f not in ("prev_hmac", "signature")]), {"ignoreNullFields": "false"})
    kinds = dict(audited.dtypes)
    schema = f"{by} {kinds[by]}, {order} {kinds[order]}, prev_hmac string, signature string"

    def walk(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for text, place in sorted(((t, o) for pdf in frames for t, o in zip(pdf["head"], pdf[order], strict=True)), key=lambda x: x[1]):
            message = f'{text[:-1]},"prev_hmac":{json.dumps(last)},"signature":null}}'
            signed = hmac.new(key, message.encode(), hashlib.sha256).hexdigest()
            rows.append((group[0], place, last, signed))
            last = signed
        state.update((last,))
        yield pd.DataFrame(rows, columns=[by, order, "prev_hmac", "signature"])

    slim = audited.select(by, order, head.alias("head"))
    return slim.groupBy(by).applyInPandasWithState(walk, schema, "last string", "append", GroupStateTimeout.NoTimeout)
