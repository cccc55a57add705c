"""Translation as a hook: a function from texts to texts, called in batches, tried again, with the text itself as the fallback.

The hook may call a service or a model; here it is any function ``list[str] -> list[str | None]`` that workers can import.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

Translator = Callable[[list[str]], Sequence[str | None]]
#: Texts in one call, attempts for a batch and seconds before the second one; each further wait is twice as long.
BATCH, ATTEMPTS, WAIT = 32, 3, 0.5
#: Bytes that a worker gets at once.
MOST_BYTES = 4 << 20


def in_batches(texts: list[str | None], translator: Translator, batch: int = BATCH, attempts: int = ATTEMPTS, wait: float = WAIT) -> list[str | None]:
    """The translations; a null or blank text, one without a translation, or one of a batch that fails each time stays as it is."""
    out = list(texts)
    ask = [k for k, t in enumerate(texts) if t and t.strip()]
    for at in range(0, len(ask), batch):
        part = ask[at : at + batch]
        for attempt in range(attempts):
            try:
                found = list(translator([texts[k] for k in part]))
                if len(found) != len(part):
                    raise ValueError("a translator returns as many texts as it is given")
            except Exception:  # a service that is down: the texts stay as they are
                if attempt + 1 < attempts:
                    time.sleep(wait * 2**attempt)
                continue
            for k, t in zip(part, found):
                out[k] = t if t else texts[k]
            break
    return out


def _translate(batches: Iterator[pa.RecordBatch], columns: list[str], translator: Translator, options: dict) -> Iterator[pa.RecordBatch]:
    # The rows of one call at a time: a worker holds no more texts than these beside the batch as it came.
    step = options.get("batch", BATCH)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            for c in columns:
                k = part.schema.get_field_index(c)
                part = part.set_column(k, part.schema.field(k), pa.array(in_batches(part.column(k).to_pylist(), translator, **options), part.schema.field(k).type))
            yield part


def translated(rows: DataFrame, columns: list[str], translator: Translator, **options) -> DataFrame:
    """The rows with the text columns translated; workers get bounded batches whatever the length of the texts."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("b")) > MOST_BYTES:
        conf.set(key, str(MOST_BYTES))
    return rows.mapInArrow(partial(_translate, columns=columns, translator=translator, options=options), rows.schema)

