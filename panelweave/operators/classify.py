"""Rows to classes by a pluggable function, as a remote service would give them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelweave.operators.relational import keep_first
from panelweave.sources.io import union_by_name

#: Offline default: the first field one of whose stems the text holds. Fixed order, so that the result is certain.
FIELDS = (
    ("engineering", ("engen", "engin", "mecan", "eletr", "civil")),
    ("health", ("medic", "enferm", "saude", "odont", "farm")),
    ("computing", ("comput", "sistem", "inform", "softw", "dados")),
    ("education", ("pedag", "licenc", "educa", "letras")),
    ("business", ("admin", "econom", "contab", "negoc", "gest")),
    ("science", ("matem", "fisic", "quim", "biolog", "estat")),
)


def offline(text: str | None) -> str:
    from unicodedata import combining, normalize

    plain = "".join(c for c in normalize("NFD", (text or "").lower()) if not combining(c))
    return next((name for name, stems in FIELDS if any(s in plain for s in stems)), "other")


def catalogue(frames: Sequence[DataFrame], label: str, year: str) -> DataFrame:
    """One row per label over all years, from the earliest year that has it."""
    return keep_first(union_by_name(frames).where(F.col(label).isNotNull()), [label], [year])


def patient(function: Callable[[str], str], retries: int = 0, pause: float = 1.0, least: float = 0.0, failed: str | None = None) -> Callable[[str], str | None]:
    """The function as a remote service needs it: called again up to ``retries`` times after an error, with pauses that double, and never sooner than ``least`` seconds after the call before.

    What fails for good gives ``failed``; without that the last error stands.
    """
    last = [0.0]

    def call(text: str) -> str | None:
        for attempt in range(retries + 1):
            time.sleep(max(0.0, last[0] + least - time.monotonic()))
            last[0] = time.monotonic()
            try:
                return function(text)
            except Exception:
                if attempt < retries:
                    time.sleep(pause * 2**attempt)
                elif failed is None:
                    raise
        return failed

    return call


def classify(df: DataFrame, text: str, out: str = "field", function: Callable[[str], str] = offline, workers: int | None = None, retries: int = 0, pause: float = 1.0, per_second: float | None = None, failed: str | None = None) -> DataFrame:
    """``df`` with the class of each distinct text; every text is asked for once, unless a task is repeated.

    ``workers`` bounds how many tasks call the function at the same time, and with
    it ``per_second`` the calls of all of them. ``retries``, ``pause`` and ``failed``
    are those of :func:`patient`.
    """
    if per_second and not workers:
        raise ValueError("a rate needs a number of workers")
    if retries or per_second or failed is not None:
        function = patient(function, retries, pause, workers / per_second if per_second else 0.0, failed)
    texts = df.select(F.col(text).alias("_text")).distinct()
    if workers:
        texts = texts.repartition(workers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_text": batch["_text"], "_class": [function(t) for t in batch["_text"]]})

    known = texts.mapInPandas(run, "_text string, _class string")
    return df.join(known, F.col(text).eqNullSafe(F.col("_text")), "left").select(*df.columns, F.col("_class").alias(out))


def prompt(template: str, df: DataFrame, columns: Sequence[str], out: str = "prompt") -> DataFrame:
    """A text per row from a template with ``%s`` for each column."""
    return df.withColumn(out, F.format_string(template, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
