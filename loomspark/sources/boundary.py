"""Services outside the engine: fetching pages and extracting records, as injected callables.

Each runs in ``mapInPandas`` on as many partitions as calls may run at once.
Results should be written before they are used twice: calls cost, and may
answer differently.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import jsonx

Extractor = Callable[[str], tuple[int, str]]


def fetched(urls: DataFrame, fetch: Callable[[str], str], at_once: int = 1, pause: Callable[[], float] = lambda: 0.0) -> DataFrame:
    """(url, file, content, error) of every address; an error takes the content's place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url, file in zip(b["url"], b["file"], strict=True):
                try:
                    out.append((url, file, fetch(url), None))
                except Exception as e:  # whatever a service raises belongs to its page
                    out.append((url, file, None, f"{type(e).__name__}: {e}"))
                time.sleep(pause())
            yield pd.DataFrame(out, columns=["url", "file", "content", "error"])

    return urls.select("url", "file").repartition(at_once).mapInPandas(run, "url string, file string, content string, error string")


#: What a service may raise that is worth another attempt; anything else ends a page's attempts at once.
PASSING = (ValueError, TimeoutError, ConnectionError)


def attempted(service: Extractor, kind: str, text: str, attempts: int, pause: float) -> tuple[str | None, str | None, int]:
    """(reply, error, calls) of one page.

    A status other than 200 is tried again at once; a call that passes out of
    time or reach, and a reply without JSON, after a pause. Any other exception
    is critical and ends the attempts.
    """
    error = "no attempt"
    for n in range(attempts):
        try:
            status, reply = service(jsonx.request(kind, text, n))
            if status == 200:
                jsonx.found_in(reply)
                return reply, None, n + 1
            error = f"status {status}"
            continue
        except PASSING as e:
            error = f"failed after retries: {type(e).__name__}"
        except Exception as e:  # whatever a service raises belongs to its page
            return None, f"Critical: {type(e).__name__}", n + 1
        if n + 1 < attempts:
            time.sleep(pause)
    return None, error, attempts


def extracted(pages: DataFrame, service: Extractor, at_once: int = 1, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """``pages`` (key, kind, text) with (reply, error, calls); the text is cut shorter after the first attempt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, kind, *attempted(service, kind, t or "", attempts, pause)) for k, kind, t in zip(b["key"], b["kind"], b["text"], strict=True)]
            yield pd.DataFrame(out, columns=["key", "kind", "reply", "error", "calls"]).astype({"calls": "int64"})

    return pages.select("key", "kind", "text").repartition(at_once).mapInPandas(run, "key string, kind string, reply string, error string, calls long")


def records(replies: DataFrame) -> DataFrame:
    """(key, kind, typed record's fields …, error): replies repaired and put into shape."""
    typed = replies.withColumn("_json", jsonx.repaired(F.col("reply"))).withColumn("_r", jsonx.normalise("kind", "_json"))
    names = [f for f in typed.schema["_r"].dataType.fieldNames() if f != "error"]
    return typed.select("key", "kind", *(F.col(f"_r.{n}").alias(n) for n in names), F.coalesce("error", "_r.error").alias("error"))
