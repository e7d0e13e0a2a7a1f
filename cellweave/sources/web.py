"""Requests to search and knowledge-graph services, with a status for every row in place of an exception."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE = "site:www.wikidata.org"
CANDIDATES = 30


def search_text(query: Column, site: bool = True) -> Column:
    """The text that is sent to the web search; the site restriction follows without a space."""
    return F.concat(query, F.lit(SITE)) if site else query


def _url(base: str, fixed: dict[str, str], name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{base}?{urllib.parse.urlencode(fixed)}&{name}="), F.url_encode(value))


def entity_search_url(base: str, query: Column, limit: int = CANDIDATES, lang: str = "en") -> Column:
    """URL of a candidate search, in relevance order, ``limit`` entries."""
    return _url(base, {"action": "wbsearchentities", "format": "json", "language": lang, "limit": str(limit)}, "search", query)


def entity_url(base: str, number: Column, lang: str = "en") -> Column:
    """URL of one entity's labels, descriptions and claims in one language."""
    return _url(base, {"action": "wbgetentities", "format": "json", "languages": lang}, "ids", F.concat(F.lit("Q"), number.cast("string")))


def http_get(url: str, timeout: float = 30.0) -> tuple[int, str]:
    """Status and body."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetch(requests: DataFrame, get: Callable[[str], tuple[int, str]] = http_get, partitions: int | None = None, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``requests(url, ...)`` with ``status``, ``error`` and ``body``.

    Equal URLs are asked once. ``partitions`` bounds the number of requests in
    flight. A refused request (429) is asked up to ``tries`` times, after ``wait``
    seconds, then twice as many, and so on. What is still refused, or failed,
    keeps its row, with an error, and can be asked again by filtering on it.
    """
    asked = requests.select("url").distinct()
    asked = asked.repartition(partitions) if partitions else asked

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    status, body = get(url)
                    for n in range(1, tries):
                        if status != 429:
                            break
                        time.sleep(wait * 2 ** (n - 1))
                        status, body = get(url)
                    rows.append((url, status, None if status == 200 else "rate limit" if status == 429 else f"status {status}", body if status == 200 else None))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, str(e), None))
            yield pd.DataFrame(rows, columns=["url", "status", "error", "body"]).astype({"status": "Int64"})

    return requests.join(asked.mapInPandas(run, "url string, status long, error string, body string"), "url")


def found_ids(answers: DataFrame) -> DataFrame:
    """``answers(mention, body)`` as ``(mention, entity_id, pos)``: ids of a candidate search in their order."""
    ids = F.from_json("body", "search array<struct<id:string>>")["search"]["id"]
    listed = answers.select("mention", F.posexplode(ids).alias("pos", "id"))
    return listed.select("mention", F.substring("id", 2, 40).try_cast("bigint").alias("entity_id"), "pos")
