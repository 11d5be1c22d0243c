"""Articles of a wiki as a batch data source: ``spark.read.format("wiki_pages")``.

Options: ``folder`` reads replies saved as JSON files (offline); ``api`` and ``titles`` (one a line) ask a wiki's API, in
``tasks`` parallel slices; ``seed`` instead of titles takes the articles that one article links to, and itself first; ``base`` is the address that page ids are
added to, ``agent`` names the reader. A request is tried three times with growing pauses, and the last error is raised. ``assemble`` cleans the texts
and makes the corpus.
"""

from __future__ import annotations

import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from amphora.functions.text import SKIPPED_TITLE_PREFIXES, clean_extract
from amphora.operators.ordering import first_distinct
from amphora.schema import ARTICLE


def with_retries(call: Callable[[], dict], tries: int = 3, pause: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    for n in range(tries):
        try:
            return call()
        except OSError:
            if n == tries - 1:
                raise
            sleep(pause * (n + 1))
    raise ValueError("no tries")


PAGE_BASE = "https://en.wikipedia.org/"
SKIPPED = tuple(SKIPPED_TITLE_PREFIXES)


def linked_titles(reply: dict) -> list[str]:
    """The articles that a page's reply to the links question names, in the order of the page: those of the main space that exist, no lists and no disambiguations."""
    links = (reply.get("parse") or {}).get("links") or []
    return [x["title"] for x in links if x.get("ns") == 0 and x.get("exists") and "(disambiguation)" not in x["title"] and not x["title"].startswith(SKIPPED)]


def article_of(reply: dict, base: str = PAGE_BASE) -> tuple | None:
    """The article of an API reply; None if the page is missing or has no text. Categories lose their name space."""
    for page in (reply.get("query") or {}).get("pages") or []:
        text = (page.get("extract") or "").strip()
        if page.get("missing") or not text:
            return None
        categories = [re.sub(r"^Category:", "", c["title"]) for c in page.get("categories") or []]
        return (int(page["pageid"]), page.get("title"), f"{base}?curid={page['pageid']}", categories, text)
    return None


def assemble(pages: DataFrame, order: list[str], n: int = 40) -> DataFrame:
    """The corpus: the first ``n`` distinct pages in order, cleaned; pages that are empty after cleaning are left out before that.

    ``order`` are the columns that say which page comes first.
    """
    cleaned = pages.withColumn("text", clean_extract(F.col("text"))).where("text <> ''")
    return first_distinct(cleaned, "pageid", order, n)


class _Slice(InputPartition):
    def __init__(self, items: list[str]) -> None:
        self.items = items


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def _ask(self, **params) -> dict:
        q = {**params, "format": "json", "formatversion": "2"}
        request = urllib.request.Request(f"{self.options['api']}?{urllib.parse.urlencode(q)}", headers={"User-Agent": self.options.get("agent", "amphora (corpus reader)")})

        def call() -> dict:
            with urllib.request.urlopen(request, timeout=30) as r:
                return json.load(r)

        return with_retries(call)

    def partitions(self) -> list[InputPartition]:
        if "folder" in self.options:
            items = sorted(str(p) for p in Path(self.options["folder"]).glob("*.json"))
        elif "seed" in self.options:
            seed = self.options["seed"]
            items = [seed, *linked_titles(self._ask(action="parse", page=seed, prop="links"))]
        else:
            items = [t for t in self.options.get("titles", "").split("\n") if t]
        n = max(1, min(len(items), int(self.options.get("tasks", "8"))))
        return [_Slice(items[i::n]) for i in range(n)]

    def _fetch(self, title: str) -> dict:
        return self._ask(action="query", prop="extracts|categories", titles=title, redirects=1, explaintext=1, exsectionformat="wiki", clshow="!hidden", cllimit="max")

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for item in partition.items:
            reply = json.loads(Path(item).read_text(encoding="utf-8")) if "folder" in self.options else self._fetch(item)
            found = article_of(reply, self.options.get("base", PAGE_BASE))
            if found:
                yield found


class WikiPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki_pages"

    def schema(self) -> str:
        return ARTICLE

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
