"""Admission of URLs on a stream, keyed by platform, in state that is bounded.

A platform's state is the URLs it has admitted, which go after a time to live, and how many it has admitted in all, which never exceeds its budget.
So the state of a platform is at most its budget, where dropDuplicates keeps every URL ever seen. It lives in the RocksDB store on
disk, not in the heap, and a query that is started again goes on with it.

Within a batch URLs are taken by seq, then url, so a stream that gets all candidates at once admits what `crawl.admit` admits of the same platforms. A URL that has expired may be
admitted again, and counts again. A URL that two platforms reach is admitted for each; platforms of a crawl are of different sites as a rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.functions import urls
from textloom.plans.lexicon import DEFAULT, Lexicon

ADMITTED = "platform_id string, url string, nth int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Platform(StatefulProcessor):
    def __init__(self, max_pages: int, ttl_ms: int | None):
        self.max_pages, self.ttl_ms = max_pages, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "url string", "nth int", self.ttl_ms)
        self.used = handle.getValueState("used", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0
        before, out = used, []
        # what can enter is within the budget, so no more than that of the batch is held in order
        wanted: dict[str, int] = {}
        for part in rows:
            for seq, url in zip(part["seq"].tolist(), part["url"].tolist(), strict=True):
                if url not in wanted or seq < wanted[url]:
                    wanted[url] = seq
            if len(wanted) > 4 * self.max_pages:
                wanted = dict(self._new(wanted)[: self.max_pages])
        for url, _ in self._new(wanted)[: self.max_pages - used]:
            used += 1
            self.known.updateValue((url,), (used,))
            out.append((key[0], url, used))
        if used > before:
            self.used.update((used,))
        yield pd.DataFrame(out, columns=["platform_id", "url", "nth"])

    def _new(self, wanted: dict[str, int]) -> list[tuple[str, int]]:
        """Those not admitted before, in order."""
        return sorted(((u, s) for u, s in wanted.items() if not self.known.containsKey((u,))), key=lambda x: (x[1], x[0]))

    def close(self) -> None:
        pass


def use_disk_store(spark: SparkSession) -> None:
    """State of streams begun from now on in RocksDB, which this kind of state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def admit_stream(candidates: DataFrame, max_pages: int, ttl_ms: int | None = None, seeds: bool = False, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """platform_id, url, nth of the candidates (url, platform_id, root_host, seq) that a platform admits: of its site, a page, relevant unless they are seeds, new, within the budget.

    ttl_ms: how long an admitted URL is known; None: for ever. With it the query must run by a processing-time trigger: what expires by the clock
    never lets an availableNow query end."""
    ok = urls.same_site(F.col("url"), F.col("root_host")) & urls.is_page(F.col("url"))
    if not seeds:
        ok = ok & urls.relevant(F.col("url"), lexicon)
    rows = candidates.filter(ok).select("platform_id", "url", F.col("seq").cast("long"))
    return rows.groupBy("platform_id").transformWithStateInPandas(_Platform(max_pages, ttl_ms), ADMITTED, "Append", "ProcessingTime" if ttl_ms else "None")
