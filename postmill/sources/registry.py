"""Adapters by source name.

An adapter is a plain function from a frame of landed payloads to raw postings. A
new board registers one function; everything after it is shared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Adapter = Callable[..., DataFrame]


class SourceRegistry:
    def __init__(self) -> None:
        self._adapters: dict[str, Adapter] = {}

    def register(self, name: str, adapter: Adapter) -> None:
        key = name.strip().lower()
        if not key:
            raise ValueError("a source needs a name")
        self._adapters[key] = adapter

    def names(self) -> list[str]:
        """Registered sources in order of registration, which is the merge order."""
        return list(self._adapters)

    def postings(self, name: str, payloads: DataFrame, **options) -> DataFrame:
        return self._adapters[name.strip().lower()](payloads, **options)


def default_registry() -> SourceRegistry:
    from postmill.sources.api import api_postings
    from postmill.sources.cards import card_postings
    from postmill.sources.feed import feed_postings
    from postmill.sources.startup import project_markdown_links, project_startup_card, startup_postings

    registry = SourceRegistry()
    registry.register("naukri", api_postings)
    registry.register("remoteok", feed_postings)
    registry.register("wellfound", project_startup_card)
    # Other payload shapes of the same boards.
    registry.register("naukri_cards", card_postings)
    registry.register("wellfound_markdown", project_markdown_links)
    registry.register("wellfound_pages", startup_postings)
    return registry
