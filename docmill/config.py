"""Settings from the environment, and the storage and search that they choose."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

STORAGE = ("local", "object_store")
SEARCH = ("local", "remote")


@dataclass(frozen=True)
class Settings:
    """What a run needs to know. Optional parts are required by the choice that uses them."""

    storage: str = "local"
    data_dir: str = "data"
    object_store_uri: str = ""
    search: str = "local"
    search_endpoint: str = ""
    search_index: str = ""
    model_key: str = ""
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        if self.storage not in STORAGE:
            raise ValueError(f"storage is one of {', '.join(STORAGE)}, not {self.storage!r}")
        if self.search not in SEARCH:
            raise ValueError(f"search is one of {', '.join(SEARCH)}, not {self.search!r}")
        if self.storage == "object_store" and "://" not in self.object_store_uri:
            raise ValueError("an object store needs object_store_uri, with its scheme")
        if self.search == "remote" and not (self.search_endpoint and self.search_index and self.model_key):
            raise ValueError("a remote search needs search_endpoint, search_index and model_key")

    @classmethod
    def load(cls, environment: Mapping[str, str] | None = None, prefix: str = "DOCMILL_") -> Settings:
        """From variables such as DOCMILL_STORAGE; unknown names below the prefix are an error."""
        given = {k.removeprefix(prefix).lower(): v for k, v in (os.environ if environment is None else environment).items() if k.startswith(prefix)}
        if unknown := sorted(given.keys() - cls.__dataclass_fields__.keys()):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**given)


def storage_root(settings: Settings) -> str:
    """Where tables and files are: any URI that Spark's readers open."""
    return settings.data_dir if settings.storage == "local" else settings.object_store_uri.rstrip("/")
