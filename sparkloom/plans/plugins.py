"""What a plugin may provide, as protocols over DataFrames, and the registry that checks what it declares."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession

from .errors import ParameterError

#: The interface's version and the capabilities that a plugin can declare.
API_VERSION = (1, 5)
CAPABILITIES = ("analyzer", "ocr_provider", "embedding_provider", "vector_store_provider", "dataset_provider", "discovery_provider", "acquisition_downloader", "prompt_planner", "relevance_evaluator", "exporter")


#: Fixed value: the form of a plugin's name.
NAME = r"[a-z0-9][a-z0-9._-]{1,119}"


@runtime_checkable
class Analyzer(Protocol):
    def analyze(self, assets: DataFrame) -> DataFrame: ...


@runtime_checkable
class OcrProvider(Protocol):
    def read_text(self, images: DataFrame) -> DataFrame: ...


@runtime_checkable
class EmbeddingProvider(Protocol):
    def embed(self, chunks: DataFrame) -> DataFrame: ...


@runtime_checkable
class VectorStoreProvider(Protocol):
    def upsert(self, vectors: DataFrame) -> None: ...

    def nearest(self, vector: list[float], k: int) -> DataFrame: ...


@runtime_checkable
class DatasetProvider(Protocol):
    def files(self, spark: SparkSession, dataset: str) -> DataFrame: ...


@runtime_checkable
class DiscoveryProvider(Protocol):
    def search(self, spark: SparkSession, query: str, limit: int, cursor: str | None) -> DataFrame: ...


@runtime_checkable
class AcquisitionDownloader(Protocol):
    def download(self, candidates: DataFrame) -> DataFrame: ...


@runtime_checkable
class PromptPlanner(Protocol):
    def plan(self, prompt: str) -> dict[str, Any]: ...


@runtime_checkable
class RelevanceEvaluator(Protocol):
    def relevance(self, text: Column) -> Column: ...


@runtime_checkable
class Exporter(Protocol):
    def export(self, df: DataFrame, path: str) -> None: ...


PROTOCOLS = dict(zip(CAPABILITIES, (Analyzer, OcrProvider, EmbeddingProvider, VectorStoreProvider, DatasetProvider, DiscoveryProvider, AcquisitionDownloader, PromptPlanner, RelevanceEvaluator, Exporter), strict=True))


def supports(spec: str, version: tuple[int, int] = API_VERSION) -> bool:
    """Whether a version meets all of a comma-separated list of bounds such as `>=1.2, <2, !=1.4`."""
    compare = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}
    for bound in spec.split(","):
        m = re.fullmatch(r"\s*(>=|<=|==|!=|>|<)\s*(\d+)(?:\.(\d+))?\s*", bound)
        if not m:
            raise ParameterError(f"not a version bound: {bound!r}")
        if not compare[m[1]](version, (int(m[2]), int(m[3] or 0))):
            return False
    return True


@dataclass(frozen=True)
class Plugin:
    """What a plugin says of itself, and what it provides by capability."""

    name: str
    version: str
    api: str
    capabilities: tuple[str, ...]
    provides: dict[str, Any] = field(default_factory=dict)
    permissions: tuple[str, ...] = ()


class Plugins:
    def __init__(self) -> None:
        self._known: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        """Takes a plugin whose name, versions and capabilities are sound and whose objects have the methods they need."""
        if not re.fullmatch(NAME, plugin.name) or plugin.name in self._known:
            raise ParameterError("a plugin's name is a new lower-case word of 2 to 120 characters")
        if not re.fullmatch(r"\d+(\.\d+)*([a-z0-9.+-]*)", plugin.version):
            raise ParameterError("the version is not one")
        if not supports(plugin.api):
            raise ParameterError(f"not for interface {'.'.join(map(str, API_VERSION))}")
        if not plugin.capabilities or set(plugin.capabilities) - set(CAPABILITIES):
            raise ParameterError("capabilities are missing or unknown")
        if any(not re.fullmatch(r"[a-z0-9][a-z0-9:._-]*", p) for p in plugin.permissions):
            raise ParameterError("permissions are lower-case words")
        for c in plugin.capabilities:
            if not isinstance(plugin.provides.get(c), PROTOCOLS[c]):
                raise ParameterError(f"{c} lacks a method")
        self._known[plugin.name] = plugin

    def providing(self, capability: str) -> list[tuple[str, Any]]:
        """(name, object) of the plugins with a capability, by name."""
        if capability not in CAPABILITIES:
            raise ParameterError(f"unknown capability {capability!r}")
        return [(p.name, p.provides[capability]) for p in sorted(self._known.values(), key=lambda p: p.name) if capability in p.capabilities]

    def named(self, capability: str, name: str) -> Any:
        """What the plugin of that name provides for a capability; refused if there is none."""
        found = dict(self.providing(capability))
        if name not in found:
            raise ParameterError(f"no {capability} named {name!r}")
        return found[name]
