"""Loaders of schema documents: URI -> parsed document. They run on the driver only."""

from __future__ import annotations

import threading
from collections.abc import Callable
from urllib.parse import urljoin, urlparse
from urllib.request import urlopen

from pyspark.sql import SparkSession

from streamcontract.plans.jsonschema import loads
from streamcontract.sources import metaschemas

Loader = Callable[[str], object]


class LoadError(LookupError):
    pass


def no_loader(uri: str) -> object:
    raise LoadError(f"no loader for {uri}")


def metaschema_loader(uri: str) -> object:
    if (found := metaschemas.lookup(uri)) is None:
        raise LoadError(f"not a metaschema: {uri}")
    return found


def http_loader(timeout: float = 10.0) -> Loader:
    def load(uri: str) -> object:
        try:
            with urlopen(uri, timeout=timeout) as r:
                return loads(r.read().decode())
        except (OSError, ValueError) as e:
            raise LoadError(str(e)) from e

    return load


def file_loader(spark: SparkSession) -> Loader:
    """Reads through Spark, so any store that it knows works."""

    def load(uri: str) -> object:
        try:
            return loads(spark.read.text(uri, wholetext=True).head()[0])
        except Exception as e:
            raise LoadError(f"{uri}: {type(e).__name__}") from e

    return load


def mapping_loader(documents: dict[str, object]) -> Loader:
    def load(uri: str) -> object:
        if uri not in documents:
            raise LoadError(uri)
        return documents[uri]

    return load


def cached(loader: Loader) -> Loader:
    """Remembers results by URI."""
    known: dict[str, object] = {}
    lock = threading.Lock()

    def load(uri: str) -> object:
        with lock:
            if uri not in known:
                known[uri] = loader(uri)
            return known[uri]

    return load


def first_of(*loaders: Loader) -> Loader:
    """The first loader that succeeds."""

    def load(uri: str) -> object:
        failed = []
        for x in loaders:
            try:
                return x(uri)
            except LookupError as e:
                failed.append(str(e))
        raise LoadError("; ".join(failed) or uri)

    return load


class Schemes:
    """Dispatch by URI scheme, with a default."""

    def __init__(self, default: Loader = no_loader) -> None:
        self.by_scheme: dict[str, Loader] = {}
        self.default = default

    def register(self, scheme: str, loader: Loader) -> Schemes:
        self.by_scheme[scheme.lower()] = loader
        return self

    def __call__(self, uri: str) -> object:
        return self.by_scheme.get(urlparse(uri).scheme.lower(), self.default)(uri)


def standard(spark: SparkSession) -> Loader:
    """Metaschemas, then http(s) and files, each document once."""
    schemes = Schemes(file_loader(spark)).register("http", http_loader()).register("https", http_loader())
    return cached(first_of(metaschema_loader, schemes))


def resolve_relative(base: str, reference: str) -> str:
    return urljoin(base, reference)
