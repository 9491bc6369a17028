"""Validation of JSON columns."""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamcontract.plans.columns import NotNative, compile_column
from streamcontract.plans.jsonschema import Config, Documents, Evaluator, loads, render
from streamcontract.runtime import prepare

RESULT = "struct<valid:boolean,errors:array<struct<keyword:string,message:string,schema_path:string,instance_path:string>>,annotations:map<string,map<string,string>>>"


@functools.lru_cache(64)
def _evaluator(packed: bytes) -> Evaluator:
    return pickle.loads(packed)


class Validator:
    """A schema compiled once on the driver.

    `is_valid` is the boolean column: native where the schema allows (`native` tells),
    else an Arrow function. `result` gives errors and annotations. A null or malformed
    text is null for `is_valid` and has a null `valid` in `result`.
    """

    def __init__(self, schema: object, config: Config | None = None, loader: Callable[[str], object] | None = None) -> None:
        if isinstance(schema, str):
            schema = loads(schema)
        self.config = config or Config()
        self.evaluator = Evaluator(schema, self.config, Documents(loader, default=self.config.draft))
        try:
            compile_column(self.evaluator, F.try_parse_json(F.lit("null")))
            self.native, self.why = True, ""
        except NotNative as e:
            self.native, self.why = False, str(e)

    def is_valid(self, json: Column | str, native: bool | None = None) -> Column:
        text = F.col(json) if isinstance(json, str) else json
        if self.native if native is None else native:
            return compile_column(self.evaluator, F.try_parse_json(text))
        packed = self._packed()

        @F.pandas_udf("boolean")
        def run(s: pd.Series) -> pd.Series:
            e = _evaluator(packed)
            return pd.Series([None if (r := e.validate_text(x)) is None else r.valid for x in s], dtype=object)

        return run(text)

    def result(self, json: Column | str) -> Column:
        text = F.col(json) if isinstance(json, str) else json
        packed = self._packed()

        @F.pandas_udf(RESULT)
        def run(s: pd.Series) -> pd.DataFrame:
            e = _evaluator(packed)
            rows = []
            for x in s:
                r = e.validate_text(x)
                if r is None:
                    rows.append((None, [{"keyword": "json", "message": "null or malformed", "schema_path": "", "instance_path": ""}], {}))
                    continue
                notes: dict[str, dict[str, str]] = {}
                for at, k, v in r.notes if r.valid else ():
                    notes.setdefault(at, {}).setdefault(k, render(v))
                rows.append((r.valid, [vars(y) for y in r.errors], notes))
            return pd.DataFrame(rows, columns=["valid", "errors", "annotations"])

        return run(text)

    def _packed(self) -> bytes:
        loader, self.evaluator.documents.loader = self.evaluator.documents.loader, None  # documents are loaded by now
        try:
            return _pack(self.evaluator)
        finally:
            self.evaluator.documents.loader = loader


def _pack(e: Evaluator) -> bytes:
    from pyspark import cloudpickle

    # ids of objects change with pickling: bases are rebuilt on arrival
    return cloudpickle.dumps(_Arrival(e))


class _Arrival:
    def __init__(self, e: Evaluator) -> None:
        self.e = e

    def __reduce__(self) -> tuple:
        state = {k: v for k, v in self.e.__dict__.items() if k != "documents"}
        docs = self.e.documents
        return _rebuild, (state, docs.resources, list(docs.bases.values()), docs.default)


def _rebuild(state: dict, resources: dict, bases: list, default: str) -> Evaluator:
    e = Evaluator.__new__(Evaluator)
    e.__dict__.update(state)
    e.documents = Documents(None, default)
    e.documents.resources = resources
    e.documents.bases = {id(s): (s, base, draft) for s, base, draft in bases}
    return e


def validate(df: DataFrame, json: str, schema: object, result: str = "valid", config: Config | None = None, loader: Callable[[str], object] | None = None) -> DataFrame:
    """df with a boolean column."""
    prepare(df.sparkSession)
    return df.withColumn(result, Validator(schema, config, loader).is_valid(json))


def validate_full(df: DataFrame, json: str, schema: object, result: str = "validation", config: Config | None = None, loader: Callable[[str], object] | None = None) -> DataFrame:
    """df with the struct of valid, errors and annotations."""
    prepare(df.sparkSession)
    return df.withColumn(result, Validator(schema, config, loader).result(json))


def combine(*results: Column) -> Column:
    """One result of several: valid if all are, errors together, annotations only if all are valid."""
    valid = functools.reduce(lambda a, b: a & b, (r["valid"] for r in results))
    errors = F.concat(*(r["errors"] for r in results))
    notes = functools.reduce(lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, y)), (r["annotations"] for r in results))
    return F.struct(valid.alias("valid"), errors.alias("errors"), F.when(valid, notes).otherwise(F.create_map().cast("map<string,map<string,string>>")).alias("annotations"))
