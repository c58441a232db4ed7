"""TOML as JSON: the one thing that needs Python, and all that Python does."""

from __future__ import annotations

import datetime
import json
import tomllib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def toml_to_json(text: str | None) -> tuple[str | None, str | None]:
    """(JSON, error) of a TOML text."""
    if text is None:
        return None, "no text"
    try:
        return json.dumps(tomllib.loads(text), ensure_ascii=False, default=_plain), None
    except (tomllib.TOMLDecodeError, RecursionError) as error:
        return None, str(error)


def _plain(value: object) -> str:
    return value.isoformat() if isinstance(value, datetime.date | datetime.time | datetime.datetime) else str(value)


def toml_json(text: Column | str) -> Column:
    """struct<json, error> of a column of TOML texts."""

    def convert(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([toml_to_json(t) for t in texts], columns=["json", "error"])

    return F.pandas_udf(convert, "struct<json:string,error:string>")(text)
