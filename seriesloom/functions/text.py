"""Cleaning of headers, labels and model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import as_column

BOM = "\ufeff"

# Canonical spelling of model names, by lower-case column prefix.
MODEL_ALIASES = {
    "xgb": "XGB",
    "gbr": "GBR",
    "sarimax": "SARIMAX",
    "sarima": "SARIMA",
    "tide": "TiDE",
    "seq2seq": "Seq2Seq",
    "transformer": "Transformer",
    "automl": "AutoML",
}


def clean_header(name: str) -> str:
    return name.strip().strip(BOM).strip()


def canonical_model(column: str) -> str:
    """``xgb_feature`` gives ``XGB``; unknown prefixes stay as they are."""
    base = column[: -len("_feature")] if column.lower().endswith("_feature") else column
    return MODEL_ALIASES.get(base.lower(), base)


def clean_label(c, aliases: dict[str, str] | None = None) -> Column:
    """Trimmed text, empty to NULL, then an optional alias lookup."""
    text = F.trim(as_column(c).cast("string"))
    text = F.when(text != "", text)
    if aliases:
        pairs = [F.lit(x) for kv in aliases.items() for x in kv]
        text = F.coalesce(F.create_map(*pairs)[text], text)
    return text
