"""Shaping pandas frames returned by grouped functions into a fixed tagged schema."""

from __future__ import annotations

import pandas as pd


def conform(pdf: pd.DataFrame, schema: str) -> pd.DataFrame:
    """Add missing columns, order them as in ``schema`` and turn NaN holes into None
    in non-double columns (Arrow needs None for a missing array or integer)."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    for name, typ in fields:
        if name not in pdf.columns:
            pdf[name] = None
        elif typ != "DOUBLE" and not typ.startswith("STRING"):
            col = pdf[name]
            if col.dtype == object or col.isna().any():
                pdf[name] = col.astype(object).where(col.notna(), None)
    return pdf[[n for n, _ in fields]]
