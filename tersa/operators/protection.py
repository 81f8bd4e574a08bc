"""Protection of personal columns of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import fixed
from ..functions.privacy import MASKS, Pseudonymizer
from ..functions.sql import ident, replace
from ..functions.text import column_as_text


def pseudonymise(df: DataFrame, fields: dict[str, str], keyed: Pseudonymizer | None) -> DataFrame:
    if keyed is None:
        raise ValueError(
            "Se ha pedido seudonimizar sin configurar la clave: falta el Pseudonymizer.")
    return replace(df, {
        fields[f]: keyed.token(ident(fields[f]), f, df.schema[fields[f]].dataType)
        for f in fixed.PSEUDONYM_FIELDS if fields.get(f) in df.columns
    })


def mask(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    return replace(df, {
        fields[f]: MASKS[f](column_as_text(ident(fields[f]), df.schema[fields[f]].dataType))
        for f in fixed.MASK_FIELDS if fields.get(f) in df.columns
    })


def protect(
    df: DataFrame, fields: dict[str, str], pseudonyms: bool = False, masks: bool = False,
    keyed: Pseudonymizer | None = None,
) -> DataFrame:
    """Pseudonyms win over masks when both are asked for."""
    if pseudonyms:
        return pseudonymise(df, fields, keyed)
    return mask(df, fields) if masks else df
