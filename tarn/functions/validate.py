"""Validation of writes: a rule gives a reason for a rejection, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(c: Column, t: T.DataType) -> Column:
    """Whether a value counts as true: not null, false, 0 or empty text; arrays and objects always do."""
    if isinstance(t, T.BooleanType):
        p = c
    elif isinstance(t, T.NumericType):
        p = c != 0
    elif isinstance(t, T.StringType):
        p = c != ""
    else:
        p = c.isNotNull()
    return F.coalesce(p, F.lit(False))


def keeps_ownership(new: Column, old: Column, schema: T.StructType) -> Column:
    """The soft-delete rule over db structs (of one schema) with CreatedByUid, OrganizationId and DocType: the reason for a rejection, else null."""

    def has(db: Column, name: str) -> Column:
        return truthy(db.getField(name), schema[name].dataType) if name in schema.names else F.lit(False)

    lost = lambda name: has(old, name) & ~has(new, name)
    # fixed values: the reasons are part of the replies
    return (
        F.when(new.isNull() & has(old, "CreatedByUid"), "soft delete requires db object (with ownership metadata)")
        .when(new.isNull(), F.lit(None))
        .when(lost("OrganizationId"), "soft delete requires db.OrganizationId when the old document had one")
        .when(lost("CreatedByUid"), "soft delete requires db.CreatedByUid when the old document had one")
        .when(lost("DocType"), "soft delete must preserve db.DocType")
    )
