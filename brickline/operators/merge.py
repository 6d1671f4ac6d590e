"""Upserts, dedupe and retention over plain Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.session import settle


def _pick_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    """One whole row per key through a mergeable aggregate.

    A key with very many copies is reduced inside each map task first, so the
    shuffle carries at most one row per key and task.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(pick(row, F.struct(*[F.col(c) for c in order])).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def dedupe_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick_row(df, keys, order, F.max_by)


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick_row(df, keys, order, F.min_by)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def align_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Expected columns in order; absent ones are null, NaN becomes null."""
    have = dict(df.dtypes)
    out = []
    for name, kind in types.items():
        if name not in have:
            out.append(F.lit(None).cast(kind).alias(name))
        elif have[name] in ("double", "float"):
            out.append(F.when(~F.isnan(name), F.col(name)).cast(kind).alias(name))
        else:
            out.append(F.col(name).cast(kind).alias(name))
    return df.select(*out)


def _no_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def _reduced(incoming: DataFrame, keys: Sequence[str], order: Sequence[str], pick=F.max_by) -> DataFrame:
    """One incoming row per key, written once: it is used by several joins, and its size tells whether to broadcast it."""
    order = order or [c for c in incoming.columns if c not in keys]
    require_columns(incoming, [*keys, *order])
    known = _no_null_keys(incoming, keys)
    return settle(_pick_row(known, keys, order, pick) if order else known.distinct(), "incoming")


def _merged(existing: DataFrame, fresh: DataFrame, keys: Sequence[str], policy) -> DataFrame:
    """Stored rows without a new one as they are, and a row per new key from it and the stored row it meets.

    The stored table meets only the new keys, once to leave them out and once to find them, so a small refresh does
    not move it. It must hold one row per key.
    """
    wanted = fresh.select(*keys)
    kept = existing.join(wanted, list(keys), "left_anti").select(*existing.columns)
    touched = existing.join(wanted, list(keys), "left_semi")
    old = touched.select(*[F.col(c).alias(c if c in keys else f"__old_{c}") for c in existing.columns])
    met = fresh.join(old, list(keys), "left")
    return kept.unionByName(met.select(*[F.col(c) if c in keys else policy(c).alias(c) for c in existing.columns]))


def upsert_last_wins(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Insert or replace whole rows by key; among incoming copies the last by ``order`` wins, null keys are left out."""
    fresh = _reduced(incoming, keys, order)
    kept = existing.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.select(*existing.columns).unionByName(fresh.select(*existing.columns))


def upsert_coalesce(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    replace: Sequence[str] = (),
    greatest: Sequence[str] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """Per-column policy on conflict: replace, keep the greatest, else new-if-present.

    Among incoming copies of a key the last by ``order`` counts, by all other columns where none is given.
    """

    def policy(c: str) -> Column:
        if c in replace:
            return F.col(c)
        return F.greatest(f"__old_{c}", c) if c in greatest else F.coalesce(c, f"__old_{c}")

    return _merged(existing, _reduced(incoming, keys, order), keys, policy)


def upsert_partial(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], measures: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Insert or update only ``measures``; the other stored columns stay untouched. Copies of a key as in ``upsert_coalesce``."""

    def policy(c: str) -> Column:
        return F.col(c) if c in measures else F.col(f"__old_{c}")

    fresh = _reduced(incoming, keys, order).select(*keys, *measures)
    return _merged(existing, fresh, keys, policy)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Add only rows whose key is not stored yet, of incoming copies the first by ``order``, by all other columns where
    none is given.

    The new rows come from the incoming keys that the stored table does not hold; stored rows are only probed.
    """
    fresh = _reduced(incoming, keys, order, F.min_by)
    held = existing.join(fresh.select(*keys), list(keys), "left_semi").select(*keys)
    new = fresh.join(held, list(keys), "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def replace_slice(existing: DataFrame, incoming: DataFrame, slice_keys: Sequence[str]) -> DataFrame:
    """Drop every stored row of the incoming slices, then add the incoming rows."""
    slices = incoming.select(*slice_keys).distinct()
    kept = existing.join(slices, list(slice_keys), "left_anti").select(*existing.columns)
    return kept.unionByName(incoming.select(*existing.columns))


def retain_recent(df: DataFrame, date: str, ref_date: Column, days: int = 90) -> DataFrame:
    return df.filter(F.col(date) >= F.date_sub(ref_date, days))
