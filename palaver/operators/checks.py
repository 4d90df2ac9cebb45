"""Predicates over settings, sessions and batches of embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions import vectors as V

#: What each tunable may be, both ends included.
RANGES = {
    "lag_chunks": (0, 16),
    "min_pool": (2, 16),
    "margin": (0.0, 0.5),
    "mint_ceiling": (0.0, 1.0),
    "change_threshold": (0.0, 1.0),
    "relabel_window": (0, 600),
}


def out_of_range(columns: dict[str, Column] | None = None) -> Column:
    """The names of tunables that are null, not a number or out of their range, in the order of ``RANGES``."""
    columns = columns or {k: F.col(k) for k in RANGES}
    bad = [F.when(columns[k].isNull() | F.isnan(columns[k].cast("double")) | ~columns[k].between(*RANGES[k]), F.lit(k)) for k in RANGES if k in columns]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def types_at_cursor(mode: Column) -> Column:
    return F.coalesce(mode.isin("type", "both"), F.lit(False))


def wire_mode(mode: Column) -> Column:
    """What types at a cursor can't take anything back, so its session only appends."""
    return F.when(types_at_cursor(mode), "live").otherwise("transcript")


def labelling(mode: Column, asked: Column, available: Column) -> Column:
    """Labels are promised only if asked for, in a transcript, by a server that can give them."""
    return F.coalesce(asked & available & (wire_mode(mode) == "transcript"), F.lit(False))


def can_load(free: Column, model: Column, floor: Column) -> Column:
    """Whether more than the floor stays free beside a model; unknown sizes can't."""
    return F.coalesce(free > model + floor, F.lit(False))


def address_fault(url: Column) -> Column:
    """What is wrong with a server's address; null if nothing is."""
    u = F.trim(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(u, "^wss?://", "")
    return F.when(u == "", "empty").when(~u.rlike("^wss?://"), "no scheme").when((rest == "") | rest.startswith("/"), "no host")


def stale_previews(built: Column, wanted: Column, metering: Column, tried: Column, retry: float) -> Column:
    """Whether previews have to be made anew: for other sources, or none gives a level and the wait
    (``tried`` seconds since the last try; null: never) is over."""
    return ~built.eqNullSafe(wanted) | (~metering & (tried.isNull() | (tried >= retry)))


def batch_fault(lengths: Column, outputs: Column) -> Column:
    """What is wrong with a batch of windows (their ``lengths``) and embeddings (``outputs``, an array each);
    null if nothing is."""
    uneven = F.array_size(F.array_distinct(lengths)) > 1
    odd = F.exists(outputs, lambda v: v.isNull() | F.exists(v, lambda x: ~V.finite(x)))
    return F.when(uneven, "windows of unequal length").when(F.size(lengths) != F.size(outputs), "not an embedding a window").when(odd, "an embedding that is not finite")
