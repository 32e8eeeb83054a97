"""A SQL surface: a log's tables as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import log as lg
from ..operators import relations as rel
from ..operators import views as vw


def register(traces: DataFrame, prefix: str = "") -> dict[str, DataFrame]:
    """Create or replace the views events, traces, variants, views and edges (with ``prefix``) over a log of traces."""
    variants = lg.variants_of(traces)
    frames = {
        "events": lg.events_of(traces),
        "traces": traces,
        "variants": vw.with_kappa(variants),
        "views": vw.induce_views(variants),
        "edges": rel.classical_dfg(rel.universe_steps(variants)),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return frames
