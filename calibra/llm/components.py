"""Connected components of an edge table, in rounds of joins; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import forget, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """id and component, the least id reachable, of every id in edges(a, b); a saved table.

    Each round gives an id the least of its neighbours and itself, follows these to their ends, and goes on with the links that
    are left between the ends, each once. So a round has fewer links than the one before, whatever the length of chains.
    Neighbours are summed to a minimum before they are dealt, so an id with very many of them is one row for a task.
    """
    rounds, links = [], edges.select("a", "b")
    while True:
        once = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = saved(once, "edges")
        both = links.union(links.select("b", "a"))
        ends = _followed(saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels"))
        of = lambda end: ends.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))  # noqa: B023, E731
        rest = links.join(of("a"), "a").join(of("b"), "b").filter("of_a <> of_b")
        rounds.append((links, ends))
        if not rest.limit(1).count():
            break
        links = rest.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    # What the last round's ends are is known; each earlier round's ends are carried on to them.
    links, labels = rounds.pop()
    forget(links)
    while rounds:
        links, ends = rounds.pop()
        later = labels.select(F.col("id").alias("component"), F.col("component").alias("least"))
        whole = saved(ends.join(later, "component", "left").select("id", F.coalesce("least", "component").alias("component")), "labels")
        forget(links, ends, labels)
        labels = whole
    return labels


def _followed(labels: DataFrame) -> DataFrame:
    """labels(id, component) with each component replaced by its own, until none changes: every component is an id here."""
    while True:
        own = labels.select(F.col("id").alias("component"), F.col("component").alias("of"))
        step = saved(labels.join(own, "component").select("id", F.col("of").alias("component"), (F.col("of") < F.col("component")).alias("changed")), "labels")
        forget(labels)
        changed = step.filter("changed").limit(1).count()
        labels = step.drop("changed")
        labels.saved_at = step.saved_at
        if not changed:
            return labels


def joined_components(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The components of labels(id, component) after the links more(a, b): only the components that these meet are labelled again."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    met = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    bridges = connected_components(met.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    ends = more.select(F.col("a").alias("id")).union(more.select("b")).distinct()
    known = labels.select("id", "component").union(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
    whole = known.join(bridges.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left")
    out = saved(whole.select("id", F.coalesce("least", "component").alias("component")), "labels")
    forget(bridges)
    return out
