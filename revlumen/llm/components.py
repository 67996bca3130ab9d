"""Links and connected components of very large groups, without all pairs and without hot tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlumen.llm.common import staged

# Rounds at most, and pivots that a member asks in each.
PIVOT_ROUNDS, PIVOTS = 5, 2
# A round that finds fewer new links than this part of the known ones is the last, over buckets and over finer ones.
FEW, FEWER = 10, 50
# Components whose labels are shipped, at most.
MANY = 10_000


def turned(left: Column, right: Column, words: int) -> Column:
    """Number of bits by which two lists of ``words`` words differ."""
    return sum((F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))) for i in range(words)), F.lit(0))


def _settled(tree: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child."""
    ends = tree.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        tree.select("parent", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not each.agg(F.count_if(F.expr("up + down > 1 and up > 0"))).first()[0]


def _stars(edges: DataFrame) -> DataFrame:
    """``child, parent``: the least node that edges ``a, b`` reach, for every other node of an edge.

    Alternates two star steps until all is stars: every node hands its larger, then its smaller neighbours to
    its least neighbour. Hubs are never gathered: the least neighbour is a combining aggregate, and handing over
    is a join that can be split. The number of rounds grows with the logarithm of a component's diameter.
    """
    tree = staged(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct(), "edges")
    while not _settled(tree):
        both = tree.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(tree.select("parent", "child"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = staged(both.join(least, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("child"), F.col("m").alias("parent")), "large-star")
        least = large.groupBy("child").agg(F.min("parent").alias("m"))
        down = large.join(least, "child").where(F.col("parent") != F.col("m")).select(
            F.col("parent").alias("child"), F.col("m").alias("parent"))
        tree = staged(down.union(least.select("child", F.col("m").alias("parent"))).distinct(), "small-star")
    return tree


def _with_roots(tree: DataFrame) -> DataFrame:
    roots = tree.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return tree.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(roots)


def connected(edges: DataFrame) -> DataFrame:
    """``node, component``: the least node that edges ``a, b`` reach, for every node of an edge."""
    return _with_roots(_stars(edges))


def crowded_members(members: DataFrame) -> DataFrame:
    """The rows of ``members`` whose bucket holds more than one."""
    crowded = members.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket")
    return staged(members.join(crowded, "bucket", "left_semi"), "members")


def _pivot_pairs(labelled: DataFrame, may_link: Callable[[Column, Column], Column], turn: int, pivots: int) -> DataFrame:
    """Pairs of members and pivots of their buckets: the ``pivots`` that a member meets in most buckets.

    The pivot of a bucket belongs to the component with most members there, so that few others have to ask. Pairs
    of two members that chose each other come twice.
    """
    some = F.struct(F.xxhash64("node", F.lit(turn)).alias("r"), "node", "about").alias("some")
    if turn:
        parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.min(some).alias("some"))
    else:
        # Every member is its own component.
        parts = labelled.select("bucket", "component", F.lit(1).alias("n"), some)
    chosen = parts.groupBy("bucket").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.xxhash64("component", F.lit(turn)).alias("r"), "component", "some")).alias("_p"),
        F.min("component").alias("_low"), F.max("component").alias("_high"))
    asked = chosen.where("_low != _high").select(
        "bucket", F.col("_p.some.node").alias("_node"), F.col("_p.some.about").alias("_about"),
        F.col("_p.component").alias("_component"))
    met = labelled.join(asked, "bucket").where(
        (F.col("component") != F.col("_component")) & may_link(F.col("about"), F.col("_about")))
    # A member has as many rows here as it has buckets, at most.
    best = W.partitionBy("node").orderBy(F.desc("_shared"), F.xxhash64("_node", F.lit(turn)), "_node")
    few = met.groupBy("node", "_node").agg(F.count("*").alias("_shared")).withColumn(
        "_rank", F.row_number().over(best)).where(F.col("_rank") <= pivots)
    return few.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"))


def link_members(members: DataFrame, verify: Callable[[DataFrame], DataFrame], may_link: Callable[[Column, Column], Column],
                 rounds: int = PIVOT_ROUNDS, pivots: int = PIVOTS, narrow: Callable[[DataFrame], DataFrame] | None = None,
                 narrow_pairs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components ``node, component`` of all pairs that share a bucket and pass ``verify``.

    ``members`` are ``crowded_members`` of ``bucket, node, about``, unique by bucket and node; ``may_link(about,
    about)`` is a cheap necessary test. ``verify`` takes pairs ``a, b`` and returns those that are links.

    In each round a member is checked against a few pivots of its buckets, and what is connected by then needs no
    check against each other: a group of copies costs some rows per member. The rounds end with one that finds few
    links; a pair may be checked again in a later one. At last the pairs that share a bucket but no component are
    checked, all of them, so nothing that shares a bucket and passes ``verify`` is lost.

    ``narrow`` may replace the buckets before that by finer ones without loss: it takes ``node, component, about`` of the
    members concerned and returns members, with ``component``, whose new buckets hold every link between two
    components. They go through rounds of their own, and ``narrow_pairs`` makes the last list of pairs from them.
    """
    links, tree = None, None

    def joined(members, labelled, first):
        nonlocal links, tree
        for turn in range(first, first + rounds):
            found = staged(verify(_pivot_pairs(labelled, may_link, turn, pivots)), "links")
            known, new = 0 if tree is None else tree.count(), found.count()
            links = found if links is None else links.union(found)
            few = new <= known // (FEWER if first else FEW)
            # What is found over finer buckets is joined before the last list.
            if not new or few and not first:
                break
            tree = _stars(links)
            links = tree.select(F.col("child").alias("a"), F.col("parent").alias("b"))
            labelled = staged(members.join(tree, F.col("node") == F.col("child"), "left").select(
                *members.columns, F.coalesce("parent", "node").alias("component")), "labelled")
            if few:
                break
        return labelled

    labelled = joined(members, members.withColumn("component", F.col("node")), 0)
    several = labelled.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where(
        "_low != _high").select("bucket")
    mixed = labelled.join(several, "bucket", "left_semi")
    if narrow is not None:
        finer = narrow(staged(mixed.select("node", "component", "about").distinct(), "mixed"))
        rest = narrow_pairs(joined(finer.drop("component"), finer, rounds))
    else:
        other = mixed.select("bucket", F.col("node").alias("_node"), F.col("about").alias("_about"),
                             F.col("component").alias("_component"))
        met = mixed.join(other, "bucket").where(
            (F.col("component") < F.col("_component")) & may_link(F.col("about"), F.col("_about")))
        rest = met.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
    return _with_roots(_stars(links.union(verify(rest))))


def labels_of(components: DataFrame, firsts: DataFrame, first: str) -> DataFrame:
    """``node`` and the least ``first`` of its component; ``firsts`` holds ``node`` and ``first``.

    Components with more than a ``MANY``-th part of the nodes are fewer than ``MANY``: their labels are shipped, so
    a large component is not gathered.
    """
    total = components.count()
    least = staged(components.join(firsts, "node").groupBy("component").agg(
        F.min(first).alias(first), F.count("*").alias("_n")), "least")
    large = F.broadcast(least.where(F.col("_n") * MANY > total).drop("_n"))
    small = least.where(F.col("_n") * MANY <= total).drop("_n")
    return components.join(large, "component").select("node", first).union(
        components.join(large, "component", "left_anti").join(small, "component").select("node", first))
