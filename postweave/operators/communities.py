"""Modularity communities by repeated local moves, and their features.

Every tag starts alone. Each tag knows the neighbouring community that raises the
modularity most, the smallest label winning ties. In a round some of the tags that
gain by moving do so, chosen by a hash of tag and round; as they move at once, a
round counts only if the modularity has grown. Every few rounds the single best
move is made alone, which always gains, so rounds go on until no tag gains. Settled
communities are merged into single vertices and the moves start again on the
smaller graph, until a level moves nothing. All quantities compared are whole
numbers, so a run is repeatable.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.functions.text import tag_set
from postweave.operators.ranking import hash_rank
from postweave.operators.tag_graph import both_ways
from postweave.session import broadcast_if_small, stage, unstage

# First hex digit below which a tag moves in a round, by turn; None: the best alone.
TURNS = ("c", "8", "8", "8", "4", None)
# Links from which on only tags whose choice can have changed choose again. Both
# ways give the same choices; below, reading all links is the cheaper one.
FRONTIER_LINKS = 1_000_000
WHOLE = "decimal(38,0)"
RESTLESS = "best_loss < own_loss"


def _choices(links: DataFrame, state: DataFrame, total: int, only: DataFrame | None = None) -> DataFrame:
    """(v, k, c, best, best_loss, own_loss, inside, degree) of the vertices in ``only``, or of all.

    ``links`` is (a, b, weight, k) without loops, with the weighted degree k of a, and
    ``state`` (v, k, c); ``inside`` is the weight of v's links into its own community,
    ``degree`` that of all links of the community.
    Links into each neighbouring community are summed per vertex, then the best
    community is kept: two combining shuffles.
    """
    own = state
    if only is not None:
        links = links.join(only.select(F.col("v").alias("a")), "a", "left_semi")
        own = state.join(only, "v", "left_semi")
    where = state.select(F.col("v").alias("b"), "c")
    near = links.join(where, "b").select(F.col("a").alias("v"), "k", "c", "weight", F.lit(False).alias("stays"))
    # The own community is always a choice, also without a link into it.
    stay = own.select("v", "k", "c", F.lit(0).cast("long").alias("weight"), F.lit(True).alias("stays"))
    sums = near.unionByName(stay).groupBy("v", "k", "c").agg(
        F.sum("weight").alias("inside"), F.bool_or("stays").alias("stays")
    )
    sizes = state.groupBy("c").agg(F.sum("k").alias("degree"))
    others = F.col("degree") - F.when(F.col("stays"), F.col("k")).otherwise(0)
    # Loss form: k * (degree of the others) - 2m * (links into the community).
    loss = F.col("k").cast("decimal(19,0)") * others.cast("decimal(19,0)") - F.col("inside").cast(
        "decimal(19,0)"
    ) * F.lit(total).cast("decimal(19,0)")
    return sums.join(sizes, "c").withColumn("loss", loss.cast(WHOLE)).groupBy("v", "k").agg(
        F.min(F.struct("loss", "c")).alias("best"),
        F.min(F.when(F.col("stays"), F.struct("loss", "c", "inside", "degree"))).alias("own"),
    ).select(
        "v", "k", "own.c", F.col("best.c").alias("best"), F.col("best.loss").alias("best_loss"),
        F.col("own.loss").alias("own_loss"), "own.inside", "own.degree",
    )


def _by_hash(turn: int) -> Column:
    """Whether a tag that gains is among those that move in a turn of many."""
    digit = F.substring(F.md5(F.concat("v", F.lit(f":{turn}"))), 1, 1)
    return F.expr(RESTLESS) & (digit < TURNS[turn % len(TURNS)])


def _moves(state: DataFrame, turn: int) -> Column:
    """Whether a tag moves in a turn."""
    if TURNS[turn % len(TURNS)] is not None:
        return _by_hash(turn)
    best = state.filter(RESTLESS).orderBy(F.expr("best_loss - own_loss"), "v").select("v").limit(1).collect()
    return F.col("v") == F.lit(best[0].v)


def _score(state: DataFrame, total: int, turn: int) -> tuple[int, list[int]]:
    """2m * (links inside) - squared degrees, which rises with the modularity, and
    the turns of the next cycle in which some tag would move; none if no tag gains."""
    turns = range(turn, turn + len(TURNS))
    goes = [F.expr(RESTLESS) if TURNS[t % len(TURNS)] is None else _by_hash(t) for t in turns]
    # The degrees of the members times that of their community add up to its square.
    square = F.col("k").cast("decimal(19,0)") * F.col("degree").cast("decimal(19,0)")
    row = state.agg(
        F.sum("inside"), F.sum(square.cast(WHOLE)), *[F.max(g) for g in goes]
    ).first()
    return total * int(row[0] or 0) - int(row[1] or 0), [t for t, any_ in zip(turns, row[2:]) if any_]


def _frontier(links: DataFrame, after: DataFrame) -> DataFrame:
    """(v) of the tags in a community that someone left or joined, and their neighbours."""
    touched = after.filter("to <> c").select(F.explode(F.array("c", "to")).alias("to")).distinct()
    inner = after.join(touched, "to", "left_semi").select("v")
    outer = links.join(inner.select(F.col("v").alias("b")), "b", "left_semi").select(F.col("a").alias("v"))
    return stage(inner.union(outer).distinct(), "frontier")


def _round(links: DataFrame, state: DataFrame, total: int, turn: int, large: bool) -> DataFrame:
    """The state after the moves of a turn; stored."""
    to = F.when(_moves(state, turn), F.col("best")).otherwise(F.col("c"))
    after = state.select("v", "k", to.alias("to"), "c")
    moved = after.select("v", "k", F.col("to").alias("c"))
    if not large:
        return stage(_choices(links, moved, total), "communities")
    front = _frontier(links, after)
    # A tag outside has not moved, and nothing that it looks at has changed.
    rest = state.join(front, "v", "left_anti")
    step = stage(_choices(links, moved, total, front).unionByName(rest), "communities")
    unstage(front)
    return step


def _settled(links: DataFrame, start: DataFrame, total: int) -> DataFrame:
    """(v, k, c, ..) after moves from ``start`` (v, k, c) until no tag gains; stored."""
    large = links.limit(FRONTIER_LINKS + 1).count() > FRONTIER_LINKS
    state = stage(_choices(links, start, total), "communities")
    score, turns = _score(state, total, 0)
    turn = 0
    while turns:
        # Turns in which no tag would move are passed over.
        later = [t for t in turns if t >= turn]
        if not later:
            score, turns = _score(state, total, turn)
            continue
        turn = later[0] + 1
        step = _round(links, state, total, later[0], large)
        new_score, new_turns = _score(step, total, turn)
        if new_score > score:
            unstage(state)
            state, score, turns = step, new_score, new_turns
        else:
            unstage(step)
    return state


def find_communities(edges: DataFrame, levels: int | None = None) -> DataFrame:
    """(tag, label) for every vertex of (src, dst, weight); the label is a tag.

    Merging goes on until a level moves nothing; ``levels`` stops earlier. Within a
    level the moves go on until no tag gains, and every round and level that counts
    has raised the modularity. Each round is stored in the shared folder and
    replaces the one before.
    """
    sym = stage(both_ways(edges), "graph")
    total = sym.agg(F.sum("weight")).first()[0] or 0
    member = None
    for level in count():
        degree = stage(sym.groupBy("a").agg(F.sum("weight").alias("k")), "degrees")
        links = stage(sym.filter("a <> b").join(degree, "a"), "graph")
        state = _settled(links, degree.select(F.col("a").alias("v"), "k", F.col("a").alias("c")), total)
        unstage(links)
        unstage(degree)
        moves = state.select("v", "c")
        if member is None:
            member = moves.toDF("tag", "label")
        else:
            wider = stage(
                member.join(moves.toDF("label", "next"), "label").select(
                    "tag", F.col("next").alias("label")
                ),
                "communities",
            )
            unstage(member)
            member = wider
        if level + 1 == levels or state.filter("v <> c").limit(1).count() == 0:
            break
        left, right = moves.toDF("a", "ca"), moves.toDF("b", "cb")
        merged = sym.join(left, "a").join(right, "b").groupBy("ca", "cb")
        smaller = stage(
            merged.agg(F.sum("weight").alias("weight")).toDF("a", "b", "weight"), "graph"
        )
        unstage(sym)
        sym = smaller
    return member


def number_communities(member: DataFrame, label: str = "label") -> DataFrame:
    """(label, community, size): indexes by falling size, largest 0.

    Communities of one size follow in md5 order of their label. Only the table
    of distinct sizes, at most about sqrt(2V) rows, is numbered in one piece.
    """
    sizes = member.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    inside = hash_rank(sizes, ["size"], label, rank="place", total="same")
    by_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    larger = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    starts = by_size.select("size", F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("start"))
    return inside.join(starts, "size").select(
        label, (F.col("start") + F.col("place") - 1).cast("int").alias("community"), "size"
    )


def membership(member: DataFrame) -> DataFrame:
    """(tag, community) with communities numbered by size."""
    return member.join(number_communities(member), "label").select("tag", "community")


def community_text(members: DataFrame, per_row: int | None = None) -> DataFrame:
    """(community, part, size, members): tags of a community as blank-separated text.

    One text per community; with ``per_row`` a longer one continues in further parts.
    """
    placed = hash_rank(members, ["community"], "tag", rank="place", total="size")
    part = F.lit(0) if per_row is None else F.floor((F.col("place") - 1) / per_row).cast("int")
    part = part.alias("part")
    return placed.groupBy("community", "size", part).agg(
        F.array_join(F.sort_array(F.collect_list("tag")), " ").alias("members")
    )


def modularity(edges: DataFrame, member: DataFrame, label: str = "label") -> DataFrame:
    """One row: modularity of a partition, and of every tag alone."""
    sym = both_ways(edges)
    total = sym.agg(F.sum("weight").cast("double")).scalar()
    of_a = member.select(F.col("tag").alias("a"), F.col(label).alias("ca"))
    of_b = member.select(F.col("tag").alias("b"), F.col(label).alias("cb"))
    placed = sym.join(of_a, "a").join(of_b, "b")
    parts = placed.groupBy("ca").agg(
        F.sum("weight").cast("double").alias("degree"),
        F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0))
        .cast("double")
        .alias("inside"),
    )
    alone = sym.groupBy("a").agg(F.sum("weight").cast("double").alias("degree"))
    alone_q = alone.agg(-F.sum(F.pow(F.col("degree") / total, F.lit(2.0))))
    return parts.agg(
        F.sum(F.col("inside") / total - F.pow(F.col("degree") / total, F.lit(2.0))).alias(
            "modularity"
        ),
        F.count(F.lit(1)).alias("communities"),
    ).withColumn("modularity_alone", alone_q.scalar())


def community_features(
    df: DataFrame,
    id_col: str,
    tags_col: str,
    members: DataFrame,
    kind: str = "weighted",
    centrality: DataFrame | None = None,
) -> DataFrame:
    """(id, community, value) of the communities a post's tags touch.

    ``binary``: 1; ``weighted``: number of distinct tags; ``betweeness``: sum of
    their centrality. Unknown tags are ignored; absent communities are zero.
    """
    table = members
    if kind == "betweeness":
        table = members.join(centrality.select("tag", "centrality"), "tag", "left")
        value = F.sum(F.coalesce("centrality", F.lit(0.0)))
    elif kind == "weighted":
        value = F.count(F.lit(1)).cast("double")
    elif kind == "binary":
        value = F.lit(1.0)
    else:
        raise ValueError(f"unknown community feature: {kind}")
    each = df.select(id_col, F.explode_outer(tag_set(F.col(tags_col))).alias("tag"))
    known = each.join(broadcast_if_small(table), "tag")
    return known.groupBy(id_col, "community").agg(value.alias("value"))


def community_arrays(ids: DataFrame, long: DataFrame, id_col: str, k: int) -> DataFrame:
    """(id, features) with one array entry per community; for a modest ``k``."""
    entries = long.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("community", "value"))).alias("m")
    )
    cell = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))
    )
    return ids.join(entries, id_col, "left").select(id_col, cell.alias("features"))
