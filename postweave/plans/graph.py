"""Tag graph, communities, centrality and the features they give."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave.operators import centrality as ce
from postweave.operators import communities as co
from postweave.operators import tag_graph as tg
from postweave.plans.registry import query
from postweave.plans.views import (
    PAGE_TAGS_SQL,
    TAGGED_SQL,
    page_tags,
    tag_rows_sql,
    tagged,
)
from postweave.session import scratch_path, stage
from postweave.sources import store


def _edges_sql(view: str, source: str) -> str:
    return f"""{view}, {source}_rows AS ({tag_rows_sql(source)}),
      {source}_edges AS MATERIALIZED (SELECT x.tag AS src, y.tag AS dst, count(*) AS weight
        FROM {source}_rows x JOIN {source}_rows y ON x.id = y.id AND x.tag < y.tag GROUP BY 1, 2)"""


_ORDERS = _edges_sql(TAGGED_SQL, "tagged")
_PAGES = _edges_sql(PAGE_TAGS_SQL, "page_tags")


def page_edges(spark, sf, weighted=True):
    return tg.cooccurrence_edges(page_tags(spark, sf), "tags", weighted)


@query("tag_edges_weighted", f"WITH {_ORDERS} SELECT * FROM tagged_edges")
def tag_edges_weighted(spark, sf):
    return tg.cooccurrence_edges(tagged(spark, sf), "tags")


@query("tag_edges_distinct", f"WITH {_ORDERS} SELECT src, dst, 1 AS weight FROM tagged_edges")
def tag_edges_distinct(spark, sf):
    return tg.cooccurrence_edges(tagged(spark, sf), "tags", weighted=False)


@query("page_edges_weighted", f"WITH {_PAGES} SELECT * FROM page_tags_edges")
def page_edges_weighted(spark, sf):
    return page_edges(spark, sf)


@query(
    "tag_vertices",
    f"""WITH {_PAGES} SELECT src AS tag FROM page_tags_edges
        UNION SELECT dst FROM page_tags_edges""",
)
def tag_vertices(spark, sf):
    return tg.vertices(page_edges(spark, sf))


def _score_sql(sym: str, state: str) -> str:
    """2m * (links inside) - squared degrees of a state (v, c, k)."""
    return f"""(SELECT (SELECT m2 FROM whole) * coalesce((SELECT sum(g.w) FROM {sym} g JOIN {state} x ON x.v = g.a
      JOIN {state} y ON y.v = g.b WHERE x.c = y.c AND g.a <> g.b), 0)
      - (SELECT sum(CAST(d AS HUGEINT) * d) FROM (SELECT sum(k) AS d FROM {state} GROUP BY c)))"""


def _round_sql(sym: str, before: str, after: str, turn: int) -> str:
    below = co.TURNS[turn % len(co.TURNS)]
    goes = f"substr(md5(v || ':{turn}'), 1, 1) < '{below}'"
    if below is None:
        goes = f"v = (SELECT v FROM {after}_best WHERE loss < own_loss ORDER BY loss - own_loss, v LIMIT 1)"
    return f"""
  {after}_links AS (SELECT v, c, sum(w) AS inside FROM (
      SELECT g.a AS v, s.c, g.w FROM {sym} g JOIN {before} s ON s.v = g.b WHERE g.a <> g.b
      UNION ALL SELECT v, c, 0 FROM {before}) GROUP BY v, c),
  {after}_sizes AS (SELECT c, sum(k) AS d FROM {before} GROUP BY c),
  {after}_all AS (SELECT l.v, l.c, s.c AS own, s.k,
      CAST(s.k AS HUGEINT) * (z.d - CASE WHEN l.c = s.c THEN s.k ELSE 0 END)
        - (SELECT m2 FROM whole) * l.inside AS loss
    FROM {after}_links l JOIN {before} s ON s.v = l.v JOIN {after}_sizes z ON z.c = l.c),
  {after}_best AS MATERIALIZED (SELECT * FROM (SELECT *,
        row_number() OVER (PARTITION BY v ORDER BY loss, c) AS rn,
        min(CASE WHEN c = own THEN loss END) OVER (PARTITION BY v) AS own_loss
      FROM {after}_all) WHERE rn = 1),
  {after}_new AS MATERIALIZED (SELECT v, CASE WHEN loss < own_loss AND {goes} THEN c ELSE own END AS c, k
    FROM {after}_best),
  {after} AS MATERIALIZED (SELECT n.v, CASE WHEN gained THEN n.c ELSE b.c END AS c, n.k
    FROM {after}_new n JOIN {before} b USING (v),
      (SELECT {_score_sql(sym, after + '_new')} > {_score_sql(sym, before)} AS gained))"""


# Rounds of each level that the SQL spells out; rounds after the last gain change
# nothing, so these must only be enough for the tables the SQL runs on.
SQL_ROUNDS = (18, 16, 8, 3)


def _communities_sql(edges: str, rounds: tuple = SQL_ROUNDS) -> str:
    """The local moves round by round; ends in members(tag, community)."""
    parts = [
        f"""sym0 AS MATERIALIZED (SELECT src AS a, dst AS b, weight AS w FROM {edges}
    UNION ALL SELECT dst, src, weight FROM {edges})""",
        "whole AS (SELECT CAST(sum(w) AS HUGEINT) AS m2 FROM sym0)",
    ]
    levels = len(rounds)
    for level in range(levels):
        sym, state = f"sym{level}", f"st{level}_0"
        parts.append(
            f"{state} AS MATERIALIZED (SELECT a AS v, a AS c, sum(w) AS k FROM {sym} GROUP BY a)"
        )
        for turn in range(rounds[level]):
            after = f"st{level}_{turn + 1}"
            parts.append(_round_sql(sym, state, after, turn))
            state = after
        if level == 0:
            parts.append(f"mem0 AS (SELECT v AS tag, c AS label FROM {state})")
        else:
            parts.append(
                f"""mem{level} AS (SELECT m.tag, s.c AS label
    FROM mem{level - 1} m JOIN {state} s ON s.v = m.label)"""
            )
        if level < levels - 1:
            parts.append(
                f"""sym{level + 1} AS MATERIALIZED (SELECT x.c AS a, y.c AS b, sum(g.w) AS w
    FROM {sym} g JOIN {state} x ON x.v = g.a JOIN {state} y ON y.v = g.b GROUP BY 1, 2)"""
            )
    last = f"mem{levels - 1}"
    parts.append(
        f"""numbered AS (SELECT label, count(*) AS size,
      row_number() OVER (ORDER BY count(*) DESC, md5(label), label) - 1 AS community
    FROM {last} GROUP BY label),
  members AS MATERIALIZED (SELECT tag, community FROM {last} JOIN numbered USING (label))"""
    )
    return ",\n  ".join(parts)


_COMMUNITIES = f"{_PAGES}, {_communities_sql('page_tags_edges')}"


def page_members(spark, sf, edges=None):
    edges = stage(page_edges(spark, sf), "edges") if edges is None else edges
    return co.membership(co.find_communities(edges))


@query("tag_communities", f"WITH {_COMMUNITIES} SELECT tag, community FROM members")
def tag_communities(spark, sf):
    path = scratch_path(spark, "memberships")
    store.write_table(page_members(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "tag_communities_unweighted",
    f"""WITH {_PAGES}, plain AS (SELECT src, dst, 1 AS weight FROM page_tags_edges),
      {_communities_sql('plain')} SELECT tag, community FROM members""",
)
def tag_communities_unweighted(spark, sf):
    return page_members(spark, sf, stage(page_edges(spark, sf, weighted=False), "edges"))


@query(
    "community_sizes",
    f"""WITH {_COMMUNITIES} SELECT community, 0 AS part, count(*) AS size,
          string_agg(tag, ' ' ORDER BY tag) AS members FROM members GROUP BY community""",
)
def community_sizes(spark, sf):
    return co.community_text(page_members(spark, sf))


@query(
    "community_modularity",
    f"""WITH {_COMMUNITIES}, placed AS (SELECT g.w, g.a, x.community AS ca, y.community AS cb
          FROM sym0 g JOIN members x ON x.tag = g.a JOIN members y ON y.tag = g.b),
        parts AS (SELECT ca, sum(w) AS d, sum(CASE WHEN ca = cb THEN w ELSE 0 END) AS inside
          FROM placed GROUP BY ca),
        alone AS (SELECT a, sum(w) AS d FROM sym0 GROUP BY a)
        SELECT round(sum(CAST(inside AS DOUBLE) / m2 - (CAST(d AS DOUBLE) / m2) ** 2), 9)
            AS modularity, count(*) AS communities,
          (SELECT round(-sum((CAST(d AS DOUBLE) / m2) ** 2), 9) FROM alone, whole)
            AS modularity_alone
        FROM parts, whole""",
)
def community_modularity(spark, sf):
    edges = stage(page_edges(spark, sf), "edges")
    score = co.modularity(edges, page_members(spark, sf, edges), "community")
    return score.withColumns(
        {c: F.round(c, 9) for c in ("modularity", "modularity_alone")}
    )


# Walks of each length from every tag: the first length reaching a tag is its
# distance, and the number of such walks the number of shortest paths.
_BETWEENNESS = """links AS MATERIALIZED (SELECT src AS a, dst AS b FROM page_tags_edges
    UNION ALL SELECT dst, src FROM page_tags_edges),
  verts AS MATERIALIZED (SELECT DISTINCT a AS tag FROM links),
  walks AS (
    SELECT 0 AS h, tag AS s, tag AS v, CAST(1 AS DOUBLE) AS n FROM verts
    UNION ALL
    SELECT w.h + 1, w.s, l.b, sum(w.n) FROM walks w JOIN links l ON l.a = w.v
    WHERE w.h < 24 GROUP BY w.h + 1, w.s, l.b),
  paths AS MATERIALIZED (
    SELECT s, v, min(h) AS d, arg_min(n, h) AS sigma FROM walks GROUP BY s, v),
  through AS (SELECT p.v AS tag, sum(p.sigma * q.sigma / r.sigma) AS part
    FROM paths p JOIN paths q ON q.s = p.v JOIN paths r ON r.s = p.s AND r.v = q.v
    WHERE p.s <> p.v AND q.s <> q.v AND p.d + q.d = r.d GROUP BY p.v),
  central AS MATERIALIZED (SELECT tag, coalesce(part, 0) / ((n - 1.0) * (n - 2.0)) AS centrality
    FROM verts LEFT JOIN through USING (tag), (SELECT count(*) AS n FROM verts))"""


@query(
    "tag_betweenness",
    f"""WITH RECURSIVE {_PAGES}, {_BETWEENNESS}
        SELECT tag, round(centrality, 6) AS centrality FROM central""",
)
def tag_betweenness(spark, sf):
    scores = ce.betweenness(stage(page_edges(spark, sf, weighted=False), "edges"))
    return scores.withColumn("centrality", F.round("centrality", 6))


# Least costs by one more link a step, kept as they are by a link of cost 0 to oneself;
# then the numbers of walks along links that lie on a cheapest path.
STEPS = 40
_BY_COST = f"""costs AS MATERIALIZED (SELECT src AS a, dst AS b, weight AS w FROM page_tags_edges
    UNION ALL SELECT dst, src, weight FROM page_tags_edges),
  verts AS MATERIALIZED (SELECT DISTINCT a AS tag FROM costs),
  hops AS MATERIALIZED (SELECT a, b, w FROM costs UNION ALL SELECT tag, tag, 0 FROM verts),
  least AS (
    SELECT 0 AS h, tag AS s, tag AS v, CAST(0 AS BIGINT) AS c FROM verts
    UNION ALL
    SELECT l.h + 1, l.s, g.b, CAST(min(l.c + g.w) AS BIGINT) FROM least l JOIN hops g ON g.a = l.v
    WHERE l.h < {STEPS} GROUP BY l.h + 1, l.s, g.b),
  dist AS MATERIALIZED (SELECT s, v, c AS d FROM least WHERE h = {STEPS}),
  tight AS MATERIALIZED (SELECT x.s, g.a, g.b FROM dist x JOIN costs g ON g.a = x.v
    JOIN dist y ON y.s = x.s AND y.v = g.b WHERE x.d + g.w = y.d),
  walks AS (
    SELECT 0 AS h, tag AS s, tag AS v, CAST(1 AS DOUBLE) AS n FROM verts
    UNION ALL
    SELECT w.h + 1, w.s, t.b, sum(w.n) FROM walks w JOIN tight t ON t.s = w.s AND t.a = w.v
    WHERE w.h < {STEPS} GROUP BY w.h + 1, w.s, t.b),
  ways AS (SELECT s, v, sum(n) AS sigma FROM walks GROUP BY s, v),
  paths AS MATERIALIZED (SELECT s, v, d, sigma FROM dist JOIN ways USING (s, v)),
  {_BETWEENNESS[_BETWEENNESS.index('through AS'):]}"""


@query(
    "tag_betweenness_weighted",
    f"""WITH RECURSIVE {_PAGES}, {_BY_COST}
        SELECT tag, round(centrality, 6) AS centrality FROM central""",
)
def tag_betweenness_weighted(spark, sf):
    scores = ce.betweenness(stage(page_edges(spark, sf), "edges"), weighted=True)
    return scores.withColumn("centrality", F.round("centrality", 6))


def _features(kind, value_sql):
    recursive, extra, join = "", "", ""
    if kind == "betweeness":
        recursive, extra, join = "RECURSIVE ", f", {_BETWEENNESS}", "JOIN central USING (tag)"
    sql = f"""WITH {recursive}{_COMMUNITIES}{extra}
      SELECT id, community, round({value_sql}, 6) AS value
      FROM page_tags_rows JOIN members USING (tag) {join} GROUP BY id, community"""

    @query(f"community_features_{kind}", sql)
    def run(spark, sf):
        edges = stage(page_edges(spark, sf), "edges")
        members = stage(page_members(spark, sf, edges), "members")
        central = stage(ce.betweenness(edges), "central") if kind == "betweeness" else None
        long = co.community_features(page_tags(spark, sf), "id", "tags", members, kind, central)
        return long.withColumn("value", F.round("value", 6))

    return run


community_features_binary = _features("binary", "CAST(1 AS DOUBLE)")
community_features_weighted = _features("weighted", "CAST(count(*) AS DOUBLE)")
community_features_betweeness = _features("betweeness", "sum(centrality)")
