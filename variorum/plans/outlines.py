"""Outlines: conversations set as outlined pages and read back, so that SQL can say from the turns what must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.marks import SPACE
from ..query import Registry, table
from ..sources import outlines as O

registry = Registry()


def pages(spark, sf_dir: str) -> DataFrame:
    """conv_id and html: a conversation's first turn is the outermost node, each answer lies within it beside later questions; a line is a paragraph, and each node refers to the one before it and to a commentary."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.concat(F.lit("<p>"), F.replace(escaped, F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>"))
    node = F.format_string(
        '<div class="ybhDiv" id="T%dD01_%d"><div class="YBh_head"><span class="head_text" path="1.%d">%s</span></div><a class="ref" id="p%04da"></a>%s<a class="link2oth" id="T%dD01_%d"></a><a class="link2oth" id="X7D02_%d"></a>',
        "conv_id", "turn", "turn", F.coalesce("role", F.lit("")), "turn", lines, "conv_id", F.col("turn") - 1, "turn",
    )
    own = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", node.alias("html")))).alias("x"))
    first, rest = F.col("x")[0]["html"], F.transform(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda n: F.concat(n["html"], F.lit("</div>")))
    return own.select("conv_id", F.concat(F.lit("<html><body>"), first, F.array_join(rest, "\n"), F.lit("</div></body></html>")).alias("html"))


def nodes(spark, sf_dir: str) -> DataFrame:
    return O.outline(pages(spark, sf_dir), "conv_id", "html")


_NODES = f"""WITH c AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS root, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS number, trim(regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g')) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), n AS (SELECT *, CAST(conv_id AS VARCHAR) AS name, 'T' || conv_id || 'D01_' || turn AS node_id, 'T' || conv_id || 'D01_' || root AS top FROM c)"""


@registry.add(_NODES + """ SELECT name, number, node_id, 'T' || conv_id AS work, coalesce(role, '') AS head, '1.' || turn AS path, md5(said) AS digest, printf('p%04da', turn) AS page, CASE WHEN turn = root THEN '' ELSE top END AS parent FROM n""")
def a10_outline(spark, sf_dir):
    """Every node of the pages with its head, path, text, page and the node around it."""
    n = nodes(spark, sf_dir).withColumnRenamed("conv_id", "name")
    return n.select("name", "number", "node_id", "work", "head", "path", F.md5("text").alias("digest"), "page", F.coalesce(F.element_at(F.col("ancestors"), F.when(F.size("ancestors") > 0, -1)), F.lit("")).alias("parent"))


@registry.add(_NODES + " SELECT top AS ancestor, node_id AS descendant, 1 AS distance FROM n WHERE turn > root UNION ALL SELECT node_id, node_id, 0 FROM n")
def a10_closure(spark, sf_dir):
    """Ancestors and descendants, from which subtrees and ways from the root are read."""
    return O.closure(nodes(spark, sf_dir)).select("ancestor", "descendant", "distance")


@registry.add(_NODES + """, l AS (SELECT conv_id, root, turn, node_id, top FROM n)
SELECT node_id, 'T' || conv_id || 'D01_' || (turn - 1) AS link, true AS to_base FROM l WHERE turn > 0 AND node_id <> top UNION ALL SELECT node_id, 'X7D02_' || turn, false FROM l WHERE node_id <> top
UNION ALL SELECT top, 'T' || conv_id || 'D01_' || (turn - 1), true FROM l WHERE turn > 0 UNION ALL SELECT top, 'X7D02_' || turn, false FROM l""")
def a10_node_links(spark, sf_dir):
    """References of nodes (the outermost has those of all within it) to their own work and to commentaries."""
    n = nodes(spark, sf_dir)
    x = O.links(n.withColumn("own", F.col("work")), "", "own")
    return x.select("node_id", "link", (F.col("work") == F.col("own")).alias("to_base"))


@registry.add(_NODES + """, v AS (SELECT 'W' || (conv_id % 10) AS work, CAST(conv_id // 10 + 1 AS BIGINT) AS volume, count(*) AS n FROM n WHERE said <> '' GROUP BY ALL),
w AS (SELECT work, max(volume) + 1 AS last FROM v GROUP BY work), a AS (SELECT work, unnest(range(1, last + 1)) AS volume FROM w)
SELECT work, volume, coalesce(n, 0) AS n_segments, n IS NOT NULL AS available FROM a LEFT JOIN v USING (work, volume)""")
def d13_volume_catalogue(spark, sf_dir):
    """The volumes of works (a conversation is one), those without text too, and one more than there are."""
    n = nodes(spark, sf_dir).select(F.concat(F.lit("W"), (F.col("conv_id").cast("long") % 10).cast("string")).alias("work"), F.floor(F.col("conv_id").cast("long") / 10).alias("volume"), "number", "node_id", "head", "path", "text", "page", "links")
    records = O.volumes(n.withColumn("volume", F.col("volume") + 1), "work", "volume")
    return O.catalogue(records, records.groupBy("work").agg((F.max("volume") + 1).alias("n_volumes")))
