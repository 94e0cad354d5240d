"""Audit of how corpus filters interact, by decision diagrams over failure masks.

Spark reduces a part of the corpus to the counts of its failure masks, 32 at most with five
filters.  From these a decision diagram is built for each part: one level a filter, every node with a
pass and a fail edge, equal nodes shared, each node with the counts of all documents below it.
Two neighbouring levels change places by an exchange inside the nodes of the upper one.  All orders
of the filters are visited by such exchanges alone (plain changes), and the path of pass edges
from the root tells, step by step, what a filter removes and what is left.

Texts are read once.  A document fails E when a smaller id has its text; the smallest id of a
text is a combined aggregate, and it meets its row by (text, id), so a text in a third of all rows is
no hot key.

Defined results: a null text is empty and fails A only (and E behind an equal one); a null lang is
part ''; a null ``doc_id`` never fails E, is no smaller id and has no labels; rows that repeat an
id and text don't fail E by each other; a document counts as good or toxic when any of its label rows
says so; an empty table gives no rows, empty labels give zeros; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import settle, table
from winnow.llm.registry import query
from winnow.llm.sharding import text_digest

FILTERS = "ABCDE"
Weight = tuple[int, int, int]
RESULT = ("part string, filter_order string, step int, kept bigint, removed bigint, "
          "redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, "
          "shapley bigint")


# ---- decision diagram ---------------------------------------------------------------------

class Diagram:
    """Shared diagram of masks with weights; ``order`` names the variable of each level.

    Levels are never skipped: a node whose edges meet still stands, so that weights add up.
    """

    def __init__(self, masks: dict[int, Weight], variables: int):
        self.order = list(range(variables))
        self.weight: list[Weight] = []
        self.edges: list[dict[int, tuple[int, int]]] = [{} for _ in self.order]
        self._ids: list[dict] = [{} for _ in range(variables + 1)]  # nodes by content, by level
        below = [self._leaf(masks.get(_reversed(i, variables), (0, 0, 0)))
                 for i in range(1 << variables)]
        for level in reversed(range(variables)):
            below = [self._node(level, below[i], below[i + 1]) for i in range(0, len(below), 2)]
        self.root = below[0]

    def _leaf(self, weight: Weight) -> int:
        if weight not in self._ids[-1]:
            self.weight.append(weight)
            self._ids[-1][weight] = len(self.weight) - 1
        return self._ids[-1][weight]

    def _node(self, level: int, passed: int, failed: int) -> int:
        key = (passed, failed)
        if key not in self._ids[level]:
            a, b = self.weight[passed], self.weight[failed]
            self.weight.append((a[0] + b[0], a[1] + b[1], a[2] + b[2]))
            self._ids[level][key] = len(self.weight) - 1
            self.edges[level][len(self.weight) - 1] = key
        return self._ids[level][key]

    def exchange(self, level: int) -> None:
        """Variables of ``level`` and the next one change places.

        A node of the upper level stands for the same documents as before, so it keeps its
        number and nothing above it changes; the lower level is made anew.
        """
        lower = self.edges[level + 1]
        self.edges[level + 1], self._ids[level + 1] = {}, {}
        for node, (passed, failed) in self.edges[level].items():
            (pp, pf), (fp, ff) = lower[passed], lower[failed]
            self.edges[level][node] = (self._node(level + 1, pp, fp),
                                       self._node(level + 1, pf, ff))
        self._ids[level] = {key: node for node, key in self.edges[level].items()}
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, Weight, Weight]]:
        """(variable, weight removed, weight kept) along the path of passes."""
        out, node = [], self.root
        for level, variable in enumerate(self.order):
            node, failed = self.edges[level][node]
            out.append((variable, self.weight[failed], self.weight[node]))
        return out


def _reversed(bits: int, width: int) -> int:
    """The first variable decides at the top, so it is the highest bit of a leaf's place."""
    return sum(1 << k for k in range(width) if bits >> (width - 1 - k) & 1)


def plain_changes(n: int) -> Iterator[int]:
    """Places of the exchanges of neighbours that visit every order of ``n`` things once."""
    if n < 2:
        return
    down = True
    for place in [*plain_changes(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if place is not None:
            yield place + down  # the largest thing stands at the front after a sweep down
        down = not down


def audit_masks(masks: dict[int, Weight], names: Sequence[str] = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    diagram = Diagram(masks, len(names))
    found = {tuple(diagram.order): diagram.steps()}
    for place in plain_changes(len(names)):
        diagram.exchange(place)
        found[tuple(diagram.order)] = diagram.steps()
    fails, unique, total = {}, {}, dict.fromkeys(range(len(names)), 0)
    for steps in found.values():
        fails[steps[0][0]] = steps[0][1][0]  # nothing is removed before the first step
        unique[steps[-1][0]] = steps[-1][1][0]  # what reaches the last step passes all others
        for variable, removed, _ in steps:
            total[variable] += removed[0]
    return [("".join(names[v] for v in order), n, kept[0], removed[0], fails[v] - removed[0],
             unique[v], removed[1], removed[2], total[v])
            for order, steps in sorted(found.items())
            for n, (v, removed, kept) in enumerate(steps, 1)]


# ---- masks --------------------------------------------------------------------------------

def _bits(fails: Sequence[Column]) -> Column:
    return sum((f.cast("int") * F.lit(1 << k) for k, f in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the filters they fail, first in bit 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"),
                        F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "").alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    own = _bits([n < 200, 100 * distinct.cast("bigint") < 50 * n.cast("bigint"),
                 100 * capitals.cast("bigint") > 3 * F.length("text").cast("bigint"),
                 F.col("text").rlike("[#$%&*|]")])
    rows = settle(words.select("doc_id", "part", own.alias("own"),
                               text_digest(F.col("text")).alias("digest"))
                  .groupBy("doc_id", "digest", "part", "own").agg(F.count("*").alias("n")))
    first = (rows.filter(F.col("doc_id").isNotNull()).groupBy("digest")
             .agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True)))
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    marked = rows.join(first, ["digest", "doc_id"], "left").withColumn(
        "mask", F.col("own") + copy.cast("int") * F.lit(16))
    said = labels.groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("_good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("_toxic"))
    marked = marked.join(said.filter("_good + _toxic > 0"), "doc_id", "left")

    def among(mark: str) -> Column:
        return F.sum(F.col("n") * F.coalesce(mark, F.lit(0)))

    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), among("_good").alias("good"), among("_toxic").alias("toxic"))


def audit(masks: DataFrame) -> DataFrame:
    """Every order and step of every part; a part is 32 rows of counts at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in
                  zip(pdf["mask"], pdf["n"], pdf["good"], pdf["toxic"])}
        part = pdf["part"].iloc[0]
        return pd.DataFrame([(part, *row) for row in audit_masks(counts)],
                            columns=[c.split()[0] for c in RESULT.split(", ")])

    return masks.groupBy("part").applyInPandas(run, RESULT)


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
      FROM labels GROUP BY doc_id),
f AS (SELECT t.doc_id, part, (len(ws) < 200)::INT
        + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
        + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x))::INT
        + 8 * regexp_matches(x, '[#$%&*|]')::INT
        + 16 * coalesce(min(t.doc_id) OVER (PARTITION BY x) < t.doc_id, false)::INT AS mask
      FROM t),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good,
             sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT [v1.c, v2.c, v3.c, v4.c, v5.c] AS cs, [v1.b, v2.b, v3.b, v4.b, v5.b] AS bs
      FROM v v1, v v2, v v3, v v4, v v5 WHERE v1.b + v2.b + v3.b + v4.b + v5.b = 31
        AND len(list_distinct([v1.c, v2.c, v3.c, v4.c, v5.c])) = 5),
p AS (SELECT array_to_string(cs, '') AS filter_order, step::INTEGER AS step, cs[step] AS c, bs[step] AS bit,
             coalesce(list_sum(bs[1:step - 1]), 0)::INTEGER AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, any_value(c) AS c,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM m, p GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, c)::BIGINT AS shapley
FROM r
"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failure_masks(
        table(spark, sf_dir, "documents").select("doc_id", "text", "lang"),
        table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))
