"""Mixing sources to target weights (operator 9): min-cost flow over membership patterns, then seeded documents.

Documents are added up by membership pattern (the set of sources that hold them). Each pattern offers its words in
tiers, one for each repetition, at rising unit costs; each source asks for its quota. A successive-shortest-path flow
on this small graph decides how much of each pattern goes out how often and to which source. Documents then fill a
pattern's flow in a seeded order: everyone's whole repetitions first, the last partial one up to a cut in that order.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _run

WEIGHTS = (5.0, 2.0, 1.0)
#: More distinct patterns than this is an error: the flow graph and its broadcast are bounded by it.
MAX_PATTERNS = 100_000
#: Classes of the seeded order in which words are summed before single documents are looked at.
BUCKETS = 1 << 14


def word_count(text_column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words for each source (in order): by weight, at most ``most`` times its size, the excess shared again."""
    n = len(sizes)
    w = [weights[i % len(weights)] for i in range(n)]
    out, full = [0.0] * n, [s == 0 for s in sizes]
    left = share * sum(sizes)
    while left > 0 and not all(full):
        unit = left / sum(x for x, f in zip(w, full, strict=True) if not f)
        over = [i for i in range(n) if not full[i] and w[i] * unit > most * sizes[i]]
        if not over:
            for i in range(n):
                if not full[i]:
                    out[i] = w[i] * unit
            break
        for i in over:
            out[i], full[i] = most * sizes[i], True
            left -= out[i]
    return out


def min_cost_flow(capacity: list[int], members: list[tuple[int, ...]], quotas: list[float], most: int = 2) -> dict[tuple[int, int], float]:
    """Words from each pattern to each source it belongs to: as near to the quotas as can be, repetitions as few and
    as even as can be (the unit cost of the r-th repetition of a pattern is r²).

    Successive shortest paths with potentials from patterns to sources; ties go to lower numbers.
    """
    n_p, n_s = len(capacity), len(quotas)
    s, t = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]
    to, cap, cost = [], [], []

    def edge(a: int, b: int, c: float, w: float) -> None:
        for u, v, x, y in ((a, b, c, w), (b, a, 0.0, -w)):
            graph[u].append(len(to))
            to.append(v)
            cap.append(x)
            cost.append(y)

    for p in range(n_p):
        for r in range(1, most + 1):
            edge(s, p, float(capacity[p]), float(r * r))
        for q in members[p]:
            edge(p, n_p + q, math.inf, 0.0)
    for q in range(n_s):
        edge(n_p + q, t, quotas[q], 0.0)
    potential = [0.0] * len(graph)
    eps = 1e-9 * max(1.0, sum(quotas))
    while True:
        dist, back = [math.inf] * len(graph), [-1] * len(graph)
        dist[s] = 0.0
        heap = [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if cap[e] > eps and (nd := d + cost[e] + potential[u] - potential[to[e]]) < dist[to[e]] - 1e-12:
                    dist[to[e]], back[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if back[t] < 0:
            break
        potential = [p + d if d < math.inf else p for p, d in zip(potential, dist, strict=True)]
        push, v = math.inf, t
        while v != s:
            push, v = min(push, cap[back[v]]), to[back[v] ^ 1]
        v = t
        while v != s:
            cap[back[v]] -= push
            cap[back[v] ^ 1] += push
            v = to[back[v] ^ 1]
    return {(p, to[e] - n_p): cap[e ^ 1] for p in range(n_p) for e in graph[p] if n_p <= to[e] < n_p + n_s and cap[e ^ 1] > 0}


def mix(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 29, buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of ``df``: doc_id, source, size, source_size, target, taken, copies.

    ``source_column`` is a string, or an array of strings for documents that several sources hold (null or empty: the
    null source; order and repeats in it do not count). A source's size is the words of all documents it holds. Null
    texts have size 0; those of size 0 are never taken. Rows that repeat id and text are rows of their own and fall
    on the same place of the seeded order, where the cut may divide them. An empty table gives no rows.
    """
    spark = df.sparkSession
    listed = dict(df.dtypes)[source_column].startswith("array")
    pattern = F.sort_array(F.array_distinct(F.coalesce(F.col(source_column), F.array().cast("array<string>"))) if listed else F.array(F.col(source_column)), asc=False)
    pattern = F.when(F.size(pattern) == 0, F.array(F.lit(None).cast("string"))).otherwise(pattern)
    slim = df.select(F.col(id_column).alias("doc_id"), pattern.alias("pattern"), word_count(text_column).alias("size"), F.pmod(_run.seeded(seed, F.col(id_column), F.crc32(_run.utf8(text_column))), F.lit(1 << 62)).alias("place"))
    slim = _run.cut(slim.withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int")))
    sums = _run.cut(slim.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")))
    found = sums.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found.sort(key=lambda r: [(x is None, x or "") for x in r["pattern"]])
    names = sorted({x for r in found for x in r["pattern"]}, key=lambda x: (x is None, x or ""))
    number = {x: i for i, x in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for x in r["pattern"]:
            sizes[number[x]] += r["words"]
    quota = targets(sizes, weights, share, most)
    flow = min_cost_flow([r["words"] for r in found], [tuple(sorted(number[x] for x in r["pattern"])) for r in found], quota, most)
    out_of = [0.0] * len(found)
    for (p, _), v in flow.items():
        out_of[p] += v
    plans = []
    for p, r in enumerate(found):
        whole = min(most, int(out_of[p] / r["words"] + 1e-9)) if r["words"] else 0
        first = min(r["pattern"], key=lambda x: (x is None, x or ""))
        plans.append((r["pattern"], first, sizes[number[first]], float(quota[number[first]]), whole, float(max(0.0, out_of[p] - whole * r["words"]))))
    # As many rows as patterns, bounded above.
    plan = F.broadcast(spark.createDataFrame(plans, "pattern array<string>, source string, source_size long, target double, whole int, part double").withColumnRenamed("pattern", "p"))
    # The bucket of the seeded order in which a pattern's partial repetition ends, from sums alone.
    before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = sums.withColumn("before", before).join(plan, F.col("pattern").eqNullSafe(F.col("p"))).filter((F.col("before") <= F.col("part")) & (F.col("before") + F.col("words") > F.col("part")) & (F.col("part") > 0))
    # One cut for each pattern.
    cut_at = F.broadcast(edges.select(F.col("pattern").alias("cp"), F.col("bucket").alias("cut_bucket"), F.col("part") - F.col("before")))
    cut_at = cut_at.toDF("cp", "cut_bucket", "room")
    planned = slim.join(plan, F.col("pattern").eqNullSafe(F.col("p"))).join(F.broadcast(cut_at), F.col("pattern").eqNullSafe(F.col("cp")), "left")
    inside = F.col("bucket") == F.col("cut_bucket")
    fits = F.when(F.col("part") <= 0, False).when(F.col("cut_bucket").isNull(), True).otherwise(F.col("bucket") < F.col("cut_bucket"))
    # Only the documents of the cut's own bucket are ordered one by one.
    run_sum = F.sum("size").over(Window.partitionBy("pattern").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge_rows = planned.filter(inside).withColumn("fits", run_sum - F.col("size") / 2 <= F.col("room"))
    rest = planned.filter(~F.coalesce(inside, F.lit(False))).withColumn("fits", fits)
    both = edge_rows.unionByName(rest)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.lit(most), F.col("whole") + F.col("fits").cast("int")))
    return both.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), "place")


def mixture(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 29, **options) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken; all columns as they are."""
    other, key, spot, copies, alike, at = _run.fresh(df, "id_", "key_", "spot_", "copies_", "alike_", "at_")
    plan = mix(df, id_column, text_column, seed=seed, **options)
    takes = plan.filter("copies > 0").groupBy(F.col("doc_id").alias(other), F.col("place").alias(key)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(alike))
    takes = _run.cut(takes)
    own = df.withColumn(spot, F.pmod(_run.seeded(seed, F.col(id_column), F.crc32(_run.utf8(text_column))), F.lit(1 << 62)))
    joined = own.join(takes, own[id_column].eqNullSafe(takes[other]) & (F.col(spot) == F.col(key)))
    each = F.col(copies)
    if not takes.filter(F.col(alike) > 1).isEmpty():
        # Rows alike in id and text share what their like takes, evenly.
        like = Window.partitionBy(own[id_column], spot)
        joined = joined.withColumn(alike, F.count(F.lit(1)).over(like)).withColumn(at, F.row_number().over(like.orderBy(F.lit(0))))
        each = F.floor(F.col(copies) / F.col(alike)) + (F.col(at) <= F.col(copies) % F.col(alike)).cast("int")
    return joined.withColumn(at, F.explode(F.array_repeat(F.lit(1), each.cast("int")))).select(*df.columns)
