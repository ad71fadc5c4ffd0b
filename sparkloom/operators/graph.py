"""Lookups, bounded traversal, weighted propagation and centrality over edge tables, batched over many seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import few, written

PRIORS = {"import": 0.12, "call": 0.28, "inherit": 0.32, "descriptor": 0.34, "config-ref": 0.41, "migration-of": 0.18, "test-of": 0.05}
OTHER_PRIOR, DECAY, DAMPING = 0.1, 0.82, 0.85
#: Edges of a source under one key of PageRank's partitions.
KEY_EDGES = 1_000_000
#: Seeds that walk together at most, and steps around them that a task holds.
GROUP_SEEDS, GROUP_STEPS = 1000, 8_000_000


def prior(edge_type: Column) -> Column:
    out = F.lit(OTHER_PRIOR)
    for name, value in PRIORS.items():
        out = F.when(edge_type == name, value).otherwise(out)
    return out


def find_bare(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (ref) with the fqn of the only node of that name; none if there are several."""
    only = nodes.groupBy("name").agg(F.min("fqn").alias("fqn"), F.count("*").alias("n")).filter("n = 1")
    return refs.join(only, refs.ref == only.name, "left").select("ref", "fqn")


def find_dotted(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """refs with the first node (by node_ord) whose fqn is the ref, or ends with a dot and the ref.

    Every dotted tail of a fqn is a key, so the join is one of equal keys.
    """
    parts = F.split("fqn", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = nodes.select("fqn", "node_ord", F.explode(tails).alias("ref"))
    return refs.join(keys, "ref", "left").groupBy("ref").agg(F.min_by("fqn", "node_ord").alias("fqn"))


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst, ...) as it stands, turned, or both."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return {"out": edges, "in": turned, "both": edges.unionByName(turned)}[direction]


def _groups(starts: DataFrame) -> DataFrame:
    """starts (seed, node) with grp: seeds that are next to each other by name, with numbers at its end by value, share one, since
    such often have neighbours in common. Any grouping gives the same rows."""
    cores, name = starts.sparkSession.sparkContext.defaultParallelism, F.col("seed").cast("string")
    seeds = starts.select("seed").filter("seed is not null").distinct()
    n = seeds.count()
    size = min(GROUP_SEEDS, max(64, -(-n // (2 * cores))))
    own = seeds.repartitionByRange(max(1, -(-n // size)), F.regexp_replace(name, "[0-9]+$", ""), F.regexp_extract(name, "([0-9]+)$", 1).try_cast("decimal(38,0)"), "seed")
    return written(starts.join(written(own.withColumn("grp", F.spark_partition_id())), "seed"))


def _walked(steps: DataFrame, starts: DataFrame, hops: int, walk, schema: str, rest) -> DataFrame:
    """walk(a group's starts, the steps around it) of all groups of seeds.

    All pairs of seeds and nodes on the way would be far more rows than are found. So the steps (src, dst, ...) that lead on from
    what a group's seeds reach are gathered once for all of them, and each seed walks there on its own. A group whose
    surroundings are too large for a task goes to rest(its starts) instead.
    """
    starts = _groups(starts)
    need = front = written(starts.select("grp", "node").filter("node is not null").distinct())
    for _ in range(1, hops):
        reached = steps.select("src", "dst").join(few(front), F.col("node") == F.col("src")).select("grp", F.col("dst").alias("node")).distinct()
        front = written(reached.join(need, ["grp", "node"], "left_anti"))
        need = need.unionByName(front)
    # What a group needs is told from one step in a hundred; that only chooses the way.
    large = steps.select("src").sample(0.01, seed=1).join(need, F.col("node") == F.col("src")).groupBy("grp").count().filter(F.col("count") * 100 > GROUP_STEPS)
    large = [r.grp for r in large.select("grp").collect()]  # as many as there are groups at most
    held = lambda df: df.filter(~F.col("grp").isin(large)) if large else df
    around = steps.join(held(need), F.col("node") == F.col("src")).drop("node")
    out = held(starts).groupBy("grp").cogroup(around.groupBy("grp")).applyInArrow(walk, schema)
    return out.unionByName(rest(starts.filter(F.col("grp").isin(large)).select("seed", "node"))) if large else out


class _Walk:
    """A group's starts and steps by numbers; parts() goes through the seeds, as many at once as keep its arrays small."""

    def __init__(self, starts, steps):
        chunks = [*starts["node"].chunks, *steps["src"].chunks, *steps["dst"].chunks]
        named = pa.chunked_array(chunks, starts.schema.field("node").type).combine_chunks().dictionary_encode()
        codes = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seeds = starts["seed"].combine_chunks().dictionary_encode()
        self.names, self.n, self.seeds = named.dictionary, len(named.dictionary), seeds.dictionary
        self.owner, self.start = seeds.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes[: len(starts)]
        src = codes[len(starts) : len(starts) + len(steps)]
        self.order = np.argsort(src, kind="stable")
        self.dst, self.begin = codes[len(starts) + len(steps) :][self.order], np.concatenate([[0], np.cumsum(np.bincount(src, minlength=self.n))])

    def parts(self):
        """The first seed of a part, how many there are, and where each of their starts is in arrays of a row for each."""
        width = int(max(1, min((4 << 20) // self.n, (32 << 20) // max(1, len(self.dst)))))
        for low in range(0, len(self.seeds), width):
            own = (self.owner >= low) & (self.owner < low + width)
            yield low, min(width, len(self.seeds) - low), (self.owner[own] - low) * self.n + self.start[own]

    def next(self, front):
        """What steps lead to from the front, which of the front each comes from, and which step it is."""
        rows, nodes = np.divmod(front, self.n)
        many = self.begin[nodes + 1] - self.begin[nodes]
        of = np.repeat(np.arange(len(front)), many)
        step = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + self.begin[nodes][of]
        return rows[of] * self.n + self.dst[step], of, step

    def named(self, low, found):
        rows, nodes = np.divmod(found, self.n)
        return [self.seeds.take(pa.array(rows + low)), self.names.take(pa.array(nodes))]


def _walk_hops(hops: int):
    def walk(starts, steps):
        w, out = _Walk(starts, steps), []
        for low, many, front in w.parts():
            hop = np.full(many * w.n, -1, np.int32)
            hop[front] = 0
            for h in range(1, hops + 1):
                to = w.next(front)[0]
                hop[to[hop[to] < 0]] = h
                front = np.flatnonzero(hop == h)
            found = np.flatnonzero(hop >= 0)
            out.append(pa.table([*w.named(low, found), pa.array(hop[found])], ["seed", "node", "hop"]))
        return pa.concat_tables(out)

    return walk


def khop(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out") -> DataFrame:
    """(seed, node, hop): all nodes within so many hops of each seed, by the least number of hops; the seed has 0."""
    steps = directed(edges.select("src", "dst"), direction).filter("src is not null and dst is not null")
    starts = seeds.select("seed", F.col("seed").alias("node")).distinct()
    if hops < 2:
        return _khop_joined(steps, starts, hops)
    steps = directed(written(edges.select("src", "dst")), direction).filter("src is not null and dst is not null")
    kind = dict(starts.dtypes)
    lone = starts.filter("seed is null").withColumn("hop", F.lit(0))
    return _walked(steps, starts, hops, _walk_hops(hops), f"seed {kind['seed']}, node {kind['node']}, hop int", lambda own: _khop_joined(steps, own, hops)).unionByName(lone)


def _khop_joined(steps: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """The same by joins, for surroundings of any size."""
    steps, seen = steps.distinct(), starts.withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        reached = front.join(steps, front.node == steps.src).select("seed", F.col("dst").alias("node")).distinct()
        front = reached.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        if hop > 1:
            front = written(front)
        seen = seen.unionByName(front)
    return seen


def propagate_from(edges: DataFrame, starts: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """(seed, node, weight, hop, via) of every hop: the best product of priors along a path from any of the seed's starts (seed, node),
    each hop decayed once more, and the type of its last edge (of equal products the first by name). Starts aren't entered."""
    steps = directed(edges.select("src", "dst", "edge_type"), direction).withColumn("p", prior(F.col("edge_type"))).groupBy("src", "dst").agg(F.max("p").alias("p"), F.min_by("edge_type", F.struct(-F.col("p"), "edge_type")).alias("via"))
    steps = written(steps)
    starts = written(starts.select("seed", "node").distinct())
    front, out = starts.withColumn("weight", F.lit(1.0)), None
    for hop in range(1, hops + 1):
        moved = front.select("seed", F.col("node").alias("src"), "weight").join(steps, "src").withColumn("weight", F.col("weight") * F.col("p") * DECAY ** (hop - 1))
        front = moved.groupBy("seed", F.col("dst").alias("node")).agg(F.max("weight").alias("weight"), F.min_by("via", F.struct(-F.col("weight"), "via")).alias("via"))
        front = written(front.join(starts, ["seed", "node"], "left_anti"))
        own = front.select("seed", "node", "weight", F.lit(hop).alias("hop"), "via")
        out = own if out is None else out.unionByName(own)
    if out is None:
        return starts.filter("false").select("seed", "node", F.lit(0.0).alias("weight"), F.lit(0).alias("hop"), F.lit("").alias("via"))
    return out


def best_path(found: DataFrame) -> DataFrame:
    """Of each seed and node the greatest weight; a later hop wins only by a greater one."""
    top = found.groupBy("seed", "node").agg(F.min(F.struct((-F.col("weight")).alias("w"), "hop", "via")).alias("m"))
    return top.select("seed", "node", (-F.col("m.w")).alias("weight"), F.col("m.hop").alias("hop"), F.col("m.via").alias("via"))


def _walk_best(hops: int):
    def walk(starts, steps):
        w, out = _Walk(starts, steps), []
        kinds = sorted(steps["edge_type"].unique().to_pylist(), key=lambda x: (x is not None, x or ""))
        types, none = steps["edge_type"].combine_chunks().dictionary_encode("encode"), len(kinds)
        place = np.array([kinds.index(x) for x in types.dictionary.to_pylist()], np.int64)
        via = place[types.indices.to_numpy(zero_copy_only=False)][w.order] if len(steps) else np.empty(0, np.int64)
        p = np.array([PRIORS.get(x, OTHER_PRIOR) for x in kinds])
        for low, many, begin in w.parts():
            front, weight = begin, np.ones(len(begin))
            best, at, last = np.full(many * w.n, -1.0), np.zeros(many * w.n, np.int32), np.full(many * w.n, none)
            for h in range(1, hops + 1):
                to, of, step = w.next(front)
                x, kind = weight[of] * p[via[step]] * DECAY ** (h - 1), via[step]
                now, name = np.full(many * w.n, -1.0), np.full(many * w.n, none)
                np.maximum.at(now, to, x)
                now[begin] = -1.0
                tied = x == now[to]
                np.minimum.at(name, to[tied], kind[tied])
                front = np.flatnonzero(now >= 0)
                weight = now[front]
                more = front[weight > best[front]]
                best[more], at[more], last[more] = now[more], h, name[more]
            found = np.flatnonzero(best >= 0)
            out.append(pa.table([*w.named(low, found), pa.array(best[found]), pa.array(at[found]), pa.array(kinds, pa.string()).take(pa.array(last[found]))], ["seed", "node", "score", "hop", "via"]))
        return pa.concat_tables(out)

    return walk


def propagate(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """(seed, node, score, hop, via) from single seeds (seed): see propagate_from and best_path."""
    starts = seeds.select("seed", F.col("seed").alias("node")).filter("seed is not null").distinct()
    by_join = lambda own: best_path(propagate_from(edges, own, hops, direction).filter("node is not null")).withColumnRenamed("weight", "score")
    if hops < 2:
        return by_join(starts)
    steps = directed(written(edges.select("src", "dst", "edge_type")), direction).filter("src is not null and dst is not null")
    kind = dict(starts.dtypes)
    return _walked(steps, starts, hops, _walk_best(hops), f"seed {kind['seed']}, node {kind['node']}, score double, hop int, via string", by_join)


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 30) -> DataFrame:
    """(node, rank) after so many iterations. Parallel edges add up; edges of no weight or unknown ends don't count; the mass
    of nodes without out-edges spreads evenly. edges: (src, dst, weight).

    Nodes are numbered, and edges are partitioned and sorted by source once; each round moves ranks and partial sums only. Sources
    of very many edges are spread over several keys. Every round is written, so plans don't grow.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = written(nodes.select("node").filter("node is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    ends = lambda c: named.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    known = edges.filter("weight > 0").select("src", "dst", "weight").join(ends("src"), "src").select("src_id", "dst", "weight").join(ends("dst"), "dst")
    known = written(known.groupBy(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).agg(F.sum("weight").alias("weight")))
    out = written(known.groupBy("src").agg(F.sum("weight").alias("whole"), F.ceil(F.count("*") / KEY_EDGES).cast("int").alias("keys")))
    state = written(named.select("id").join(out.select(F.col("src").alias("id"), "keys"), "id", "left"))
    n = state.count()
    # Persisted from written tables: a lost executor's part is computed again from those.
    steps = known.join(out, "src").select("src", F.pmod(F.xxhash64("dst"), F.col("keys")).cast("int").alias("key"), "dst", (F.col("weight") / F.col("whole")).alias("share")).repartition(parts, "src", "key").sortWithinPartitions("src", "key").persist()
    rank = written(state.withColumn("rank", F.lit(1.0 / max(n, 1))))
    for _ in range(iterations):
        loose = rank.filter("keys is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = rank.filter("keys is not null").select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("key"), "rank")
        flow = sent.join(steps, ["src", "key"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        rank = written(rank.join(flow, rank.id == flow.dst, "left").select("id", "keys", ((1 - DAMPING) / n + DAMPING * (F.coalesce("flow", F.lit(0.0)) + loose / n)).alias("rank")))
    steps.unpersist()
    return rank.join(named, "id").select("node", "rank")


def rank_cap(ranks: DataFrame) -> DataFrame:
    """One row: the rank at the place floor(n / 10) from above; where that isn't positive, half the greatest, or 1.

    The place is found by histograms of narrower and narrower ranges, so no task sees all ranks in order.
    """
    spark = ranks.sparkSession
    n, most = ranks.agg(F.count("*"), F.max("rank")).first()
    if not n:
        return spark.createDataFrame([(1.0,)], "cap double")
    counts = written(ranks.groupBy("rank").agg(F.count("*").alias("c")))
    want, low, high = int(n * 0.1) + 1, None, None
    while True:
        own = counts if low is None else counts.filter((F.col("rank") >= low) & (F.col("rank") <= high))
        lo, hi, kinds = own.agg(F.min("rank"), F.max("rank"), F.count("*")).first()
        if kinds <= 4096 or lo == hi:
            rows = sorted(((r["rank"], r["c"]) for r in own.collect()), reverse=True)  # 4096 at most
            for value, c in rows:
                want -= c
                if want <= 0:
                    break
            cap = value if value > 0 else most / 2 if most > 0 else 1.0
            return spark.createDataFrame([(float(cap),)], "cap double")
        width = (hi - lo) / 1024
        bins = own.groupBy(F.least(F.floor((F.col("rank") - lo) / width), F.lit(1023)).alias("b")).agg(F.sum("c").alias("c"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).orderBy(F.col("b").desc()).collect()  # 1024 at most
        for r in bins:
            if want <= r["c"]:
                low, high = r["lo"], r["hi"]
                break
            want -= r["c"]


def in_degrees(edges: DataFrame) -> DataFrame:
    """(node, calls, inherits): incoming edges of those types."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count_if(F.col("edge_type") == "call").alias("calls"), F.count_if(F.col("edge_type") == "inherit").alias("inherits"))


def expand(edges: DataFrame, ranks: DataFrame, seeds: DataFrame, hops: int, most: int) -> DataFrame:
    """(seed, node, weight, place): each seed and its neighbourhood, by the weight of direct edges, cut to most rows a seed.

    Only direct neighbours have a weight, so the other nodes within hops are looked for where those don't fill the rows.
    """
    seeds, order = written(seeds.select("seed").distinct()), Window.partitionBy("seed").orderBy(F.col("own").desc(), F.round("weight", 9).desc(), "node")
    cut = lambda df: df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    ends = directed(edges.select("src", "dst", "edge_type"), "both").filter("src <> dst" if hops > 0 else "false").join(few(seeds), F.col("seed") == F.col("src"))
    # By node, so that the ranks and each pair's best edge need no other shuffle.
    direct = ends.select("seed", F.col("dst").alias("node"), prior(F.col("edge_type")).alias("p")).join(ranks, "node", "left").groupBy("seed", "node").agg(F.max(F.col("p") * (1 + F.coalesce("rank", F.lit(0.0)))).alias("weight"))
    best = written(cut(direct.withColumn("own", F.lit(False))))
    full = written(best.filter(F.round("weight", 9) > 0).groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") >= most - 1).select("seed"))
    found = seeds.join(full, "seed", "left_semi").select("seed", F.col("seed").alias("node"), F.lit(0.0).alias("weight"), F.lit(True).alias("own"))
    found = found.unionByName(best.join(full, "seed", "left_semi").select("seed", "node", "weight", "own"))
    lacking = written(seeds.join(full, "seed", "left_anti"))
    if not lacking.isEmpty():
        # Fewer than most of their neighbours have a weight, so best has all of these.
        near = khop(edges, lacking, hops, "both").join(best.select("seed", "node", "weight"), ["seed", "node"], "left")
        found = found.unionByName(near.select("seed", "node", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce(F.col("node") == F.col("seed"), F.lit(False)).alias("own")))
    return cut(found).select("seed", "node", "weight", "place")


def slice_edges(edges: DataFrame, near: DataFrame) -> DataFrame:
    """(seed, src, dst, ...) of the edges whose ends are both in the seed's neighbourhood."""
    a, b = near.select("seed", F.col("node").alias("src")), near.select("seed", F.col("node").alias("dst"))
    return edges.join(a, "src").join(b, ["seed", "dst"])


def ancestors(nodes: DataFrame, column: str) -> DataFrame:
    """nodes exploded by the dotted paths above and at the column."""
    parts = F.split(column, r"\.")
    return nodes.withColumn("ancestor", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))))
