"""Graph operators over an edge table ``(graph, src, dst)``.

``graph`` tells apart independent graphs (one per function, say), so many are
worked on at once. Every operator is a sequence of joins on (graph, node); the
rows of a round go to the shared folder and the next round reads them there.
A NULL graph, and a NULL node, is one like any other.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator, Sequence
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import GrowingTable, saved

G = "graph"
SMALL_CORE = 100_000  # edges of a graph that are searched in one task, or, of a larger graph's core, split into components there

# -- keys ---------------------------------------------------------------
KEYS, BOX = (G, "src", "dst", "node", "a", "b"), "_boxed"


def _is_box(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == [BOX]


def _boxed(df: DataFrame) -> DataFrame:
    """Keys as structs of one field: these are never NULL, so equal keys meet in every join."""
    return df.withColumns({c: F.struct(F.col(c).alias(BOX)) for c in df.columns if c in KEYS})


def _open_column(name: str, kind: T.DataType) -> Column:
    if _is_box(kind):
        return F.col(f"`{name}`.{BOX}").alias(name)
    if isinstance(kind, T.ArrayType) and _is_box(kind.elementType):
        return F.transform(F.col(f"`{name}`"), lambda x: x[BOX]).alias(name)
    return F.col(f"`{name}`")


def _opened(df: DataFrame) -> DataFrame:
    return df.select(*[_open_column(f.name, f.dataType) for f in df.schema.fields])


def _lacks_key(df: DataFrame) -> bool:
    """Whether a key is NULL somewhere; a scan that ends at the first one."""
    keys = [F.col(c).isNull() for c in df.columns if c in KEYS]
    return bool(keys) and df.filter(functools.reduce(or_, keys)).limit(1).count() > 0


def over_boxed_keys(core: Callable) -> Callable:
    """The operator on tables as they come: if a key is NULL, all are boxed for ``core`` and opened in its results.

    Plain keys are half as wide as boxed ones, and Spark sorts them several times faster.
    """

    @functools.wraps(core)
    def run(*args, **named):
        boxing = any(_lacks_key(x) for x in (*args, *named.values()) if isinstance(x, DataFrame))
        box = lambda x: _boxed(x) if boxing and isinstance(x, DataFrame) else x
        out = core(*map(box, args), **{k: box(v) for k, v in named.items()})
        return tuple(map(_opened, out)) if isinstance(out, tuple) else _opened(out)

    return run


# -- joins --------------------------------------------------------------
HASH = "_hash"


def _hashed(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.withColumn(HASH, F.xxhash64(*on))


def _met(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys, led by a hash of them.

    Spark's sort compares whole rows where the first eight bytes of the first
    key agree. Those of a graph's name do for all its rows, those of a hash do not.
    """
    return _hashed(left, on).join(_hashed(right, on), [HASH, *on], how).drop(HASH)


# -- operators ----------------------------------------------------------
def _bfs_levels(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Distance of every reachable node from the entries ``(graph, node)``: ``(graph, node, level)``."""
    return _levels(saved(edges.select(G, "src", "dst").distinct()), entries)


def _levels(steps: DataFrame, entries: DataFrame) -> DataFrame:
    """The same over different ``steps`` that are read anew in each round."""
    table, on = GrowingTable(steps.sparkSession), [G, "node"]
    frontier = table.append(entries.select(*on).distinct().withColumn("level", F.lit(0).cast("long")))
    while not frontier.isEmpty():
        ends = _met(frontier.withColumnRenamed("node", "src"), steps, [G, "src"]).select(G, F.col("dst").alias("node"))
        nxt = _hashed(ends, on).distinct().join(_hashed(table.all().select(*on), on), [HASH, *on], "left_anti").drop(HASH)
        frontier = table.append(nxt.withColumn("level", F.lit(table.batches).cast("long")))
    return table.all()


def _reachable_nodes(edges: DataFrame, entries: DataFrame) -> DataFrame:
    return _bfs_levels(edges, entries).select(G, "node")


def _trim_unreachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Edges whose two ends can be reached; a reachable source makes its target reachable."""
    nodes = _reachable_nodes(edges, entries).withColumnRenamed("node", "src")
    return _met(edges, nodes, [G, "src"], "left_semi")


def _transitive_closure(edges: DataFrame) -> DataFrame:
    """All pairs ``(graph, src, dst)`` with a path of at least one edge.

    Round i has the pairs joined by exactly 2 ** i steps and adds those that a
    known path goes on from: paths double, so a chain of n edges closes in
    log2(n) rounds. A round's new pairs follow from one aggregate over them and
    the known ones.
    """
    steps = saved(edges.select(G, "src", "dst").distinct())
    table = GrowingTable(edges.sparkSession)
    table.append(steps)
    while True:
        on = steps.select(G, F.col("dst").alias("mid"), F.col("src").alias("from"))
        twice = _met(on, steps.withColumnRenamed("src", "mid"), [G, "mid"]).select(G, F.col("from").alias("src"), "dst").distinct()
        steps = saved(twice)
        if steps.isEmpty():
            return table.all()
        on = steps.select(G, F.col("dst").alias("mid"), F.col("src").alias("from"))
        known = table.all()
        further = _met(on, known.withColumnRenamed("src", "mid"), [G, "mid"]).select(G, F.col("from").alias("src"), "dst")
        found = steps.unionByName(further).withColumn("_old", F.lit(0)).unionByName(known.withColumn("_old", F.lit(1)))
        if table.append(found.groupBy(G, "src", "dst").agg(F.max("_old").alias("_old")).filter("_old = 0").drop("_old")).isEmpty():
            return table.all()


def _simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Every path without a repeated node from a start to an end: ``(graph, start, end, nodes)``.

    All paths are listed, so the result grows with their number; a start that
    is an end is a path of one node. Only nodes from which an end can be reached
    are walked, found by a search from the ends against the edges. A step says
    whether it leads to an end, and whether any step may follow it, so paths are
    written once and those that are done are not joined again.
    """
    every = saved(edges.select(G, "src", "dst").distinct())
    goal = saved(ends.select(G, "node").distinct())
    against = every.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
    useful = saved(_levels(against, goal))
    onward = _met(every.select(G, F.col("src").alias("node")), goal, [G, "node"], "left_semi").distinct().withColumn("_on", F.lit(True))
    marked = _met(useful, onward, [G, "node"], "left").select(
        G, "node", (F.col("level") == 0).alias("goal"), ((F.col("level") > 0) | F.coalesce("_on", F.lit(False))).alias("more"))
    marked = saved(marked)
    steps = saved(_met(every, marked.withColumnRenamed("node", "dst"), [G, "dst"]).select(G, "src", "dst", "goal", "more"))
    table = GrowingTable(edges.sparkSession)
    first = _met(starts.select(G, "node").distinct(), marked, [G, "node"]).withColumnRenamed("node", "start")
    frontier = table.append(first.select(G, "start", F.col("start").alias("last"), F.array("start").alias("nodes"), "goal", "more"))
    while not (going := frontier.filter("more")).isEmpty():
        nxt = _met(going.drop("goal", "more").withColumnRenamed("last", "src"), steps, [G, "src"])
        frontier = table.append(nxt.filter(~F.array_contains("nodes", F.col("dst"))).select(
            G, "start", F.col("dst").alias("last"), F.array_append("nodes", F.col("dst")).alias("nodes"), "goal", "more"))
    return table.all().filter("goal").select(G, "start", F.col("last").alias("end"), "nodes")


def _topological_layers(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """Layer of each ``(graph, node)``: 0 without dependencies, else one past the last of them.

    ``depends`` is ``(graph, src, dst)``: src needs dst. What is left when no
    node is free, because it lies on or behind a cycle, forms the last layer.

    Chains are contracted first, so they cost no rounds. Then dependencies are
    counted down: a round takes the blocks that became free, sends a count and
    a layer along their edges, and frees those whose counts are complete. Every
    edge is sent once, and only what was sent is written.
    """
    every = saved(nodes.select(G, "node").distinct())
    named = [every.withColumnRenamed("node", n) for n in ("src", "dst")]
    needs = depends.filter("src <> dst").select(G, F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    flow = saved(_met(_met(needs, named[0], [G, "src"], "left_semi"), named[1], [G, "dst"], "left_semi"))
    placed = saved(_chain_blocks(every.withColumns({"cluster": F.lit(0), "fixed": F.lit(False)}), flow))
    a = placed.select(G, F.col("node").alias("src"), F.col("block").alias("from"), F.col("place").alias("p"))
    b = placed.select(G, F.col("node").alias("dst"), F.col("block").alias("to"), F.col("place").alias("q"))
    joined = _met(_met(flow, a, [G, "src"]), b, [G, "dst"]).filter("from <> to or q <> p + 1")
    edges = saved(joined.select(G, "from", "to", (F.col("p") + 1).alias("more")))
    degrees = saved(edges.groupBy(G, "to").agg(F.count(F.lit(1)).alias("degree")))

    sent, done = GrowingTable(nodes.sparkSession), GrowingTable(nodes.sparkSession)
    blocks = placed.select(G, F.col("block").alias("from")).distinct()
    roots = _met(blocks, degrees.select(G, F.col("to").alias("from")), [G, "from"], "left_anti")
    free = done.append(roots.withColumn("layer", F.lit(0).cast("long")))
    while not free.isEmpty():
        news = _met(free, edges, [G, "from"]).groupBy(G, "to").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col("layer") + F.col("more")).alias("layer"))
        touched = sent.append(news).select(G, "to")
        so_far = _met(sent.all(), touched, [G, "to"], "left_semi").groupBy(G, "to").agg(F.sum("n").alias("n"), F.max("layer").alias("layer"))
        complete = _met(so_far, degrees, [G, "to"]).filter("n = degree")
        free = done.append(complete.select(G, F.col("to").alias("from"), "layer"))
    layered = _met(placed, done.all().withColumnRenamed("from", "block"), [G, "block"], "left")
    layered = saved(layered.select(G, "node", (F.col("layer") + F.col("place")).alias("layer")))
    last = layered.groupBy(G).agg(F.coalesce(F.max("layer") + 1, F.lit(0)).alias("top"))
    return layered.join(last, G).select(G, "node", F.coalesce("layer", "top").alias("layer"))


def _back_edges(edges: DataFrame, entries: DataFrame, tangled: bool = True) -> DataFrame:
    """Edges into a node that every way from the entry to their source passes: the loops.

    Graphs of structured code have the same loops in every depth-first order,
    and these are those. What cycles are left without them can be entered at
    several nodes; there, if ``tangled``, the loops are those of a depth-first
    search that takes up the last neighbour first.

    Graphs of up to ``SMALL_CORE`` edges are spread over the tasks, each searched
    by itself; only larger ones take a round of joins for each step of depth.
    """
    steps = saved(edges.select(G, "src", "dst").distinct())
    large = saved(steps.groupBy(G).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SMALL_CORE).select(G))
    if large.isEmpty():
        return _loops_by_graph(steps, entries, tangled)
    small = _loops_by_graph(_met(steps, large, [G], "left_anti"), entries, tangled)
    return small.unionByName(_loops_by_rounds(saved(_met(steps, large, [G], "left_semi")), _met(entries, large, [G], "left_semi"), tangled))


def _loops_by_graph(steps: DataFrame, entries: DataFrame, tangled: bool) -> DataFrame:
    """The loops of small graphs, one graph after the other in a task.

    Rows come sorted by graph, so a task holds one graph and one batch of rows,
    and a call of Python serves as many graphs as a batch has.
    """
    # Only entries with an edge out of them matter, so there are no more of them than edges.
    node = steps.schema["src"].dataType
    starts = _met(entries.select(G, F.col("node").alias("src")).distinct(), steps.select(G, "src"), [G, "src"], "left_semi")
    starts = starts.select(G, F.lit(None).cast(node).alias("src"), F.col("src").alias("dst"), F.lit(True).alias("root"))
    every = _opened(steps.withColumn("root", F.lit(False)).unionByName(starts))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, kinds in _by_graph(batches, tangled):
            yield pa.record_batch([pa.array(v, kinds.field(n).type) for n, v in found.items()], names=list(found))

    opened = every.repartition(G).sortWithinPartitions(F.xxhash64(G), G).mapInArrow(search, every.select(G, "src", "dst").schema)
    opened = saved(opened)
    return _boxed(opened) if _is_box(node) else opened


def _by_graph(batches: Iterable[pa.RecordBatch], tangled: bool) -> Iterator[tuple[dict, pa.Schema]]:
    """Loops as columns, batch by batch, and the types of the columns; a graph may go on in the next batch."""
    names, kinds = (G, "src", "dst"), None
    graph, pairs, roots = None, [], set()
    found: dict = {n: [] for n in names}

    def finish() -> None:
        loops = _loops_of(sorted(pairs, key=lambda p: [_place(x) for x in p]), roots, tangled)
        for n, values in zip(names, ([graph] * len(loops), [a for a, _ in loops], [b for _, b in loops])):
            found[n] += values

    for batch in batches:
        kinds = batch.schema
        for g, a, b, root in zip(*(batch.column(n).to_pylist() for n in (*names, "root"))):
            if g != graph and (g == g or graph == graph):
                finish()
                graph, pairs, roots = g, [], set()
            if root:
                roots.add(b)
            else:
                pairs.append((a, b))
        yield found, kinds
        found = {n: [] for n in names}
    if kinds:
        finish()
        yield found, kinds


def _loops_by_rounds(steps: DataFrame, entries: DataFrame, tangled: bool) -> DataFrame:
    """The same by joins over all graphs at once.

    For each candidate target the graph is searched from the entry without it;
    sources not found are dominated by it.
    """
    levels = saved(_bfs_levels(steps, entries))
    here = levels.select(G, F.col("node").alias("src"), F.col("level").alias("src_level"))
    there = levels.select(G, F.col("node").alias("dst"), F.col("level").alias("dst_level"))
    candidates = saved(
        steps.join(here, [G, "src"]).join(there, [G, "dst"]).filter("dst_level <= src_level").select(G, "src", "dst")
    )
    heads = candidates.select(G, F.col("dst").alias("head")).distinct()
    table = GrowingTable(steps.sparkSession)
    frontier = table.append(heads.join(entries.select(G, "node").distinct(), G).filter("node <> head"))
    while not frontier.isEmpty():
        nxt = (
            frontier.withColumnRenamed("node", "src")
            .join(steps, [G, "src"])
            .filter("dst <> head")
            .select(G, "head", F.col("dst").alias("node"))
            .distinct()
            .join(table.all(), [G, "head", "node"], "left_anti")
        )
        frontier = table.append(nxt)
    found = table.all().select(G, F.col("head").alias("dst"), F.col("node").alias("src"))
    loops = saved(candidates.join(found, [G, "src", "dst"], "left_anti"))
    if not tangled:
        return loops
    known = steps.join(levels.select(G, F.col("node").alias("src")), [G, "src"], "left_semi")
    return loops.unionByName(_tangled_loops(saved(known.join(loops, [G, "src", "dst"], "left_anti")), entries))


def _tangled_loops(steps: DataFrame, entries: DataFrame) -> DataFrame:
    """Loops (graph, src, dst) of cycles with several entries, among edges without other loops.

    Nodes without an edge in, or without one out, are peeled off until only the
    cycles and what lies between them are left. That core falls into strongly
    connected components, and each is searched depth first by itself, from the
    nodes at which it is entered. Only a component meets in one task; small
    cores are split into theirs there as well.
    """
    core = steps.select(G, "src", "dst")
    while True:
        heads, tails = core.select(G, F.col("src").alias("dst")), core.select(G, F.col("dst").alias("src"))
        less = saved(core.join(heads.distinct(), [G, "dst"], "left_semi").join(tails.distinct(), [G, "src"], "left_semi"))
        before, after = core.count(), less.count()
        core = less
        if not after or before == after:
            break
    if not core.head(1):
        return core
    sizes = saved(core.groupBy(G).agg(F.count(F.lit(1)).alias("_n")))
    small = core.join(sizes.filter(F.col("_n") <= SMALL_CORE), G, "left_semi")
    large = saved(core.join(sizes.filter(F.col("_n") > SMALL_CORE), G, "left_semi"))
    node = core.schema["src"].dataType
    parts = small.select(G, F.lit(None).cast(node).alias("part"), "src", "dst")
    if large.head(1):
        parts = parts.unionByName(_within_components(large, _components(large)))
    parts = saved(parts)

    # Edges into a part from elsewhere, and entries, say where its search starts.
    inside = parts.select(G, F.col("src").alias("dst"), "part").distinct()
    outer = steps.select(G, "src", "dst").join(parts.select(G, "src", "dst"), [G, "src", "dst"], "left_anti")
    starts = outer.unionByName(entries.select(G, F.lit(None).cast(node).alias("src"), F.col("node").alias("dst")))
    starts = starts.join(inside, [G, "dst"]).select(G, "part", F.col("dst").alias("src"), "dst", F.lit(True).alias("root"))
    every = _opened(parts.withColumn("root", F.lit(False)).unionByName(starts))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[["src", "dst"]].astype(object).where(pdf[["src", "dst"]].notna(), None)
        pairs = list(rows[~pdf["root"]].itertuples(index=False, name=None))
        found = _searched(sorted(pairs, key=lambda p: [_place(x) for x in p]), set(rows.loc[pdf["root"], "dst"]))
        return pd.DataFrame({G: [pdf[G].iloc[0]] * len(found), "src": [a for a, _ in found], "dst": [b for _, b in found]})

    opened = every.groupBy(G, "part").applyInPandas(search, every.select(G, "src", "dst").schema)
    return _boxed(opened) if _is_box(node) else opened


def _place(node) -> tuple:
    """Sorts nodes with NULL first."""
    return (False,) if node is None else (True, node)


def _loops_of(pairs: list[tuple], entries: set, tangled: bool) -> list[tuple]:
    """Loops of one graph, given by its edges (sorted) and entries."""
    ahead: dict = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
    tree = _dominators(ahead, entries)
    known = [(a, b) for a, b in pairs if a in tree]
    loops = [(a, b) for a, b in known if tree[b][0] <= tree[a][0] < tree[b][1]]
    if not tangled:
        return loops
    own = set(loops)
    rest = [p for p in known if p not in own]
    return loops + _searched(rest, entries.intersection(n for p in rest for n in p))


def _dominators(ahead: dict, entries: set) -> dict:
    """(place, end) of each reached node in the tree of dominators: a node dominates those placed from its place to before its end.

    By Lengauer and Tarjan. Nodes are numbered depth first; 0 stands above the entries.
    """
    number, parent, before, stack = {}, [0], [[]], [(0, iter(entries))]
    while stack:
        at, rest = stack[-1]
        for n in rest:
            if n not in number:
                number[n] = len(parent)
                parent.append(at)
                before.append([at])
                stack.append((number[n], iter(ahead.get(n, ()))))
                break
            before[number[n]].append(at)
        else:
            stack.pop()
    count = len(parent)
    semi, best, up, above = list(range(count)), list(range(count)), [-1] * count, [0] * count
    waiting: list = [[] for _ in range(count)]

    def lowest(v: int) -> int:
        path, at = [], v
        while up[at] >= 0 and up[up[at]] >= 0:
            path.append(at)
            at = up[at]
        for x in reversed(path):
            if semi[best[up[x]]] < semi[best[x]]:
                best[x] = best[up[x]]
            up[x] = up[up[x]]
        return best[v]

    for w in range(count - 1, 0, -1):
        semi[w] = min(semi[lowest(v)] for v in before[w])
        waiting[semi[w]].append(w)
        up[w] = parent[w]
        for v in waiting[parent[w]]:
            low = lowest(v)
            above[v] = low if semi[low] < semi[v] else parent[w]
        waiting[parent[w]] = []
    size = [1] * count
    for w in range(1, count):
        if above[w] != semi[w]:
            above[w] = above[above[w]]
    for w in range(count - 1, 0, -1):
        size[above[w]] += size[w]
    place, free = [0] * count, [1] * count
    for w in range(1, count):
        place[w] = free[above[w]]
        free[above[w]] += size[w]
        free[w] = place[w] + 1
    return {n: (place[i], place[i] + size[i]) for n, i in number.items()}


def _searched(pairs: list[tuple], roots: set) -> list[tuple]:
    """Loops of the components among ``pairs`` (sorted): edges to a node on the path of a depth-first search, last neighbour first."""
    part, roots = _local_components(pairs), set(roots)
    children: dict = {}
    for a, b in pairs:
        if part[a] == part[b]:
            children.setdefault(a, []).append(b)
        else:
            roots.add(b)
    found, seen = [], set()
    by_part: dict = {}
    for n in sorted(roots, key=_place):
        by_part.setdefault(part[n], []).append(n)
    for start in by_part.values():
        stack, path, on_path = [(n, 0) for n in start], [], set()
        while stack:
            node, depth = stack.pop()
            while len(path) > depth:
                on_path.discard(path.pop())
            if node in seen:
                continue
            seen.add(node)
            path.append(node)
            on_path.add(node)
            for child in children.get(node, ()):
                if child in on_path:
                    found.append((node, child))
                else:
                    stack.append((child, depth + 1))
    return found


def _local_components(pairs: list[tuple]) -> dict:
    """A representative of each node's strongly connected component: two searches, the second against the edges."""
    ahead: dict = {}
    against: dict = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        against.setdefault(b, []).append(a)
    finished, seen = [], set()
    for root in {**ahead, **against}:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(ahead.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                finished.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(ahead.get(step, ()))))
    part: dict = {}
    for root in reversed(finished):
        todo = [] if root in part else [root]
        while todo:
            node = todo.pop()
            if node not in part:
                part[node] = root
                todo += [x for x in against.get(node, ()) if x not in part]
    return part


def _within_components(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges (graph, part, src, dst) whose ends are in one component."""
    a, b = (parts.select(G, F.col("node").alias(n), F.col("part").alias(f"_{n}")) for n in ("src", "dst"))
    met = edges.select(G, "src", "dst").join(a, [G, "src"]).join(b, [G, "dst"]).filter("_src = _dst")
    return met.select(G, F.col("_src").alias("part"), "src", "dst")


def _components(edges: DataFrame) -> DataFrame:
    """(graph, node, part): strongly connected components, by colours.

    The largest node from which a node can be reached is its colour; nodes of
    one colour that can reach that node are its component. They go, and the rest
    is coloured anew. A round is one aggregate over tables.
    """
    found = GrowingTable(edges.sparkSession)
    left = saved(edges.select(G, "src", "dst").distinct())
    nodes = saved(left.select(G, F.col("src").alias("node")).union(left.select(G, "dst")).distinct())
    while not nodes.isEmpty():
        colours = saved(nodes.withColumn("colour", F.col("node")))
        while True:
            sent = left.join(colours.withColumnRenamed("node", "src"), [G, "src"]).select(G, F.col("dst").alias("node"), "colour")
            largest = colours.withColumn("own", F.col("colour")).unionByName(sent.withColumn("own", F.lit(None).cast(colours.schema["colour"].dataType)))
            merged = saved(largest.groupBy(G, "node").agg(F.max("colour").alias("colour"), F.max("own").alias("own")))
            colours = merged.drop("own")
            if merged.filter("colour <> own").isEmpty():
                break
        # Against the edges, inside a colour, from the node that gave the colour.
        mine = [colours.select(G, F.col("node").alias(n), F.col("colour").alias(f"_{n}")) for n in ("src", "dst")]
        inner = saved(left.join(mine[0], [G, "src"]).join(mine[1], [G, "dst"]).filter("_src = _dst").select(G, F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = _bfs_levels(inner, colours.filter("node = colour").select(G, "node")).select(G, "node")
        found.append(colours.join(reached, [G, "node"], "left_semi").select(G, "node", F.col("colour").alias("part")))
        nodes = saved(nodes.join(reached, [G, "node"], "left_anti"))
        rest = [nodes.withColumnRenamed("node", n) for n in ("src", "dst")]
        left = saved(left.join(rest[0], [G, "src"], "left_semi").join(rest[1], [G, "dst"], "left_semi"))
    return found.all()


def _chain_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Position of each node in its chain: ``(graph, node, block, place)``.

    An edge joins its ends when it is the only one out of its source and the
    only one into its target, and ``nodes(graph, node, cluster, fixed)`` does
    not forbid it: other cluster, or an end that is ``fixed``. ``block`` is the
    first node of the chain. Links are followed by doubling, so a chain of n
    nodes takes about log2(n) rounds.
    """
    steps = saved(edges.select(G, "src", "dst").distinct())
    single_out = steps.groupBy(G, "src").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(G, "src")
    single_in = steps.groupBy(G, "dst").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(G, "dst")
    left = nodes.select(G, F.col("node").alias("src"), F.col("cluster").alias("c1"), F.col("fixed").alias("f1"))
    right = nodes.select(G, F.col("node").alias("dst"), F.col("cluster").alias("c2"), F.col("fixed").alias("f2"))
    single = _met(_met(steps.filter("src <> dst"), single_out, [G, "src"], "left_semi"), single_in, [G, "dst"], "left_semi")
    links = saved(
        _met(_met(single, left, [G, "src"]), right, [G, "dst"])
        .filter("c1 <=> c2 AND NOT f1 AND NOT f2")
        .select(G, F.col("dst").alias("node"), F.col("src").alias("up"))
    )
    every = _met(nodes.select(G, "node"), links, [G, "node"], "left")
    hops = saved(
        every.select(
            G, "node", F.coalesce("up", "node").alias("block"),
            F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("place"),
        )
    )
    # A node that keeps moving for more rounds than any chain can last is on a ring without a first node.
    rounds = max(hops.count(), 2).bit_length()
    for _ in range(rounds):
        far = hops.select(G, F.col("node").alias("block"), F.col("block").alias("next"), F.col("place").alias("more"))
        moved = _met(hops, far, [G, "block"])
        if moved.filter("next <> block").isEmpty():
            break
        hops = saved(moved.select(G, "node", F.col("next").alias("block"), (F.col("place") + F.col("more")).alias("place")))
    heads = links.select(G, F.col("node").alias("block"), F.lit(True).alias("ring"))
    settled = _met(hops, heads, [G, "block"], "left")
    return settled.select(
        G, "node",
        F.when(F.col("ring"), F.col("node")).otherwise(F.col("block")).alias("block"),
        F.when(F.col("ring"), F.lit(0)).otherwise(F.col("place")).cast("long").alias("place"),
    )


def _contract_chains(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge chains: the last node of a chain stays and takes the code of all, in order.

    ``nodes`` is ``(graph, node, type, code, cluster, fixed)``. Returns nodes
    ``(graph, node, type, code, size)`` and edges between the nodes that stay.
    """
    placed = saved(_chain_blocks(nodes, edges))
    full = nodes.join(placed, [G, "node"])
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "\n")
    merged = full.groupBy(G, "block").agg(
        F.max_by("node", "place").alias("node"), F.min_by("type", "place").alias("type"),
        code.alias("code"), F.count(F.lit(1)).alias("size"),
    )
    stays = saved(merged)
    names = placed.join(stays.select(G, "block", F.col("node").alias("stay")), [G, "block"])
    a = names.select(G, F.col("node").alias("src"), F.col("stay").alias("s"), F.col("block").alias("b1"))
    b = names.select(G, F.col("node").alias("dst"), F.col("stay").alias("d"), F.col("block").alias("b2"))
    kept = edges.select(G, "src", "dst").join(a, [G, "src"]).join(b, [G, "dst"])
    kept = kept.filter("b1 <> b2 OR src = dst").select(
        G, F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    return stays.select(G, "node", "type", "code", "size"), kept


def _short(node: Column) -> Column:
    return F.xxhash64(node)


def _numbered_ends(edges: DataFrame) -> DataFrame:
    """(edge, ca, cb) of ``(edge, a, b)``: a number for each node. It is a hash, unless two nodes share one."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    if nodes.groupBy(_short(F.col("node"))).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return edges.select("edge", _short(F.col("a")).alias("ca"), _short(F.col("b")).alias("cb"))
    numbers = saved(nodes.withColumn("number", F.monotonically_increasing_id()))
    a, b = (numbers.select(F.col("node").alias(n), F.col("number").alias(f"c{n}")) for n in ("a", "b"))
    return edges.join(a, "a").join(b, "b").select("edge", "ca", "cb")


def _minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges ``(a, b, weight)`` of the lightest forest that joins what the given edges join.

    Edges are numbered by weight, ties by their ends, so no ring can form, and
    rounds move three numbers an edge. In each round every component takes its
    lightest outgoing edge, and of the edges between two components only the
    lightest is kept. Components at least halve.
    """
    spark = edges.sparkSession
    pairs = saved(edges.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight"
    ).filter("a <> b").groupBy("a", "b").agg(F.min("weight").alias("weight")))
    order = ["weight", "a", "b"]
    ordered = saved(pairs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("edge", F.monotonically_increasing_id()))
    left = saved(_numbered_ends(ordered))
    chosen = GrowingTable(spark)
    while not left.isEmpty():
        sides = left.select(F.col("ca").alias("c"), "edge", F.col("cb").alias("to")).unionByName(
            left.select(F.col("cb").alias("c"), "edge", F.col("ca").alias("to")))
        picks = saved(sides.groupBy("c").agg(F.min("edge").alias("edge"), F.min_by("to", "edge").alias("to")))
        chosen.append(picks.select("edge").distinct())
        # Each component points at the one it joins; of a pair that points at each other the smaller is the root.
        back = picks.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = saved(
            picks.select("c", "to").join(back, "to", "left").select(
                "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c"))
                .otherwise(F.col("to")).alias("root"))
        )
        moving = True
        while moving:
            up = root.select(F.col("c").alias("root"), F.col("root").alias("top"))
            far = saved(root.join(up, "root").select("c", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            moving = not far.filter("moved").isEmpty()
            root = far.drop("moved")
        ra = root.select(F.col("c").alias("ca"), F.col("root").alias("na"))
        rb = root.select(F.col("c").alias("cb"), F.col("root").alias("nb"))
        joined = left.join(ra, "ca").join(rb, "cb").filter("na <> nb")
        left = saved(joined.groupBy(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb")).agg(F.min("edge").alias("edge")))
    return chosen.all().join(ordered, "edge").select("a", "b", "weight") if chosen.schema else pairs


bfs_levels = over_boxed_keys(_bfs_levels)
reachable_nodes = over_boxed_keys(_reachable_nodes)
trim_unreachable = over_boxed_keys(_trim_unreachable)
transitive_closure = over_boxed_keys(_transitive_closure)
simple_paths = over_boxed_keys(_simple_paths)
topological_layers = over_boxed_keys(_topological_layers)
back_edges = over_boxed_keys(_back_edges)
strong_components = over_boxed_keys(_components)
chain_blocks = over_boxed_keys(_chain_blocks)
contract_chains = over_boxed_keys(_contract_chains)
minimum_spanning_forest = over_boxed_keys(_minimum_spanning_forest)
