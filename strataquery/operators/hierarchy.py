"""Parent-child rows to full hierarchies: paths, depth, root and everything below, circles included.

Only containers can hold others, so only they form the forest; everything else hangs on it by one join.
Each file's forest is cut into heavy chains (every node's chain goes on in the child with the largest
subtree), after circles were separated and their nodes made roots. A node's ancestors are then at most
log2(n) + 1 prefixes of chains, each a contiguous slice of the chain layout. Files with up to
FOREST_LIMIT containers are laid out by vectorised passes over blocks of whole files; larger ones by
rounds of joins (pointer doubling), with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.plans.skew import maybe_broadcast, salted_join
from strataquery.session import forget, stored

#: Kinds whose definitions can hold others (fixed values).
CONTAINER_KINDS = ("class", "interface", "struct", "enum", "record", "table", "xmlElement")
#: Containers of one file that one task lays out at once.
FOREST_LIMIT = 100_000
#: Rows of whole files that are laid out together, ancestors in one batch, and in one row.
BLOCK_ROWS, BATCH_ANCESTORS, ROW_ANCESTORS = 100_000, 1_000_000, 4096

FOREST = (
    "file_id long, name string, def_id long, parent_id long, root_id long, depth int, in_cycle boolean, "
    "chain long, pos int, below long, path string, holds boolean, part int, ancestors array<long>"
)


def bare_name(parent: Column) -> Column:
    """The holder's name without type arguments, qualifiers and blanks; null if nothing is left.

    Type arguments may nest to any depth; an unclosed `<` cuts the rest.
    """
    flat = F.regexp_replace(parent, "<[^<>]*>", "")  # few rows need a pattern, and fewer more than one
    text = F.when(F.contains(parent, F.lit("<")), F.when(F.contains(flat, F.lit("<")), _outside(flat)).otherwise(flat)).otherwise(parent)
    text = F.substring_index(F.substring_index(text, "::", -1), ".", -1)
    return F.nullif(F.btrim(text, F.lit(" \t\r\n\f\v\u00a0")), F.lit(""))


def _outside(text: Column) -> Column:
    """The characters outside all angle brackets; a `>` that closes nothing stays."""

    def step(acc: Column, part: Column) -> Column:
        opens, closes = F.startswith(part, F.lit("<")), F.startswith(part, F.lit(">")) & (acc["depth"] > 0)
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        kept = F.when(depth > 0, F.lit("")).when(closes, F.substr(part, F.lit(2))).otherwise(part)
        return F.struct(depth.alias("depth"), F.concat(acc["out"], kept).alias("out"))

    return F.aggregate(F.split(text, "(?=[<>])"), F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def _holders(file: np.ndarray, name: pa.Array, ids: np.ndarray, parent: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each row's parent within a block, -1 without one; whether a row holds). Of equal names the smallest id holds."""
    import pandas as pd

    codes, uniques = pd.factorize(name.to_numpy(zero_copy_only=False))
    wanted = pd.Index(uniques).get_indexer(parent.to_pandas().astype(object))  # null: -1
    _, files = np.unique(file, return_inverse=True)
    key = files.astype(np.int64) * (len(uniques) + 1) + codes
    order = np.lexsort((ids, key))
    ordered = key[order]
    ask = files.astype(np.int64) * (len(uniques) + 1) + wanted
    at = np.minimum(np.searchsorted(ordered, ask), len(ordered) - 1)
    holds = np.zeros(len(key), bool)
    holds[order[np.r_[True, ordered[1:] != ordered[:-1]]]] = True
    return np.where((wanted >= 0) & (ordered[at] == ask), order[at], -1), holds


def _on_cycles(holder: np.ndarray) -> np.ndarray:
    """True for nodes on circles. Doubling: once the image of f^m no longer shrinks under f^m, it is the circles."""
    jump = holder.copy()
    size = len(np.unique(jump[jump >= 0]))
    while size:
        live = jump >= 0
        jump[live] = jump[jump[live]]
        now = len(np.unique(jump[jump >= 0]))
        if now == size:
            break
        size = now
    cyclic = np.zeros(len(holder), bool)
    cyclic[jump[jump >= 0]] = True
    return cyclic


class _Forest:
    """Heavy chains of the forest given by holder (row of the parent or -1)."""

    def __init__(self, ids: np.ndarray, holder: np.ndarray) -> None:
        n = len(ids)
        self.ids, self.cyclic = ids, _on_cycles(holder)
        self.up = np.where(self.cyclic, -1, holder)
        self.circle = np.full(n, -1, np.int64)  # row of the smallest id on a cyclic node's circle
        self.members: dict[int, np.ndarray] = {}
        for v in np.flatnonzero(self.cyclic):
            if self.circle[v] < 0:
                ring, x = [v], holder[v]
                while x != v:
                    ring.append(x)
                    x = holder[x]
                ring = np.array(sorted(ring, key=ids.__getitem__))
                self.circle[ring] = ring[0]
                self.members[int(ring[0])] = ids[ring]
        depth, jump = np.where(self.up >= 0, 1, 0), self.up.copy()
        while (live := np.flatnonzero(jump >= 0)).size:
            depth[live] += depth[jump[live]]
            jump[live] = jump[jump[live]]
        self.depth = depth
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if n else np.zeros(1, int)
        levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        size = np.ones(n, np.int64)
        for level in reversed(levels[1:]):
            np.add.at(size, self.up[level], size[level])
        self.size = size
        heavy = np.full(n, -1, np.int64)
        kids = np.flatnonzero(self.up >= 0)
        kids = kids[np.lexsort((ids[kids], -size[kids], self.up[kids]))]
        first = np.r_[True, self.up[kids][1:] != self.up[kids][:-1]] if kids.size else np.zeros(0, bool)
        heavy[self.up[kids[first]]] = kids[first]
        self.head, self.top = np.arange(n), np.arange(n)
        for level in levels[1:]:
            up = self.up[level]
            self.top[level] = self.top[up]
            on = heavy[up] == level
            self.head[level[on]] = self.head[up[on]]
        self.pos = depth - depth[self.head]
        self.layout = np.lexsort((self.pos, self.head))
        self.start = np.zeros(n, np.int64)
        heads = self.head[self.layout]
        first = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]]) if n else np.zeros(0, int)
        self.start[heads[first]] = first

    def root_ids(self) -> np.ndarray:
        return self.ids[np.where(self.circle[self.top] >= 0, self.circle[self.top], self.top)]

    def n_ancestors(self) -> np.ndarray:
        """Ancestors and self, all of a circle counted."""
        rings = np.ones(len(self.ids), np.int64)
        on = np.flatnonzero(self.circle >= 0)
        rings[on] = [len(self.members[int(c)]) for c in self.circle[on]]
        return self.depth + rings[self.top]

    def below(self) -> np.ndarray:
        """Containers reached downwards, without the node itself."""
        below = self.size - 1
        on = np.flatnonzero(self.circle >= 0)
        if on.size:
            total = np.bincount(self.circle[on], self.size[on], len(self.ids)).astype(np.int64)
            below[on] = total[self.circle[on]] - 1
        return below

    def ancestors(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in rows, id) of all ancestors and self of rows, by prefixes of chains."""
        who, what, cur, of = [], [], rows.copy(), np.arange(len(rows))
        while cur.size:
            head = self.head[cur]
            lens = self.pos[cur] + 1
            flat = np.repeat(self.start[head] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
            who.append(np.repeat(of, lens))
            what.append(self.ids[self.layout[flat]])
            cur = self.up[head]
            of, cur = of[cur >= 0], cur[cur >= 0]
        for i in np.flatnonzero(self.circle[self.top[rows]] >= 0):
            top = self.top[rows[i]]
            ring = self.members[int(self.circle[top])]
            ring = ring[ring != self.ids[top]]
            who.append(np.full(len(ring), i))
            what.append(ring)
        if not who:
            return np.zeros(0, int), np.zeros(0, np.int64)
        return np.concatenate(who), np.concatenate(what)


def _layout(block: pa.Table, with_paths: bool) -> Iterator[pa.RecordBatch]:
    file, ids = (block.column(c).to_numpy() for c in ("file_id", "def_id"))
    order = np.lexsort((ids, file))
    new = np.r_[True, (file[order][1:] != file[order][:-1]) | (ids[order][1:] != ids[order][:-1])]
    block = block.take(pa.array(order[new])).combine_chunks()
    file, ids = (block.column(c).to_numpy() for c in ("file_id", "def_id"))
    names, parents = (block.column(c).combine_chunks() for c in ("name", "holder"))
    holder, holds = _holders(file, names, ids, parents)
    forest = _Forest(ids, holder)
    paths = None
    if with_paths:
        own = names.to_pylist()
        paths = list(own)
        for v in np.argsort(forest.depth, kind="stable"):
            if forest.up[v] >= 0:
                paths[v] = f"{paths[forest.up[v]]}/{own[v]}"
    counts, roots = forest.n_ancestors(), forest.root_ids()
    parent_ids = pa.array(ids[np.maximum(holder, 0)], mask=holder < 0)
    below = forest.below()
    edges = np.r_[0, np.cumsum(counts)]
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + BATCH_ANCESTORS, "right")) - 1)
        rows = np.arange(at, min(to, len(ids)))
        who, what = forest.ancestors(rows)
        what = what[np.argsort(who, kind="stable")]
        parts = np.maximum(1, -(-counts[rows] // ROW_ANCESTORS))
        node = np.repeat(rows, parts)
        part = np.arange(len(node)) - np.repeat(np.cumsum(parts) - parts, parts)
        lens = np.minimum(counts[node] - part * ROW_ANCESTORS, ROW_ANCESTORS)
        pick = pa.array(node)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(file[node]), names.take(pick), pa.array(ids[node]), parent_ids.take(pick), pa.array(roots[node]), pa.array(forest.depth[node].astype(np.int32)),
                pa.array(forest.cyclic[node]), pa.array(ids[forest.head[node]]), pa.array(forest.pos[node].astype(np.int32)), pa.array(below[node]),
                pa.array([paths[v] for v in node], pa.string()) if paths else pa.nulls(len(node), pa.string()), pa.array(holds[node]), pa.array(part.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.array(what)),
            ],
            names=[c.split()[0] for c in FOREST.split(", ")],
        )
        at = to


def _blocks(with_paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by file; blocks are cut between files."""
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                block = pa.Table.from_batches(held)
                file = block.column("file_id").to_numpy()
                cut = int(np.searchsorted(file, file[-1]))
                if cut:
                    yield from _layout(block.slice(0, cut), with_paths)
                held = block.slice(cut).to_batches()
                n = block.num_rows - cut
        if n:
            yield from _layout(pa.Table.from_batches(held), with_paths)

    return run


def _doubled(nodes: DataFrame, label: str, until_stable: bool = False) -> DataFrame:
    """Pointer doubling over (id, up): (id, last, dist, size): the top, the steps to it and the subtree's size.

    until_stable: up may hold circles; stops when the images no longer shrink and returns these ids instead.
    """
    state = stored(nodes.select("id", F.col("up").alias("ptr"), F.col("up").alias("last"), F.col("up").isNotNull().cast("int").alias("dist"), F.lit(1).cast("long").alias("size")), label)
    images = None
    while True:
        live = state.where("ptr is not null")
        if until_stable:
            now = live.agg(F.count_distinct("ptr")).first()[0]
            if now in (0, images):
                return live.select(F.col("ptr").alias("id")).distinct()
            images = now
        elif live.isEmpty():
            return state.select("id", F.coalesce("last", "id").alias("last"), "dist", "size")
        gain = live.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("gain"))  # exactly 2^k below
        far = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("last").alias("last2"), F.col("dist").alias("dist2"))
        sizes = live.groupBy("ptr").agg(F.count("*").alias("n"))  # pointers end at few tops
        old, state = state, stored(
            salted_join(state, far, ["ptr"], sizes, "n", F.xxhash64("id"), how="left")
            .join(gain, "id", "left")
            .select(
                "id",
                F.col("ptr2").alias("ptr"),
                F.coalesce("last2", "last").alias("last"),
                (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
                (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"),
            ),
            label,
        )
        forget(old)


def _large_forest(containers: DataFrame, with_paths: bool) -> DataFrame:
    """The forest of files above the limit, by joins only; each row carries one ancestor."""
    containers = containers.dropDuplicates(["file_id", "def_id"])
    holders = stored(containers.groupBy("file_id", "name").agg(F.min("def_id").alias("first")), "holders")
    own = containers.join(holders, ["file_id", "name"]).withColumn("holds", F.col("first") == F.col("def_id")).drop("first")
    above = holders.select("file_id", F.col("name").alias("holder"), F.col("first").alias("up"))
    nodes = stored(own.join(above, ["file_id", "holder"], "left").select("file_id", "name", F.col("def_id").alias("id"), "up", "holds"), "nodes")
    cyclic = stored(_doubled(nodes, "circles", until_stable=True), "cyclic").withColumn("in_cycle", F.lit(True))
    tree = stored(
        nodes.join(cyclic, "id", "left").select("file_id", "name", "id", "holds", F.col("up").alias("parent_id"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), F.expr("if(in_cycle, null, up)").alias("up")),
        "tree",
    )
    rings = _rings(nodes, cyclic)
    state = _doubled(tree, "depth").select("id", F.col("last").alias("top"), F.col("dist").alias("depth"), "size")
    tree = stored(tree.join(state, "id").join(rings, F.col("top") == rings["ring_id"], "left").withColumn("root_id", F.coalesce("circle", "top")), "sized")
    heavy = tree.where("up is not null").groupBy("up").agg(F.min_by("id", F.struct(-F.col("size"), F.col("id"))).alias("id")).withColumn("on", F.lit(True))
    chains = _doubled(tree.join(heavy, ["up", "id"], "left").select("id", F.expr("if(on, up, null)").alias("up")), "chains").select("id", F.col("last").alias("chain"), F.col("dist").alias("pos"))
    tree = stored(tree.join(chains, "id"), "chained")
    upper = tree.select(F.col("id").alias("chain"), F.col("up").alias("cur2"))
    place = tree.select(F.col("id").alias("cur"), "chain", "pos")
    parts, cur = None, tree.select("id", F.col("id").alias("cur"))
    while True:  # at most log2(n) + 1 chains on the way to a root
        step = stored(cur.join(place, "cur").join(upper, "chain"), "segments")
        if step.isEmpty():
            break
        parts = step if parts is None else parts.union(step)
        cur = step.where("cur2 is not null").select("id", F.col("cur2").alias("cur"))
    # A chain's or circle's rows meet all of its nodes: long ones are split, as what comes out is their square.
    asked = stored(parts.select("id", "chain", F.col("pos").alias("upto")), "asked")
    links = tree.select("chain", "pos", F.col("id").alias("anc"), F.col("name").alias("anc_name"), F.col("depth").alias("anc_depth"))
    pairs = salted_join(asked, links, ["chain"], asked.groupBy("chain").agg(F.count("*").alias("n")), "n", F.xxhash64("id"), least=2_000).where("pos <= upto")
    ring = rings.select("circle", F.col("ring_id").alias("anc"))
    rounds = tree.where("circle is not null").select("id", "circle", "top")
    around = salted_join(rounds, ring, ["circle"], rounds.groupBy("circle").agg(F.count("*").alias("n")), "n", F.xxhash64("id"), least=2_000).where("anc <> top").select("id", "anc")
    paths = pairs.groupBy("id").agg(F.expr("concat_ws('/', transform(array_sort(collect_list(struct(anc_depth, anc_name))), x -> x.anc_name))").alias("path")) if with_paths else None
    around_n = tree.where("in_cycle").groupBy("circle").agg((F.sum("size") - 1).alias("ring_below"))
    out = tree.join(around_n, "circle", "left").withColumn("below", F.expr("if(in_cycle, ring_below, size - 1)"))
    out = out.join(paths, "id", "left") if with_paths else out.withColumn("path", F.lit(None).cast("string"))
    # Ancestors lie in rows of bounded length; those of circles, which have no order, behind the others. The root's row is part 0.
    chained = pairs.select("id", "anc", F.floor(F.col("anc_depth") / ROW_ANCESTORS).cast("int").alias("part"))
    size = rings.groupBy("circle").agg(F.count("*").alias("ring_size"))
    ringed = around.join(rings.select(F.col("ring_id").alias("anc"), "circle"), "anc").join(size, "circle")
    ringed = ringed.select("id", "anc", (-1 - F.pmod(F.xxhash64("anc"), F.ceil(F.col("ring_size") / ROW_ANCESTORS))).cast("int").alias("part"))
    every = chained.union(ringed).groupBy("id", "part").agg(F.collect_list("anc").alias("ancestors"))
    return out.join(every, "id").withColumnRenamed("id", "def_id").select(*[c.split()[0] for c in FOREST.split(", ")])


def _rings(nodes: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(ring_id, circle): each cyclic node with the smallest id on its circle."""
    state = stored(nodes.join(cyclic, "id").select("id", F.col("up").alias("nxt"), F.least("id", "up").alias("low")), "rings")
    while True:
        far = state.select(F.col("id").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("low").alias("low2"))
        state = stored(state.join(far, "nxt").select("id", F.col("nxt2").alias("nxt"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")), "rings")
        if state.where("moved").isEmpty():
            return state.select(F.col("id").alias("ring_id"), F.col("low").alias("circle"))
        state = state.drop("moved")


def forest(definitions: DataFrame, with_paths: bool = True, limit: int = FOREST_LIMIT) -> DataFrame:
    """FOREST rows of all containers of definitions (def_id, file_id, name, kind, parent).

    One row per container and ROW_ANCESTORS ancestors (part numbers them); ancestors hold the node itself.
    A node on a circle has depth 0, all nodes of its circle as ancestors and the circle's smallest id as root.
    """
    containers = definitions.where(F.col("kind").isin(*CONTAINER_KINDS) & F.col("file_id").isNotNull() & F.col("def_id").isNotNull() & F.col("name").isNotNull()).select(
        F.col("file_id").cast("long"), F.col("def_id").cast("long"), "name", bare_name(F.col("parent")).alias("holder")
    )
    large = containers.groupBy("file_id").count().where(F.col("count") > limit).select("file_id")
    blocks = lambda df: df.repartition("file_id").sortWithinPartitions("file_id").mapInArrow(_blocks(with_paths), FOREST)
    if large.isEmpty():
        return blocks(containers)
    large = maybe_broadcast(stored(large, "large"))
    return blocks(containers.join(large, "file_id", "left_anti")).union(_large_forest(containers.join(large, "file_id", "left_semi"), with_paths))


def _members(definitions: DataFrame) -> DataFrame:
    return definitions.where(
        ~(F.coalesce(F.col("kind"), F.lit("")).isin(*CONTAINER_KINDS) & F.col("name").isNotNull()) & F.col("file_id").isNotNull() & F.col("def_id").isNotNull()
    ).select(F.col("file_id").cast("long").alias("file_id"), F.col("def_id").cast("long").alias("def_id"), F.col("name").alias("own"), bare_name(F.col("parent")).alias("name"))


def _hung(members: DataFrame, holders: DataFrame) -> DataFrame:
    """Members whose holder is known with its columns; one holder may have millions of members."""
    sizes = members.groupBy("file_id", "name").agg(F.count("*").alias("n"))
    return salted_join(members, holders, ["file_id", "name"], sizes, "n", F.xxhash64("def_id"), how="left", once_per=["def_id"])


def related_pairs(definitions: DataFrame, limit: int = FOREST_LIMIT) -> DataFrame:
    """(def_id_a, def_id_b), smaller id first: pairs of which one is reached from the other by parents.

    Rows without file_id or def_id are left out; repeated rows count once; a definition whose kind or
    name is null holds nothing but may be held. No rows in, no rows out.
    """
    trees = stored(forest(definitions, with_paths=False, limit=limit).select("file_id", "name", "def_id", "in_cycle", "holds", "ancestors"), "forest")
    inner = trees.select(F.col("def_id").alias("x"), "in_cycle", F.explode("ancestors").alias("y")).where("x <> y and (not in_cycle or y < x)")
    hung = _hung(_members(definitions).where("name is not null"), trees.where("holds").select("file_id", "name", "ancestors"))
    outer = hung.select(F.col("def_id").alias("x"), F.explode("ancestors").alias("y"))
    return inner.select("x", "y").union(outer).select(F.least("x", "y").alias("def_id_a"), F.greatest("x", "y").alias("def_id_b"))


def hierarchy(definitions: DataFrame, limit: int = FOREST_LIMIT) -> DataFrame:
    """One row per definition: def_id, file_id, parent_id, root_id, depth, path, in_cycle, containers_below.

    path joins names from the root by `/`. A definition without a holder is its own root at depth 0.
    """
    columns = ["def_id", "file_id", "parent_id", "root_id", "depth", "path", "in_cycle", "below"]
    trees = stored(forest(definitions, True, limit).where("part = 0").select(*columns, "name", "holds"), "forest")
    members = _members(definitions)
    alone = members.where("name is null").dropDuplicates(["file_id", "def_id"]).withColumns(
        {"parent_id": F.lit(None).cast("long"), "root_id": F.lit(None).cast("long"), "depth": F.lit(None).cast("int"), "path": F.lit(None).cast("string")}
    )
    holders = trees.where("holds").select("file_id", "name", F.col("def_id").alias("parent_id"), "root_id", "depth", "path")
    hung = _hung(members.where("name is not null"), holders).unionByName(alone).select(
        "def_id",
        "file_id",
        "parent_id",
        F.coalesce("root_id", "def_id").alias("root_id"),
        F.coalesce(F.col("depth") + 1, F.lit(0)).alias("depth"),
        F.expr("if(path is null, own, path || '/' || coalesce(own, ''))").alias("path"),
        F.lit(False).alias("in_cycle"),
        F.lit(0).cast("long").alias("below"),
    )
    return trees.select(*columns).union(hung.select(*columns)).withColumnRenamed("below", "containers_below")
