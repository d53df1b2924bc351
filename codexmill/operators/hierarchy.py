"""Parent-child links to full hierarchies (problem 5).

Nodes are child pages; a link names a parent, which may be a node itself or a *top* (a name with
no page, or whose page has no link). Nodes may have several parents and links may go round.

1. **Peeling.** Only nodes with exactly one parent that is a node can close a pure chain or cycle.
   Their parent pointers are doubled: after k rounds a pointer spans 2^k links, nodes whose chain
   ends drop out, and the pointers' targets are just the nodes that survive 2^k rounds of peeling
   leaves. When neither set shrinks any more, the targets are the cycles; each is cut at its
   smallest node.
2. **Euler tours.** Cut nodes and nodes with several parents become *piece roots*, which leaves a
   forest. Every node gets an entry and an exit arc, linked to a tour of its tree; parallel list
   ranking (pointer jumping, log2 of the longest tour rounds) gives each arc its place, and each
   node its tree, depth and entry-exit interval. Siblings are linked within salted buckets first,
   so a parent with a third of all children is not one task's work.
3. **Intervals.** Ancestors and descendants are the intervals that hold a node's entry. They are
   found by equi-joins on dyadic blocks: an interval is cut into O(log n) aligned blocks, and an
   entry lies in one block per size, so every pair is met once and nothing else is compared.
4. **Between pieces.** Links that leave a piece (the other parents, the cut cycle links) form a
   graph of pieces. Its leaves are peeled off from the tops down: a piece all of whose parents'
   pieces are peeled ends, those left over have an ancestry that never ends. What is asked for
   (topmost names, or ancestors) spreads down this graph from a frontier of what was new in the
   round before, so no pair is ever met that is not part of the answer; there is no closure of the
   graph. Rounds are as many as multi-parent nodes follow one another on a path.

All steps are joins and aggregations on distributed tables, with every round in the checkpoint
folder; steps 1 to 3 take O(log n) rounds. Links are never collected.

Defined cases: null children, null parents and parents empty after normalising are no links;
repeated links count once; a node that is its own parent is a cycle; empty tables give no rows;
extra columns are ignored; if a name belongs to several pages, the smallest page id is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_title
from ..session import cut, union_of

#: Buckets into which the children of one parent are spread while they are linked.
SALT = 64


def category_links(categorylinks: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(child, parent_name, parent) of the subcat rows, parent null for tops; (page, name) of category pages."""
    raw = (
        categorylinks.where("cl_type = 'subcat'")
        .select(F.col("cl_from").alias("child"), norm_title("cl_to").alias("parent_name"))
        .where("child is not null and parent_name <> ''")
        .distinct()
    )
    title = norm_title("title")
    named = (
        articles.select(title.alias("t"), F.col("page_id").alias("page"))
        .where(F.col("t").startswith("Category:") & F.col("page").isNotNull())
        .groupBy(F.col("t").substr(F.lit(10), F.length("t") - 9).alias("name"))
        .agg(F.min("page").alias("page"))
    )
    pages = named.join(raw.select(F.col("child").alias("page")).distinct(), "page", "left_semi")
    links = raw.join(pages.select(F.col("name").alias("parent_name"), F.col("page").alias("parent")), "parent_name", "left")
    return cut(links.select("child", "parent_name", "parent")), named


def cycle_cuts(single: DataFrame) -> DataFrame:
    """The smallest node of every cycle of ``single`` (child, parent), where a child has one parent."""
    s = cut(single.select(F.col("child").alias("x"), F.col("parent").alias("to"), F.col("child").alias("low")))
    before, seen = -1, None
    while True:
        n = s.count()
        if n == 0:
            break
        if n == before:  # none dropped out any more: what is left runs into cycles; are they covered?
            now = s.agg(F.count_distinct("to").alias("m"), F.sum(F.col("low").cast("decimal(38,0)")).alias("l")).first()
            if (now["m"], now["l"]) == seen:
                break
            seen = (now["m"], now["l"])
        before = n
        t = s.select(F.col("x").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        s = cut(s.join(t, "to").select("x", F.col("to2").alias("to"), F.least("low", "low2").alias("low")))
    on_cycle = s.select(F.col("to").alias("x")).distinct()
    return s.join(on_cycle, "x", "left_semi").select(F.col("low").alias("child")).distinct()


def euler_tours(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """node, piece, depth, entry, exit for ``nodes`` (node) and the forest ``tree`` (child, parent).

    Within a piece entry and exit are unique, and a node's interval holds those of its descendants.
    """
    # Arc 2n enters node n, arc 2n + 1 leaves it. A leaf's two arcs follow each other and are one element,
    # named by the leaving arc, so leaves, which most nodes are, take half the room in every round.
    inner_nodes = tree.select(F.col("parent").alias("child"), F.lit(0).alias("leaf")).distinct()
    start = (F.col("child") * 2 + F.coalesce("leaf", F.lit(1))).alias("start")
    kids = tree.join(inner_nodes, "child", "left").select("parent", "child", start, F.pmod(F.xxhash64("child"), F.lit(SALT)).alias("b"))
    inner = Window.partitionBy("parent", "b").orderBy("child")
    linked = kids.withColumn("sib", F.lead("start").over(inner))
    groups = kids.groupBy("parent", "b").agg(F.min_by("start", "child").alias("first"))
    between = Window.partitionBy("parent").orderBy("b")
    groups = groups.withColumn("after", F.lead("first").over(between))
    sib = linked.join(groups.select("parent", "b", "after"), ["parent", "b"]).select("child", "parent", F.coalesce("sib", "after").alias("sib"))
    first = groups.groupBy("parent").agg(F.min_by("first", "b").alias("kid")).select(F.col("parent").alias("node"), "kid")
    shape = nodes.join(first, "node", "left").join(sib.withColumnRenamed("child", "node"), "node", "left")

    def element(arc, to, rank: int, rise: int):
        return F.struct(arc.alias("arc"), to.alias("to"), F.lit(rank).cast("bigint").alias("rank"), F.lit(rise).cast("bigint").alias("rise"))

    enter, leave, is_leaf = F.col("node") * 2, F.col("node") * 2 + 1, F.col("kid").isNull()
    onward = F.coalesce(F.col("sib"), F.col("parent") * 2 + 1)
    both = F.array(element(enter, F.col("kid"), 1, -1), element(leave, onward, 1, 1))
    arcs = shape.select(F.explode(F.when(is_leaf, F.array(element(leave, onward, 2, 0))).otherwise(both)).alias("a")).select("a.*")
    # rank: arcs from this one to the end of what it spans; rise: leaving minus entering arcs therein.
    # An arc without successor is the exit of its piece's root and names the piece.
    arcs = cut(arcs.withColumn("last", F.col("arc")))
    while True:
        going = arcs.where("to is not null")
        if going.isEmpty():
            break
        nxt = arcs.select(F.col("arc").alias("to"), F.col("to").alias("to2"), F.col("rank").alias("rank2"), F.col("rise").alias("rise2"), F.col("last").alias("last2"))
        jumped = going.join(nxt, "to").select("arc", F.col("to2").alias("to"), (F.col("rank") + F.col("rank2")).alias("rank"), (F.col("rise") + F.col("rise2")).alias("rise"), F.col("last2").alias("last"))
        arcs = cut(jumped.unionByName(arcs.where("to is null")))
    # A leaf's element begins with its entering arc; its leaving arc comes one place and one rise later.
    alone = F.count("*") == 1
    ranked = arcs.withColumn("node", F.shiftright("arc", 1)).groupBy("node").agg(
        F.max("rank").alias("in_rank"),
        F.when(alone, F.min("rank") - 1).otherwise(F.min("rank")).alias("out_rank"),
        F.when(alone, F.min("rise") + 1).otherwise(F.min_by("rise", "rank")).alias("rise"),
        F.shiftright(F.max("last"), 1).alias("piece"),
    )
    # The rise of a leaving arc counts itself and its open ancestors: depth + 1.
    return ranked.select("node", "piece", (F.col("rise") - 1).cast("int").alias("depth"), (-F.col("in_rank")).alias("entry"), (-F.col("out_rank")).alias("exit"))


def interval_pairs(tours: DataFrame) -> DataFrame:
    """(node, ancestor, up): every pair in one piece, node itself included with up = 0.

    Ranks are taken as positions; the interval [entry, exit] is cut into aligned dyadic blocks.
    """
    t = tours.select("node", "piece", "depth", (-F.col("exit")).alias("lo"), (-F.col("entry")).alias("hi"))
    pieces = t.groupBy("piece").agg(F.max("hi").alias("top"))
    # Per size 2^k at most one block at either end; b counts blocks of that size.
    levels = "sequence(0, cast(ceil(log2(top + 2)) as int))"
    cover = F.expr(
        f"""flatten(transform({levels}, k -> filter(array(
             if((((lo + shiftleft(1L, k) - 1) div shiftleft(1L, k)) % 2 = 1) and (((lo + shiftleft(1L, k) - 1) div shiftleft(1L, k)) + 1) * shiftleft(1L, k) <= hi + 1,
                named_struct('k', k, 'b', (lo + shiftleft(1L, k) - 1) div shiftleft(1L, k)), null),
             if((((hi + 1) div shiftleft(1L, k)) % 2 = 1) and (((hi + 1) div shiftleft(1L, k)) - 1) * shiftleft(1L, k) >= lo,
                named_struct('k', k, 'b', ((hi + 1) div shiftleft(1L, k)) - 1), null)
           ), x -> x is not null)))"""
    )
    t = t.join(pieces, "piece")
    up = t.select("piece", F.col("node").alias("ancestor"), F.col("depth").alias("da"), F.explode(F.array_distinct(cover)).alias("c")).select("piece", "ancestor", "da", "c.k", "c.b")
    # A node's own position is that of its entry arc.
    blocks = F.expr(f"transform({levels}, k -> named_struct('k', k, 'b', hi div shiftleft(1L, k)))")
    down = t.select("piece", "node", "depth", F.explode(blocks).alias("c")).select("piece", "node", "depth", "c.k", "c.b")
    return down.join(up, ["piece", "k", "b"]).select("node", "ancestor", (F.col("depth") - F.col("da")).alias("up"))


def endless(edges: DataFrame) -> DataFrame:
    """(a): nodes of the graph ``edges`` (a, b), distinct, from which edges can be followed for ever."""
    left = cut(edges.groupBy("a").agg(F.count("*").alias("n")))
    done = cut(edges.select(F.col("b").alias("a")).distinct().join(left.select("a"), "a", "left_anti"))
    while not done.isEmpty():
        hit = edges.join(done.select(F.col("a").alias("b")), "b").groupBy("a").agg(F.count("*").alias("m"))
        now = cut(left.join(hit, "a", "left").select("a", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")))
        done, left = now.where("n = 0").select("a"), now.where("n > 0")
    return left.select("a")


def spread(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Distinct (a, x): every label x of ``own`` (a, x), and of all nodes reached over ``edges`` (a, b).

    Semi-naive: only what was new in a round goes on in the next.
    """
    new = cut(own.select("a", "x").distinct())
    parts = [new]
    while not new.isEmpty():
        known = union_of(parts)
        if len(parts) > 6:
            known = cut(known)
            parts = [known]
        step = edges.select("a", "b").join(new.select(F.col("a").alias("b"), "x"), "b").select("a", "x").distinct()
        new = cut(step.join(known, ["a", "x"], "left_anti"))
        parts.append(new)
    return union_of(parts)


class Hierarchy:
    """The pieces of a hierarchy, from which paths, roots, descendants and endless pages derive."""

    def __init__(self, categorylinks: DataFrame, articles: DataFrame):
        self.links, self.names = category_links(categorylinks, articles)
        n_parents = self.links.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
        single = n_parents.where("n = 1 and parent is not null").select("child", "parent")
        single = cut(single)
        self.tree = cut(single.join(cycle_cuts(single), "child", "left_anti"))
        nodes = n_parents.select(F.col("child").alias("node"))
        self.tours = cut(euler_tours(nodes, self.tree))
        # Links that leave a piece: those of its root.
        self.exits = cut(self.links.join(self.tours.select(F.col("piece").alias("child")).distinct(), "child", "left_semi"))
        where = self.tours.select(F.col("node").alias("parent"), F.col("piece").alias("b"))
        self.crossing = self.exits.where("parent is not null").join(where, "parent").select(F.col("child").alias("a"), "parent", "b")
        self.edges = cut(self.crossing.select("a", "b").distinct())

    def roots(self) -> DataFrame:
        """Distinct (cl_from, root): topmost names reached; '' where following parents never ends."""
        own = self.exits.where("parent is null").select(F.col("child").alias("a"), F.col("parent_name").alias("x"))
        per_piece = spread(self.edges, own).unionByName(endless(self.edges).select("a", F.lit("").alias("x")))
        return self.tours.select(F.col("node").alias("cl_from"), F.col("piece").alias("a")).join(per_piece, "a").select("cl_from", F.col("x").alias("root"))

    def descendants(self) -> DataFrame:
        """Distinct (ancestor, descendant) pages, over all parents; a page on a cycle is its own descendant."""
        own = cut(interval_pairs(self.tours))
        inside = own.where("up > 0").select("ancestor", F.col("node").alias("descendant"))
        # What lies above a piece: the parents outside it with their ancestors, and what lies above their pieces.
        gates = self.crossing.select("a", "parent").distinct()
        above = spread(self.edges, gates.join(own.select(F.col("node").alias("parent"), F.col("ancestor").alias("x")), "parent").select("a", "x"))
        outside = above.join(self.tours.select(F.col("piece").alias("a"), F.col("node").alias("descendant")), "a").select(F.col("x").alias("ancestor"), "descendant")
        return inside.unionByName(outside).distinct()

    def paths(self) -> DataFrame:
        """(cl_from, root, depth, path): one row per path of names from a topmost category to the page.

        ``depth`` counts the links of the path. Paths that meet a cycle stop where a piece would
        repeat and do not come out; pages with no other path appear in roots() with root ''.
        """
        named = self.names.groupBy("page").agg(F.min("name").alias("name"))
        own = interval_pairs(self.tours).join(named.select(F.col("page").alias("ancestor"), "name"), "ancestor", "left")
        own = own.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), F.coalesce("name", F.lit("")).alias("name")))).alias("p"))
        own = cut(own.select("node", F.transform("p", lambda x: x["name"]).alias("names")).join(self.tours.select("node", "piece"), "node"))
        start = self.exits.where("parent is null").select(F.col("child").alias("piece"), F.col("parent_name").alias("root"), F.array("parent_name").alias("above"), F.array("child").alias("seen"))
        frontier, done = cut(start), None
        down = self.crossing.select(F.col("a").alias("piece2"), "parent", F.col("b").alias("piece"))
        while not frontier.isEmpty():
            done = frontier if done is None else done.unionByName(frontier)
            step = frontier.join(down, "piece").where("not array_contains(seen, piece2)").join(own.select(F.col("node").alias("parent"), "names"), "parent")
            frontier = cut(step.select(F.col("piece2").alias("piece"), "root", F.concat("above", "names").alias("above"), F.concat("seen", F.array("piece2")).alias("seen")))
        whole = (frontier if done is None else done).join(own, "piece")
        return whole.select(F.col("node").alias("cl_from"), "root", (F.size("above") + F.size("names") - 1).alias("depth"), F.concat("above", "names").alias("path"))
