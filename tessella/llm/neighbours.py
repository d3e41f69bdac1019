"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

import itertools
import logging
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize

EDGES = "u long, w long, sim double"
#: Share of the pairs at the threshold that the start may miss, the nodes of a bucket aimed at, and tables of buckets in one job.
MISS, BUCKET, WAVE = 0.01, 128, 8
#: Nodes of a large bucket that all its blocks have in common.
HUBS = 16
log = logging.getLogger(__name__)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision of an array column of equal lengths."""
    n = len(column)
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _edges(u: np.ndarray, w: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64()), pa.array(sim, pa.float64())], names=["u", "w", "sim"])


def _top(edges: DataFrame, k: int, components: DataFrame | None, threshold: float) -> DataFrame:
    """(u, w, sim, inside): each node's best ``k`` in its own component and its best ``k`` outside, with every link that leads outside."""
    best = edges.groupBy("u", "w").agg(F.max("sim").alias("sim"))
    if components is None:
        best = best.withColumn("inside", F.lit(False))
    else:
        for end in ("u", "w"):
            best = best.join(components.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
        best = best.select("u", "w", "sim", (F.coalesce("_u", "u") == F.coalesce("_w", "w")).alias("inside"))
    order = Window.partitionBy("u", "inside").orderBy(F.desc("sim"), "w")
    return best.withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= k) | (~F.col("inside") & (F.col("sim") >= threshold))).drop("_n")


def _joined(components: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``components`` (node, component) after the further links (src, dst)."""
    if links.isEmpty():
        return components
    known = [] if components is None else [components.select(F.col("node").alias("src"), F.col("component").alias("dst"))]
    for more in known:
        links = links.unionByName(more)
    return materialize(connected_components(links))


def _join_lists(graph: DataFrame, k: int, components: DataFrame | None, threshold: float) -> tuple[DataFrame, DataFrame | None, bool]:
    """The lists and components after every link in ``graph`` that leads outside has joined two components, and whether there was one."""
    links = graph.where(~F.col("inside") & (F.col("sim") >= threshold)).select(F.col("u").alias("src"), F.col("w").alias("dst"))
    after = _joined(components, links)
    if after is components:
        return graph, components, False
    return materialize(_top(graph.select("u", "w", "sim"), k, after, threshold), instead_of=graph), after, True


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one value of the first column together, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(key)) + 1
        edges = [0, *cuts.tolist(), len(key)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and held[0].column(0)[0] != batch.column(0)[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _labels(linked: np.ndarray) -> np.ndarray:
    """The smallest place that each can reach over the symmetric matrix ``linked``, whose diagonal is true."""
    label = np.arange(len(linked))
    rows = np.flatnonzero(linked.sum(axis=1) > 1)
    linked, of = linked[np.ix_(rows, rows)], np.arange(len(rows))
    while len(rows):
        least = np.where(linked, of[None, :], len(of)).min(axis=1)
        least = least[least]
        if (least == of).all():
            break
        of = least
    label[rows] = rows[of]
    return label


def _block_pairs(members: DataFrame, by: str) -> DataFrame:
    """(unit, side) of rows with their block ``mine``: each pair of the ``blocks`` of a group ``by`` of which one is among its first ``hard`` ones is a unit, with sides 1 and 2, or 0 within a block."""
    pair = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.col("mine") < F.col("hard")) | (o < F.col("hard"))), lambda o: F.struct(F.least(F.col("mine"), o).alias("a"), F.greatest(F.col("mine"), o).alias("b")))
    units = members.withColumn("p", F.explode(pair))
    return units.withColumn("unit", F.xxhash64(by, "p.a", "p.b")).withColumn("side", F.when(F.col("p.a") == F.col("p.b"), 0).when(F.col("mine") == F.col("p.a"), 1).otherwise(2))


def _in_blocks(members: DataFrame, by: str, sizes: DataFrame) -> DataFrame:
    """``members`` with ``blocks`` (1 for a group that ``sizes`` does not name), ``hard`` (all of them) and their own, ``mine``, dealt by hash."""
    own = members.join(sizes, by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("hard", F.col("blocks"))
    return own.withColumn("mine", F.pmod(F.xxhash64("id", by), F.col("blocks")).cast("int"))


def _start(nodes: DataFrame, dim: int, bits: int, tables: range, threshold: float, near: int, block: int) -> DataFrame:
    """(u, w, sim, link): what nodes in one bucket have to do with each other, a bucket being the signs along ``bits`` random directions.

    All pairs in a bucket are compared. A larger bucket than ``block`` is dealt into blocks, each with the ``HUBS`` smallest
    nodes of the first one, so that its work grows with its size and not the square: what its blocks miss is left to the rounds that
    follow. Without directions there is one bucket of all nodes, and all pairs of its blocks are compared. ``link`` rows join what links join there, by fewer
    rows than nodes; the others are each node's ``near`` nearest among those it is joined with and among the rest.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = [np.random.RandomState(101 + t).normal(size=(dim, bits)) for t in tables]
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1))
                keys = np.stack([((t << 48) + ((m @ axis > 0) @ (1 << np.arange(bits, dtype=np.int64)))) for t, axis in zip(tables, axes)], axis=1)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * len(axes), pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], names=["id", "v", "keys"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids, side = group.column(1).to_numpy(), group.column(3).to_numpy()
            if len(ids) < 2:
                continue
            m = _matrix(group.column(2).chunk(0))
            sim = m @ m.T
            linked = sim >= threshold
            np.fill_diagonal(linked, True)
            label, before = _labels(linked), np.arange(len(ids))
            if side[0]:
                before = _labels(linked & (side[:, None] == side[None, :]))
            joins = np.unique(np.stack([ids[before], ids[label]], axis=1)[before != label], axis=0)
            found = [(joins[:, 0], joins[:, 1], np.full(len(joins), threshold), True)]
            if not side[0]:
                same = label[:, None] == label[None, :]
                for mask in (same & (ids[:, None] != ids[None, :]), ~same):
                    s = np.where(mask, sim, -3.0)
                    best = np.argpartition(-s, near - 1, axis=1)[:, :near] if len(ids) > near else np.tile(before, (len(ids), 1))
                    a, b = np.repeat(before, best.shape[1]), best.ravel()
                    keep = s[a, b] > -3
                    found.append((ids[a[keep]], ids[b[keep]], s[a, b][keep], False))
            for u, w, s, link in found:
                if len(u):
                    yield pa.RecordBatch.from_arrays([*_edges(u, w, s).columns, pa.array([link] * len(u))], names=["u", "w", "sim", "link"])

    signed = nodes.select("id", "v").mapInArrow(sign, "id long, v array<double>, keys array<long>").select("id", "v", F.explode("keys").alias("key"))
    sizes = materialize(signed.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > block).select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    dealt = _in_blocks(signed, "key", sizes)
    if bits:
        units = dealt.select(F.xxhash64("key", "mine").alias("unit"), "id", "v", F.lit(0).alias("side"))
        hubs = dealt.where("blocks > 1 and mine = 0").withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("_n") <= HUBS)
        others = hubs.withColumn("other", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
        units = units.unionByName(others.select(F.xxhash64("key", "other").alias("unit"), "id", "v", F.lit(0).alias("side")))
    else:
        units = _block_pairs(dealt, "key").select("unit", "id", "v", "side")
    return units.repartition("unit").sortWithinPartitions("unit", "side", "id").mapInArrow(compare, EDGES + ", link boolean")


def _audit(nodes: DataFrame, components: DataFrame | None, threshold: float) -> tuple[int, int, DataFrame]:
    """The true links of the nodes (id, v, mult, audited) that are audited, by brute force in blocks, how many of them are inside a component, and (src, dst) that join the others."""
    named = nodes.withColumn("component", F.col("id")) if components is None else nodes.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = materialize(named)
    true, inside, missed = 0, 0, nodes.sparkSession.createDataFrame([], "src long, dst long")

    def check(block: list) -> DataFrame:
        ids, component, m = np.array([r[0] for r in block]), np.array([r[1] for r in block]), _matrix(pa.array([r[2] for r in block], pa.list_(pa.float64())))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, held, lost = 0, 0, set()
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    others, of, mult = (part.column(i).to_numpy() for i in (0, 1, 3))
                    a, b = np.nonzero((m @ _matrix(part.column(2)).T >= threshold) & (ids[:, None] != others[None, :]))
                    here = component[a] == of[b]
                    n, held = n + int(mult[b].sum()), held + int(mult[b[here]].sum())
                    lost |= set(zip(component[a[~here]].tolist(), of[b[~here]].tolist()))
            rows = [(None, None, n, held), *((x, y, 0, 0) for x, y in lost)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["src", "dst", "n", "held"])

        return materialize(named.select("id", "component", "v", "mult").mapInArrow(count, "src long, dst long, n long, held long"))

    rows = named.where("audited").select("id", "component", "v").toLocalIterator()
    while block := list(itertools.islice(rows, 4096)):
        found = check(block)
        n, held = found.agg(F.sum("n"), F.sum("held")).first()
        true, inside, missed = true + (n or 0), inside + (held or 0), missed.unionByName(found.where("src IS NOT NULL").select("src", "dst"))
    return true, inside, missed


def nn_descent(nodes: DataFrame, *, threshold: float, k: int = 10, near: int = 4, block: int = 1024, settle: float = 0.002, recall: float = 0.9) -> DataFrame | None:
    """(node, component) of each of (id, v array<double>, all of one length, mult, audited) that a cosine >= ``threshold`` links; None without a link.

    It starts from buckets of random directions: as many tables of them, growing with the number of nodes, that a pair at the
    threshold shares one with a probability of 99% (``MISS``). Each round then
    joins every node's neighbours, and those it is a neighbour of (the nearest 2k), with their vectors, compares them
    with each other and keeps each one's best k. A list that is full of links is enlarged to the node's whole component: any pair
    over the threshold joins two components for good, and a node keeps its best k inside and, apart from them, its best k outside.
    So no list ends above the threshold, and copies within a tight group do not crowd out its links to others. Rounds end
    when one joins nothing and changes less than a share ``settle`` of the lists. A round is an equi-join
    and a group of at most 4k vectors a node; no list is longer.
    Then the true links of the ``audited`` nodes are found by brute force. While under a share ``recall`` of them is inside
    components, it goes on with further tables of buckets of half the directions, at last of none, which compare all pairs.
    """
    first = nodes.agg(F.count("*"), F.first(F.size("v"))).first()
    if not first[0]:
        return None
    bits, used, graph, components = min(40, max(0, math.ceil(math.log2(first[0] / BUCKET)))), 0, None, None
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    while True:
        tables = 1 if not bits or agree == 1 else math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))
        for low in range(used, used + tables, WAVE):
            found = materialize(_start(nodes, first[1], bits, range(low, min(low + WAVE, used + tables)), threshold, near, block))
            components = _joined(components, found.where("link").select(F.col("u").alias("src"), F.col("w").alias("dst")))
            lists = found.where(~F.col("link")).select("u", "w", "sim")
            graph = materialize(_top(lists if graph is None else graph.select("u", "w", "sim").unionByName(lists), k, components, threshold), instead_of=graph)
            discard(found)
        used += tables
        graph, components = _descend(nodes, graph, components, k, threshold, settle)
        true, inside, missed = _audit(nodes, components, threshold)
        log.info("%d nodes, buckets of %d directions, %d tables: %d of %d audited links are inside components", first[0], bits, used, inside, true)
        components = _joined(components, missed)
        if not bits or inside >= recall * true:
            return components
        bits //= 2


def _descend(nodes: DataFrame, graph: DataFrame, components: DataFrame | None, k: int, threshold: float, settle: float) -> tuple[DataFrame, DataFrame | None]:
    """The lists and components after rounds of joining neighbours, until they are settled."""
    graph, components, _ = _join_lists(graph, k, components, threshold)
    size = graph.count()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids, inner, outer, component = (group.column(i).to_numpy() for i in (1, 3, 4, 5))
            m = _matrix(group.column(2).chunk(0))
            sim = m @ m.T
            better = sim > np.where(component[:, None] == component[None, :], inner[:, None], outer[:, None])
            better &= ids[:, None] != ids[None, :]
            a, b = np.nonzero(better)
            if len(a):
                yield _edges(ids[a], ids[b], sim[a, b])

    while True:
        order = Window.partitionBy("c", "inside").orderBy(F.desc("sim"), "m")
        around = graph.select(F.col("u").alias("c"), F.col("w").alias("m"), "sim", "inside").unionByName(graph.select(F.col("w").alias("c"), F.col("u").alias("m"), "sim", "inside")).distinct()
        around = around.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 2 * k).select("c", "m")
        least = [F.when(F.count_if(here) >= k, F.min(F.when(here, F.col("sim")))).otherwise(-2.0).alias(name) for name, here in (("inner", F.col("inside")), ("outer", ~F.col("inside")))]
        known = nodes.select("id", "v").join(graph.groupBy(F.col("u").alias("id")).agg(*least), "id", "left")
        known = known.withColumn("component", F.col("id")) if components is None else known.join(components.withColumnRenamed("node", "id"), "id", "left")
        known = known.select(F.col("id").alias("m"), "v", F.coalesce("inner", F.lit(-2.0)).alias("inner"), F.coalesce("outer", F.lit(-2.0)).alias("outer"), F.coalesce("component", "id").alias("component"))
        joined = around.join(known, "m").select("c", "m", "v", "inner", "outer", "component").repartition("c").sortWithinPartitions("c", "m")
        after = materialize(_top(graph.select("u", "w", "sim").unionByName(joined.mapInArrow(compare, EDGES)), k, components, threshold))
        changed = after.join(graph, ["u", "w"], "left_anti").count()
        discard(graph)
        graph, components, more = _join_lists(after, k, components, threshold)
        log.info("%d of %d neighbours changed", changed, size)
        if not more and changed <= settle * size:
            return graph, components


def _count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, n): the multiplicity of all nodes linked with each, from every pair inside a component of (id, v, mult, component).

    A large component is cut in blocks; each pair of blocks is a matrix product in a task of its own that gives out sums,
    not pairs. A group of close copies costs no pairs: see ``_cores``.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m")).where("m > 1")
    sizes = materialize(sizes.withColumn("large", F.col("m") > block))
    small = members.join(sizes.where("not large").select("component"), "component")
    units, sure = small.select(F.xxhash64("component").alias("unit"), "id", "v", "mult", F.lit(0).alias("side")), None
    if not sizes.where("large").isEmpty():
        cored = _cores(members.join(sizes.where("large").select("component"), "component"), threshold, block)
        units = units.unionByName(_block_pairs(cored, "component").select("unit", "id", "v", "mult", "side"))
        sure = cored.where("core").select("id", (F.col("core_mult") - F.col("mult")).alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids, mult, side = (group.column(i).to_numpy() for i in (1, 3, 4))
            m = _matrix(group.column(2).chunk(0))
            n = np.zeros(len(ids), np.int64)
            left, right = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
            for lo in range(0, len(left), 1024):
                rows = left[lo : lo + 1024]
                linked = m[rows] @ m[right].T >= threshold
                if side[0] == 0:
                    linked[np.arange(len(rows)), lo + np.arange(len(rows))] = False
                n[rows] += linked @ mult[right]
                if side[0]:
                    n[right] += linked.T @ mult[rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    found = units.repartition("unit").sortWithinPartitions("unit", "side", "id").mapInArrow(count, "id long, n long")
    return (found if sure is None else found.unionByName(sure)).groupBy("id").agg(F.sum("n").alias("n"))


def _cores(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """``members`` of large components with ``core``, the multiplicity ``core_mult`` of their component's core, and their blocks.

    The core are the nodes within half of a link's angle of the component's mean direction: any two of them are linked, so
    they need no comparison. The others, in the first ``hard`` blocks, are compared with each other and with the core.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                component, m = batch.column(0).to_numpy(), _matrix(batch.column(1))
                own, at = np.unique(component, return_inverse=True)
                total = np.zeros((len(own), m.shape[1]))
                np.add.at(total, at.ravel(), m)
                yield pa.RecordBatch.from_pydict({"component": np.repeat(own, m.shape[1]), "place": np.tile(np.arange(m.shape[1]), len(own)), "s": total.ravel()})

    total = members.select("component", "v").mapInArrow(sums, "component long, place long, s double").groupBy("component", "place").agg(F.sum("s").alias("s"))
    centre = materialize(total.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]).alias("centre")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    near = dot("v", "centre") >= (math.cos(math.acos(max(-1.0, min(1.0, threshold))) / 2) + 1e-9) * F.sqrt(dot("v", "v") * dot("centre", "centre"))
    cored = materialize(members.join(centre, "component").withColumn("core", F.coalesce(near, F.lit(False))).drop("centre"))
    of = lambda core: F.ceil(F.count_if(F.col("core") == core) / block).cast("int")
    counts = cored.groupBy("component").agg(F.coalesce(F.sum(F.when(F.col("core"), F.col("mult"))), F.lit(0)).alias("core_mult"), of(False).alias("hard"), (of(False) + of(True)).alias("blocks"))
    own = cored.join(counts, "component")
    deal = F.xxhash64("id", "component")
    return own.withColumn("mine", F.when(F.col("core"), F.col("hard") + F.pmod(deal, F.greatest(F.col("blocks") - F.col("hard"), F.lit(1)))).otherwise(F.pmod(deal, F.greatest("hard", F.lit(1)))).cast("int"))


def _valid(rows: DataFrame) -> DataFrame:
    """Those of (vec_id, v) whose vector can link, scaled."""
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    valid = rows.where(fine & F.col("vec_id").isNotNull())
    # by the largest component first, so that the squares of very small or large ones stay in range
    return valid.withColumn("top", F.array_max(F.transform("v", F.abs))).select("vec_id", F.transform("v", lambda x: x / F.col("top")).alias("v"))


def _drawn(id_col: str, every: int, most: int, rows: int):
    """Whether an id divisible by ``every`` is among about ``most`` drawn by hash."""
    draw = F.pmod(F.xxhash64(id_col, F.lit("audit")), F.lit(1 << 30)) / float(1 << 30)
    return (F.col(id_col) % every == 0) & (draw <= min(1.0, most * every / max(1, rows)))


def near_vectors(vectors: DataFrame, *, threshold: float = 0.95, k: int = 10, block: int = 2048, every: int = 50, audit_rows: int = 2_000, id_col: str = "vec_id", vector_col: str = "embedding", **descent) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row, for links of cosine >= ``threshold`` in double precision.

    Equal vectors are one node with a count, and link with each other. NN-descent finds the
    components that links form among the nodes, and links are counted over every pair in a component; it audits itself on about
    ``audit_rows`` of the rows whose id is divisible by ``every``, drawn by hash: the bound of the audit's sample, as the work of brute force is that of every row for each. Vectors that are null, empty, zero or hold null or non-finite components link with nothing and
    are their own component; so do vectors of a length that no other has. A row with a null id links with nothing and has a
    null component; rows that repeat an id are nodes of one name. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    valid = _valid(rows)
    nodes = valid.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"), F.max(_drawn("vec_id", every, audit_rows, rows.count())).alias("audited"))
    nodes = materialize(nodes.select("id", "v", "mult", "audited", F.xxhash64("v").alias("h")))
    lengths = sorted(r[0] for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").collect())
    spark = vectors.sparkSession
    edges = spark.createDataFrame([], "src long, dst long")
    for d in lengths:
        found = nn_descent(nodes.where(F.size("v") == d).select("id", "v", "mult", "audited"), threshold=threshold, k=k, **descent)
        if found is not None:
            edges = edges.unionByName(found.select(F.col("node").alias("src"), F.col("component").alias("dst")))
    components = materialize(connected_components(edges))
    grouped = nodes.join(components, F.col("id") == F.col("node")).select("id", "v", "mult", "component")
    counts = None
    for d in lengths:
        one = _count_links(grouped.where(F.size("v") == d), threshold, block)
        counts = one if counts is None else counts.unionByName(one)
    counts = counts if counts is not None else spark.createDataFrame([], "id long, n long")
    named = nodes.select("id", "h", "mult").join(counts, "id", "left").join(components, F.col("id") == F.col("node"), "left")
    named = named.select(F.col("h").alias("_h"), "id", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("_n"), F.coalesce("component", "id").alias("_c"))
    named = materialize(named)
    mine = valid.select("vec_id", F.xxhash64("v").alias("_h"))
    found = mine.join(named, "_h").groupBy("vec_id").agg(F.max("_n").alias("n_links"), F.min("_c").alias("component_id"))
    out = rows.select(F.col("vec_id").alias("_id")).join(found, F.col("_id") == F.col("vec_id"), "left")
    return out.select(
        F.col("_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit_recall(vectors: DataFrame, result: DataFrame, *, threshold: float = 0.95, every: int = 50, audit_rows: int = 4_000, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Share of the true links of about ``audit_rows`` of the rows whose id is divisible by ``every`` that ``result`` counted, found by brute force in blocks.

    Rows that link with nothing by definition (see ``near_vectors``) have no true links. Rows without any link measure
    nothing: a warning says so, and the share is 1.
    """
    unit = _valid(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")))
    queries = unit.where(_drawn("vec_id", every, audit_rows, vectors.count()))
    counted = F.broadcast(queries.select("vec_id").distinct())
    counted = {r[0]: r[1] for r in result.join(counted, "vec_id").select("vec_id", "n_links").toLocalIterator()}
    rows = queries.toLocalIterator()
    total, found = 0, 0

    def check(block: list) -> tuple[int, int]:
        of_size: dict[int, list] = {}
        for place, (_, v) in enumerate(block):
            of_size.setdefault(len(v), []).append(place)
        sides = {d: (np.array(places), _matrix(pa.array([block[p][1] for p in places], pa.list_(pa.float64())))) for d, places in of_size.items()}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(block), np.int64)
            for batch in batches:
                size = pc.list_value_length(batch.column(1)).to_numpy()
                for d, (places, m) in sides.items():
                    other = batch.column(1).filter(pa.array(size == d))
                    if len(other):
                        n[places] += (m @ _matrix(other).T >= threshold).sum(axis=1)
            yield pa.RecordBatch.from_pydict({"place": np.arange(len(block)), "n": n})

        true = {r[0]: r[1] - 1 for r in unit.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n")).collect()}
        return sum(true.values()), sum(min(n, counted.get(block[p][0], 0)) for p, n in true.items())

    while block := list(itertools.islice(rows, 4096)):
        a, b = check(block)
        total, found = total + a, found + b
    if not total:
        warnings.warn("no links among the audited rows: nothing was measured", stacklevel=2)
        return 1.0
    return found / total
