"""A random forest as tables: label-balanced bags, growth (large nodes from histograms, small ones in a task), scoring, votes, usage.

``nodes`` has a row a node: tree_id, node_id (the root is 1, the children of k are 2k and 2k + 1), feature, split (null at a
leaf), share_left (how much of the weight goes left, for rows without a value) and probs (one for each class).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmill.operators.sampling import draw, draws
from voxmill.plans.subtrees import LEAST_GAIN, MOST_DEPTH, grown
from voxmill.sources.tables import discard, written

#: Values (rows x features) of a node that one task grows to its leaves: 64 MB of doubles.
CELLS = 1 << 23
#: Nodes go to tasks together until their rows are this many times the table, or LEAST_SENT values.
SENT, LEAST_SENT = 4, 1 << 27
#: Rows of all nodes together that one task grows, unless one node has more; each is an entry of some 20 bytes.
ENTRIES = 1 << 21
#: Hash buckets within which a feature is permuted.
BUCKETS = 64
#: Larger nodes of one level whose splits go to every task (about 100 bytes each).
MOST_SPLITS = 1 << 20
#: Nodes that go to every task at once (about 100 bytes each as arrays).
MOST_NODES = 1 << 20


def bags(rows: DataFrame, trees: int, percent: int, seed: int = 1) -> DataFrame:
    """Rows (row_id, label_id, class_id, ...) with tree_id, in_bag and weight: of each tree a label is in as a whole or out
    (rows with label -1 each for themselves); weights are the size of the bag's largest class over that of the row's."""
    spread = rows.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    key = F.when(F.col("label_id") == -1, F.concat(F.lit("r"), F.col("row_id").cast("string"))).otherwise(F.col("label_id").cast("string"))
    drawn = spread.withColumn("in_bag", draw(key, F.col("tree_id"), F.lit(seed)) % 100 < percent)
    sizes = drawn.where("in_bag").groupBy("tree_id", "class_id").agg(F.count("*").alias("n"))  # a row a tree and class
    weights = sizes.select("tree_id", "class_id", (F.max("n").over(W.partitionBy("tree_id")) / F.col("n")).alias("weight"))
    return drawn.join(weights, ["tree_id", "class_id"], "left")


def times_drawn(u: Column) -> Column:
    """How often a row is drawn with replacement: a Poisson draw of mean 1 from ``u`` in [0, 1), at most 6."""
    times, below = F.lit(0), 0.0
    for k in range(6):
        below += math.exp(-1) / math.factorial(k)
        times = times + F.when(u >= below, 1).otherwise(0)
    return times


def bootstrap(rows: DataFrame, trees: int, seed: int = 1) -> DataFrame:
    """Rows with tree_id and weight, the times they are drawn (by the row's key)."""
    spread = rows.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return spread.withColumn("weight", times_drawn(draw("row_id", F.col("tree_id"), F.lit(seed)) / F.lit(float(1 << 32)))).where("weight > 0")


def cuts(rows: DataFrame, n_features: int, n_bins: int) -> DataFrame:
    """feature, cuts: up to ``n_bins - 1`` values between the quantiles of each feature, from one pass of sketches."""
    shares = [i / n_bins for i in range(1, n_bins)]
    sketch = rows.agg(*(F.percentile_approx(F.get("features", i), shares, 10 * n_bins).alias(str(i)) for i in range(n_features)))
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.array_sort(F.array_distinct(F.col(str(i)))).alias("cuts")) for i in range(n_features))))
    return sketch.select(pairs.alias("p")).select("p.feature", "p.cuts")


def histograms(rows: DataFrame, bins: np.ndarray | None = None) -> DataFrame:
    """Weight of each (tree_id, node_id, feature, bin, class_id) of ``rows`` (tree_id, node_id, class_id, weight, binned: a
    bin for each feature, null without a value). Summed map-side; a row a bin at most."""
    return rows.select("tree_id", "node_id", "class_id", "weight", F.posexplode("binned").alias("feature", "bin")).groupBy("tree_id", "node_id", "feature", "bin", "class_id").agg(F.sum("weight").alias("w"))


def _entropy(counts: Column) -> Column:
    def part(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n)).otherwise(0.0)

    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return part(total) - F.aggregate(counts, F.lit(0.0), lambda a, x: a + part(x))


def best_splits(hist: DataFrame, classes: int, k: int | None = None, n_features: int = 0, seed: int = 1, names: list[int] | None = None) -> DataFrame:
    """The split of each node: feature and bin (left: bins up to it) of least weighted conditional entropy, gain (entropy a
    unit of weight), the class weights and the part of the weight that goes left. With ``k``, a node looks at its k features of least draw,
    and at further ones as long as none of those gains over LEAST_GAIN. ``names``: the numbers that features are drawn by."""
    zero = F.array(*(F.lit(0.0) for _ in range(classes)))
    vector = F.array(*(F.sum(F.when(F.col("class_id") == c, F.col("w")).otherwise(0.0)) for c in range(classes)))
    sums = hist.where("bin is not null").groupBy("tree_id", "node_id", "feature", "bin").agg(vector.alias("own"))
    # The bins of one feature of one node: bounded by the number of bins, never by the rows.
    per = sums.groupBy("tree_id", "node_id", "feature").agg(F.array_sort(F.collect_list(F.struct("bin", "own"))).alias("bins"))

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    total = F.aggregate(F.transform("bins", lambda b: b["own"]), zero, add)
    per = per.withColumn("total", total).where(F.size("bins") > 1)
    running = F.transform(F.sequence(F.lit(1), F.size("bins") - 1), lambda i: F.struct(F.get(F.col("bins"), i - 1)["bin"].alias("bin"), F.aggregate(F.transform(F.slice("bins", F.lit(1), i), lambda b: b["own"]), zero, add).alias("left")))
    cut = per.select("tree_id", "node_id", "feature", "total", F.inline(running))
    right = F.zip_with("total", "left", lambda t, x: t - x)
    weight = F.aggregate("total", F.lit(0.0), lambda a, x: a + x)
    after = (_entropy(F.col("left")) + _entropy(right)) / weight
    scored = cut.select("tree_id", "node_id", "feature", "bin", "total", (F.aggregate("left", F.lit(0.0), lambda a, x: a + x) / weight).alias("share_left"), F.round(after, 9).alias("after"), F.round(_entropy(F.col("total")) / weight - after, 9).alias("gain"))
    best = scored.groupBy("tree_id", "node_id", "feature").agg(F.min(F.struct("after", "bin", "share_left", "gain", "total")).alias("b")).select("tree_id", "node_id", "feature", "b.*")
    if k:
        place = F.row_number().over(W.partitionBy("tree_id", "node_id").orderBy(draw("tree_id", "node_id", _original("feature", names) if names else "feature", F.lit(seed)), "feature"))
        best = best.withColumn("place", place)
        first = F.min(F.when((F.col("place") >= k) & F.col("good"), F.col("place"))).over(W.partitionBy("tree_id", "node_id"))
        good = F.max(F.col("gain") > LEAST_GAIN).over(W.partitionBy("tree_id", "node_id").orderBy("place"))
        best = best.withColumn("good", good).withColumn("last", first).where(F.col("last").isNull() | (F.col("place") <= F.col("last")))
    chosen = best.groupBy("tree_id", "node_id").agg(F.min(F.struct("after", "feature", "bin", "share_left", "gain", "total")).alias("b"))
    return chosen.select("tree_id", "node_id", "b.feature", "b.bin", "b.gain", "b.share_left", "b.total")


def best_nominal_splits(hist: DataFrame, classes: int) -> DataFrame:
    """The same for features whose bins are names: one value against all others (bin: that value)."""
    vector = F.array(*(F.sum(F.when(F.col("class_id") == c, F.col("w")).otherwise(0.0)) for c in range(classes)))
    sums = hist.where("bin is not null").groupBy("tree_id", "node_id", "feature", "bin").agg(vector.alias("left"))
    whole = W.partitionBy("tree_id", "node_id", "feature")  # the values of one feature
    total = F.array(*(F.sum(F.get("left", c)).over(whole) for c in range(classes)))
    cut = sums.withColumn("total", total).withColumn("right", F.zip_with("total", "left", lambda t, x: t - x))
    weight = F.aggregate("total", F.lit(0.0), lambda a, x: a + x)
    after = (_entropy(F.col("left")) + _entropy(F.col("right"))) / weight
    scored = cut.select("tree_id", "node_id", "feature", "bin", F.round(after, 9).alias("after"), F.round(_entropy(F.col("total")) / weight - after, 9).alias("gain"), (F.aggregate("left", F.lit(0.0), lambda a, x: a + x) / weight).alias("share_left"))
    return scored.groupBy("tree_id", "node_id").agg(F.min(F.struct("after", "feature", "bin", "gain", "share_left")).alias("b")).select("tree_id", "node_id", "b.feature", "b.bin", "b.gain", "b.share_left")


def in_bags(rows: DataFrame, trees: int, percent: int, seed: int = 1) -> DataFrame:
    """``rows`` (row_id, label_id, class_id, ...) with ``at``: tree_id and weight of the bags that hold the row, those of
    ``bags``. Rows are not copied: only keys are counted tree by tree, for the weights."""

    def inside(batch) -> dict[int, np.ndarray]:
        draw_of = _label_draws(batch.column("row_id"), batch.column("label_id"), seed)
        return {t: draw_of(t) % 100 < percent for t in range(trees)}

    def counted(batches):
        for batch in batches:
            label = batch.column("class_id").to_numpy()
            for t, held in inside(batch).items():
                names, n = np.unique(label[held], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int64)), pa.array(names.astype(np.int64)), pa.array(n)], ["tree_id", "class_id", "n"])

    sizes = rows.select("row_id", "label_id", "class_id").mapInArrow(counted, "tree_id long, class_id long, n long").groupBy("tree_id", "class_id").agg(F.sum("n").alias("n")).toPandas()  # trees x classes values
    share = sizes.groupby("tree_id")["n"].transform("max") / sizes["n"]
    known = {(t, c): w for t, c, w in zip(sizes["tree_id"], sizes["class_id"], share, strict=True)}
    names = list(rows.columns)

    def entries(batches):
        step = max(1, (1 << 21) // trees)
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            weight, (classes, back) = np.zeros((batch.num_rows, trees)), np.unique(batch.column("class_id").to_numpy(), return_inverse=True)
            for t, held in inside(batch).items():
                weight[:, t] = held * np.array([known.get((t, c), 0.0) for c in classes])[back]
            row, tree = np.nonzero(weight)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(tree.astype(np.int32)), pa.array(weight[row, tree])], ["tree_id", "weight"])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.ListArray.from_arrays(pa.array(ends), each)], [*names, "at"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(entries, f"{shape}, at array<struct<tree_id: int, weight: double>>")


def _label_draws(row_id, label_id, seed: int):
    """A function of a tree that gives the draw of each row: its label's (taken once), of rows with label -1 their own."""
    ids, null = row_id.to_numpy(), np.asarray(label_id.is_null())
    label = label_id.fill_null(0).to_numpy()
    names, back = np.unique(label, return_inverse=True)
    alone = (label == -1) & ~null

    def draw_of(tree: int) -> np.ndarray:
        found = draws((b"%d," % i for i in names.tolist()), tree, seed)[back]
        found[alone] = draws((b"r%d," % i for i in ids[alone].tolist()), tree, seed)
        found[null] = draws((b"",), tree, seed)
        return found

    return draw_of


def train(rows: DataFrame, classes: int, n_features: int, trees: int = 200, percent: int = 66, depth: int = MOST_DEPTH, n_bins: int = 32, seed: int = 1, k: int | None = None, features: list[int] | None = None, cells: int = CELLS) -> DataFrame:
    """``nodes`` of a forest over ``rows`` (row_id, label_id, class_id 0.., features array) with label-balanced bags; the
    other arguments are those of ``grow``. Rows without class or features take no part."""
    known = rows.where("class_id is not null and features is not null")
    return grow(in_bags(known, trees, percent, seed), classes, n_features, trees, depth, n_bins, seed, k, features, cells)


def grow(rows: DataFrame, classes: int, n_features: int, trees: int, depth: int = MOST_DEPTH, n_bins: int = 32, seed: int = 1, k: int | None = None, features: list[int] | None = None, cells: int = CELLS) -> DataFrame:
    """``nodes`` of ``trees`` trees over ``rows`` (class_id, features, ``at``: an array of tree_id and weight).

    A node of at most ``cells`` values (rows x features) is grown to its leaves by one task, at midpoints of sorted values.
    Larger nodes are split level by level at the edges of ``n_bins`` quantile bins, from histograms that tasks sum first.
    Rows are stored once, with the node and weight of each tree beside them; so many nodes go to tasks together that what is sent is
    about SENT times the rows (of a small table: all). A task gets several nodes at once if their rows are few or
    the table is no larger than ``cells``, and a row that is in several of them is sent to it once. ``k`` features a node (a tenth, rounded up, if not given).
    Rows without a value for a split's feature go to both sides with their share of the weight. ``features``: use these
    alone (the second pass of ``two_passes``); ids of the others never occur. An empty table gives no nodes.
    """
    spark = rows.sparkSession
    used = sorted(features) if features is not None else list(range(n_features))
    k = k or max(1, math.ceil(0.1 * len(used)))
    values = F.col("features").cast("array<double>") if features is None else F.array(*(F.get("features", i).cast("double") for i in used))
    entries = F.transform("at", lambda a: F.struct(a["tree_id"].alias("tree_id"), F.lit(1).cast("long").alias("node_id"), a["weight"].cast("double").alias("weight")))
    stored = written(rows.select(F.col("class_id").cast("int").alias("class_id"), values.alias("features"), entries.alias("at")).where(F.size("at") > 0), "bag")
    found = _grow_all(stored, classes, used, depth, n_bins, seed, k, cells, stored.count())
    discard(stored)
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree_id, node_id, weight) of every entry of ``at`` of a batch."""
    at = batch.column("at")
    flat = at.flatten()
    row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
    return row, *(flat.field(name).to_numpy(zero_copy_only=False) for name in ("tree_id", "node_id", "weight"))


def _matrix(features, n: int) -> np.ndarray:
    """The features of ``n`` rows (an Arrow list array); NaN where there is no value."""
    return features.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(n, -1)


def _one(column: pa.ChunkedArray) -> pa.Array:
    """The column as one array, not copied if it is one already."""
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _finder(known: dict[tuple[int, int], int]):
    """A function of tree_ids and node_ids that gives their values in ``known``, -1 where they are not there."""
    pairs, values = np.array(list(known), np.int64).reshape(-1, 2), np.array(list(known.values()), np.int64)
    names = np.unique(pairs[:, 1])
    codes = pairs[:, 0] * len(names) + np.searchsorted(names, pairs[:, 1])
    order = np.argsort(codes)
    codes, values = codes[order], values[order]

    def find(tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.full(len(tree), -1)
        name = np.minimum(np.searchsorted(names, node), len(names) - 1)
        code = tree.astype(np.int64) * len(names) + name
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where((names[name] == node) & (codes[at] == code), values[at], -1)

    return find


def _grow_all(now: DataFrame, classes: int, used: list[int], depth: int, n_bins: int, seed: int, k: int, cells: int, total: int) -> list[DataFrame]:
    """Tables of nodes of the trees of ``now``, whose table has ``total`` rows."""
    spark, own, marks, found, few = now.sparkSession, None, None, [], []
    for level in range(depth + 1):
        masses = ", ".join(f"m{c} double" for c in range(classes))
        sizes = now.select("class_id", "at").mapInArrow(_sizes(1 << level, classes), f"tree_id int, node_id long, n long, {masses}").groupBy("tree_id", "node_id")
        sizes = sizes.agg(F.sum("n").alias("n"), F.array(*(F.sum(f"m{c}") for c in range(classes))).alias("mass"))
        sizes = written(sizes.withColumn("whole", F.aggregate("mass", F.lit(0.0), lambda a, x: a + x)), "large")
        large = sizes.where(F.col("n") * len(used) > cells)
        few += [(r.tree_id, r.node_id, r.n) for r in sizes.where(F.col("n") * len(used) <= cells).select("tree_id", "node_id", "n").collect()]  # two for each large node
        n_large = large.count()
        if not n_large:
            discard(sizes)
            break
        if n_large > MOST_SPLITS:
            raise ValueError(f"{n_large} nodes of more than {cells} values at once; raise cells")
        if marks is None:  # the quantiles of a feature are taken once, over all rows
            marks = {r.feature: np.array(r.cuts, float) for r in cuts(now, len(used), n_bins).collect()}  # features x n_bins values
            edges = spark.createDataFrame([(i, b, float(x)) for i, m in marks.items() for b, x in enumerate(m)], "feature int, bin int, split double")
        open_nodes = {(r.tree_id, r.node_id): i for i, r in enumerate(large.select("tree_id", "node_id").collect())}  # MOST_SPLITS at most
        probs = F.transform("mass", lambda m: m / F.col("whole"))
        if level < depth:
            hist = now.mapInArrow(_binned(open_nodes, marks, classes), "tree_id int, node_id long, feature int, bin int, class_id int, w double")
            hist = hist.groupBy("tree_id", "node_id", "feature", "bin", "class_id").agg(F.sum("w").alias("w"))
            splits = best_splits(hist, classes, k, len(used), seed, used).where(F.col("gain") > LEAST_GAIN).join(F.broadcast(edges), ["feature", "bin"]).select("tree_id", "node_id", "feature", "split", "share_left")  # edges: features x n_bins rows
        else:
            splits = spark.createDataFrame([], "tree_id int, node_id long, feature int, split double, share_left double")
        nodes = written(large.join(splits, ["tree_id", "node_id"], "left").select("tree_id", "node_id", "feature", "split", "share_left", "n", probs.alias("probs")), "nodes")
        table = {(r.tree_id, r.node_id): (-1 if r.feature is None else r.feature, r.split or 0.0, r.share_left or 0.0) for r in nodes.select("tree_id", "node_id", "feature", "split", "share_left").collect()}  # MOST_SPLITS at most
        moved = written(now.mapInArrow(_moved(table), now.schema), "moved")
        discard(sizes, *([own] if own is not None else []))
        now = own = moved
        found.append(nodes.select("tree_id", "node_id", _original("feature", used), "split", "share_left", "n", "probs"))
    width, groups, sent = max(1, len(used)), [[]], 0.0
    for node in sorted(few):
        n = node[2]
        each = 2 * n + width * (n if total * width > cells else min(n, total * n / ENTRIES))
        if groups[-1] and sent + each > max(SENT * total * width, LEAST_SENT):
            groups, sent = [*groups, []], 0.0
        groups[-1].append(node)
        sent += each
    for group in groups:
        bundles = _bundles(group, width, cells, total, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = now.mapInArrow(_dealt(group, bundles), "bundle int, class_id int, features array<double>, at array<struct<place: int, weight: double>>")
        small = dealt.groupBy("bundle").applyInArrow(_finished(group, classes, used, k, depth, seed), "tree_id int, node_id long, feature int, split double, share_left double, n long, probs array<double>")
        found.append(written(small, "subtrees"))
    if own is not None:
        discard(own)
    return found


def _sizes(least: int, classes: int):
    def count(batches):
        """Of a batch: rows and class weights of each node from ``least`` on."""
        for batch in batches:
            row, tree, node, weight = _entries(batch)
            there = node >= least
            row, tree, node, weight = row[there], tree[there].astype(np.int64), node[there], weight[there]
            names, name = np.unique(node, return_inverse=True)
            codes, code = np.unique(tree * max(1, len(names)) + name, return_inverse=True)
            label, m = batch.column("class_id").to_numpy()[row], max(1, len(names))
            sums = [np.bincount(code[label == c], weight[label == c], minlength=len(codes)).astype(float) for c in range(classes)]
            columns = [(codes // m).astype(np.int32), names[codes % m] if len(codes) else np.zeros(0, np.int64), np.bincount(code, minlength=len(codes)), *sums]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree_id", "node_id", "n", *(f"m{c}" for c in range(classes))])

    return count


def _bundles(few: list[tuple[int, int, int]], width: int, cells: int, total: int, parts: int) -> np.ndarray:
    """The bundle of each node (tree_id, node_id, n): nodes one after the other as long as their entries are ENTRIES at most and, in
    a table of more than ``cells`` values, their rows a quarter of ``cells``; fewer if all could otherwise not be dealt to ``parts`` evenly."""
    most = min(ENTRIES, sum(n for *_, n in few) / (3 * parts)) if total * width <= cells else min(ENTRIES, cells / max(1, width)) / 4
    found, bundle, held = [], -1, 0
    for *_, n in few:
        if bundle < 0 or held + n > most:
            bundle, held = bundle + 1, 0
        held += n
        found.append(bundle)
    return np.array(found, np.int64)


def _dealt(few: list[tuple[int, int, int]], bundles: np.ndarray):
    find = _finder({(tree, node): i for i, (tree, node, _) in enumerate(few)})

    def deal(batches):
        """Each row once for each bundle of nodes that holds it, with its places among the nodes and its weights there."""
        for batch in batches:
            row, tree, node, weight = _entries(batch)
            place = find(tree, node)
            row, weight, place = row[place >= 0], weight[place >= 0], place[place >= 0]
            if not len(row):
                continue
            bundle = bundles[place]
            order = np.argsort(bundle.astype(np.uint16) if bundles[-1] < 1 << 16 else bundle, kind="stable")  # rows are in order
            row, bundle, place, weight = row[order], bundle[order], place[order].astype(np.int32), weight[order]
            starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1]))))
            step, ends = max(1, (1 << 19) // max(1, len(batch.column("features").flatten()) // batch.num_rows)), np.append(starts, len(row))
            for a in range(0, len(starts), step):
                b = min(a + step, len(starts))
                own = slice(ends[a], ends[b])
                entries = pa.StructArray.from_arrays([pa.array(place[own]), pa.array(weight[own])], ["place", "weight"])
                taken = pa.array(row[starts[a:b]])
                yield pa.RecordBatch.from_arrays([pa.array(bundle[starts[a:b]].astype(np.int32)), batch.column("class_id").take(taken), batch.column("features").take(taken), pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), entries)], ["bundle", "class_id", "features", "at"])

    return deal


def _original(column: str, used: list[int]) -> Column:
    """The feature's own number, from its place among those used."""
    return F.get(F.array(*(F.lit(i) for i in used)), F.col(column)).alias(column)


def _binned(open_nodes: dict[tuple[int, int], int], marks: dict[int, np.ndarray], classes: int):
    names, find = np.array(sorted(open_nodes, key=open_nodes.get), np.int64).reshape(-1, 2), _finder(open_nodes)
    width = max(len(m) for m in marks.values()) + 1

    def histogram(batches):
        """Of a batch: the weight of each bin and class of each feature of the nodes that are split from histograms."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x, label = _matrix(batch.column("features"), batch.num_rows), batch.column("class_id").to_numpy()
            row, tree, node, weight = _entries(batch)
            place = find(tree, node)
            row, weight, place = row[place >= 0], weight[place >= 0], place[place >= 0]
            own, back = np.unique(place, return_inverse=True)
            for f, cut in marks.items():
                bins, known = np.searchsorted(cut, x[row, f], side="left"), ~np.isnan(x[row, f])
                cell = (back * width + bins) * classes + label[row]
                sums = np.bincount(cell[known], weight[known], minlength=len(own) * width * classes)
                full = np.flatnonzero(sums)
                at = names[own[full // (width * classes)]]
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1]), pa.array(np.full(len(full), f, np.int32)), pa.array((full // classes % width).astype(np.int32)), pa.array((full % classes).astype(np.int32)), pa.array(sums[full])], ["tree_id", "node_id", "feature", "bin", "class_id", "w"])

    return histogram


def _moved(table: dict[tuple[int, int], tuple]):
    find = _finder({key: i for i, key in enumerate(table)})
    feature, split, share = (np.array(v) for v in zip(*table.values(), strict=True))

    def move(batches):
        """Entries of split nodes go on to the children, those of leaves go, those of smaller nodes stay."""
        for batch in batches:
            row, tree, node, weight = _entries(batch)
            x, place = _matrix(batch.column("features"), batch.num_rows) if batch.num_rows else np.zeros((0, 1)), find(tree, node)
            stays, on = place < 0, np.flatnonzero((place >= 0) & (feature[np.maximum(place, 0)] >= 0))
            at = place[on]
            v = x[row[on], feature[at]]
            gone, parts = np.isnan(v), [(row[stays], tree[stays], node[stays], weight[stays])]
            for side, there, part in ((0, v <= split[at], share[at]), (1, v > split[at], 1 - share[at])):
                take = there | gone
                parts.append((row[on][take], tree[on][take], 2 * node[on][take] + side, weight[on][take] * np.where(gone, part, 1.0)[take]))
            row, tree, node, weight = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(row, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(tree[order].astype(np.int32)), pa.array(node[order].astype(np.int64)), pa.array(weight[order])], ["tree_id", "node_id", "weight"])
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("features"), pa.ListArray.from_arrays(pa.array(ends), entries)], ["class_id", "features", "at"])

    return move


def _finished(few: list[tuple[int, int, int]], classes: int, used: list[int], k: int, depth: int, seed: int):
    def finish(table):
        """The nodes of a bundle and all below them. Rows are put in an order of their own first, so that sums do not hang on the
        order in which they arrive."""
        x, label = _matrix(_one(table["features"]), table.num_rows), table["class_id"].to_numpy()
        at = _one(table["at"])
        row = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(at.offsets.to_numpy()))
        place, weight = (at.flatten().field(name).to_numpy() for name in ("place", "weight"))
        del at
        order = np.lexsort((*x.T[::-1], label))
        x, label, rank = x[order], label[order], np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        row = rank[row]
        del rank
        order = np.lexsort((row, place))
        row, place, weight = row[order], place[order], weight[order]
        del order
        starts = np.append(np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))), len(place))
        parts = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            (tree_id, node_id, _), own, w = few[place[a]], row[a:b], weight[a:b]
            again = np.lexsort((w, label[own]))  # of a class, the lighter rows first
            own, w = own[again], w[again]
            del again
            alone = len(own) == len(x) and (own[1:] > own[:-1]).all()  # all rows, as they lie
            found = grown(x if alone else x[own], label if alone else label[own], w, tree_id, node_id, classes, used, k, depth, seed)
            ids, feature, split, share, n, probs = zip(*found, strict=True)
            parts.append(pa.table({"tree_id": pa.array([tree_id] * len(ids), pa.int32()), "node_id": pa.array(ids, pa.int64()), "feature": pa.array(feature, pa.int32()), "split": pa.array(split, pa.float64()), "share_left": pa.array(share, pa.float64()), "n": pa.array(n, pa.int64()), "probs": pa.array([p.tolist() for p in probs], pa.list_(pa.float64()))}))
        return pa.concat_tables(parts)

    return finish


@dataclass
class Tree:
    """A tree as arrays, for whole batches of rows: ``left`` and ``right`` are places in them, -1 where no row of the bag went;
    ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    share: np.ndarray
    left: np.ndarray
    right: np.ndarray
    probs: np.ndarray

    @classmethod
    def of(cls, nodes: dict[int, tuple]) -> Tree:
        """From node_id -> (feature, split, share_left, probs); the root comes first."""
        ids = sorted(nodes)
        place = {n: i for i, n in enumerate(ids)}
        feature = np.array([-1 if nodes[n][0] is None else nodes[n][0] for n in ids], np.int64)
        split, share = (np.array([nodes[n][i] or 0.0 for n in ids]) for i in (1, 2))
        left, right = (np.array([place.get(2 * n + side, -1) for n in ids], np.int64) for side in (0, 1))
        width = max(len(nodes[n][3]) for n in ids)
        return cls(feature, split, share, left, right, np.array([list(nodes[n][3]) if len(nodes[n][3]) else [0.0] * width for n in ids]))


def blocks(nodes: DataFrame, most: int | None = None) -> list[list[int]]:
    """The trees in order, in runs of at most MOST_NODES nodes, which go to the tasks together."""
    most, found, size = most or MOST_NODES, [], 0
    for r in nodes.groupBy("tree_id").count().orderBy("tree_id").collect():  # trees
        if r["count"] > most:
            raise ValueError(f"tree {r.tree_id} has {r['count']} nodes, more than {most}: train with less depth")
        if not found or size + r["count"] > most:
            found, size = [*found, []], 0
        found[-1].append(r.tree_id)
        size += r["count"]
    return found


def packed(nodes: DataFrame, trees: list[int] | None = None) -> dict[int, Tree]:
    """Trees for scoring (all, or a run of ``blocks``). All together have to be one run: their size is checked."""
    if trees is None:
        runs = blocks(nodes)
        if len(runs) > 1:
            raise ValueError(f"the forest has more than {MOST_NODES} nodes; use scored, which takes trees in runs")
    else:
        nodes = nodes.where(F.col("tree_id").isin(trees))
    found: dict[int, dict[int, tuple]] = {}
    for r in nodes.select("tree_id", "node_id", "feature", "split", "share_left", "probs").collect():  # MOST_NODES at most
        found.setdefault(r.tree_id, {})[r.node_id] = (r.feature, r.split, r.share_left, r.probs)
    return {t: Tree.of(own) for t, own in found.items()}


def tree_probs(tree: Tree, x: np.ndarray, classes: int) -> np.ndarray:
    """Class probabilities of each row of ``x`` by one tree; a missing value (NaN) takes both branches by their shares. All
    rows go down together, a level a step."""
    out, row, at, weight = np.zeros((len(x), classes)), np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x))
    while len(row):
        feature = tree.feature[at]
        leaf = feature < 0
        np.add.at(out, row[leaf], weight[leaf, None] * tree.probs[at[leaf]])
        row, at, weight, feature = row[~leaf], at[~leaf], weight[~leaf], feature[~leaf]
        v = x[row, feature]
        gone, parts = np.isnan(v), []
        for there, child, part in ((v <= tree.split[at], tree.left[at], tree.share[at]), (v > tree.split[at], tree.right[at], 1 - tree.share[at])):
            take = (there | gone) & (child >= 0)
            parts.append((row[take], child[take], (weight * np.where(gone, part, 1.0))[take]))
        row, at, weight = (np.concatenate(p) for p in zip(*parts, strict=True))
    return out


def add_votes(forest: dict[int, Tree], x: np.ndarray, total: np.ndarray, used: np.ndarray, trees: int, every: int = 10, a: float = 4.0) -> np.ndarray:
    """Adds the votes of the forest's trees to ``total`` and ``used`` (votes of each row so far), of ``trees`` in all, and
    returns the places of rows that are still undecided: votes are looked at after tree 11, 21, ... and the last, and are
    enough once the first class leads by ``a`` standard errors. All rows come undecided, with the same number of votes."""
    classes, undecided = total.shape[1], np.arange(len(x))
    before = int(used[0]) if len(used) else 0
    for i, name in enumerate(sorted(forest), before):
        if not len(undecided):
            break
        tree = forest[name] if isinstance(forest[name], Tree) else Tree.of(forest[name])
        total[undecided] += tree_probs(tree, x[undecided], classes)
        used[undecided] = i + 1
        if (i > 0 and i % every == 0) and i + 1 < trees:
            p = np.sort(total[undecided] / np.maximum(total[undecided].sum(axis=1, keepdims=True), 1e-300), axis=1)
            first, second = p[:, -1], p[:, -2] if classes > 1 else np.zeros(len(p))
            with np.errstate(divide="ignore", invalid="ignore"):
                sure = (first >= 1) | ((first - second) ** 2 / (first * (1 - first) / (i + 1)) > a * a)
            undecided = undecided[~sure]
    return undecided


def top_two(total: np.ndarray):
    """(first class, its probability, second class, its probability) of each row of votes."""
    p = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
    order, classes = np.argsort(-p, axis=1, kind="stable"), total.shape[1]
    first, second = order[:, 0], order[:, min(1, classes - 1)]
    at = np.arange(len(total))
    return first, p[at, first], second, p[at, second] if classes > 1 else np.zeros(len(total))


def until_significant(forest: dict[int, Tree], x: np.ndarray, classes: int, every: int = 10, a: float = 4.0):
    """(first class, its probability, second class, its probability, trees used) of each row, by all trees of ``forest``;
    see ``add_votes``."""
    total, used = np.zeros((len(x), classes)), np.zeros(len(x), int)
    add_votes(forest, x, total, used, len(forest), every, a)
    return *top_two(total), used


def features_of(pdf: pd.DataFrame) -> np.ndarray:
    return np.array([[np.nan if a is None else a for a in r] for r in pdf["features"]], float).reshape(len(pdf), -1)


def _shape(rows: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)


def scored(rows: DataFrame, nodes: DataFrame, classes: int, keep: list[str], most: int | None = None) -> DataFrame:
    """``rows`` (features) with the two likeliest classes, their probabilities, the trees used and the result code.

    Trees go to the tasks in runs of at most ``most`` (MOST_NODES) nodes; between runs the votes are written beside the rows, and
    rows that are decided take no part in later runs. The result is that of ``until_significant`` over all trees.
    """
    runs = blocks(nodes, most)
    trees = sum(map(len, runs))
    shape = f"{_shape(rows, keep)}, features {rows.schema['features'].dataType.simpleString()}, total array<double>, used int, undecided boolean"

    def voting(forest):
        def vote(batches):
            for pdf in batches:
                total = np.array([[0.0] * classes if v is None else list(v) for v in pdf["total"]]).reshape(len(pdf), classes)
                used, undecided = pdf["used"].to_numpy().copy(), np.zeros(len(pdf), bool)
                undecided[add_votes(forest, features_of(pdf), total, used, trees)] = True
                yield pd.DataFrame({**{k: pdf[k] for k in keep}, "features": pdf["features"], "total": list(total), "used": used, "undecided": undecided})

        return vote

    now = rows.select(*keep, "features", F.lit(None).cast("array<double>").alias("total"), F.lit(0).alias("used"))
    decided = []
    for run in runs[:-1]:
        now = written(now.mapInPandas(voting(packed(nodes, run)), shape), "votes")
        decided.append(now.where("not undecided").select(*keep, "total", "used"))
        now = now.where("undecided").drop("undecided")
    last = now.mapInPandas(voting(packed(nodes, runs[-1] if runs else [])), shape).select(*keep, "total", "used")
    result = f"{_shape(rows, keep)}, class_id int, prob double, second_id int, second_prob double, n_trees int, code int"

    def finish(batches):
        for pdf in batches:
            first, p, second, q = top_two(np.array([list(v) for v in pdf["total"]]).reshape(len(pdf), classes))
            yield pd.DataFrame({**{k: pdf[k] for k in keep}, "class_id": first, "prob": p, "second_id": second, "second_prob": q, "n_trees": pdf["used"], "code": result_codes(first, p, q)})

    return _union([*decided, last]).mapInPandas(finish, result)


def result_codes(first: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return first * 10 + 1 + np.floor(np.round((p - q) * 9, 7)).astype(int)


def votes(rows: DataFrame, nodes: DataFrame, classes: int, keep: list[str], most: int | None = None) -> DataFrame:
    """A row for each row and tree: ``probs`` of that tree. Trees go to the tasks in runs, as in ``scored``."""

    def voting(forest):
        def vote(batches):
            for pdf in batches:
                x = features_of(pdf)
                for tree in sorted(forest):
                    yield pd.DataFrame({**{k: pdf[k] for k in keep}, "tree_id": tree, "probs": list(tree_probs(forest[tree], x, classes))})

        return vote

    shape = f"{_shape(rows, keep)}, tree_id int, probs array<double>"
    return _union([rows.select(*keep, "features").mapInPandas(voting(packed(nodes, run)), shape) for run in blocks(nodes, most) or [[]]])


def walked(rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """row_id, tree_id, node_id of the leaf: the walk as joins of rows with the nodes, level by level (rows without missing
    values). A forest is small beside its rows, so its nodes are the side that Spark may send round."""
    roots = nodes.where("node_id = 1").agg(F.sort_array(F.collect_list("tree_id"))).first()[0]  # trees
    now = rows.withColumn("tree_id", F.explode(F.array(*(F.lit(t) for t in roots)))).withColumn("node_id", F.lit(1).cast("long"))
    now = now.join(nodes.select("tree_id", "node_id", "feature", "split"), ["tree_id", "node_id"])
    for _ in range(depth):
        side = F.when(F.get("features", F.col("feature")) <= F.col("split"), 0).otherwise(1)
        now = now.withColumn("node_id", F.when(F.col("feature").isNull(), F.col("node_id")).otherwise(F.col("node_id") * 2 + side)).drop("feature", "split")
        now = now.join(nodes.select("tree_id", "node_id", "feature", "split"), ["tree_id", "node_id"])
    return now.select("row_id", "tree_id", "node_id")


def usage(nodes: DataFrame, n_features: int) -> DataFrame:
    """feature, usage, relative: how often a feature splits, alone and against the mean over all features."""
    counts = nodes.where("feature is not null").groupBy("feature").agg(F.count("*").alias("usage"))
    total = F.sum("usage").over(W.partitionBy())  # a row a feature
    return counts.withColumn("relative", F.col("usage") / (total / F.lit(n_features)))


def selected(used: DataFrame, least_relative: float | None = None, least_usage: int | None = None, most: int | None = None) -> DataFrame:
    """Features kept by relative usage, by usage, or the ``most`` used (ties to the smaller feature)."""
    if least_relative is not None:
        used = used.where(F.col("relative") >= least_relative)
    if least_usage is not None:
        used = used.where(F.col("usage") >= least_usage)
    return used.orderBy(F.desc("usage"), "feature").limit(most) if most else used


def shapes(nodes: DataFrame) -> DataFrame:
    """Of each tree: decision nodes, leaves, depth."""
    return nodes.groupBy("tree_id").agg(F.count_if(F.col("feature").isNotNull()).alias("decisions"), F.count_if(F.col("feature").isNull()).alias("leaves"), F.max(F.floor(F.log2("node_id") + 1e-9)).alias("depth"))


def two_passes(rows: DataFrame, classes: int, n_features: int, least_relative: float, **options) -> tuple[DataFrame, list[int]]:
    """A forest over all features, then one over those used enough; nodes keep the features' own numbers."""
    first = train(rows, classes, n_features, **options)
    kept = [r.feature for r in selected(usage(first, n_features), least_relative).orderBy("feature").collect()]  # features
    return (train(rows, classes, n_features, features=kept, **options) if kept else first), kept


def out_of_bag(rows: DataFrame, nodes: DataFrame, classes: int, trees: int, percent: int, seed: int = 1, group: list[str] | None = None) -> DataFrame:
    """Error of the votes of trees whose bag did not hold the row, weighted by class; rows that all trees saw are left out."""
    group = group or []
    outside = bags(rows.select(*group, "row_id", "label_id", "class_id"), trees, percent, seed).where("not in_bag").select(*group, "row_id", "tree_id")
    cast = votes(rows, nodes, classes, [*group, "row_id", "class_id"]).join(outside, [*group, "row_id", "tree_id"])
    mean = cast.groupBy(*group, "row_id", "class_id").agg(F.array(*(F.round(F.avg(F.get("probs", c)), 9) for c in range(classes))).alias("p"))
    seen = F.array_position("p", F.array_max("p")) - 1
    return mean.groupBy(*group).agg(F.count("*").alias("n"), F.avg((seen != F.col("class_id")).cast("double")).alias("error"))


def scrambled(rows: DataFrame, feature: int, seed: int = 1) -> DataFrame:
    """One feature permuted over the rows, by a second order drawn from the rows' keys. Both orders are numbered within
    hash buckets, so no single task holds all rows."""
    bucket = draw("row_id", F.lit(seed)) % BUCKETS
    there = W.partitionBy("bucket").orderBy("row_id")
    here = W.partitionBy("bucket").orderBy(draw("row_id", F.lit(feature), F.lit(seed)), "row_id")
    numbered = rows.withColumn("bucket", bucket).withColumn("from", F.row_number().over(there)).withColumn("to", F.row_number().over(here))
    values = numbered.select("bucket", F.col("from").alias("to"), F.get("features", feature).alias("other"))
    swapped = F.transform("features", lambda v, i: F.when(i == feature, F.col("other")).otherwise(v))
    return numbered.join(values, ["bucket", "to"]).withColumn("features", swapped).select(*rows.columns)


def importance(rows: DataFrame, nodes: DataFrame, classes: int, n_features: int, trees: int, percent: int, seed: int = 1, cells: int = CELLS) -> DataFrame:
    """feature, rise: how much the out-of-bag error rises when the feature is scrambled; all features in one job.

    If the trees are one run and a bucket of rows has at most ``cells`` values, a task permutes all features of a bucket, as
    ``scrambled`` does, and counts the errors there; else rows are permuted by joins, and votes meet their bags by another."""
    runs, total = blocks(nodes), rows.count()
    if len(runs) == 1 and total / BUCKETS * (n_features + 4) <= cells:
        errors = _bucket_errors(rows, packed(nodes, runs[0]), classes, n_features, trees, percent, seed)
    else:
        parts = [rows.withColumn("feature", F.lit(-1))] + [scrambled(rows, f, seed).withColumn("feature", F.lit(f)) for f in range(n_features)]
        errors = out_of_bag(_union(parts), nodes, classes, trees, percent, seed, ["feature"])
    errors = written(errors, "errors")
    plain = F.max(F.when(F.col("feature") == -1, F.col("error"))).over(W.partitionBy())  # a row a feature
    return errors.withColumn("plain", plain).where("feature >= 0").select("feature", (F.col("error") - F.col("plain")).alias("rise"))


def _bucket_errors(rows: DataFrame, forest: dict[int, Tree], classes: int, n_features: int, trees: int, percent: int, seed: int) -> DataFrame:
    """feature (-1: none), n, error: what ``out_of_bag`` gives with each feature scrambled."""

    def count(table):
        x, own = np.array(_matrix(table["features"].combine_chunks(), table.num_rows), order="F"), table["class_id"].to_numpy()
        ids, draw_of = table["row_id"].to_numpy(), _label_draws(table["row_id"], table["label_id"], seed)
        outside = {t: np.flatnonzero(draw_of(t) % 100 >= percent) for t in forest}
        used = np.bincount(np.concatenate(list(outside.values())), minlength=len(x))
        seen = (used > 0) & ~np.isnan(own.astype(float))
        there = np.argsort(ids, kind="stable")
        found = []
        for feature in range(-1, n_features):
            if feature >= 0:
                here, kept = np.lexsort((ids, draws((b"%d," % i for i in ids.tolist()), feature, seed))), x[:, feature].copy()
                x[here, feature] = kept[there]  # the n-th by draw takes the value of the n-th by row_id
            total = np.zeros((len(x), classes))
            for t, at in outside.items():
                total[at] += tree_probs(forest[t], x[at], classes)
            said = np.round(total[seen] / used[seen, None], 9).argmax(axis=1)
            found.append((feature, int(seen.sum()), int((said != own[seen]).sum())))
            if feature >= 0:
                x[:, feature] = kept
        feature, n, wrong = zip(*found, strict=True)
        return pa.table({"feature": pa.array(feature, pa.int32()), "n": pa.array(n, pa.int64()), "wrong": pa.array(wrong, pa.int64())})

    dealt = rows.select((draw("row_id", F.lit(seed)) % BUCKETS).alias("bucket"), "row_id", "label_id", "class_id", F.col("features").cast("array<double>").alias("features"))
    counts = dealt.groupBy("bucket").applyInArrow(count, "feature int, n long, wrong long")
    return counts.groupBy("feature").agg(F.sum("n").alias("n"), (F.sum("wrong") / F.sum("n")).alias("error"))
