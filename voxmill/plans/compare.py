"""Two ways of bagging compared by repeated cross-validation, all models trained in one pass over the rows.

A model is a run, a fold that it does not see, and a learner: BALANCED takes labels as a whole and weighs classes, CLASSIC draws
rows with replacement. Its trees have ids of their own, tree_id = model * trees + tree with model = (run * folds + fold) * 2 +
learner, so that one call of ``forest.grow`` trains them all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.sampling import draw, draws
from voxmill.plans import forest
from voxmill.plans.scoring import corrected_t, fold_auc
from voxmill.sources.tables import written

BALANCED, CLASSIC = range(2)


def with_folds(rows: DataFrame, runs: int, folds: int, seed: int = 1) -> DataFrame:
    """``rows`` with ``folds``: the fold of each run that a row is tested in, drawn by its row_id."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: (draw("row_id", r, F.lit(seed)) % folds).cast("int"))
    return rows.withColumn("folds", drawn)


#: Draws from which on a row is drawn once, twice, ... six times: those of ``forest.times_drawn``.
_ONCE = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(6)])


def in_models(rows: DataFrame, runs: int, folds: int, trees: int, percent: int, seed: int = 1) -> DataFrame:
    """Rows of ``with_folds`` with ``at``: tree_id and weight of each tree, of the models that may see the row, that holds it.

    A label's draws are taken once and lie as bits beside its rows; a row's own draws are taken as it is dealt. Both go by Arrow
    batches, since functions over long arrays are interpreted, an entry at a time."""
    ids = np.arange(runs * folds * 2 * trees)
    model = ids // trees
    run, fold, balanced = model // (2 * folds), model // 2 % folds, model % 2 == BALANCED

    def sliced(batches):
        """So many rows at once that with a value for each tree they are some MB."""
        step = max(1, (1 << 21) // len(ids))
        for batch in batches:
            yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))

    def labels(batches):
        for batch in sliced(batches):
            keys = [k.encode() + b"," if k else b"" for k in batch.column(0).to_pylist()]  # a draw leaves out a null
            drawn = np.array([draws(keys, t, seed) % 100 < percent for t in ids[balanced]], bool).reshape(-1, len(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in np.packbits(drawn.T, axis=1)], pa.binary())], ["key", "drawn"])

    def seen(batch) -> np.ndarray:
        """Of each row and tree: whether the model may see the row."""
        return batch.column("folds").flatten().to_numpy().reshape(-1, runs)[:, run] != fold

    def inside(batch, may: np.ndarray) -> np.ndarray:
        """Of each row and balanced tree: whether the tree holds it."""
        bits = np.frombuffer(b"".join(batch.column("drawn").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        return np.unpackbits(bits, axis=1, count=int(balanced.sum())).astype(bool) & may[:, balanced]

    def counted(batches):
        for batch in sliced(batches):
            if batch.num_rows:
                held, own = inside(batch, seen(batch)), batch.column("class_id").to_numpy()
                for c in np.unique(own):
                    n = held[own == c].sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[balanced]), pa.array(np.full(len(n), c, np.int64)), pa.array(n)], ["tree_id", "class_id", "n"])

    key = F.when(F.col("label_id") == -1, F.concat(F.lit("r"), F.col("row_id").cast("string"))).otherwise(F.col("label_id").cast("string"))
    keyed = rows.withColumn("key", F.coalesce(key, F.lit("")))
    held = written(keyed.join(keyed.select("key").distinct().mapInArrow(labels, "key string, drawn binary"), "key").drop("key"), "models")
    sizes = held.select("class_id", "folds", "drawn").mapInArrow(counted, "tree_id long, class_id long, n long").groupBy("tree_id", "class_id").agg(F.sum("n").alias("n")).where("n > 0")
    sizes = sizes.toPandas()  # trees x classes values
    largest = sizes.groupby("tree_id")["n"].transform("max")
    known = {(c, t): x for c, t, x in zip(sizes["class_id"], sizes["tree_id"], largest / sizes["n"], strict=True)}
    names = list(rows.columns)

    def entries(batches):
        for batch in sliced(batches):
            may, own = seen(batch), batch.column("class_id").to_numpy()
            weight = np.zeros(may.shape)
            if batch.num_rows:
                share = {c: np.array([known.get((c, t), 0.0) for t in ids[balanced]]) for c in np.unique(own)}
                weight[:, balanced] = inside(batch, may) * np.array([share[c] for c in share])[np.searchsorted(list(share), own)]
                keys = [b"%d," % k for k in batch.column("row_id").to_pylist()]
                for t in ids[~balanced]:
                    at = np.flatnonzero(may[:, t])
                    weight[at, t] = np.searchsorted(_ONCE, draws([keys[i] for i in at], t, seed) / float(1 << 32), side="right")
            row, tree = np.nonzero(weight)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(tree.astype(np.int32)), pa.array(weight[row, tree])], ["tree_id", "weight"])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.ListArray.from_arrays(pa.array(ends), each)], [*names, "at"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return held.mapInArrow(entries, f"{shape}, at array<struct<tree_id: int, weight: double>>")


def predictions(rows: DataFrame, nodes: DataFrame, classes: int, runs: int, folds: int, trees: int) -> DataFrame:
    """row_id, run, fold, learner, class_id and ``probs`` of each row under the models that did not see it. Each row goes through the
    trees of its own models alone; trees go to the tasks in runs of checked size. If that is one run, a model's trees meet in the task."""
    blocks = forest.blocks(nodes) or [[]]

    def voting(found):
        together: dict[int, list[int]] = {}
        for tree in sorted(found):
            together.setdefault(tree // trees if len(blocks) == 1 else tree, []).append(tree)

        def vote(batches):
            for pdf in batches:
                x, own = forest.features_of(pdf), np.array([list(f) for f in pdf["folds"]]).reshape(len(pdf), runs)
                for own_trees in together.values():
                    model = own_trees[0] // trees
                    run, fold, learner = model // (2 * folds), model // 2 % folds, model % 2
                    at = np.flatnonzero(own[:, run] == fold)
                    if len(at):
                        probs = sum(forest.tree_probs(found[tree], x[at], classes) for tree in own_trees) / len(own_trees)
                        yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy()[at], "run": run, "fold": fold, "learner": learner, "class_id": pdf["class_id"].to_numpy()[at], "probs": list(probs)})

        return vote

    shape = "row_id long, run int, fold int, learner int, class_id int, probs array<double>"
    wanted = rows.select("row_id", F.col("class_id").cast("int").alias("class_id"), "features", "folds")
    cast = [wanted.mapInPandas(voting(forest.packed(nodes, block)), shape) for block in blocks]
    if len(cast) == 1:
        return cast[0].withColumn("probs", F.array(*(F.round(F.get("probs", c), 9) for c in range(classes))))
    every = cast[0]
    for more in cast[1:]:
        every = every.union(more)
    mean = F.array(*(F.round(F.avg(F.get("probs", c)), 9) for c in range(classes)))
    return every.groupBy("row_id", "run", "fold", "learner", "class_id").agg(mean.alias("probs"))


def model_scores(said: DataFrame, classes: int, folds: int) -> DataFrame:
    """run, fold, learner, n, accuracy (ties to the smaller class) and auc: that of each class against all others, weighted by the
    classes' shares of the fold's rows; a class that is all of a fold or none of it counts for nothing."""
    model = (F.col("run") * folds + F.col("fold")) * 2 + F.col("learner")
    right = (F.array_position("probs", F.array_max("probs")) - 1 == F.col("class_id")).cast("int")
    plain = said.groupBy("run", "fold", "learner").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))
    each = said.select(model.alias("model"), F.col("class_id").alias("own"), F.posexplode("probs").alias("class", "score"))
    each = each.select((F.col("model") * classes + F.col("class")).alias("fold"), "score", (F.col("own") == F.col("class")).cast("int").alias("quality"))
    shares = each.groupBy("fold").agg(F.sum("quality").alias("share"))  # a row a model and class
    areas = fold_auc(each).where("auc is not null").join(shares, "fold").groupBy(F.floor(F.col("fold") / classes).alias("model"))
    areas = areas.agg((F.sum(F.col("auc") * F.col("share")) / F.sum("share")).alias("auc"))
    return plain.withColumn("model", model.cast("long")).join(areas, "model", "left").drop("model")


def cross_validated(rows: DataFrame, classes: int, n_features: int, runs: int = 10, folds: int = 10, trees: int = 200, percent: int = 66, seed: int = 1, **options) -> DataFrame:
    """``model_scores`` of both learners over ``rows`` (row_id, label_id, class_id 0.., features). Rows without class or features
    take no part; a fold without rows has no line. ``options`` go to ``forest.grow``. Beside each row lies an entry for each tree that
    holds it, so runs x folds x trees is what bounds a row."""
    known = rows.where("class_id is not null and features is not null").select("row_id", "label_id", "class_id", "features")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file is one partition, and its rows get long
    dealt = written(with_folds(known.repartition(parts, "row_id"), runs, folds, seed), "folds")
    nodes = written(forest.grow(in_models(dealt, runs, folds, trees, percent, seed), classes, n_features, runs * folds * 2 * trees, seed=seed, **options), "nodes")
    return model_scores(written(predictions(dealt, nodes, classes, runs, folds, trees), "said"), classes, folds)


def compared(scores: DataFrame, folds: int) -> DataFrame:
    """measure (accuracy, auc), both learners' means, and the paired t of their differences over all runs and folds, with the
    variance corrected for training sets that overlap."""
    pairs = scores.groupBy("run", "fold").pivot("learner", [BALANCED, CLASSIC]).agg(F.first("accuracy").alias("accuracy"), F.first("auc").alias("auc"))
    found = None
    for measure in ("accuracy", "auc"):
        both = pairs.select(F.col(f"{BALANCED}_{measure}").alias("a"), F.col(f"{CLASSIC}_{measure}").alias("b")).where("a is not null and b is not null")
        line = corrected_t(both, 1 / (folds - 1), F.avg("a").alias("balanced"), F.avg("b").alias("classic")).withColumn("measure", F.lit(measure))
        found = line if found is None else found.unionByName(line)
    return found
