"""Near-duplicate vectors by product quantisation: coarse inverted lists with residual subspace codes, table-lookup distances
over the lists that a partner can lie in, exact cosines of what they leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drained, table, written
from .graph import connected_components

#: Vectors on which the index is fitted, at most; every vector is indexed.
SAMPLE = 8192
#: Lists of the coarse quantiser: the square root of the number of vectors, at most so many.
MOST_LISTS = 1024
#: Subspaces of the residual codes, and codewords of each (one byte).
SUBSPACES, CODEWORDS = 16, 256
#: Vectors of a list, or visiting it, that one task compares at once with as many others.
BLOCK = 1024
#: Vectors of the sample whose true partners, found among all vectors, settle how far probes reach.
FITTED_QUERIES = 256


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)


def _means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """``k`` centres of ``rows`` by Lloyd's rounds; an empty one takes a random row."""
    centres = rows[rng.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rows[rng.integers(0, len(rows), k)])
    return centres


class Quantiser:
    """Coarse centres and residual codebooks over unit vectors of ``size`` components (shorter ones filled up with zeros)."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.radius, self.reach, self.size = radius, radius, sample.shape[1]
        self.width = -(-self.size // SUBSPACES)
        self.centres = _means(sample, lists, rng)
        gaps = (self.centres**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * self.centres @ self.centres.T
        self.gaps = np.sqrt(np.maximum(gaps, 0))
        rest = self._cut(sample - self.centres[_nearest(sample, self.centres)])
        self.books = np.stack([_means(rest[:, s], CODEWORDS, rng) for s in range(SUBSPACES)])

    def _cut(self, rows: np.ndarray) -> np.ndarray:
        filled = np.zeros((len(rows), SUBSPACES * self.width))
        filled[:, : rows.shape[1]] = rows
        return filled.reshape(len(rows), SUBSPACES, self.width)

    def fit_rows(self, rows: np.ndarray) -> np.ndarray:
        """``rows`` with exactly ``size`` components."""
        out = np.zeros((len(rows), self.size))
        out[:, : rows.shape[1]] = rows[:, : self.size]
        return out

    def margins(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How far each row is from each list: the distance to the plane between its own list's centre and the other's.
        A partner in that list lies beyond the plane."""
        far = (self.centres**2).sum(1) - 2 * rows @ self.centres.T
        with np.errstate(divide="ignore", invalid="ignore"):
            found = (far - far[np.arange(len(rows)), own][:, None]) / (2 * self.gaps[own])
        return np.nan_to_num(found, nan=0.0, posinf=0.0)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, residual codes, distance from the vector that these stand for) of each row."""
        own = _nearest(rows, self.centres)
        rest = self._cut(rows - self.centres[own])
        codes = np.stack([_nearest(rest[:, s], self.books[s]) for s in range(SUBSPACES)], axis=1)
        error = np.sqrt(((rest - self.books[np.arange(SUBSPACES), codes]) ** 2).sum(axis=(1, 2)))
        return own, codes.astype(np.uint8), error

    def tables(self, rows: np.ndarray, at: int) -> np.ndarray:
        """Squared distances from each row, in the list ``at``, to every codeword of every subspace."""
        rest = self._cut(rows - self.centres[at])
        return np.stack([((rest[:, s, None] - self.books[s]) ** 2).sum(axis=2) for s in range(SUBSPACES)], axis=1)

    def candidates(self, tables: np.ndarray, codes: np.ndarray, errors: np.ndarray) -> np.ndarray:
        """Whether each pair (row of ``tables``, row of ``codes``) can lie within the radius: the looked-up distance is off
        by the code's error at most, so none is lost."""
        far = np.zeros((len(tables), len(codes)))
        for s in range(SUBSPACES):
            far += tables[:, s][:, codes[:, s]]
        return far <= (self.radius + errors + 1e-6) ** 2


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of links that span the linked groups of a block of rows and columns."""
    rows_left, columns_left, found = np.ones(links.shape[0], bool), np.ones(links.shape[1], bool), []
    for first in np.flatnonzero(links.any(axis=1)).tolist():
        if not rows_left[first]:
            continue
        rows_left[first], stack = False, [first]
        while stack:
            row = stack.pop()
            for column in np.flatnonzero(links[row] & columns_left).tolist():
                columns_left[column] = False
                found.append((row, column))
                more = np.flatnonzero(links[:, column] & rows_left)
                rows_left[more] = False
                found += [(k, column) for k in more.tolist()]
                stack += more.tolist()
    edges = np.array(found, np.int64).reshape(-1, 2)
    return edges[:, 0], edges[:, 1]


def _units(column: pa.Array) -> np.ndarray:
    """Rows of a column of lists of one length, as unit vectors in double precision."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.sqrt((rows**2).sum(axis=1))[:, None]


def _sizes(column: pa.Array) -> Iterator[np.ndarray]:
    """Places of the rows of each length of list."""
    lengths = pc.list_value_length(column).to_numpy()
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def fit(classes: DataFrame, least: float) -> Quantiser | None:
    """The index for ``classes`` (rid, label, size, vector), fitted on SAMPLE rows.

    The guarantee that no partner is missed would probe every list whose plane is within the radius (the distance of a
    pair of cosine ``least``). Evenly spread vectors of many components have nearly all lists that close, though a partner
    seldom lies beyond a plane that is far: in a random direction of n components, a step of the radius goes radius / sqrt(n)
    towards the plane (root mean square). Probes reach 2.5 times that, and at least half as much again as any partner needs of
    FITTED_QUERIES rows of the sample, which are held against all rows, in tasks; never further than the guarantee, which
    vectors of six components or fewer get. Beyond the largest component number of the sample vectors are cut for the
    lists, not for their cosines.
    """
    rows = classes.select("vector").orderBy(F.xxhash64("rid")).limit(SAMPLE).toArrow().column(0).combine_chunks()
    if not len(rows):
        return None
    size = pc.max(pc.list_value_length(rows)).as_py()
    sample = np.zeros((len(rows), size))
    for at in _sizes(rows):
        units = _units(rows.take(pa.array(at)))
        sample[at, : units.shape[1]] = units
    radius = float(np.sqrt(2 - 2 * least))
    found = Quantiser(sample, max(1, min(MOST_LISTS, len(sample), int(classes.count() ** 0.5))), radius)

    queries = sample[:FITTED_QUERIES]
    sent = classes.sparkSession.sparkContext.broadcast((found, queries))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, queries = sent.value
        own_q, most = _nearest(queries, index.centres), []
        for batch in batches:
            for at in _sizes(batch.column(0)):
                rows = index.fit_rows(_units(batch.column(0).take(pa.array(at))))
                own = _nearest(rows, index.centres)
                row, query = np.nonzero(rows @ queries.T >= least)
                # the one in the list of the smaller number visits the other's
                low = own[row] < own_q[query]
                apart = own[row] != own_q[query]
                if apart.any():
                    row, query, low = row[apart], query[apart], low[apart]
                    visitor = np.where(low[:, None], rows[row], queries[query])
                    home, to = np.where(low, own[row], own_q[query]), np.where(low, own_q[query], own[row])
                    most.append(index.margins(visitor, home)[np.arange(len(home)), to].max())
                elif len(row):
                    most.append(0.0)
        if most:
            yield pa.RecordBatch.from_arrays([pa.array([max(most)], pa.float64())], ["reach"])

    reach = classes.select("vector").mapInArrow(of, "reach double").agg(F.max("reach")).first()[0] or 0.0
    found.reach = min(radius, max(1.5 * reach, 2.5 * radius / size**0.5))
    return found


def links(classes: DataFrame, index: Quantiser, least: float) -> DataFrame:
    """(rid, other, n) of the links among ``classes`` (rid, label, size, vector, copies): n rows are linked to ``rid``, or
    (n null) rid and other are linked. Links span every linked group; the numbers count every link found.

    A vector lies in one list of its label, and of two in different lists the one in the list of the smaller number visits the
    other's, if its margin is within ``index.reach``. Lists and their visitors are cut into blocks of about BLOCK vectors and each
    block of visitors meets each block of the list in a group of its own, so no task holds a list.
    """
    sent = classes.sparkSession.sparkContext.broadcast(index)
    schema = "at int, own boolean, rid long, copies long, label string, vector array<double>, codes binary, error double"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in drained(batches):
            for at in _sizes(batch.column(3)):
                for part in np.array_split(at, -(-len(at) // 4096)):
                    rid, copies, label, vectors = (c.take(pa.array(part)) for c in batch.columns)
                    units = _units(vectors)
                    rows = found.fit_rows(units)
                    own, codes, error = found.encode(rows)
                    # what the components beyond the index's size make up is part of the error
                    error = error + np.sqrt(np.maximum(0, 1 - (rows**2).sum(axis=1)))
                    visits = (found.margins(rows, own) <= found.reach) & (np.arange(len(found.centres)) > own[:, None])
                    row, to = np.nonzero(visits)
                    every, lists = np.append(np.arange(len(part)), row), np.append(own, to)
                    take = pa.array(every)
                    shape = units.shape[1]
                    spread = pa.ListArray.from_arrays(pa.array(np.arange(len(every) + 1) * shape, pa.int32()), pa.array(units[every].ravel()))
                    shown = pa.array([c.tobytes() for c in codes], pa.binary()).take(take)
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(np.arange(len(every)) < len(part)), rid.take(take), copies.take(take), label.take(take), spread, shown, pa.array(error[every])], ["at", "own", "rid", "copies", "label", "vector", "codes", "error"])

    rows = written(classes.select("rid", "copies", F.concat_ws(":", "label", "size").alias("label"), F.col("vector").cast("array<double>")).mapInArrow(placed, schema), "lists")
    sizes = rows.groupBy("label", "at").agg(F.ceil(F.count_if("own") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(~F.col("own")) / BLOCK).cast("int").alias("visits"))
    rows = rows.join(written(sizes.where("blocks > 0"), "sizes"), ["label", "at"])
    block = lambda n: F.pmod(F.xxhash64("rid"), F.greatest(n, F.lit(1))).cast("int")
    # Blocks of visitors have numbers from 0; a list's own vectors visit it too, as block -1, -2 and so on.
    own = rows.where("own").withColumn("block", block(F.col("blocks")))
    members = own.select("*", F.explode(F.sequence(-F.col("block") - 1, F.col("visits") - 1)).alias("visit"), F.lit(True).alias("member")).where("visit < visits")
    guests = own.select("*", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("to"), (-F.col("block") - 1).alias("visit"))
    guests = guests.unionByName(rows.where("not own").withColumn("block", block(F.col("visits"))).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), F.col("block").alias("visit")))
    guests = guests.drop("block").withColumnRenamed("to", "block").withColumn("member", F.lit(False))
    columns = ["label", "at", "block", "visit", "member", "rid", "copies", "vector", "codes", "error"]
    rows = members.select(columns).union(guests.select(columns))

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, (_, at, block, visit) = sent.value, key
        inside, guests = pdf[pdf["member"]], pdf[~pdf["member"]]
        if not len(inside) or not len(guests):
            return pd.DataFrame({"rid": [], "other": [], "n": []})
        x, y = np.stack(guests["vector"]), np.stack(inside["vector"])
        rid_x, rid_y = guests["rid"].to_numpy(), inside["rid"].to_numpy()
        codes, errors = np.stack([np.frombuffer(c, np.uint8) for c in inside["codes"]]), inside["error"].to_numpy()
        beyond = np.sqrt(np.maximum(0, 1 - (found.fit_rows(x) ** 2).sum(axis=1)))
        linked = np.zeros((len(x), len(y)), bool)
        for i in range(0, len(x), 128):
            near = found.candidates(found.tables(found.fit_rows(x[i : i + 128]), at), codes, errors + (beyond[i : i + 128].max() if beyond.any() else 0))
            row, column = np.nonzero(near)
            for j in range(0, len(row), 65_536):
                r, c = row[j : j + 65_536], column[j : j + 65_536]
                linked[i + r, c] = np.einsum("ij,ij->i", x[i + r], y[c]) >= least
        if visit == -block - 1:  # a block with itself: each pair once
            linked &= rid_x[:, None] < rid_y
        n_x, n_y = linked @ inside["copies"].to_numpy(), guests["copies"].to_numpy() @ linked
        row, column = _forest(linked)
        ids = np.concatenate([rid_x[n_x > 0], rid_y[n_y > 0], rid_x[row]])
        other = np.concatenate([np.full((n_x > 0).sum() + (n_y > 0).sum(), -1), rid_y[column]])
        return pd.DataFrame({"rid": ids, "other": other, "n": np.concatenate([n_x[n_x > 0], n_y[n_y > 0], np.full(len(row), -1)])})

    found = rows.groupBy("label", "at", "block", "visit").applyInPandas(compared, "rid long, other long, n long")
    return found.select("rid", F.expr("nullif(other, -1)").alias("other"), F.expr("nullif(n, -1)").alias("n"))


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding, label).

    Two rows link when their labels are equal and not null and their cosine, in double precision, is ``least`` or more;
    component_id is the smallest vec_id that links reach, and kept says whether it is the row's own. Equal vectors of a
    label are one class of the index with a number of copies, so a hot vector costs one entry. Links within a class and
    between classes that the index brings together are all counted, none under ``least``; see ``fit`` for what it may miss.

    Rows whose label is null, or whose vector is null, empty, zero or has a null or non-finite component, link with nothing.
    Vectors of different lengths do not link. Repeated rows are rows of their own. A null vec_id counts as a link of others;
    its component is the smallest of the group's, null if there is none, and kept is then false. Other columns are ignored;
    an empty table gives no rows.
    """
    vector = F.col("embedding").cast("array<double>")
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.when(F.coalesce(ok, F.lit(False)), vector).alias("vector"))
    classes = rows.where("vector is not null").groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("rid"), "label", F.size("vector").alias("size"), "vector", "copies", "least"), "classes")
    index = fit(classes, least)
    if index is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = written(links(classes, index, least), "links")
    numbers = found.where("n is not null").groupBy("rid").agg(F.sum("n").alias("linked"))
    roots = connected_components(found.where("other is not null").select(F.col("rid").alias("u"), F.col("other").alias("v")))
    named = classes.join(numbers, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    named = written(named.select("label", "vector", "least", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "rid").alias("root")), "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("label", "vector", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    grouped = rows.where("vector is not null").join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    return grouped.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector of ``embeddings``; see ``near_vectors``."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
