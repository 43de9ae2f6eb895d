"""Near-duplicate vectors by sorted projection passes.

Each pass orders all vectors lexicographically by BITS concatenated random
hyperplane hashes and compares every vector with the neighbours in its block of
BLOCK positions and the HALO positions after it; pairs are verified by cosine in
double precision and joined across passes. A pair that several passes compare
counts in the first only, which the positions of the two tell without writing
pairs down, so a task returns one row per vector.

A pass surely compares a vector with all that share more leading hash bits with it
than the vectors HALO positions before and after it do. With the chance that a
threshold pair shares so many, each vector has an estimate of what share of its
links all passes miss. Vectors above MISSED go through further passes with fresh
hyperplanes among themselves, as a link with any other is found from that side;
so their number follows the table's size and the density around each vector.

Where more passes would cost more than comparing all that are left with each
other, as in crowds of more links than a window holds, these are compared exactly:
every vector is at home in the cell of the nearest of up to PIVOTS vectors, and
visits the earlier cells that it can have a link in, which by the triangle
inequality are those whose pivot lies within the cell's widest angle plus the
threshold's. A cell is compared in blocks of bounded size. So several crowds don't
meet, and only the pivots go through the driver.

Equal vectors are one representative with a count, compared once. Vectors that
are null, zero, or hold null or non-finite components link with nothing; vectors
of different lengths never link. Numbers of double precision keep it. Repeated ids
keep a row each, of equal vectors or not. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkripple.llm.common import cut
from sparkripple.llm.components import stars

THRESHOLD = 0.95
PASSES = 12
BITS = 32
BLOCK = 1024
HALO = 512
SEED = 7
#: Share of a vector's links at the threshold that the passes may miss, as estimated from the density around it.
MISSED = 1e-4
#: Vectors that mark the cells of the exact comparison; so many go to the driver and all executors.
PIVOTS = 512


def hyperplanes(dim: int, passes: int, done: int = 0) -> np.ndarray:
    return np.random.default_rng([SEED, dim, done] if done else [SEED, dim]).standard_normal((dim, passes * BITS))


def pass_keys(passes: int, done: int = 0):
    """Per vector and pass the hashes of its side of BITS hyperplanes as one number that orders like their sequence."""
    powers = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                if dim not in planes:
                    planes[dim] = hyperplanes(dim, passes, done)
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                keys = ((x @ planes[dim]) > 0).reshape(len(x), passes, BITS) @ powers
                yield pd.DataFrame({"pass": np.tile(np.arange(passes), len(x)), "dim": dim, "key": keys.ravel(), "rep": np.repeat(part["rep"].to_numpy(), passes)})

    return run


def positions(reps: DataFrame, passes: int, done: int = 0) -> DataFrame:
    """(rep, pos, keys): each representative's position in the order of every pass, and its hashes."""
    keys = reps.select("rep", "embedding").mapInPandas(pass_keys(passes, done), "pass int, dim int, key long, rep long")
    order = ["pass", "dim", "key", "rep"]
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("pass", "rep", "key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    placed = cut(placed)
    # One number per shuffle partition, as many as the cluster's setting says.
    offset, starts = 0, {}
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts[r["part"]] = offset
        offset += r["n"]
    if not starts:
        return placed.select("rep", F.array().cast("array<long>").alias("pos"), F.array().cast("array<long>").alias("keys"))
    n = offset // passes
    start = F.element_at(F.lit([starts.get(p, 0) for p in range(max(starts) + 1)]), F.col("part") + 1)
    pos = (start + F.col("at") - F.col("pass") * F.lit(n)).cast("long")
    spots = placed.select("rep", F.struct("pass", pos.alias("pos"), "key").alias("p")).groupBy("rep").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return spots.select("rep", F.transform("p", lambda x: x["pos"]).alias("pos"), F.transform("p", lambda x: x["key"]).alias("keys"))


def local_roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row reaches by links within the block."""
    a, b = np.nonzero(linked)
    roots = ids.copy()
    while True:
        new = roots.copy()
        np.minimum.at(new, a, roots[b])
        if (new == roots).all():
            return roots
        roots = new


def shared_bits(keys: np.ndarray, dims: np.ndarray, places: int) -> np.ndarray:
    """Leading bits that each key shares with the one so many places on; -1 where there is none or its vector has another length."""
    out = np.full(len(keys), -1, dtype=np.int64)
    if len(keys) > places:
        # Numbers of up to BITS bits are exact in double precision, and the exponent is the place of the first bit that differs.
        differ = np.frexp((keys[:-places] ^ keys[places:]).astype(np.float64))[1]
        out[:-places] = np.where(dims[:-places] == dims[places:], BITS - differ, -1)
    return out


def compare(threshold: float):
    """Links of the vectors of a block with each other, where `inner`, and with those of the halo, without the pairs of earlier passes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        now, inner = int(group["pass"].iloc[0]), bool(group["inner"].iloc[0])
        group = group.sort_values(["halo", "p", "rep"], ignore_index=True)
        halo = group["halo"].to_numpy(dtype=bool)
        n_own = int((~halo).sum())
        pos = np.stack(group["pos"].to_numpy())
        ids, n = group["rep"].to_numpy(), group["n"].to_numpy()
        dims = group["embedding"].map(len).to_numpy()
        linked = np.zeros((n_own, len(group)), dtype=bool)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = np.stack(group["embedding"].iloc[at].to_numpy()).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            own = at[at < n_own]
            linked[np.ix_(own, at)] = x[: len(own)] @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if not inner:
            linked[:, :n_own] = False
        a, b = np.nonzero(linked)
        square = np.zeros((len(group), len(group)), dtype=bool) if len(a) else None
        roots = ids
        if square is not None:
            square[a, b] = square[b, a] = True
            roots = local_roots(square, ids)
        fresh = np.ones(len(a), dtype=bool)
        for earlier in range(now):
            p, q = pos[a, earlier], pos[b, earlier]
            later = np.maximum(p, q)
            apart = later // BLOCK - np.minimum(p, q) // BLOCK
            fresh &= ~((apart == 0) | (apart == 1) & (later % BLOCK < HALO))
        a, b = a[fresh], b[fresh]
        # A pair of two own rows is there in both directions, one with the halo only once.
        links = np.bincount(a, n[b], minlength=len(ids)) + np.bincount(b[b >= n_own], n[a[b >= n_own]], minlength=len(ids))
        ahead = shared_bits(group["key"].to_numpy(), dims, HALO)
        shared = np.where(halo, -1, ahead)
        shared[HALO:] = np.maximum(shared[HALO:], ahead[:-HALO])
        out = (links > 0) | (roots != ids) | (shared >= 0)
        return pd.DataFrame({"rep": ids[out], "links": links[out].astype(np.int64), "root": roots[out], "pass": now, "shared": shared[out]})

    return run


FOUND = "rep long, links long, root long, pass int, shared int"


def one_round(reps: DataFrame, passes: int, done: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """FOUND of further passes over reps(rep, n, embedding, pos), and reps with their positions appended."""
    spots = reps.join(positions(reps, passes, done).withColumnRenamed("pos", "more"), "rep").withColumn("pos", F.concat("pos", "more"))
    block, within = F.floor(F.col("p") / BLOCK), F.col("p") % BLOCK
    dealt = spots.select("rep", "n", "pos", "keys", "embedding", F.posexplode("more").alias("own", "p")).withColumn("key", F.col("keys")[F.col("own")])
    dealt = dealt.withColumn("to", F.explode(F.when((within < HALO) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))))
    dealt = dealt.select((F.col("own") + done).alias("pass"), "to", (F.col("to") != block).alias("halo"), F.lit(True).alias("inner"), "rep", "n", "p", "key", "pos", "embedding")
    return cut(dealt.groupBy("pass", "to").applyInPandas(compare(threshold), FOUND)), spots.drop("more", "keys")


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_cell(pivots: pd.DataFrame):
    """(rep, home, angle): the cell of the nearest pivot of the vector's length; cells of lengths without a pivot are numbered below zero."""
    by_dim = {dim: (part.index.to_numpy(), unit(part["embedding"])) for dim, part in pivots.groupby(pivots["embedding"].map(len))}

    def run(batches):
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                home, angle = np.full(len(part), -1 - dim), np.zeros(len(part))
                if dim in by_dim:
                    at, centres = by_dim[dim]
                    cosines = unit(part["embedding"]) @ centres.T
                    home, angle = at[cosines.argmax(axis=1)], np.arccos(np.clip(cosines.max(axis=1), -1, 1))
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "home": home, "angle": angle})

    return run


def visits(pivots: pd.DataFrame, widest: dict[int, float], threshold: float):
    """(rep, cell) of the earlier cells in which a vector (rep, home, embedding) can have a link."""
    by_dim = {dim: (part.index.to_numpy(), unit(part["embedding"])) for dim, part in pivots.groupby(pivots["embedding"].map(len))}
    reach = {dim: np.array([widest.get(c, -4.0) for c in at]) + float(np.arccos(threshold)) + 1e-6 for dim, (at, _) in by_dim.items()}

    def run(batches):
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                if dim in by_dim:
                    at, centres = by_dim[dim]
                    near = np.arccos(np.clip(unit(part["embedding"]) @ centres.T, -1, 1)) <= reach[dim]
                    i, j = np.nonzero(near & (at[None, :] < part["home"].to_numpy()[:, None]))
                    yield pd.DataFrame({"rep": part["rep"].to_numpy()[i], "cell": at[j]})

    return run


def all_pairs(reps: DataFrame, size: int, done: int, threshold: float) -> DataFrame:
    """FOUND of all pairs of the reps(rep, n, embedding, pos) that no pass compared; reps, so many, must be written already."""
    pivots = reps.orderBy(F.xxhash64("rep", F.lit(SEED)), "rep").limit(max(1, min(PIVOTS, size // (2 * BLOCK)))).select("embedding").toPandas()
    homes = cut(reps.select("rep", "embedding").mapInPandas(nearest_cell(pivots), "rep long, home long, angle double"))
    sizes = homes.groupBy("home").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n")).collect()
    widest = {r["home"]: r["widest"] for r in sizes}
    placed = cut(reps.join(homes, "rep"))
    guests = cut(placed.select("rep", "home", "embedding").mapInPandas(visits(pivots, widest, threshold), "rep long, cell long"))
    known = {r["cell"]: r["n"] for r in guests.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.element_at(F.create_map(*(F.lit(x) for r in sizes for x in (r["home"], -(-r["n"] // BLOCK)))), F.col("cell"))
    guest_blocks = F.element_at(F.create_map(*(F.lit(x) for r in sizes for x in (r["home"], -(-known.get(r["home"], 0) // BLOCK)))), F.col("cell"))
    spread = F.xxhash64("rep", F.lit(SEED + 1))
    own = placed.withColumn("cell", F.col("home")).withColumn("own", F.pmod(spread, blocks))
    columns = [F.lit(done).alias("pass"), "cell", "i", "j", "halo", "inner", "rep", "n", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("key"), "pos", "embedding"]
    # A cell's own blocks meet each other, i up to j, and the blocks of its guests, which are numbered on from them.
    inside = own.withColumn("to", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"i": F.least("own", "to"), "j": F.greatest("own", "to")}).withColumns({"halo": F.col("own") != F.col("i"), "inner": F.col("i") == F.col("j")})
    hosts = own.filter(guest_blocks > 0).withColumn("j", F.explode(F.sequence(blocks, blocks + guest_blocks - 1))).withColumns({"i": F.col("own"), "halo": F.lit(False), "inner": F.lit(False)})
    strangers = guests.join(placed.drop("home"), "rep").withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"j": blocks + F.pmod(spread, guest_blocks), "halo": F.lit(True), "inner": F.lit(False)})
    dealt = inside.select(*columns).unionByName(hosts.select(*columns)).unionByName(strangers.select(*columns))
    return cut(dealt.groupBy("cell", "i", "j").applyInPandas(compare(threshold), FOUND))


def find_links(reps: DataFrame, passes: int, threshold: float) -> DataFrame:
    """FOUND of passes over all reps, then of more over those whose links they may miss."""
    open_, found, done = reps.withColumn("pos", F.array().cast("array<long>")), [], 0
    seen = reps.select("rep", F.lit(0.0).alias("missed"))
    # The chance that one hash bit tells two vectors at the threshold apart.
    agree = 1 - float(np.arccos(min(1.0, max(-1.0, threshold)))) / np.pi
    while True:
        new, placed = one_round(open_, passes, done, threshold)
        found.append(new)
        done += passes
        per = new.groupBy("rep", "pass").agg(F.max("shared").alias("m"))
        # A pass without a row has nothing HALO places away: it missed none, as has one whose m is -1.
        lost = F.when(F.col("m") >= BITS, 0.0).otherwise(F.log(F.greatest(F.lit(1e-30), 1 - F.pow(F.lit(agree), F.col("m") + 1))))
        own = per.groupBy("rep").agg(F.sum(lost).alias("own"), F.count(F.lit(1)).alias("k"))
        own = own.select("rep", (F.col("own") - (passes - F.col("k")) * 69.0).alias("own"))
        seen = seen.join(own, "rep").select("rep", (F.col("missed") + F.col("own")).alias("missed")).filter(F.col("missed") > float(np.log(MISSED)))
        seen = cut(seen)
        need = F.least(F.lit(1e9), done * (float(np.log(MISSED)) / F.least("missed", F.lit(-1e-9)) - 1))
        size, more = seen.agg(F.count(F.lit(1)), F.avg(need)).first()
        if not size:
            break
        open_ = cut(placed.join(seen.select("rep"), "rep", "left_semi"))
        if size <= 2 * more * (BLOCK + HALO):
            found.append(all_pairs(open_, size, done, threshold))
            break
        passes = max(1, min(PASSES, int(np.ceil(more))))
    out = found[0]
    for new in found[1:]:
        out = out.unionByName(new)
    return out


def link(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()
    distinct = rows.filter(good).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    # Numbered as they are written: an id may stand for several vectors.
    reps = cut(distinct.withColumn("rep", F.monotonically_increasing_id()))
    found = find_links(reps.drop("least"), passes, threshold).filter("links > 0 OR root <> rep")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    roots = cut(stars(edges))
    smallest = roots.join(reps.select(F.col("rep").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("smallest"))
    known = reps.join(counted, "rep", "left").join(roots.join(smallest, "root"), F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("embedding").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    out = rows.withColumn("good", good).withColumn("own", F.when(F.col("good"), F.col("embedding"))).join(known, F.col("own") == F.col("of"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
