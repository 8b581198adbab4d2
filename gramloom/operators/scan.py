"""The forward scan: how well would each term not in the model fit next to the model?

Fitting one regression per candidate is not needed. For a candidate z next to model terms
A the sums z'z, z'1, z'y and z'a are enough: the part of z outside the model has square sum
s = z'z - |proj|^2 and covariance c with the residual of y, and

    t = c / sqrt(s * (rss - c^2/s) / df).

All candidates share df, so the smallest p-value is the largest |t|.

For a pair z = a*b each sum is one entry of a matrix product of two tiles, so the M^2/2
pair columns are never stored. A task owns a pair of blocks and streams over the sample
chunks with constant memory; only its best candidate per response leaves the task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.functions.numeric import rank_key
from gramloom.functions.tails import t_pvalue
from gramloom.operators.ols import COLLINEAR, RAW_NOISE, ZERO_ERROR
from gramloom.operators.tiles import Tiles, as_matrix

# Side data (responses and model columns) up to this size is broadcast; above it, it is
# joined by a shuffle on the chunk, of which there are then many.
BROADCAST_BYTES = 128 * 1024 * 1024
KEEP_LAYOUT_BYTES = 16 * 1024**3
# regr_sxx is centred as it is summed; a constant gives zero up to this part of its square sum.
CONSTANT = 1e-20

Position = tuple  # (pos,) for a single, (pos_a, pos_b) for a pair


@dataclass(frozen=True)
class ModelState:
    """What a scan has to know about one response's current model (all k-sized)."""

    response: int
    columns: tuple
    whitening: np.ndarray
    coefficients: np.ndarray
    rss: float
    df: int
    blocked: frozenset = field(default_factory=frozenset)
    allowed: frozenset | None = None
    # Places of the variables whose terms may be taken; None for all.
    variables: tuple | None = None
    # With the pseudo-inverse rule: the model's means, its coefficients (intercept last) and the pseudo-inverse of its X'X.
    means: np.ndarray | None = None
    beta: np.ndarray | None = None
    inverse: np.ndarray | None = None


def _dependent_t(mean, u, state: ModelState):
    """t of candidates that the model and the intercept already span.

    Such a column is X v for a v over the model's columns and the intercept. The least-norm solution gives it the share v.beta / (1 + v.v) with
    the error sqrt(mse * v' inverse v) / (1 + v.v), where the divisors cancel.
    """
    v = state.whitening.T @ u
    v = np.vstack([v, mean - state.means @ v])
    error = np.sqrt(np.maximum(np.einsum("ij,ij->j", v, state.inverse @ v), 0.0) * state.rss / state.df)
    return (state.beta @ v) / np.where(error == 0.0, ZERO_ERROR, error)


def candidate_t(n, zz, z1, zw, n_responses, state: ModelState):
    """t of each candidate from raw sums; NaN where it has nothing to add. ``zw`` is (responses + columns) x candidates."""
    if np.isnan(zz).any():
        raise ValueError("missing values in a candidate; choose a missing policy")
    return centred_t(zz - z1 * z1 / n, RAW_NOISE * zz, z1 / n, zw, n_responses, state)


def centred_t(squares, noise, mean, zw, n_responses, state: ModelState):
    """The same from square sums about the mean; up to ``noise`` a candidate is constant."""
    g = zw[[n_responses + c for c in state.columns]]
    u = state.whitening @ g
    s = squares - np.einsum("ij,ij->j", u, u)
    c = zw[state.response] - state.coefficients @ g
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = c * c / s
        left = np.maximum(state.rss - gain, 0.0)
        t = c / np.sqrt(s * left / state.df)
    # Both sides are centred: a mean far from zero hides no predictor.
    free = (s > COLLINEAR * squares) & (squares > noise)
    return np.where(free, t, np.nan if state.inverse is None else _dependent_t(mean, u, state))


def _mask(state: ModelState, pos_a, pos_b):
    """Candidates of a batch this model may still take."""
    own = _keys(pos_a, pos_b)
    ok = ~np.isin(own, _term_keys(state.blocked))
    if state.variables is not None:
        # Both sides of a pair have to be among them; -1 stands for no second side.
        ok &= np.isin(pos_a, state.variables) & np.isin(pos_b, [-1, *state.variables])
    if state.allowed is not None:
        ok &= np.isin(own, _term_keys(state.allowed))
    return ok


def _keys(pos_a, pos_b) -> np.ndarray:
    """One number for each term; pos_b is -1 for singles."""
    return (np.asarray(pos_a, dtype=np.int64) << 32) + np.asarray(pos_b, dtype=np.int64)


def _term_keys(terms) -> np.ndarray:
    places = np.array([t if len(t) == 2 else (t[0], -1) for t in terms], dtype=np.int64).reshape(-1, 2)
    return _keys(places[:, 0], places[:, 1])


def _batch(pos_a, pos_b, zz, z1, zw):
    return {"pos_a": pos_a, "pos_b": pos_b, "zz": zz, "z1": z1, "zw": zw}


class _Sums:
    """Running sums of one pair of blocks over the sample chunks."""

    def __init__(self, diagonal: bool, pairs: bool):
        self.diagonal, self.pairs = diagonal, pairs
        self.single = self.pair = None

    def add(self, a, b, w):
        if self.diagonal:
            part = np.concatenate([np.einsum("ij,ij->i", a, a)[None], a.sum(axis=1)[None], w @ a.T])
            self.single = part if self.single is None else self.single + part
        if self.pairs:
            if self.pair is None:
                self.pair = np.zeros((2 + len(w), a.shape[0], b.shape[0]))
            self.pair[0] += (a * a) @ (b * b).T
            self.pair[1] += a @ b.T
            for i, row in enumerate(w):
                self.pair[2 + i] += (a * row) @ b.T

    def batches(self, pos_a, pos_b):
        if self.single is not None:
            s = self.single
            yield _batch(pos_a, np.full(len(pos_a), -1), s[0], s[1], s[2:])
        if self.pair is not None:
            i, j = np.meshgrid(np.arange(len(pos_a)), np.arange(len(pos_b)), indexing="ij")
            keep = pos_a[i] < pos_b[j] if self.diagonal else np.ones(i.shape, dtype=bool)
            p = self.pair[:, keep]
            yield _batch(pos_a[i[keep]], pos_b[j[keep]], p[0], p[1], p[2:])


def _sum_blocks(batches, pairs: bool, sample_major: bool):
    """Candidate sums from rows sorted by (block_a, block_b, part, chunk, side)."""
    key = sums = pos_a = pos_b = left = weights = None
    for pdf in batches:
        for ba, bb, part, chunk, side, positions, values, w in zip(
            pdf["block_a"], pdf["block_b"], pdf["part"], pdf["chunk"], pdf["side"],
            pdf["positions"], pdf["values"], pdf["weights"],
        ):
            if (ba, bb, part) != key:
                if sums is not None:
                    yield from sums.batches(pos_a, pos_b)
                key, sums = (ba, bb, part), _Sums(ba == bb, pairs)
            positions = np.asarray(positions)
            m = as_matrix(values, len(positions), sample_major)
            if side == 0:
                pos_a, left, left_chunk = positions, m, chunk
                weights = np.asarray(w, dtype=float).reshape(-1, m.shape[1])
                if ba == bb:
                    pos_b = positions
                    sums.add(m, m, weights)
            else:
                if left is None or left_chunk != chunk:
                    raise RuntimeError(f"tile of block {ba}, chunk {chunk} is missing")
                pos_b = positions
                sums.add(left, m, weights)
    if sums is not None:
        yield from sums.batches(pos_a, pos_b)


class _Best:
    """Best candidate per response so far: largest |t|, ties to singles, then to low positions."""

    def __init__(self, n, n_responses, states):
        self.n, self.n_responses, self.states = n, n_responses, states
        self.rows = {}

    def feed(self, batch):
        for state in self.states:
            t = candidate_t(self.n, batch["zz"], batch["z1"], batch["zw"], self.n_responses, state)
            ok = _mask(state, batch["pos_a"], batch["pos_b"]) & ~np.isnan(t)
            if not ok.any():
                continue
            key = np.where(ok, rank_key(t), -1.0)
            tied = np.flatnonzero(key == key.max())
            order = np.lexsort((batch["pos_b"][tied], batch["pos_a"][tied], batch["pos_b"][tied] >= 0))
            i = tied[order[0]]
            a, b = int(batch["pos_a"][i]), int(batch["pos_b"][i])
            rank = (float(key[i]), -int(b >= 0), -a, -b)
            if state.response not in self.rows or rank > self.rows[state.response][0]:
                stats = np.concatenate([[batch["zz"][i], batch["z1"][i]], batch["zw"][:, i]])
                self.rows[state.response] = (rank, float(t[i]), stats)

    def frame(self):
        items = list(self.rows.items())
        return pd.DataFrame(
            {
                "response": [r for r, _ in items],
                "rank": [v[0][0] for _, v in items],
                "not_pair": [v[0][1] for _, v in items],
                "neg_a": [v[0][2] for _, v in items],
                "neg_b": [v[0][3] for _, v in items],
                "t": [v[1] for _, v in items],
                "stats": [v[2] for _, v in items],
            }
        )


BEST_SCHEMA = "response int, rank double, not_pair int, neg_a int, neg_b int, t double, stats array<double>"
ALL_SCHEMA = "response int, pos_a int, pos_b int, t double"


def _emit_best(sums, n, n_responses, states):
    best = _Best(n, n_responses, states)
    for batch in sums:
        best.feed(batch)
    if best.rows:
        yield best.frame()


def _emit_all(sums, n, n_responses, states):
    for batch in sums:
        for state in states:
            t = candidate_t(n, batch["zz"], batch["z1"], batch["zw"], n_responses, state)
            ok = _mask(state, batch["pos_a"], batch["pos_b"])
            if ok.any():
                yield pd.DataFrame(
                    {
                        "response": np.full(int(ok.sum()), state.response, dtype=np.int32),
                        "pos_a": batch["pos_a"][ok],
                        "pos_b": batch["pos_b"][ok],
                        "t": t[ok],
                    }
                )


def _emit_sums(sums):
    for batch in sums:
        out = {"pos_a": batch["pos_a"], "pos_b": batch["pos_b"], "s0": batch["zz"], "s1": batch["z1"]}
        out.update({f"s{i + 2}": row for i, row in enumerate(batch["zw"])})
        yield pd.DataFrame(out)


def _read_sums(batches, width):
    for pdf in batches:
        s = pdf[[f"s{i}" for i in range(width + 2)]].to_numpy(dtype=float).T
        yield _batch(pdf["pos_a"].to_numpy(), pdf["pos_b"].to_numpy(), s[0], s[1], s[2:])


def _stack(found: dict, terms, means) -> np.ndarray:
    """The centred responses, at -1 of ``found``, and the centred columns of ``terms``, one after the other."""
    rows = [found[-1]]
    for term, mean in zip(terms, means):
        rows.append((found[term[0]] * found[term[1]] if len(term) == 2 else found[term[0]]) - mean)
    return np.concatenate(rows)


def _whole_rows(batches, terms, means, response_means, x_major, y_major):
    """(chunk, positions, variables x samples, weights) of each row of tiles of all variables."""
    wanted = {p for term in terms for p in term}
    for pdf in batches:
        for chunk, positions, values, y_positions, y_values in zip(
            pdf["chunk"], pdf["positions"], pdf["values"], pdf["y_positions"], pdf["y_values"]
        ):
            m = as_matrix(values, len(positions), x_major)
            y = as_matrix(y_values, len(y_positions), y_major) - response_means[:, None]
            found = {int(p): m[i] for i, p in enumerate(positions) if int(p) in wanted}
            yield chunk, np.asarray(positions), m, _stack({-1: y.ravel(), **found}, terms, means)


def _sum_whole(rows, pairs: bool):
    """Candidate sums of the samples of a task, from tiles of all variables."""
    sums = positions = None
    for _, positions, m, weights in rows:
        sums = sums or _Sums(True, pairs)
        sums.add(m, m, weights.reshape(-1, m.shape[1]))
    if sums is not None:
        yield from sums.batches(positions, positions)


@dataclass(frozen=True)
class SideColumns:
    """The centred responses, then the centred model columns, next to which candidates are judged.

    Model columns are cut out of the tiles of the few blocks that hold them, so nothing
    N-sized passes through the driver and the lineage does not grow with the iterations. Tiles of all variables have
    them in the very rows that are scanned.
    """

    tiles: Tiles
    responses: Tiles
    response_means: np.ndarray
    terms: list[Position]
    means: list[float]

    def cutter(self):
        """From batches of tiles of all variables to their rows with weights; holds no DataFrame."""
        terms, means, response_means = self.terms, self.means, self.response_means
        x_major, y_major = self.tiles.sample_major, self.tiles.y_sample_major
        return lambda batches: _whole_rows(batches, terms, means, response_means, x_major, y_major)

    def frame(self) -> DataFrame:
        """(chunk, weights)."""
        response_means, terms, means = self.response_means, self.terms, self.means
        y_major, x_major = self.responses.sample_major, self.tiles.sample_major
        wanted = {p for term in terms for p in term}
        if self.tiles.whole:
            cut_rows = self.cutter()

            def own(batches):
                for chunk, _, _, weights in cut_rows(batches):
                    yield pd.DataFrame({"chunk": [chunk], "weights": [weights]})

            rows = self.tiles.df.select("chunk", "positions", "values", "y_positions", "y_values")
            return rows.mapInPandas(own, "chunk int, weights array<double>")

        def centre(batches):
            for pdf in batches:
                flat = [
                    (as_matrix(v, len(p), y_major) - response_means[:, None]).ravel()
                    for v, p in zip(pdf["values"], pdf["positions"])
                ]
                yield pd.DataFrame({"chunk": pdf["chunk"], "pos": -1, "weights": flat})

        def cut(batches):
            for pdf in batches:
                for chunk, positions, values in zip(pdf["chunk"], pdf["positions"], pdf["values"]):
                    m = as_matrix(values, len(positions), x_major)
                    hit = [i for i, p in enumerate(positions) if int(p) in wanted]
                    if hit:
                        yield pd.DataFrame(
                            {"chunk": chunk, "pos": [int(positions[i]) for i in hit], "weights": [m[i] for i in hit]}
                        )

        def stack(pdf):
            weights = _stack(dict(zip(pdf["pos"], pdf["weights"])), terms, means)
            return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "weights": [weights]})

        schema = "chunk int, pos int, weights array<double>"
        y = self.responses.df.mapInPandas(centre, schema)
        if not terms:
            return y.drop("pos")
        blocks = sorted({p // self.tiles.block for p in wanted})
        columns = self.tiles.df.where(F.col("block").isin(blocks)).mapInPandas(cut, schema)
        # a group is one chunk of the responses and of the model's few columns
        return y.unionByName(columns).groupBy("chunk").applyInPandas(stack, "chunk int, weights array<double>")


def side_columns(
    tiles: Tiles, responses: Tiles, response_means: np.ndarray, terms: list[Position], means: list[float]
) -> SideColumns:
    return SideColumns(tiles, responses, np.asarray(response_means, dtype=float), list(terms), list(means))


def pair_layout(tiles: Tiles, pairs: bool, parts: int, weights: DataFrame | None = None) -> DataFrame:
    """Send every tile to the block pairs it takes part in: one shuffle, rows sorted per pair.

    ``weights`` (chunk, weights), if given, ride along on the left tile of each pair.
    """
    n_blocks = tiles.n_blocks
    part = (F.col("chunk") % parts).alias("part")
    extra = [] if weights is None else ["weights"]
    lefts = (tiles.df if weights is None else tiles.df.join(weights, "chunk")).select(
        F.col("block").alias("block_a"),
        F.explode(F.sequence(F.col("block"), F.lit(n_blocks - 1) if pairs else F.col("block"))).alias("block_b"),
        part, "chunk", F.lit(0).alias("side"), "positions", "values", *extra,
    )
    rows = lefts
    if pairs and n_blocks > 1:
        none = [F.lit(None).cast("array<double>").alias(c) for c in extra]
        rights = tiles.df.where("block > 0").select(
            F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block_a"),
            F.col("block").alias("block_b"),
            part, "chunk", F.lit(1).alias("side"), "positions", "values", *none,
        )
        rows = lefts.unionByName(rights)
    keys = _block_keys(tiles, pairs) * parts
    tasks = min(keys, max(_shuffle_partitions(tiles.df), keys // 4))
    # Pair (a, b) has the serial number a*n - a(a-1)/2 + (b - a): placing by it gives every
    # task the same number of pairs, which hashing would not.
    a, b = F.col("block_a").cast("long"), F.col("block_b").cast("long")
    serial = (a * n_blocks - F.expr("cast(block_a as long) * (block_a - 1) div 2") + (b - a)) if pairs else a
    slot = ((serial * parts + F.col("part")) % tasks).cast("int")
    return (
        rows.withColumn("_slot", slot)
        .repartitionById(tasks, "_slot")
        .drop("_slot")
        .sortWithinPartitions("block_a", "block_b", "part", "chunk", "side")
    )


def _block_keys(tiles: Tiles, pairs: bool) -> int:
    return tiles.n_blocks * (tiles.n_blocks + 1) // 2 if pairs else tiles.n_blocks


class Layout:
    """Tiles placed for scanning, reused over the iterations of one run.

    Placing costs n_blocks copies of the matrix. Up to ``keep_bytes`` the placed rows are
    persisted and the small weights meet them by broadcast, so an iteration has no big
    shuffle; beyond that, or with weights too large to broadcast, rows are placed anew
    with the weights attached. Tiles of all variables stay where they are: their rows have
    the weights in them, and nothing is broadcast.
    """

    def __init__(self, tiles: Tiles, pairs: bool, parts: int | None = None, keep_bytes: int = KEEP_LAYOUT_BYTES):
        self.tiles, self.pairs = tiles, pairs
        if tiles.whole:
            self.parts, self.kept = 1, None
            return
        self.parts = parts or _chunk_parts(tiles, pairs)
        size = tiles.n_features * tiles.n_samples * 8 * (tiles.n_blocks if pairs else 1)
        self.kept = pair_layout(tiles, pairs, self.parts).persist() if size <= keep_bytes else None

    def rows(self, weights: DataFrame, width: int) -> DataFrame:
        small = self.tiles.n_samples * width * 8 <= BROADCAST_BYTES
        if self.kept is not None and small:
            w = F.broadcast(weights.select(F.col("chunk").alias("_chunk"), "weights"))
            return self.kept.join(w, (F.col("chunk") == F.col("_chunk")) & (F.col("side") == 0), "left")
        return pair_layout(self.tiles, self.pairs, self.parts, F.broadcast(weights) if small else weights)

    def unpersist(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _chunk_parts(tiles: Tiles, pairs: bool) -> int:
    """How many tasks share the samples of one block pair (1 unless pairs are too few for the cores)."""
    keys = _block_keys(tiles, pairs)
    cores = tiles.df.sparkSession.sparkContext.defaultParallelism
    return 1 if keys >= cores else min(tiles.n_chunks, max(1, 2 * cores // keys))


def scan(
    layout: Layout, weights: SideColumns, n_responses: int, n_columns: int, states: list[ModelState],
    best_only: bool = True,
) -> DataFrame:
    """One scan job for all responses in ``states``.

    ``best_only``: one row per task and response (BEST_SCHEMA). Otherwise the t of every
    candidate (ALL_SCHEMA; pos_b is -1 for singles).
    """
    width = n_responses + n_columns
    tiles, pairs, parts = layout.tiles, layout.pairs, layout.parts
    n, sample_major = tiles.n_samples, tiles.sample_major
    emit = _emit_best if best_only else _emit_all
    schema = BEST_SCHEMA if best_only else ALL_SCHEMA
    if tiles.whole:
        cut = weights.cutter()
        rows = tiles.df.select("chunk", "positions", "values", "y_positions", "y_values")
        sums = lambda it: _sum_whole(cut(it), pairs)
    else:
        rows = layout.rows(weights.frame(), width)
        sums = lambda it: _sum_blocks(it, pairs, sample_major)
    if parts == 1 and not tiles.whole:
        return rows.mapInPandas(lambda it: emit(sums(it), n, n_responses, states), schema)
    # Few block pairs, many samples: tasks return partial sums, added up per candidate.
    names = [f"s{i}" for i in range(width + 2)]
    partial = rows.mapInPandas(
        lambda it: _emit_sums(sums(it)),
        "pos_a int, pos_b int, " + ", ".join(f"{c} double" for c in names),
    )
    summed = partial.groupBy("pos_a", "pos_b").agg(*[F.sum(c).alias(c) for c in names])
    return summed.mapInPandas(lambda it: emit(_read_sums(it, width), n, n_responses, states), schema)


def best_candidate(scanned: DataFrame) -> DataFrame:
    """The winner per response: a partial ``max`` of an ordered struct, no sort."""
    order = F.struct("rank", "not_pair", "neg_a", "neg_b", "t", "stats")
    return scanned.groupBy("response").agg(F.max(order).alias("best")).select(
        "response",
        (-F.col("best.neg_a")).alias("pos_a"),
        F.when(F.col("best.neg_b") < 1, -F.col("best.neg_b")).alias("pos_b"),
        F.col("best.t").alias("t"),
        F.col("best.stats").alias("stats"),
    )


def marginal_scan(calls: DataFrame, by: list[str], x: str | Column, y: str | Column) -> DataFrame:
    """One-variable regressions of y on each variable: built-in aggregates, combined map-side."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    sums = calls.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.sum(x * x).alias("zz"),
    )
    fitted = (
        sums.where((F.col("sxx") > CONSTANT * F.col("zz")) & (F.col("n") > 2))
        .withColumn("df", F.col("n") - 2)
        .withColumn("rss", F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0)))
        .withColumn("std_error", F.sqrt(F.col("rss") / F.col("df") / F.col("sxx")))
        .withColumn("t", F.when(F.col("std_error") > 0, F.col("slope") / F.col("std_error")))
    )
    return fitted.select(
        *by, "n", "slope", "intercept", "rss", "std_error", "t", t_pvalue(F.col("t"), F.col("df")).alias("p")
    )
