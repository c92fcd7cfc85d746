"""Hidden Markov models over ordered positions: Viterbi paths, posterior probabilities and training, by tiles of positions.

Transition matrices are powers of the one-step matrix by the gap between positions. Emissions are likelihoods by state. `viterbi` and
`posterior` do the same for one array of sites."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import scratch_path


def powers(t: np.ndarray, most: int = 10_000) -> list[np.ndarray]:
    """t**1, t**2, t**4 and so on."""
    out = [t]
    while (1 << len(out)) <= most:
        out.append(out[-1] @ out[-1])
    return out


def _steps(pos: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    table, known = powers(t, int(max([1, *np.diff(pos)]))), {}
    out = []
    for gap in np.maximum(1, np.diff(pos)).tolist():
        if gap not in known:
            m, i = np.eye(len(t)), 0
            while gap >> i:
                if gap >> i & 1:
                    m = m @ table[i]
                i += 1
            known[gap] = m
        out.append(known[gap])
    return out


def viterbi(pos: np.ndarray, emit: np.ndarray, t: np.ndarray, init: np.ndarray) -> np.ndarray:
    """Likeliest states; t[i, j]: from i to j. Probabilities are scaled at every site; ties go to the lowest state."""
    n = len(pos)
    back = np.zeros((n, len(t)), np.int32)
    p = init * emit[0]
    p = p / p.sum() if p.sum() else np.full(len(t), 1 / len(t))
    for i, m in enumerate(_steps(pos, t), 1):
        x = p[:, None] * m
        back[i] = x.argmax(0)
        p = x.max(0) * emit[i]
        p = p / p.sum() if p.sum() else np.full(len(t), 1 / len(t))
    path = np.zeros(n, np.int32)
    path[-1] = p.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def posterior(pos: np.ndarray, emit: np.ndarray, t: np.ndarray, init: np.ndarray) -> np.ndarray:
    """Forward-backward probabilities of states at each site."""
    steps, n = _steps(pos, t), len(pos)
    f, b = np.zeros((n, len(t))), np.ones((n, len(t)))
    f[0] = init * emit[0]
    f[0] /= f[0].sum() or 1
    for i in range(1, n):
        f[i] = (f[i - 1] @ steps[i - 1]) * emit[i]
        f[i] /= f[i].sum() or 1
    for i in range(n - 2, -1, -1):
        b[i] = steps[i] @ (emit[i + 1] * b[i + 1])
        b[i] /= b[i].sum() or 1
    g = f * b
    return g / np.maximum(g.sum(1, keepdims=True), 1e-300)


UNIT, LOW = 1 << 24, -(1 << 56)  # logarithms are whole numbers of 1 / UNIT; LOW stands for the logarithm of 0
ROWS, WIDTH = 50_000, 1 << 20  # sites of a call, on average; positions of a tile


def logs(p: np.ndarray) -> np.ndarray:
    """Natural logarithms as whole numbers. Their sums and maxima are the same in whatever order they are taken, so a path does not
    depend on where tiles end."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.rint(np.log(p) * UNIT), LOW).astype(np.int64)


def best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices."""
    return np.maximum((a[:, :, :, None] + b[:, None, :, :]).max(2), LOW)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacks of matrices, each scaled to a greatest entry of 1."""
    m = a @ b
    top = m.max((1, 2), keepdims=True)
    return m / np.where(top > 0, top, 1)


def folded(stack: np.ndarray, join) -> np.ndarray:
    """One matrix of a stack: neighbours are joined in pairs until one is left."""
    while len(stack) > 1:
        even = len(stack) // 2 * 2
        stack = np.concatenate([join(stack[0:even:2], stack[1:even:2]), stack[even:]])
    return stack[0]


def moves(gap: np.ndarray, cross: np.ndarray | None, t: np.ndarray) -> np.ndarray:
    """Transition matrices over gaps between positions; cross: factors (at most 1) of the entries off the diagonal, which then takes the rest."""
    each, at = np.unique(np.maximum(1, gap), return_inverse=True)
    out = np.stack([np.linalg.matrix_power(t, int(g)) for g in each])[at] if len(gap) else np.zeros((0, *t.shape))
    if cross is not None:
        off = out * np.minimum(1, cross)[:, None, None] * (1 - np.eye(len(t)))
        out = off + np.eye(len(t)) * (1 - off.sum(2, keepdims=True))
    return out


class Tiles:
    """The tiles of one call as flat arrays: sites in order of tile and position, where each tile begins, and by site what it emits and how
    it is reached from the site before it (meaningless for the first of a tile)."""

    def __init__(self, pos: np.ndarray, emit: np.ndarray, cross: np.ndarray | None, begin: np.ndarray, t: np.ndarray):
        blank = ~(np.nan_to_num(emit) > 0).any(1)
        self.emit = np.where(blank[:, None], 1.0, np.nan_to_num(emit))  # a site that says nothing
        self.begin, self.size, self.pos = begin, np.diff(np.append(begin, len(pos))), pos
        self.move = moves(np.append(1, np.diff(pos)), cross, t)
        self.log_emit, self.log_move = logs(self.emit), logs(self.move)
        self.order = np.argsort(-self.size, kind="stable")

    def rounds(self):
        """Step, and the sites at that step of all tiles that have it (longest tiles first)."""
        start, live = self.begin[self.order], np.searchsorted(-self.size[self.order], -np.arange(int(self.size.max(initial=0))), "left")
        return [(k, start[:m] + k) for k, m in enumerate(live.tolist())]

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        """By tile: from the state at its first site to that at its last one, in logarithms (best path) and in probabilities (all paths)."""
        s = self.emit.shape[1]
        eye = np.eye(s)
        first, whole = [], []
        for b, n in zip(self.begin.tolist(), self.size.tolist()):
            own = slice(b, b + n)
            log = self.log_move[own] + self.log_emit[own][:, None, :]
            log[0] = np.where(eye > 0, self.log_emit[b][None, :], LOW)
            lin = self.move[own] * self.emit[own][:, None, :]
            lin[0] = eye * self.emit[b]
            first.append(folded(np.maximum(log, LOW), best))
            whole.append(folded(lin, product))
        return np.stack(first), np.stack(whole)

    def decode(self, came: np.ndarray, ahead: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paths, first, posterior). came: logarithms of the best way to each state of a tile's first site; ahead: probabilities of its
        states; after: of what follows the tile, by state of its last site. paths: by site and state of the tile's last site, the state of
        the best way there; first: the same of a tile's first site; posterior: by site and state."""
        n, s = self.emit.shape
        back, rounds, rank = np.zeros((n, s), np.int8), self.rounds(), self.order
        v, f = came[rank].copy(), ahead[rank].copy()
        forward = np.zeros((n, s))
        for k, at in rounds:
            m = len(at)
            if k:
                way = v[:m, :, None] + self.log_move[at]
                back[at] = way.argmax(1)
                v[:m], f[:m] = way.max(1), (f[:m, None, :] @ self.move[at])[:, 0]
            v[:m] = np.maximum(v[:m] + self.log_emit[at], LOW)
            f[:m] *= self.emit[at]
            f[:m] /= np.maximum(f[:m].sum(1, keepdims=True), 1e-300)
            forward[at] = f[:m]
        paths, posterior = np.zeros((n, s), np.int8), np.zeros((n, s))
        now, b = np.tile(np.arange(s, dtype=np.int8), (len(rank), 1)), after[rank].copy()
        for k, at in rounds[::-1]:
            m = len(at)
            paths[at] = now[:m]
            posterior[at] = forward[at] * b[:m]
            if k:
                now[:m] = np.take_along_axis(back[at], now[:m].astype(np.int64), 1)
                b[:m] = (self.move[at] @ (self.emit[at] * b[:m])[:, :, None])[:, :, 0]
                b[:m] /= np.maximum(b[:m].sum(1, keepdims=True), 1e-300)
        first = np.zeros((len(rank), s), np.int8)
        first[rank] = now
        return paths, first, posterior / np.maximum(posterior.sum(1, keepdims=True), 1e-300)

    def expected(self, ahead: np.ndarray, after: np.ndarray, seam: np.ndarray) -> np.ndarray:
        """Expected transitions between neighbouring sites, summed; seam: by tile the move from the tile before, NaN for none."""
        s = self.emit.shape[1]
        total = np.zeros((s, s))
        for g, (b, n) in enumerate(zip(self.begin.tolist(), self.size.tolist())):
            f, fs = ahead[g] * self.emit[b], []
            for k in range(b, b + n):
                f = f if k == b else (f @ self.move[k]) * self.emit[k]
                f = f / max(f.sum(), 1e-300)
                fs.append(f)
            w = after[g]
            for k in range(b + n - 1, b, -1):
                xi = fs[k - b - 1][:, None] * self.move[k] * (self.emit[k] * w)[None, :]
                total += xi / max(xi.sum(), 1e-300)
                w = self.move[k] @ (self.emit[k] * w)
                w = w / max(w.sum(), 1e-300)
            if not np.isnan(seam[g]).any():
                xi = seam[g] * (self.emit[b] * w)[None, :]
                total += xi / max(xi.sum(), 1e-300)
        return total


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _read(pdf: pd.DataFrame, emissions: list[str], cross: str | None, t: np.ndarray) -> tuple[pd.DataFrame, Tiles]:
    """A pack's sites in order, and its tiles."""
    pdf = pdf.sort_values(["_key", "_tile", "_at"], kind="stable", ignore_index=True)
    begin = np.flatnonzero((np.diff(pdf["_key"], prepend=0) != 0) | (np.diff(pdf["_tile"], prepend=0) != 0) | (np.arange(len(pdf)) == 0))
    return pdf, Tiles(pdf["_at"].to_numpy(), pdf[emissions].to_numpy(float), pdf[cross].to_numpy(float) if cross else None, begin, t)


def _scanned(pdf: pd.DataFrame, t: np.ndarray, init: np.ndarray) -> pd.DataFrame:
    """What comes into each tile of one key from the left and from the right, by the maps of the tiles."""
    pdf = pdf.sort_values("_tile", ignore_index=True)
    n, s = len(pdf), len(t)
    maps, whole = np.stack(pdf["best"]).reshape(n, s, s), np.stack(pdf["whole"]).reshape(n, s, s)
    cross = pdf["cross"].to_numpy(float)
    gap = np.append(1, pdf["first_at"].to_numpy()[1:] - pdf["last_at"].to_numpy()[:-1])
    move = moves(gap, None if np.isnan(cross).all() else cross, t)
    log_move = logs(move)
    came, ahead, after, seam = np.zeros((n, s), np.int64), np.zeros((n, s)), np.ones((n, s)), np.zeros((n, s), np.int64)
    over = np.full((n, s, s), np.nan)
    v, f = logs(init), init / init.sum()
    for k in range(n):
        if k:
            way = v[:, None] + log_move[k]
            seam[k], v = way.argmax(0), way.max(0)
            over[k] = f[:, None] * move[k]
            f = f @ move[k]
        came[k], ahead[k] = v, f
        v = np.maximum((v[:, None] + maps[k]).max(0), LOW)
        v = np.maximum(v - v.max(), LOW)
        f = f @ whole[k]
        f = f / max(f.sum(), 1e-300)
    for k in range(n - 2, -1, -1):
        b = move[k + 1] @ (whole[k + 1] @ after[k + 1])
        after[k] = b / max(b.sum(), 1e-300)
    last = np.full(n, -1)
    last[-1] = int(v.argmax())
    out = pdf[["_key", "_tile"]].copy()
    out["came"], out["ahead"], out["after"], out["seam"], out["last"], out["over"] = list(came), list(ahead), list(after), list(seam), last, list(over.reshape(n, s * s))
    return out


def _scan(sites: DataFrame, emissions: list[str], cross: str | None, t: np.ndarray, init: np.ndarray, packs: int) -> DataFrame:
    """By tile, the states that come into it; a key's tiles, a few numbers each, are scanned together, its sites never are."""

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, tiles = _read(pdf, emissions, cross, t)
        one, all_ = tiles.maps()
        out = pdf.iloc[tiles.begin][["_key", "_tile"]].reset_index(drop=True)
        out["first_at"], out["last_at"] = tiles.pos[tiles.begin], tiles.pos[tiles.begin + tiles.size - 1]
        out["cross"] = pdf[cross].to_numpy(float)[tiles.begin] if cross else np.nan
        out["best"], out["whole"] = list(one.reshape(len(one), -1)), list(all_.reshape(len(all_), -1))
        return out

    told = sites.groupBy("_pack").applyInPandas(maps, "_key long, _tile long, first_at long, last_at long, cross double, best array<long>, whole array<double>")
    return told.groupBy("_key").applyInPandas(lambda pdf: _scanned(pdf, t, init), "_key long, _tile long, came array<long>, ahead array<double>, after array<double>, seam array<long>, last int, over array<double>")


def _sites(df: DataFrame, keys: list[str], at: str, more: list[str], width: int) -> tuple[DataFrame, int]:
    """Sites with a number for their key, tile and pack, written once as they are read several times."""
    x = df.select(*keys, F.col(at).cast("long").alias("_at"), *more).withColumn("_key", F.xxhash64(*keys)).withColumn("_tile", F.floor(F.col("_at") / width))
    x = _kept(x, "hmm-sites")
    packs = max(1, x.count() // ROWS)
    return x.withColumn("_pack", F.pmod(F.xxhash64("_key", "_tile"), F.lit(packs))), packs


def decode(df: DataFrame, keys: list[str], at: str, emissions: list[str], transition: list[list[float]], init: list[float], crossover: str | None = None, width: int = WIDTH, every: bool = False) -> DataFrame:
    """keys, at, state, prob (of that state; every: also probs, of all states): the likeliest path of each group, and how sure its states are. emissions: a column for
    each state. crossover: a column with the factor (at most 1) for changes of state since the site before.

    A group is cut into tiles of `width` positions. Each tile is summed up by two small matrices (the best ways, and all ways, from the states of
    its first site to those of its last), which compose in any order; a scan over a group's tiles tells what comes into each one from the
    left and the right; then each tile is decoded for itself, for every state in which it can end, and a scan from the right picks the one. No task
    holds a group's sites, and the path is the same for every width: logarithms are whole numbers (see logs). Ties go to the
    lowest state. Sites without a likelihood say nothing. Keys are told apart by a 64-bit hash."""
    t, start = np.array(transition, float), np.array(init, float)
    s = len(t)
    sites, packs = _sites(df, keys, at, emissions + ([crossover] if crossover else []), width)
    incoming = _kept(_scan(sites, emissions, crossover, t, start, packs), "hmm-tiles")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pdf, tiles = _read(left, emissions, crossover, t)
        right = right.sort_values(["_key", "_tile"], ignore_index=True)
        paths, first, post = tiles.decode(np.stack(right["came"]), np.stack(right["ahead"]), np.stack(right["after"]))
        out = pdf[[*keys, "_at", "_key", "_tile"]].copy()
        out["paths"], out["post"], out["first"] = list(paths.astype(np.int32)), list(post), None
        out["first"] = out["first"].astype(object)
        for g, b in enumerate(tiles.begin.tolist()):
            out.at[b, "first"] = first[g].astype(np.int32)
        return out

    packed = incoming.withColumn("_pack", F.pmod(F.xxhash64("_key", "_tile"), F.lit(packs)))
    decoded = sites.groupBy("_pack").cogroup(packed.groupBy("_pack")).applyInPandas(run, f"{kinds}, _at long, _key long, _tile long, paths array<int>, post array<double>, first array<int>")
    decoded = _kept(decoded, "hmm-decoded")

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_tile", ignore_index=True)
        end, state = np.zeros(len(pdf), np.int32), int(pdf["last"].iloc[-1])
        for k in range(len(pdf) - 1, -1, -1):
            end[k] = state
            state = int(pdf["seam"][k][pdf["first"][k][state]])
        return pdf[["_key", "_tile"]].assign(end=end)

    of_tile = decoded.filter("first IS NOT NULL").select("_key", "_tile", "first").join(incoming.select("_key", "_tile", "seam", "last"), ["_key", "_tile"])
    end = of_tile.groupBy("_key").applyInPandas(ends, "_key long, _tile long, end int")
    state = F.get("paths", F.col("end"))
    return decoded.join(end, ["_key", "_tile"]).select(*keys, F.col("_at").cast(df.schema[at].dataType).alias(at), state.alias("state"), F.get("post", state).alias("prob"), *([F.col("post").alias("probs")] if every else []))


def train(df: DataFrame, keys: list[str], at: str, emissions: list[str], transition: list[list[float]], init: list[float], rounds: int = 20, least: float = 1e-4, width: int = WIDTH) -> list[list[float]]:
    """Transition probabilities fitted by expectation and maximisation, for positions that follow on each other. Each tile adds up its
    expected transitions; their sum, a few numbers, comes to the driver once a round. Ends when no probability moves by more than `least`."""
    t, start = np.array(transition, float), np.array(init, float)
    s = len(t)
    sites, packs = _sites(df, keys, at, emissions, width)
    for _ in range(rounds):
        incoming = _scan(sites, emissions, None, t, start, packs).withColumn("_pack", F.pmod(F.xxhash64("_key", "_tile"), F.lit(packs)))

        def run(left: pd.DataFrame, right: pd.DataFrame, t=t) -> pd.DataFrame:
            _, tiles = _read(left, emissions, None, t)
            right = right.sort_values(["_key", "_tile"], ignore_index=True)
            x = tiles.expected(np.stack(right["ahead"]), np.stack(right["after"]), np.stack(right["over"]).reshape(-1, s, s))
            return pd.DataFrame({"cell": np.arange(s * s), "n": x.ravel()})

        sums = sites.groupBy("_pack").cogroup(incoming.groupBy("_pack")).applyInPandas(_pair(run), "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        x = np.zeros(s * s)
        for r in sums:
            x[r["cell"]] = r["n"]
        x = x.reshape(s, s)
        new = np.where(x.sum(1, keepdims=True) > 0, x / np.maximum(x.sum(1, keepdims=True), 1e-300), t)
        moved, t = np.abs(new - t).max(), new
        if moved < least:
            break
    return t.tolist()


def _pair(f):
    return lambda a, b: f(a, b)
