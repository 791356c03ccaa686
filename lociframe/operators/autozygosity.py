"""Runs of autozygosity by a hidden Markov model of two states, without a task for a whole contig.

Sites of a block of positions are taken together, all samples at once. What a block does to the scores of its first site's two
states, to become those of its last, is a 2 x 2 matrix over (max, +) for the best path and over (+, x) for the probabilities. A contig's
matrices, a row for each block and sample, are combined in order; with the scores that enter a block, its own best paths are
found again, one for each state at its end, and a pass back over the blocks says which end is taken.

Where sites of one position are no step apart, they are in one state, and what is known of it adds up: they are combined before blocks
are taken, so that a block holds no more rows than positions, however many sites there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import variants as V
from lociframe.operators.sequence import settled

BLOCK = 1 << 14
TO_AZ, TO_HW, UNSEEN = 6.7e-8, 5e-9, 30.0  # transitions per position, and PL of a genotype that is not the one called
NONE = -(2**62)
CELLS = 1 << 20  # rows x samples of a block whose matrices are held at once


def observations(nested: DataFrame, frequency: Column, likelihoods: str | None = None, unseen: float = UNSEEN) -> DataFrame:
    """CHROM, POS, ids, az, hw: for each sample the probability of its data in either state, null where it has none. Sites of
    one ALT with a frequency above 0 only. Data are genotypes, of which those not called have the PL `unseen`, or the PL field named."""
    t = _known_sites(nested, frequency)
    data = F.transform("samples", lambda s: _data(s, likelihoods))  # told once for both states
    t = t.withColumn("_x", data)
    az, hw = F.transform("_x", lambda x: _states_of(x, likelihoods, unseen)[0]), F.transform("_x", lambda x: _states_of(x, likelihoods, unseen)[1])
    return t.select("CHROM", "POS", F.transform("samples", lambda s: s["sample_id"].cast("string")).alias("ids"), az.alias("az"), hw.alias("hw"))


def observations_at_positions(nested: DataFrame, frequency: Column, likelihoods: str | None = None, unseen: float = UNSEEN) -> DataFrame:
    """What observations gives, a row per position: az and hw are logarithms, summed over its sites, and n are the sites with data."""
    t = _known_sites(nested, frequency).select("CHROM", "POS", "_f", F.explode("samples").alias("_s"))
    t = t.select("CHROM", "POS", "_f", F.col("_s")["sample_id"].alias("ids"), _data(F.col("_s"), likelihoods).alias("_x"))
    az, hw = _states_of(F.col("_x"), likelihoods, unseen)
    log = lambda c: F.when(F.col(c) > 0, F.log(c)).when(F.col(c) == 0, float("-inf"))
    t = t.select("CHROM", "POS", "ids", az.alias("az"), hw.alias("hw"))
    sums = t.groupBy("CHROM", "POS", "ids").agg(F.sum(log("az")).alias("az"), F.sum(log("hw")).alias("hw"), F.count("az").alias("n"))
    each = F.struct(F.col("ids").cast("string").alias("ids"), "az", "hw", "n")
    rows = sums.groupBy("CHROM", "POS").agg(F.array_sort(F.collect_list(each)).alias("_s"))
    return rows.select("CHROM", "POS", *(F.col("_s")[c].alias(c) for c in ("ids", "az", "hw", "n")))


def _known_sites(nested: DataFrame, frequency: Column) -> DataFrame:
    """CHROM, POS, _f, samples of sites with one ALT and a frequency above 0."""
    # a generator of one row: a filter on the frequency is not pushed below it, which would have it done in the tasks that read
    one = F.inline(F.array(F.struct(frequency.cast("double").alias("_f"), F.col("samples"))))
    return nested.where(F.size("ALT") == 1).select("CHROM", F.col("POS").cast("long").alias("POS"), one).where("_f > 0")


def _data(s: Column, likelihoods: str | None) -> Column:
    """A sample's PL, or the ALT alleles of its diploid genotype; null where it has none."""
    if likelihoods:
        pl = s[likelihoods]
        return F.when((F.size(pl) == 3) & F.forall(pl, lambda x: x.isNotNull()), pl)
    gt = s["GT"]  # only unusual texts are taken apart
    usual = F.when(gt.isin("0/0", "0|0"), 0).when(gt.isin("0/1", "0|1", "1|0", "1/0"), 1).when(gt.isin("1/1", "1|1"), 2).when(gt.isin("./.", ".|.", "."), None)
    return usual.otherwise(F.when(V.in_class(gt, "mis"), None).when(F.size(V.alleles(gt)) == 2, V.dosage(gt)))


def _states_of(x: Column, likelihoods: str | None, unseen: float) -> tuple[Column, Column]:
    """Probability of data x in the state AZ, and in HW, at a site of frequency _f."""
    f, low = F.col("_f"), 10 ** (-unseen / 10)
    # 10^(-PL/10) of RR, RA, AA
    of = (lambda i: F.pow(F.lit(10.0), -F.get(x, F.lit(i)) / 10)) if likelihoods else (lambda i: F.when(x == i, 1.0).otherwise(low))
    az = F.when(x.isNotNull(), (1 - f) * of(0) + f * of(2))
    return az, F.when(x.isNotNull(), (1 - f) * (1 - f) * of(0) + 2 * f * (1 - f) * of(1) + f * f * of(2))


class Model:
    def __init__(self, to_az: float, to_hw: float, rate: float | None):
        self.a, self.b, self.rate = to_az, to_hw, rate

    def steps(self, distance: np.ndarray) -> np.ndarray:
        """Transition probabilities [..., from, to] over distances, states HW and AZ: those of one position taken so many times, or
        with `rate` scaled by the chance of a crossover, rate x distance."""
        d = np.maximum(distance, 1).astype(np.float64)
        if self.rate is None:
            moved = -np.expm1(d * np.log1p(-(self.a + self.b))) / (self.a + self.b)
            up, down = self.a * moved, self.b * moved
        else:
            c = np.minimum(1.0, d * self.rate)
            up, down = self.a * c, self.b * c
        return np.stack([np.stack([1 - up, up], -1), np.stack([down, 1 - down], -1)], -2)


def _block(table: pa.Table) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Positions, samples, logarithms of observations [row, sample, state] with whether there are any, and of how many sites, of a block
    in order."""
    table = table.take(pa.array(np.argsort(table.column("POS").to_numpy(), kind="stable")))
    ids = table.column("ids")[0].as_py()
    grid = lambda c: np.array(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(table.num_rows, len(ids))
    obs = np.stack([grid("hw"), grid("az")], -1)
    has = ~np.isnan(obs[..., 0])
    summed = "n" in table.column_names
    logs = np.where(np.isnan(obs), 0.0, obs) if summed else _logs(np.where(np.isnan(obs), 1.0, obs))
    return table.column("POS").to_numpy(), ids, logs, has, grid("n").astype(np.int64) if summed else has.astype(np.int64)


def _logs(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _moves(model: Model, pos: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Log transition probabilities [row, sample, from, to] into each row from the sample's last one with data; rows without data, and the
    first with data, leave the state as it is."""
    upto = np.maximum.accumulate(np.where(has, pos[:, None], NONE), 0)
    before = np.concatenate([np.full((1, has.shape[1]), NONE), upto[:-1]])
    more = has & (before != NONE)
    out = np.broadcast_to(_logs(np.eye(2)), (*has.shape, 2, 2)).copy()
    out[more] = _logs(model.steps((pos[:, None] - before)[more]))
    return out


def _times(a: np.ndarray, b: np.ndarray, add: np.ufunc) -> np.ndarray:
    """a x b, matrices in the last two axes; add: maximum or logaddexp."""
    return add(a[..., :, :1] + b[..., :1, :], a[..., :, 1:] + b[..., 1:, :])


def _apply(v: np.ndarray, a: np.ndarray, add: np.ufunc) -> np.ndarray:
    """Row vectors v x a."""
    return add(v[..., :1] + a[..., 0, :], v[..., 1:] + a[..., 1, :])


def _after_each(steps: np.ndarray, v: np.ndarray, times: Callable, apply: Callable) -> np.ndarray:
    """What v is after each of the steps, all taken at once: after every other one by the steps in pairs, then after those between."""
    if len(steps) == 1:
        return apply(v, steps[0])[None]
    pairs = _after_each(times(steps[:-1:2], steps[1::2]), v, times, apply)
    out = np.empty((len(steps), *v.shape), v.dtype)
    out[1::2] = pairs
    out[::2] = apply(np.concatenate([v[None], pairs])[: len(out[::2])], steps[::2])
    return out


def _all_scores(steps: np.ndarray, v: np.ndarray, add: np.ufunc) -> np.ndarray:
    return _after_each(steps, v, lambda a, b: _times(a, b, add), lambda w, a: _apply(w, a, add))


def _product(steps: np.ndarray, add: np.ufunc) -> np.ndarray:
    while len(steps) > 1:
        rest = steps[len(steps) // 2 * 2 :]
        steps = np.concatenate([_times(steps[:-1:2], steps[1::2], add), rest])
    return steps[0]


def _by_samples(f: Callable[..., tuple], axes: tuple[int, ...], model: Model, pos: np.ndarray, *of_samples: tuple[np.ndarray, int]) -> list[np.ndarray]:
    """f of some samples at a time, so that the matrices of a block have a bound; the axis of the samples is given for each array."""
    n, width = of_samples[0][0].shape[of_samples[0][1]], max(1, CELLS // len(pos))
    parts = [f(model, pos, *(np.take(x, range(i, min(n, i + width)), axis) for x, axis in of_samples)) for i in range(0, n, width)]
    return [np.concatenate(x, axis) for x, axis in zip(zip(*parts, strict=True), axes, strict=True)]


def _transfers(model: Model, pos: np.ndarray, obs: np.ndarray, has: np.ndarray) -> dict[str, np.ndarray]:
    """By sample: first and last position with data, the best path's score and the log probability from each state at the first to
    each at the last."""

    def some(model: Model, pos: np.ndarray, obs: np.ndarray, has: np.ndarray) -> tuple:
        steps = _moves(model, pos, has) + obs[:, :, None]
        any_, n = has.any(0), has.shape[1]
        first, last = (np.where(any_, pos[i], NONE) for i in (has.argmax(0), len(pos) - 1 - has[::-1].argmax(0)))
        return first, last, _product(steps, np.maximum).reshape(n, 4), _product(steps, np.logaddexp).reshape(n, 4)

    return dict(zip(("first", "last", "best", "total"), _by_samples(some, (0, 0, 0, 0), model, pos, (obs, 1), (has, 1)), strict=True))


def _paths(model: Model, pos: np.ndarray, obs: np.ndarray, has: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the best path to each state came from [row, sample, state], its own state where nothing moves, and the final scores; enter:
    scores at the first row."""

    def some(model: Model, pos: np.ndarray, obs: np.ndarray, has: np.ndarray, enter: np.ndarray) -> tuple:
        moves = _moves(model, pos, has)
        score = _all_scores(moves + obs[:, :, None], enter, np.maximum)
        into = np.concatenate([enter[None], score[:-1]])[..., None] + moves
        return into.argmax(2).astype(np.int8), score[-1]  # of equals the first, HW

    came, score = _by_samples(some, (1, 0), model, pos, (obs, 1), (has, 1), (enter, 0))
    return came, score


def _states(came: np.ndarray, has: np.ndarray, end: np.ndarray) -> np.ndarray:
    """States [row, sample] of the paths that end in `end`; -1 where a sample has no data."""
    pick = lambda v, f: np.take_along_axis(f, v[..., None], -1)[..., 0]
    end = end.astype(np.int8)
    back = _after_each(came[:0:-1], end, lambda a, b: np.take_along_axis(b, a, -1), pick) if len(came) > 1 else np.empty((0, len(end)), np.int8)
    return np.where(has, np.concatenate([back[::-1], end[None]]), -1).astype(np.int8)


def _posterior(model: Model, pos: np.ndarray, obs: np.ndarray, has: np.ndarray, enter: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Probability of AZ [row, sample]; enter: log weights of the first row's states, after: those of what follows the last."""

    def some(model: Model, pos: np.ndarray, obs: np.ndarray, has: np.ndarray, enter: np.ndarray, after: np.ndarray) -> tuple:
        steps = _moves(model, pos, has) + obs[:, :, None]
        both = _all_scores(steps, enter, np.logaddexp)
        both[-1] += after
        if len(pos) > 1:
            both[:-1] += _all_scores(steps[:0:-1].swapaxes(-1, -2), after, np.logaddexp)[::-1]
        return (np.exp(both[..., 1] - np.logaddexp(both[..., 0], both[..., 1])),)

    return _by_samples(some, (1,), model, pos, (obs, 1), (has, 1), (enter, 0), (after, 0))[0]


def autozygosity(observed: DataFrame, to_az: float = TO_AZ, to_hw: float = TO_HW, rate: float | None = None, per_site: bool = False, block: int = BLOCK) -> DataFrame:
    """Runs (sample_id, CHROM, begin, end, n sites, quality) of the best path's AZ state, or with per_site every site's state
    (sample_id, CHROM, POS, state, quality). quality: minus ten times the logarithm of the other state's probability, 99 at most, of runs
    the mean. observed: see observations and observations_at_positions; all rows have their samples in one order.

    to_az and to_hw are transition probabilities per position, or with `rate`, a crossover rate, those of a crossover. Sites of one
    position are as far apart as neighbouring ones; those of observations_at_positions are no step apart, and counted and scored each.
    """
    model = Model(to_az, to_hw, rate)
    rows = (settled(observed) if "n" in observed.columns else observed).withColumn("b", F.floor(F.col("POS") / block))
    key = ["CHROM", "b"]

    def transfers(k: tuple, table: pa.Table) -> pa.Table:
        pos, ids, obs, has, _ = _block(table)
        t = _transfers(model, pos, obs, has)
        use = t["first"] != NONE
        lists = lambda x: pa.array(list(x[use]), pa.list_(pa.float64()))
        n = int(use.sum())
        return pa.table({"CHROM": pa.array([k[0].as_py()] * n, pa.string()), "b": pa.array([k[1].as_py()] * n, pa.int64()), "sample_id": pa.array([s for s, u in zip(ids, use, strict=True) if u], pa.string()), "first": t["first"][use], "last": t["last"][use], "best": lists(t["best"]), "total": lists(t["total"])})

    steps = settled(rows.groupBy(*key).applyInArrow(transfers, "CHROM string, b long, sample_id string, first long, last long, best array<double>, total array<double>"))

    def scan(k: tuple, table: pa.Table) -> pa.Table:
        """What enters every block of a contig and sample, and what follows it."""
        table = table.take(pa.array(np.argsort(table.column("b").to_numpy())))
        first, last = table.column("first").to_numpy(), table.column("last").to_numpy()
        grid = lambda c: table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, 2, 2)
        best, total, m = grid("best"), grid("total"), table.num_rows
        gaps = _logs(model.steps(first[1:] - last[:-1])) if m > 1 else np.zeros((0, 2, 2))
        score, enter = np.zeros((m, 2)), np.zeros((m, 2))
        v = w = np.log([0.5, 0.5])
        for i in range(m):
            score[i], enter[i] = v, w
            v, w = (v[:, None] + best[i]).max(0), np.logaddexp(*(w[:, None] + total[i]))
            if i < m - 1:
                v, w = (v[:, None] + gaps[i]).max(0), np.logaddexp(*(w[:, None] + gaps[i]))
                v, w = v - v.max(), w - w.max()
        after, w = np.zeros((m, 2)), np.zeros(2)
        for i in range(m - 1, -1, -1):
            after[i] = w
            if i:
                s = total[i] + w[None]
                w = np.logaddexp(s[:, 0], s[:, 1])
                s = gaps[i - 1] + w[None]
                w = np.logaddexp(s[:, 0], s[:, 1])
                w = w - w.max()
        lists = lambda x: pa.array(list(x), pa.list_(pa.float64()))
        return pa.table({"CHROM": table.column("CHROM"), "b": table.column("b"), "sample_id": table.column("sample_id"), "first": table.column("first"), "last": table.column("last"), "score": lists(score), "enter": lists(enter), "after": lists(after)})

    scanned = settled(steps.groupBy("CHROM", "sample_id").applyInArrow(scan, "CHROM string, b long, sample_id string, first long, last long, score array<double>, enter array<double>, after array<double>"))

    def backs(k: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """By sample, the state at the block's first site for either state at its last, and the scores of the last."""
        pos, ids, obs, has, _ = _block(left)
        came, score = _paths(model, pos, obs, has, _by_sample(right, ids, "score", 2))
        origin = np.stack([_first_states(_states(came, has, np.full(len(ids), e)), has) for e in (0, 1)], -1)
        use = has.any(0)
        n = int(use.sum())
        return pa.table({"CHROM": pa.array([k[0].as_py()] * n, pa.string()), "b": pa.array([k[1].as_py()] * n, pa.int64()), "sample_id": pa.array([s for s, u in zip(ids, use, strict=True) if u], pa.string()), "origin": pa.array(origin[use].tolist(), pa.list_(pa.int32())), "score": pa.array(score[use].tolist(), pa.list_(pa.float64()))})

    ends = rows.groupBy(*key).cogroup(scanned.groupBy(*key)).applyInArrow(backs, "CHROM string, b long, sample_id string, origin array<int>, score array<double>")
    ends = ends.join(scanned.select("CHROM", "b", "sample_id", "first", "last"), ["CHROM", "b", "sample_id"])

    def resolve(k: tuple, table: pa.Table) -> pa.Table:
        """The state at each block's last site, from the last block back."""
        table = table.take(pa.array(np.argsort(table.column("b").to_numpy())))
        m = table.num_rows
        first, last = table.column("first").to_numpy(), table.column("last").to_numpy()
        origin = table.column("origin").combine_chunks().flatten().to_numpy().reshape(-1, 2)
        score = table.column("score").combine_chunks().flatten().to_numpy().reshape(-1, 2)
        gaps = _logs(model.steps(first[1:] - last[:-1])) if m > 1 else np.zeros((0, 2, 2))
        out = np.zeros(m, np.int32)
        for i in range(m - 1, -1, -1):
            out[i] = score[i].argmax() if i == m - 1 else (score[i] + gaps[i][:, origin[i + 1][out[i + 1]]]).argmax()
        return pa.table({"CHROM": table.column("CHROM"), "b": table.column("b"), "sample_id": table.column("sample_id"), "ends": pa.array(out)})

    ends = ends.groupBy("CHROM", "sample_id").applyInArrow(resolve, "CHROM string, b long, sample_id string, ends int")
    known = settled(scanned.join(ends, ["CHROM", "b", "sample_id"]))

    def finish(k: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        pos, ids, obs, has, sites = _block(left)
        came, _ = _paths(model, pos, obs, has, _by_sample(right, ids, "score", 2))
        states = _states(came, has, _by_sample(right, ids, "ends", 1)[:, 0])
        p = _posterior(model, pos, obs, has, _by_sample(right, ids, "enter", 2), _by_sample(right, ids, "after", 2))
        other = np.where(states == 1, 1 - p, p)
        quality = np.minimum(99.0, -10 * np.log10(np.maximum(other, 1e-300)))
        out: dict[str, list] = {c: [] for c in ("sample_id", "POS", "last", "n", "state", "quality")}
        for s, name in enumerate(ids):
            at = np.flatnonzero(has[:, s])
            if not len(at):
                continue
            if per_site:
                at = np.repeat(at, sites[at, s])
            x, size = states[at, s], np.ones(len(at), np.int64) if per_site else sites[at, s]
            begin = np.arange(len(at)) if per_site else np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            end = np.append(begin[1:], len(at)) - 1
            out["sample_id"] += [name] * len(begin)
            for c, v in (("POS", pos[at[begin]]), ("last", pos[at[end]]), ("n", np.add.reduceat(size, begin)), ("state", x[begin]), ("quality", np.add.reduceat(quality[at, s] * size, begin))):
                out[c] += v.tolist()
        n = len(out["POS"])
        return pa.table({"CHROM": pa.array([k[0].as_py()] * n, pa.string()), "sample_id": pa.array(out["sample_id"], pa.string()), "POS": pa.array(out["POS"], pa.int64()), "last": pa.array(out["last"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "state": pa.array(out["state"], pa.int32()), "quality": pa.array(out["quality"], pa.float64())})

    parts = rows.groupBy(*key).cogroup(known.groupBy(*key)).applyInArrow(finish, "CHROM string, sample_id string, POS long, last long, n long, state int, quality double")
    if per_site:
        return parts.select("sample_id", "CHROM", "POS", "state", "quality")
    # a run that goes over blocks is a part in each
    w = Window.partitionBy("sample_id", "CHROM").orderBy("POS")
    parts = parts.withColumn("_new", F.coalesce((F.lag("state").over(w) != F.col("state")).cast("int"), F.lit(1)))
    parts = parts.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("state = 1")
    runs = parts.groupBy("sample_id", "CHROM", "_run").agg(F.min("POS").alias("begin"), F.max("last").alias("end"), F.sum("n").alias("n"), (F.sum("quality") / F.sum("n")).alias("quality"))
    return runs.drop("_run")


def _by_sample(table: pa.Table, ids: list[str], column: str, width: int) -> np.ndarray:
    """column of each sample, in the order of ids; those without a row get 0."""
    place = {s: i for i, s in enumerate(ids)}
    out = np.zeros((len(ids), width))
    for s, v in zip(table.column("sample_id").to_pylist(), table.column(column).to_pylist(), strict=True):
        out[place[s]] = v
    return out


def _first_states(states: np.ndarray, has: np.ndarray) -> np.ndarray:
    return np.where(has.any(0), states[has.argmax(0), np.arange(states.shape[1])], 0)
