"""Vector operators: group means, rank among means, pair similarity, mixtures, medoids."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from routeloom.functions import vector as vx

BLOCK_ROWS = 4096
MIXTURE_ROWS = 256
#: Passes of a mixture between two written states and tests of convergence.
PASSES = 5


def group_means(df: DataFrame, group: str, vec: str, out: str = "mean") -> DataFrame:
    """Mean vector per group; summed per dimension, so a large group is combined map-side."""
    dims = df.select(group, F.posexplode(vec).alias("_i", "_x"))
    sums = dims.groupBy(group, "_i").agg(F.avg("_x").alias("_m"))
    packed = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return sums.groupBy(group).agg(F.transform(packed, lambda s: s["_m"]).alias(out))


def blocks_for(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS))


def rank_among_means(df: DataFrame, means: DataFrame, key: str, group: str, vec: str, mean: str = "mean", floor: float = float("-inf")) -> DataFrame:
    """``(key, group, own_score, rank, candidates)``: place of a vector's own group among all groups.

    ``candidates`` is the number of groups that score at least ``floor``.

    Exact brute force as blocked matrix products.  Vectors are cut into blocks by
    their key and means into blocks by their group; each (vector block, mean block)
    is one task that reports a single count per vector, so no pair is ever emitted
    and nothing is collected.  Ties go to the smaller group name.
    """
    own = df.join(means.withColumnRenamed(mean, "_own"), group).select(
        key, group, F.col(vec).alias("_v"), vx.dot_product(F.col(vec), F.col("_own")).alias("own_score")
    )
    n_means = means.count()
    vb = blocks_for(df.count())
    mb = blocks_for(n_means)
    left = own.withColumn("_vb", F.pmod(F.xxhash64(key), F.lit(vb))).withColumn(
        "_mb", F.explode(F.sequence(F.lit(0), F.lit(mb - 1)))
    )
    right = (
        means.select(F.col(group).alias("_g"), F.col(mean).alias("_m"))
        .withColumn("_mb", F.pmod(F.xxhash64("_g"), F.lit(mb)).cast("int"))
        .withColumn("_vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vb - 1).cast("long"))))
    )
    key_type = dict(df.dtypes)[key]

    def count_better(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({key: [], "_better": [], "_above": []}).astype({"_better": "int64", "_above": "int64"})
        scores = np.stack(a["_v"]) @ np.stack(b["_m"]).T
        names = b["_g"].to_numpy()
        mine = a["own_score"].to_numpy()[:, None]
        me = a[group].to_numpy()[:, None]
        other = names[None, :] != me
        close = np.abs(scores - mine) <= 1e-12
        better = other & ((scores > mine + 1e-12) | (close & (names[None, :] < me)))
        return pd.DataFrame({key: a[key], "_better": better.sum(axis=1).astype("int64"), "_above": (scores >= floor).sum(axis=1).astype("int64")})

    counted = (
        left.groupBy("_vb", "_mb")
        .cogroup(right.groupBy("_vb", "_mb"))
        .applyInPandas(count_better, f"{key} {key_type}, _better long, _above long")
    )
    ranks = counted.groupBy(key).agg((F.sum("_better") + 1).alias("rank"), F.sum("_above").alias("candidates"))
    return own.select(key, group, "own_score").join(ranks, key)


def _block_sides(df: DataFrame, group: str, key: str, vec: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of all block pairs of each group, keyed by ``(group, _i, _j)``."""
    sizes = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    rows = df.select(group, key, F.col(vec).alias("_v")).join(sizes, group)
    own = F.pmod(F.xxhash64(key), F.col("_nb")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    left = rows.withColumns({"_i": own}).withColumn("_j", others).drop("_nb")
    right = rows.withColumns({"_j": own}).withColumn("_i", others).drop("_nb")
    # Fresh column identities: both sides come from the same rows.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left, right


def nearest_in_group(df: DataFrame, group: str, key: str, vec: str, floor: float, block: int = BLOCK_ROWS) -> DataFrame:
    """Per vector: closest other vector of its group and how many reach ``floor``.

    All pairs of a group are compared as block products spread over tasks; every
    task reports one row per vector.
    """
    key_type = dict(df.dtypes)[key]
    left, right = _block_sides(df, group, key, vec, block)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({key: [], "best_key": [], "best": [], "n_above": []})
        if a.empty or b.empty:
            return empty
        b = b.sort_values(key)
        sims = np.round(np.stack(a["_v"]) @ np.stack(b["_v"]).T, 12)
        sims[a[key].to_numpy()[:, None] == b[key].to_numpy()[None, :]] = -np.inf
        top = sims.argmax(axis=1)
        out = pd.DataFrame(
            {
                key: a[key].to_numpy(),
                "best_key": b[key].to_numpy()[top],
                "best": sims[np.arange(len(a)), top],
                "n_above": (sims >= floor).sum(axis=1).astype("int64"),
            }
        )
        return out

    schema = f"{key} {key_type}, best_key {key_type}, best double, n_above long"
    parts = left.groupBy(group, "_i", "_j").cogroup(right.groupBy(group, "_i", "_j")).applyInPandas(best, schema)
    met = F.when(F.col("best") > float("-inf"), F.col("best"))
    return parts.groupBy(key).agg(
        F.min_by("best_key", F.struct((-met).alias("s"), F.col("best_key").alias("k"))).alias("best_key"),
        F.max(met).alias("best"),
        F.sum("n_above").alias("n_above"),
    )


QUANTILES = {"median": 0.5, "p95": 0.95}
BINS = 2048


def cosine_diversity(
    df: DataFrame, group: str, key: str, vec: str, block: int = BLOCK_ROWS
) -> DataFrame:
    """Mean, median, 95th percentile and maximum of the pairwise cosines of each group.

    The percentiles are found by counting: block pairs report histograms of an interval
    around each wanted rank, narrowed until the answer is fixed to about 1e-12.  No pair
    leaves its task.
    """
    group_type = dict(df.dtypes)[group]

    from pyspark.sql import Window

    from routeloom.session import cut_lineage

    n = F.col("n")
    sums = df.select(group, F.posexplode(vec).alias("_d", "_x")).groupBy(group, "_d").agg(
        F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"), F.count(F.lit(1)).alias("n")
    )
    means = sums.groupBy(group).agg(
        ((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (F.max("n") * (F.max("n") - 1))).alias("mean"), F.max("n").alias("n")
    ).where("n > 1")
    pairs = n * (n - 1) / 2
    wanted = []
    for q in QUANTILES.values():
        at = (pairs - 1) * q
        wanted += [F.floor(at), F.ceil(at)]
    targets = cut_lineage(
        means.select(
            group,
            F.posexplode(F.array(*[w.cast("long") for w in wanted])).alias("t", "rank"),
            F.lit(-1.001).alias("lo"), F.lit(1.001).alias("hi"), F.lit(0).cast("long").alias("below"),
        )
    )
    left, right = _block_sides(df, group, key, vec, block)
    left, right = left.where("_i <= _j"), right.where("_i <= _j")
    top = None
    for step in range(4):
        packed = targets.groupBy(group).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("t", "lo", "hi"))), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))).alias("_t")
        )

        def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            cols = {group: [], "t": [], "bin": [], "cnt": [], "top": []}
            if a.empty or b.empty:
                return pd.DataFrame(cols)
            sims = np.round(np.stack(a["_v"]) @ np.stack(b["_v"]).T, 12)
            one, two = a[key].to_numpy()[:, None], b[key].to_numpy()[None, :]
            same_block = a["_i"].iloc[0] == a["_j"].iloc[0]
            sims = sims[one < two] if same_block else sims.ravel()
            if not len(sims):
                return pd.DataFrame(cols)
            frames = []
            for t, span in enumerate(a["_t"].iloc[0]):
                lo, hi = span["lo"], span["hi"]
                inside = sims[(sims >= lo) & (sims < hi)]
                at = np.minimum((inside - lo) / (hi - lo) * BINS, BINS - 1).astype("int64")
                counts = np.bincount(at, minlength=BINS)
                used = np.flatnonzero(counts)
                frames.append(pd.DataFrame({group: a[group].iloc[0], "t": t, "bin": used, "cnt": counts[used], "top": sims.max()}))
            return pd.concat(frames)

        schema = f"{group} {group_type}, t int, bin long, cnt long, top double"
        hist = left.join(packed, group).groupBy(group, "_i", "_j").cogroup(right.groupBy(group, "_i", "_j")).applyInPandas(count, schema)
        hist = cut_lineage(hist.groupBy(group, "t", "bin").agg(F.sum("cnt").alias("cnt"), F.max("top").alias("top")))
        if top is None:
            top = hist.groupBy(group).agg(F.max("top").alias("max"))
        w = Window.partitionBy(group, "t").orderBy("bin")
        placed = hist.withColumn("upto", F.sum("cnt").over(w)).join(targets, [group, "t"])
        hit = placed.where((F.col("below") + F.col("upto") > F.col("rank")) & (F.col("below") + F.col("upto") - F.col("cnt") <= F.col("rank")))
        width = (F.col("hi") - F.col("lo")) / BINS
        targets = cut_lineage(
            hit.select(
                group, "t", "rank", (F.col("lo") + width * F.col("bin")).alias("lo"), (F.col("lo") + width * (F.col("bin") + 1)).alias("hi"),
                (F.col("below") + F.col("upto") - F.col("cnt")).alias("below"),
            )
        )
    values = targets.groupBy(group).agg(
        *[F.max(F.when(F.col("t") == i, (F.col("lo") + F.col("hi")) / 2)).alias(f"v{i}") for i in range(4)]
    )
    out = means.join(values, group).join(top, group)

    def between(i: int, q: float):
        at = (pairs - 1) * q
        return F.col(f"v{i}") + (F.col(f"v{i + 1}") - F.col(f"v{i}")) * (at - F.floor(at))

    return out.select(group, "mean", between(0, 0.5).alias("median"), between(2, 0.95).alias("p95"), "max")


# -- mixtures ------------------------------------------------------------------


def _expect(x: np.ndarray, w: np.ndarray, mu: np.ndarray, var: np.ndarray):
    """One expectation pass: responsibilities folded into sums, and the log likelihood."""
    log_det = np.log(2 * np.pi * var).sum(axis=1)
    quad = (x**2) @ (1 / var).T - 2 * x @ (mu / var).T + (mu**2 / var).sum(axis=1)
    logp = np.log(w) - 0.5 * (log_det + quad)
    top = logp.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
    r = np.exp(logp - total[:, None])
    return r.sum(axis=0), r.T @ x, r.T @ (x**2), total.sum()


def _maximise(nk: np.ndarray, s1: np.ndarray, s2: np.ndarray, n: float, reg: float):
    nk = nk + 10 * np.finfo(float).eps
    mu = s1 / nk[:, None]
    return nk / nk.sum(), mu, np.maximum(s2 / nk[:, None] - mu**2, 0) + reg


def _starts(df: DataFrame, group: str, key: str, vec: str, most: int, seed: int) -> DataFrame:
    """The rows a group's components start from: fixed by a hash of the key."""
    from routeloom.operators import ordered

    tagged = df.select(group, key, F.col(vec).alias("_v"), F.xxhash64(F.lit(seed), key).alias("_h"))
    few = ordered.top_k(tagged, [group], ["_h", key], most, "_n")
    packed = F.array_sort(F.collect_list(F.struct("_n", "_v")))
    return few.groupBy(group).agg(F.transform(packed, lambda s: s["_v"]).alias("_start"))


def group_mixture(
    df: DataFrame, group: str, key: str, vec: str, ks: tuple[int, ...] = (2, 3, 4, 5, 6), max_iter: int = 50,
    reg: float = 1e-6, seed: int = 42, tol: float = 1e-3, limit: int | None = None,
) -> DataFrame:
    """All candidate diagonal mixtures of every group: ``(group, k, bic, converged, iterations, weights, means, n, fitted)``.

    Every pass runs over row blocks of all groups at once, whatever their sizes, and only
    the sums are combined; ``limit`` is accepted for older callers and has no effect.
    ``n`` is the group's row count.  A group with fewer rows than the smallest k has one
    row that is not ``fitted``: k 0, a null criterion and no components.  A null group is
    a group.
    """
    from routeloom.session import cut_lineage

    # Groups are numbered, so that a null one meets itself in joins.
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_g", F.monotonically_increasing_id())
    sizes = cut_lineage(sizes)
    ids = sizes.select(F.struct(F.col(group).alias("at")).alias("_at"), "_g", F.ceil(F.col("_rows") / MIXTURE_ROWS).alias("_blocks"))
    tagged = df.select(F.struct(F.col(group).alias("at")).alias("_at"), F.col(key).alias("_id"), F.col(vec).alias("_v"))
    rows = cut_lineage(tagged.join(ids, "_at").drop("_at"))
    starts = _starts(rows, "_g", "_id", "_v", max(ks), seed)
    fits = _mixture_by_blocks(rows, starts, "_g", "bigint", ks, max_iter, reg, tol)
    return sizes.join(fits, "_g", "left").select(
        group, F.coalesce("k", F.lit(0)).alias("k"), "bic", F.coalesce("converged", F.lit(False)).alias("converged"),
        F.coalesce("iterations", F.lit(0)).alias("iterations"), F.coalesce("weights", F.array().cast("array<double>")).alias("weights"),
        F.coalesce("means", F.array().cast("array<array<double>>")).alias("means"), F.col("_rows").alias("n"), F.col("k").isNotNull().alias("fitted"),
    )


def _mixture_by_blocks(rows, starts, group, group_type, ks, max_iter, reg, tol) -> DataFrame:
    from routeloom.session import cut_lineage

    # About MIXTURE_ROWS vectors are one row, dealt by place, so that repeated keys spread too.
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_blocks")).alias("_b")
    blocks = rows.select(group, block, F.col("_v").cast("array<double>").alias("_v")).groupBy(group, "_b")
    blocks = cut_lineage(blocks.agg(F.count("_v").alias("_m"), F.flatten(F.collect_list("_v")).alias("_x")).where("_m > 0"))
    dims = rows.select(group, F.posexplode("_v").alias("_d", "_x")).groupBy(group, "_d").agg(
        F.var_pop("_x").alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    packed = F.array_sort(F.collect_list(F.struct("_d", "_s")))
    spread = dims.groupBy(group).agg(F.transform(packed, lambda s: s["_s"]).alias("_var"), F.max("_n").alias("n"))
    one_state = "struct<k:int,n:bigint,w:array<double>,mu:array<double>,var:array<double>,last:double,converged:boolean,iterations:int>"
    flat = "array<double>"
    begun = F.transform(
        F.filter(F.array(*[F.lit(x) for x in ks]), lambda k: k <= F.col("n")),
        lambda k: F.struct(
            k.alias("k"), F.col("n").cast("bigint").alias("n"), F.transform(F.sequence(F.lit(1), k), lambda _: F.lit(1.0) / k).alias("w"),
            F.flatten(F.slice("_start", F.lit(1), k)).cast(flat).alias("mu"),
            F.flatten(F.transform(F.sequence(F.lit(1), k), lambda _: F.transform("_var", lambda s: s + reg))).alias("var"),
            F.lit(float("-inf")).alias("last"), F.lit(False).alias("converged"), F.lit(0).alias("iterations"),
        ),
    )
    state = starts.join(spread, group).select(group, begun.cast(f"array<{one_state}>").alias("_state")).where(F.size("_state") > 0)
    fields = ["k", "n", "w", "mu", "var", "last", "converged", "iterations"]
    part_schema = f"{group} {group_type}, k int, n bigint, w {flat}, mu {flat}, var {flat}, last double, converged boolean, iterations int, total {flat}"

    def step(states: DataFrame, last_pass: bool) -> DataFrame:
        """One pass: a block's sums leave it as one array per (group, k), with the state they belong to, and are added in one shuffle."""

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept: dict = {}
            for pdf in batches:
                for g, m, flat_rows, fits in zip(pdf[group], pdf["_m"], pdf["_x"], pdf["_state"]):
                    x = np.reshape(flat_rows, (m, -1))
                    for s in fits:
                        total = np.zeros(0)
                        if last_pass or not s["converged"]:
                            shape = (s["k"], x.shape[1])
                            nk, s1, s2, ll = _expect(x, np.asarray(s["w"]), np.reshape(s["mu"], shape), np.reshape(s["var"], shape))
                            total = np.concatenate([[ll], nk, s1.ravel(), s2.ravel()])
                        if (g, s["k"]) in kept:
                            kept[g, s["k"]][1] += total
                        else:
                            kept[g, s["k"]] = [s, total]
                if len(kept) > 2000:
                    yield rows_of(kept)
                    kept = {}
            if kept:
                yield rows_of(kept)

        def rows_of(kept: dict) -> pd.DataFrame:
            made = [(g, *[s[f] for f in fields], total) for (g, _), (s, total) in kept.items()]
            return pd.DataFrame(made, columns=[group, *fields, "total"])

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, held = None, {}
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    if held and row[group] != now:
                        out.append((now, [end(s, t) for s, t in held.values()]))
                        held = {}
                    now = row[group]
                    if row["k"] in held:
                        held[row["k"]][1] += row["total"]
                    else:
                        held[row["k"]] = [row, np.array(row["total"], float)]
                if out:
                    yield pd.DataFrame(out, columns=[group, "_state"])
            if held:
                yield pd.DataFrame([(now, [end(s, t) for s, t in held.values()])], columns=[group, "_state"])

        def end(s: dict, total: np.ndarray) -> dict:
            kk, n = int(s["k"]), int(s["n"])
            new = {f: s[f] for f in fields} | {"w": list(s["w"]), "mu": list(s["mu"]), "var": list(s["var"])}
            if last_pass:
                return new | {"last": float(total[0])}
            if s["converged"]:
                return new
            d = (len(total) - 1 - kk) // (2 * kk)
            ll, nk = total[0], total[1 : 1 + kk]
            s1 = total[1 + kk : 1 + kk + kk * d].reshape(kk, d)
            s2 = total[1 + kk + kk * d :].reshape(kk, d)
            new["iterations"] += 1
            if abs(ll / n - s["last"]) < tol:
                return new | {"converged": True}
            w, mu, var = _maximise(nk, s1, s2, n, reg)
            return new | {"last": float(ll / n), "w": w.tolist(), "mu": mu.ravel().tolist(), "var": var.ravel().tolist()}

        sums = blocks.join(states, group).mapInPandas(partial, part_schema)
        dealt = sums.repartition(group).sortWithinPartitions(group, "k")
        return dealt.mapInPandas(fold, f"{group} {group_type}, _state array<{one_state}>")

    state = cut_lineage(state)
    for done in range(0, max_iter, PASSES):
        for _ in range(min(PASSES, max_iter - done)):
            state = step(state, False)
        state = cut_lineage(state)
        if state.where(F.exists("_state", lambda s: ~s["converged"])).isEmpty():
            break
    final = step(state, True).select(group, F.inline("_state"))
    d = F.size("mu") / F.col("k")
    bic = -2 * F.col("last") + (2 * F.col("k") * d + F.col("k") - 1) * F.log(F.col("n"))
    width = d.cast("int")
    means = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda c: F.slice("mu", c * width + 1, width))
    return final.select(group, "k", bic.alias("bic"), "converged", "iterations", F.col("w").alias("weights"), means.alias("means"))


def bic_select(fits: DataFrame, group: str) -> DataFrame:
    """Fit with the smallest criterion per group; ties go to fewer components, an unfit group keeps its one row."""
    from routeloom.operators import ordered

    return ordered.top_k(fits, [group], ["bic", "k"], 1, "_n").drop("_n")


def mixture_summary(chosen: DataFrame, rows: int, dims: int) -> DataFrame:
    """Per chosen component count: groups, converged ones, components per row, the best criterion and the dimensions."""
    per = chosen.groupBy("k").agg(F.count(F.lit(1)).alias("groups"), F.count_if("converged").alias("converged"), F.round(F.min("bic"), 6).alias("best"))
    share = F.round(F.col("k") * F.col("groups") / rows, 6)
    return per.select("k", "groups", "converged", share.alias("components_per_row"), "best", F.lit(dims).alias("dimensions"))


def unit_means(chosen: DataFrame, group: str) -> DataFrame:
    """One row per component with its unit mean."""
    rows = chosen.select(group, F.posexplode("means").alias("component", "_m"))
    return rows.select(group, "component", vx.l2_normalize(F.col("_m")).alias("mean"))


def distinct_medoids(df: DataFrame, means: DataFrame, group: str, key: str, vec: str, most: int = 6) -> DataFrame:
    """Per component, in order, the closest vector not taken by an earlier component.

    At most ``components - 1`` vectors can be taken before, so the closest
    ``most`` vectors per component are enough; only those few rows form a group.
    """
    from routeloom.operators import ordered

    scored = df.join(means, group).select(
        group, "component", key, F.round(vx.dot_product(F.col(vec), F.col("mean")), 12).alias("cosine")
    )
    near = ordered.top_k(scored, [group, "component"], [F.desc("cosine"), key], most, "_n")
    types = dict(df.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        out = []
        for component, part in pdf.sort_values(["component", "_n"]).groupby("component"):
            free = part[~part[key].isin(taken)]
            row = (free if len(free) else part).iloc[0]
            taken.add(row[key])
            out.append((row[group], component, row[key], row["cosine"]))
        return pd.DataFrame(out, columns=[group, "component", key, "cosine"])

    return near.groupBy(group).applyInPandas(pick, f"{group} {types[group]}, component int, {key} {types[key]}, cosine double")


def hashed_text(text: str | None, dims: int) -> np.ndarray:
    """Signed counts of the 1 to 3 character pieces of a text's words, by hash; zeros where there is no letter or digit."""
    out = np.zeros(dims)
    words = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text or "").casefold())
    for word in words:
        marked = f"\x02{word}\x03"
        for size in (1, 2, 3):
            for at in range(len(marked) - size + 1):
                h = zlib.crc32(marked[at : at + size].encode())
                out[h % dims] += 1.0 if h & 0x80000000 else -1.0
    return out


def embed_texts(
    df: DataFrame, text: str, out: str = "embedding", encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    instruction: str = "", batch: int = 32, dims: int = 256,
) -> DataFrame:
    """Unit text vectors (``array<float>``) in column ``out`` and their state in ``<out>_state``.

    ``encoder`` is a factory called once per Python worker; it returns a function from a list
    of texts to a matrix.  Without one, character pieces are counted by signed hashes, which
    works for any script.  A null or blank text, and one whose vector is zero or not finite,
    has a null vector and the state ``blank`` or ``no_direction``; others are ``ok``.
    """
    from pyspark.sql import types as T

    state = f"{out}_state"
    kept = [f for f in df.schema if f.name not in (out, state)]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.FloatType())), T.StructField(state, T.StringType())])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = encoder() if encoder else lambda texts: np.stack([hashed_text(t, dims) for t in texts])
        for pdf in batches:
            vectors: list = [None] * len(pdf)
            states = ["blank"] * len(pdf)
            filled = [n for n, t in enumerate(pdf[text]) if t is not None and t.strip()]
            for at in range(0, len(filled), batch):
                some = filled[at : at + batch]
                m = np.asarray(run([instruction + pdf[text].iloc[n] for n in some]), dtype="float64")
                length = np.sqrt((m**2).sum(axis=1))
                for n, row, size in zip(some, m, length):
                    states[n] = "ok" if np.isfinite(size) and size > 0 else "no_direction"
                    if states[n] == "ok":
                        vectors[n] = (row / size).astype("float32")
            yield pdf[[f.name for f in kept]].assign(**{out: vectors, state: states})

    return df.mapInPandas(encode, schema)
