"""Exact, reproducible train/eval split.

The reference shuffles and takes ``int(split * n)`` rows, twice and
independently, so train and eval overlap.  Here the random order is
``(md5(seed || '|' || key), key)``: a pure function of the row key, unchanged
by re-partitioning, retries or lost executors.

Finding the cut without a global sort
-------------------------------------
1. One pass: counts per leading-hex-digit bucket of the hash (a partial hash
   aggregate; at most 16^4 = 65,536 rows reach the driver).  ``n`` is their sum.
2. The bucket holding rank ``k`` is found on the driver from cumulative counts.
   If it still holds more than ``LOCAL_MAX`` rows it is refined by the next
   digits (the same aggregate restricted to that bucket), until small.
3. The ``r``-th smallest (hash, key) inside that bucket is read with a bounded
   top-r (``TakeOrderedAndProject`` over at most ``LOCAL_MAX`` rows).
4. The split itself is a narrow comparison of every row's (hash, key) with
   that threshold: no shuffle, no window, no row count per partition.
5. Where the key at the cut stands on several rows and the cut falls among them,
   those rows alone are numbered across the cluster, and the first so many are
   inside: the sizes are exact on any multiset of keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefline.config import SplitConfig
from prefline.functions.text import hash_key
from prefline.session import reliable_checkpoint

DIGITS_PER_LEVEL = 4
LOCAL_MAX = 200_000


@dataclass(frozen=True)
class Cut:
    n: int
    k: int
    threshold: tuple[str, object] | None  # (hash, key) of the k-th row, None if k in (0, n)
    inside: int | None = None  # rows of that key that are inside; None: all of them


def train_count(fraction: float, n: int) -> int:
    """L2: ``int(split * n)``, the same double rounding as the reference."""
    return int(fraction * n)


def _histogram(df: DataFrame, h: Column, prefix_len: int, restrict: str | None = None) -> list:
    scope = df.where(h.isNotNull()) if restrict is None \
        else df.where(F.substring(h, 1, len(restrict)) == F.lit(restrict))
    return (scope.groupBy(F.substring(h, 1, prefix_len).alias("b")).agg(F.count("*").alias("c"))
            .orderBy("b").collect())


def _histograms(df: DataFrame, hs: list[Column]) -> list[list]:
    """First-level histograms of several hash orders in one pass (grouping sets)."""
    if len(hs) == 1:
        return [_histogram(df, hs[0], DIGITS_PER_LEVEL)]
    names = [f"_b{i}" for i in range(len(hs))]
    buckets = df.select(*[F.substring(h, 1, DIGITS_PER_LEVEL).alias(n) for h, n in zip(hs, names)])
    rows = (buckets.groupingSets([[n] for n in names], *names)
            .agg(F.count("*").alias("c"), F.grouping_id().alias("_g")).collect())
    out = []
    full = (1 << len(names)) - 1
    for i, n in enumerate(names):
        gid = full ^ (1 << (len(names) - 1 - i))   # every column but n is grouped away
        out.append(sorted(({"b": r[n], "c": r["c"]} for r in rows if r["_g"] == gid and r[n] is not None),
                          key=lambda r: r["b"]))
    return out


def _locate(df: DataFrame, h: Column, k: int, hist: list) -> tuple[str, int, int]:
    """(bucket prefix, prefix length, rank inside it) of the k-th smallest row,
    refining the bucket by more hex digits while it holds more than LOCAL_MAX rows."""
    prefix_len, before = DIGITS_PER_LEVEL, 0
    while True:
        cum = before
        for row in hist:
            if cum + row["c"] >= k:
                bucket, count = row["b"], row["c"]
                break
            cum += row["c"]
        if count <= LOCAL_MAX or prefix_len >= 32:
            return bucket, prefix_len, k - cum
        before = cum
        prefix_len = min(32, prefix_len + DIGITS_PER_LEVEL)
        hist = _histogram(df, h, prefix_len, bucket)


def _thresholds(df: DataFrame, key: str, targets: list) -> list[tuple[str, object]]:
    """(hash, key) of the r-th row inside each located bucket, all in one job:
    a union of bounded probes (each a top-r of at most LOCAL_MAX rows, then its last row)."""
    probes = None
    for i, (h, bucket, prefix_len, r) in enumerate(targets):
        inner = df.where(F.substring(h, 1, prefix_len) == F.lit(bucket)) \
            .select(F.lit(i).alias("_i"), h.alias("_h"), F.col(key).alias("_k"))
        # a whole hash is one key, however many rows it stands on: any of them will do
        last = inner.limit(1) if prefix_len >= 32 else \
            inner.orderBy("_h", "_k").limit(r).orderBy(F.desc("_h"), F.desc("_k")).limit(1)
        probes = last if probes is None else probes.unionByName(last)
    rows = {r["_i"]: (r["_h"], r["_k"]) for r in probes.collect()}
    return [rows[i] for i in range(len(targets))]


def _cuts(df: DataFrame, key: str, orders: list) -> list[Cut]:
    """Cuts for several (seed, k_of_n, histogram) orders; thresholds read in one job."""
    cuts, targets, slots = [], [], []
    for seed, k_of_n, hist in orders:
        n = sum(r["c"] for r in hist)
        k = k_of_n(n)
        cuts.append(Cut(n, k, None))
        if 0 < k < n:
            h = hash_key(seed, F.col(key))
            targets.append((h, *_locate(df, h, k, hist)))
            slots.append(len(cuts) - 1)
    if targets:
        found = _thresholds(df, key, targets)
        for slot, thr, inside in zip(slots, found, _inside(df, key, targets, found)):
            cuts[slot] = Cut(cuts[slot].n, cuts[slot].k, thr, inside)
    return cuts


def _inside(df: DataFrame, key: str, targets: list, found: list) -> list[int | None]:
    """For each located cut, how many rows of its key are inside, or None for all of them.
    One job; it counts in the located buckets only."""
    sums, scope = [], None
    for i, ((h, bucket, prefix_len, _), (th, tk)) in enumerate(zip(targets, found)):
        here = F.substring(h, 1, prefix_len) == F.lit(bucket)
        scope = here if scope is None else scope | here
        same = here & (h == F.lit(th)) & (F.col(key) == F.lit(tk))
        before = here & ((h < F.lit(th)) | ((h == F.lit(th)) & (F.col(key) < F.lit(tk))))
        sums += [F.count(F.when(before, 1)).alias(f"b{i}"), F.count(F.when(same, 1)).alias(f"s{i}")]
    counts = df.where(scope).agg(*sums).first()
    left = [t[3] - counts[f"b{i}"] for i, t in enumerate(targets)]
    return [r if r < counts[f"s{i}"] else None for i, r in enumerate(left)]


TIE = "__place"


def with_places(df: DataFrame, key: str, cuts: list[Cut]) -> DataFrame:
    """Add ``TIE``: the place of a row among those of its key (from 1), where a cut falls
    among the rows of that key; null elsewhere.  Only these rows are sorted."""
    keys = sorted({c.threshold[1] for c in cuts if c.inside is not None})
    if not keys:
        return df.withColumn(TIE, F.lit(None).cast("bigint"))
    from prefline.operators.tokens import dense_order_ids

    torn = F.coalesce(F.col(key).isin(keys), F.lit(False))
    order = [key] + [F.xxhash64(*[c for c in df.columns if c != key])] if len(df.columns) > 1 else [key]
    numbered = dense_order_ids(df.where(torn), order, 1, TIE)
    # at most one row for each cut
    first = numbered.groupBy(F.col(key).alias("_of")).agg(F.min(TIE).alias("_first"))
    placed = numbered.join(F.broadcast(first), F.col(key) == F.col("_of")).withColumn(TIE, F.col(TIE) - F.col("_first") + 1)
    return df.where(~torn).withColumn(TIE, F.lit(None).cast("bigint")).unionByName(placed.drop("_of", "_first"))


def find_cut(df: DataFrame, key: str, k_of_n, seed, hist: list | None = None) -> Cut:
    """Cut after the first ``k_of_n(n)`` rows in (md5(seed|key), key) order."""
    if hist is None:
        hist = _histogram(df, hash_key(seed, F.col(key)), DIGITS_PER_LEVEL)
    return _cuts(df, key, [(seed, k_of_n, hist)])[0]


def within(key_col: Column, seed, cut: Cut) -> Column:
    """True for rows among the first ``cut.k`` in (hash, key) order; false for a null key."""
    if cut.threshold is None:
        return key_col.isNotNull() & F.lit(cut.k >= cut.n)
    h = hash_key(seed, key_col)
    th, tk = cut.threshold
    last = key_col <= F.lit(tk)
    if cut.inside is not None:  # the frame then comes from ``with_places``
        last = (key_col < F.lit(tk)) | ((key_col == F.lit(tk)) & (F.col(TIE) <= F.lit(cut.inside)))
    return F.coalesce((h < F.lit(th)) | ((h == F.lit(th)) & last), F.lit(False))


def _has_exchange(df: DataFrame) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def key_set(df: DataFrame, key: str, materialize: bool | None = None) -> DataFrame:
    """The key column the cut search scans several times.

    When the input is expensive to recompute (its plan shuffles), the keys
    alone are written once with a reliable ``checkpoint`` to the shared
    checkpoint folder: later passes read that, and a lost executor does not
    re-run the upstream shuffle.  Plain scans are read directly.
    """
    keys = df.select(key)
    if materialize is None:
        materialize = _has_exchange(keys)
    return reliable_checkpoint(keys) if materialize else keys


def split_cuts(df: DataFrame, key: str, cfg: SplitConfig, materialize: bool | None = None):
    """(keys, train cut, eval seed, eval cut or None) for ``cfg``."""
    keys = key_set(df, key, materialize)
    if cfg.mode == "disjoint":
        return keys, find_cut(keys, key, lambda n: train_count(cfg.fraction, n), cfg.seed), None, None
    eval_seed = cfg.eval_seed if cfg.eval_seed is not None else cfg.seed + 1
    # both orders' histograms in one pass over the keys, both thresholds in one more
    h_train, h_eval = _histograms(keys, [hash_key(cfg.seed, F.col(key)), hash_key(eval_seed, F.col(key))])
    train_cut, eval_cut = _cuts(keys, key, [(cfg.seed, lambda n: train_count(cfg.fraction, n), h_train),
                                            (eval_seed, lambda n: n - train_count(cfg.fraction, n), h_eval)])
    return keys, train_cut, eval_seed, eval_cut


def split_flags(df: DataFrame, key: str, cfg: SplitConfig = SplitConfig(),
                materialize: bool | None = None) -> DataFrame:
    """Adds ``in_train`` and ``in_eval``.

    disjoint: eval is the complement of train.  Rows with a null key belong to
    neither part and are not counted in ``n``.
    independent (reference behaviour): train = first k by ``seed``, eval = first
    n - k by ``eval_seed`` (default seed + 1), chosen independently.
    A frame holding only the key column is answered from the materialised keys.
    """
    keys, train_cut, eval_seed, eval_cut = split_cuts(df, key, cfg, materialize)
    base = with_places(keys if df.columns == [key] else df, key, [c for c in (train_cut, eval_cut) if c])
    in_train = within(F.col(key), cfg.seed, train_cut)
    in_eval = F.col(key).isNotNull() & ~in_train if eval_cut is None else within(F.col(key), eval_seed, eval_cut)
    return base.withColumn("in_train", in_train).withColumn("in_eval", in_eval).drop(TIE)


def split_audit(df: DataFrame, key: str, fraction: float = 0.8, seed=42, eval_seed=None,
                materialize: bool | None = None) -> DataFrame:
    """E7 for both modes in one pass: rows (mode, n_eval, n_leak).

    The train cut is shared by both modes; the disjoint eval set is its
    complement, the independent one has its own cut.  Both flags sit on the
    same row, so counting the overlap needs no join.
    """
    cfg = SplitConfig(fraction=fraction, seed=seed, mode="independent", eval_seed=eval_seed)
    keys, train_cut, eseed, eval_cut = split_cuts(df, key, cfg, materialize)
    t = within(F.col(key), seed, train_cut)
    e = within(F.col(key), eseed, eval_cut)
    one = F.lit(1)
    row = with_places(keys, key, [train_cut, eval_cut]).agg(F.count(F.when(F.col(key).isNotNull() & ~t, one)).alias("d_eval"),
                   F.count(F.when(e, one)).alias("i_eval"),
                   F.count(F.when(e & t, one)).alias("i_leak"))
    return row.select(F.inline(F.array(
        F.struct(F.lit("disjoint").alias("mode"), F.col("d_eval").alias("n_eval"), F.lit(0).cast("long").alias("n_leak")),
        F.struct(F.lit("independent").alias("mode"), F.col("i_eval").alias("n_eval"), F.col("i_leak").alias("n_leak")))))


def split_parts(df: DataFrame, key: str, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """One row per (row, part) with ``part`` in {'train', 'eval'}; in independent
    mode a row may appear in both parts, as in the reference."""
    flagged = split_flags(df, key, cfg)
    parts = F.filter(F.array(F.when(F.col("in_train"), F.lit("train")),
                             F.when(F.col("in_eval"), F.lit("eval"))), lambda p: p.isNotNull())
    cols = [c for c in df.columns]
    return flagged.select(*cols, F.explode(parts).alias("part"))


def train_eval(df: DataFrame, key: str, cfg: SplitConfig = SplitConfig()) -> tuple[DataFrame, DataFrame]:
    flagged = split_flags(df, key, cfg)
    return (flagged.where("in_train").drop("in_train", "in_eval"),
            flagged.where("in_eval").drop("in_train", "in_eval"))


def leak_audit(train: DataFrame, eval_: DataFrame, key: str) -> DataFrame:
    """E7 for two arbitrary frames: one row (n_eval, n_leak), leak = eval rows whose
    key is also in train (a left-semi join; Spark picks broadcast or shuffle by size)."""
    leaked = eval_.select(key).join(train.select(key), key, "left_semi")
    return eval_.agg(F.count("*").alias("n_eval")) \
        .select("n_eval", leaked.agg(F.count("*")).scalar().alias("n_leak"))
