"""Label-structure metrics: separation, neighbours, silhouette, ARI, NMI, k-means.

Frames carry ``id``, ``v`` and label columns; labels are compared as text, a null
being the class ``None``. ``group`` columns run a metric inside every group at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions.text import label_or_none
from vitrina.functions.vectors import EPSILON, l2_normalize, norm
from vitrina.operators.similarity import Block, against, as_matrix, bounded_knn, knn_join
from vitrina.session import materialize, spread

KS = (1, 5, 10)
# Pairs drawn per label by the sampled form of the metric; here its weight.
PAIRS_PER_LABEL = 300
RESTARTS = 10
SEED = 42
# k-means: passes at most, the movement of a coordinate that counts as none, and the numbers of all centres of a pass.
TURNS = 20
TOLERANCE = 1e-4
CENTRE_VALUES = 1 << 24


def label_cardinality(df: DataFrame, label: Column | str) -> DataFrame:
    rows = df.where(F.col("v").isNotNull()).select(label_or_none(label).alias("label"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("samples"), F.count("*").alias("unique_labels"))


def label_sums(df: DataFrame, label: Column | str, *groups: str) -> DataFrame:
    """(groups, label, n, s, sq): sum of unit vectors and of their squared lengths.

    One aggregation with partial sums on the map side, whatever the label sizes.
    """
    rows = df.where(F.col("v").isNotNull()).select(
        *groups, label_or_none(label).alias("label"), "v", norm("v").alias("__norm")
    ).withColumn("__w", F.lit(1.0) / (F.col("__norm") + EPSILON))
    return rows.groupBy(*groups, "label").agg(
        F.count("*").alias("n"),
        vector_to_array(Summarizer.sum(array_to_vector("v"), F.col("__w"))).alias("s"),
        F.sum(F.pow(F.col("__norm") * F.col("__w"), 2)).alias("sq"),
    )


def filter_separation(df: DataFrame, label: Column | str) -> DataFrame:
    """Mean cosine inside labels minus mean cosine across labels, one row.

    Exact expected values of the pair samples the metric is usually taken from:
    inside, labels count by min(300, pairs); across, two labels are drawn with
    equal chance and then one row of each. Fewer than three rows give no row.
    """
    sums = label_sums(df, label)
    square = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x * x)
    n = F.col("n").cast("double")
    per_label = sums.withColumn("__ss", square).select(
        n.alias("n"), "__ss",
        F.when(F.col("n") > 1, (F.col("__ss") - F.col("sq")) / (n * (n - 1))).alias("__intra"),
        F.when(F.col("n") > 1, F.least(F.lit(float(PAIRS_PER_LABEL)), n * (n - 1) / 2)).alias("__weight"),
        "s",
    )
    total = per_label.agg(
        F.sum("n").alias("rows"),
        F.count("*").cast("double").alias("labels"),
        F.try_divide(F.sum(F.col("__intra") * F.col("__weight")), F.sum("__weight")).alias("intra_mean"),
        F.sum(F.col("__ss") / (F.col("n") * F.col("n"))).alias("__cc"),
        vector_to_array(Summarizer.sum(array_to_vector("s"), 1.0 / F.col("n"))).alias("__c"),
    ).where(F.col("rows") >= 3)
    across = F.try_divide(
        F.aggregate("__c", F.lit(0.0), lambda acc, x: acc + x * x) - F.col("__cc"),
        F.col("labels") * (F.col("labels") - 1),
    )
    return total.select("intra_mean", across.alias("inter_mean")).withColumn("separation", F.col("intra_mean") - F.col("inter_mean"))


def neighbour_metrics(ranked: DataFrame, ks: tuple[int, ...] = KS, groups: list[str] = ()) -> DataFrame:
    """1-NN accuracy and label consistency from ranked neighbours with ``same``.

    All rows of a group have the same number of neighbours, so the mean of the
    row-wise shares is one average over neighbours.
    """
    same = F.col("same").cast("double")
    return ranked.groupBy(*groups).agg(
        F.avg(F.when(F.col("rank") == 1, same)).alias("knn_1_acc"),
        *[F.avg(F.when(F.col("rank") <= k, same)).alias(f"label_consistency_{k}") for k in ks],
    )


def enough(df: DataFrame, label: Column) -> bool:
    """Whether neighbour metrics mean anything: three vectors or more, and two labels."""
    seen = df.where(F.col("v").isNotNull()).agg(F.count("*").alias("n"), F.min(label).alias("low"), F.max(label).alias("high")).first()
    return seen.n >= 3 and seen.low != seen.high


def nearest_metrics(df: DataFrame, label: Column | str, ks: tuple[int, ...] = KS) -> DataFrame:
    """1-NN accuracy and label consistency of a whole table; no row for too few vectors or labels."""
    label = label_or_none(label)
    if not enough(df, label):
        df = df.limit(0)
    found = neighbour_metrics(bounded_knn(df, max(ks, default=1), label), ks)
    return found.where(F.col("knn_1_acc").isNotNull())


def knn1_accuracy(df: DataFrame, label: Column | str) -> DataFrame:
    return nearest_metrics(df, label, ()).select("knn_1_acc")


def label_consistency(df: DataFrame, label: Column | str, ks: tuple[int, ...] = KS) -> DataFrame:
    return nearest_metrics(df, label, ks).drop("knn_1_acc")


def silhouette(df: DataFrame, label: Column | str, group: Column | str | None = None) -> DataFrame:
    """Mean cosine silhouette (per group): (group, silhouette, rows, labels).

    A row's mean distance to a label needs only the label's vector sum, so rows
    meet label sums instead of rows. Null unless 2 <= labels <= rows - 1.
    """
    pool = F.lit("") if group is None else label_or_none(group)
    rows = df.where(F.col("v").isNotNull()).select("id", "v", label_or_none(label).alias("label"), pool.alias("pool"))
    sums = label_sums(rows, "label", "pool")
    sizes = sums.groupBy("pool").agg(F.sum("n").alias("rows"), F.count("*").alias("labels"))
    centres = sums.select(F.xxhash64("pool", "label").alias("id"), F.col("s").alias("v"), "label", "n", "pool")
    schema = "id long, pool string, own double, n_own long, self double, other double"

    def kernel(a: Block, c: Block) -> pa.Table:
        totals = a.units @ as_matrix(c.table.column("v"), len(c.ids)).T
        counts = c.column("n")
        names = {name: j for j, name in enumerate(c.column("label"))}
        mine = np.array([names.get(x, -1) for x in a.column("label")])
        here = mine >= 0
        means = totals / counts
        means[here, mine[here]] = -np.inf
        best = means.max(axis=1)
        own = np.where(here, totals[np.arange(len(mine)), mine], np.nan)
        n_own = np.where(here, counts[mine], 0)
        return pa.table({
            "id": a.ids, "pool": a.table.column("pool"),
            "own": pa.array(own, from_pandas=True), "n_own": n_own.astype(np.int64),
            "self": (a.units * a.units).sum(axis=1),
            "other": pa.array(np.where(np.isfinite(best), best, np.nan), from_pandas=True),
        })

    part = against(rows, centres, kernel, schema, pooled=True)
    row = part.groupBy("pool", "id").agg(
        F.max("own").alias("own"), F.max("n_own").alias("n_own"), F.max("self").alias("self"),
        F.max("other").alias("other"),
    )
    a = 1 - F.try_divide(F.col("own") - F.col("self"), F.col("n_own") - 1)
    b = 1 - F.col("other")
    value = F.when(F.col("n_own") == 1, F.lit(0.0)).otherwise(
        F.when(F.greatest("a", "b") == 0, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    )
    scored = row.select("pool", "n_own", a.alias("a"), b.alias("b")).select("pool", value.alias("s"))
    mean = scored.groupBy("pool").agg(F.avg("s").alias("s"))
    if group is None:
        size = sizes.select(F.struct("rows", "labels").alias("z")).scalar()
        out = mean.withColumn("z", size).select("pool", "s", "z.*")
    else:
        out = mean.join(sizes, "pool")
    out = out.select(
        F.col("pool").alias("group"),
        F.when((F.col("labels") >= 2) & (F.col("labels") <= F.col("rows") - 1), F.col("s")).alias("silhouette"),
        "rows", "labels",
    )
    return out.drop("group") if group is None else out


def cluster_agreement(
    df: DataFrame, label: Column | str, cluster: Column | str, group: Column | str | None = None
) -> DataFrame:
    """ARI and NMI (arithmetic mean) of two labelings, per group.

    Both need only sums of f(n) over the cells, rows and columns of the
    contingency table, so the margins are never joined back to the cells.
    """
    cells = df.groupBy(
        (F.lit("") if group is None else label_or_none(group)).alias("group"),
        label_or_none(label).alias("label"), label_or_none(cluster).alias("cluster"),
    ).agg(F.count("*").alias("n"))
    out = agreement_of_cells(cells)
    return out.drop("group") if group is None else out


def agreement_of_cells(cells: DataFrame) -> DataFrame:
    """(group, ari, nmi) of contingency cells (group, label, cluster, n)."""
    long = cells.select("group", "n", F.explode(F.array(
        F.struct(F.lit("cell").alias("kind"), F.col("label").alias("l"), F.col("cluster").alias("c")),
        F.struct(F.lit("label").alias("kind"), F.col("label").alias("l"), F.lit(None).cast("string").alias("c")),
        F.struct(F.lit("cluster").alias("kind"), F.lit(None).cast("string").alias("l"), F.col("cluster").alias("c")),
    )).alias("x"))
    margins = long.groupBy("group", "x.kind", "x.l", "x.c").agg(F.sum("n").cast("double").alias("n"))

    def total(kind: str, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    n = F.col("n")
    pairs, entropy = n * (n - 1) / 2, n * F.log("n")
    sums = margins.groupBy("group").agg(
        total("label", n).alias("N"),
        F.count(F.when(F.col("kind") == "label", 1)).alias("n_labels"),
        F.count(F.when(F.col("kind") == "cluster", 1)).alias("n_clusters"),
        *[total(k, pairs).alias(f"p_{k}") for k in ("cell", "label", "cluster")],
        *[total(k, entropy).alias(f"e_{k}") for k in ("cell", "label", "cluster")],
    )
    N = F.col("N")
    expected = F.try_divide(F.col("p_label") * F.col("p_cluster"), N * (N - 1) / 2)
    ceiling = (F.col("p_label") + F.col("p_cluster")) / 2
    mutual = F.log(N) + (F.col("e_cell") - F.col("e_label") - F.col("e_cluster")) / N
    h_label, h_cluster = F.log(N) - F.col("e_label") / N, F.log(N) - F.col("e_cluster") / N
    return sums.select(
        "group",
        F.when((F.col("p_cell") == F.col("p_label")) & (F.col("p_cell") == F.col("p_cluster")), F.lit(1.0))
        .otherwise(F.try_divide(F.col("p_cell") - expected, ceiling - expected)).alias("ari"),
        F.when((F.col("n_labels") == 1) & (F.col("n_clusters") == 1), F.lit(1.0))
        .when(mutual <= 1e-15, F.lit(0.0))
        .otherwise(F.try_divide(mutual, (h_label + h_cluster) / 2)).alias("nmi"),
    )


def agreement_by_grain(df: DataFrame, label: Column | str, cluster: Column | str, group: Column | str) -> DataFrame:
    """(grain, group, ari, nmi, samples, unique_labels) of the whole table and of every group.

    Both grains come from one scan: the contingency cells are counted once by group, and
    grouping sets over the cells add them up for the whole table, whose group is null.
    """
    cells = df.groupBy(
        label_or_none(group).alias("group"), label_or_none(label).alias("label"), label_or_none(cluster).alias("cluster")
    ).agg(F.count("*").alias("n"))
    name, l, c = F.col("group"), F.col("label"), F.col("cluster")
    both = cells.groupingSets([[name, l, c], [l, c]], name, l, c).agg(F.sum("n").alias("n"), F.grouping("group").alias("whole"))
    # Cells of both grains, with a name that no group has for the whole table.
    named = both.select(F.when(F.col("whole") == 1, F.lit("*")).otherwise(F.concat(F.lit("="), "group")).alias("grain"), "label", "cluster", "n")
    found = agreement_of_cells(named.withColumnRenamed("grain", "group"))
    sizes = named.groupBy("grain").agg(F.sum("n").alias("samples"), F.count_distinct("label").alias("unique_labels"))
    return found.withColumnRenamed("group", "grain").join(sizes, "grain").select(
        F.when(F.col("grain") == "*", "overall").otherwise("group").alias("grain"),
        F.when(F.col("grain") != "*", F.expr("substring(grain, 2)")).alias("group"), "ari", "nmi", "samples", "unique_labels",
    )


def ari(df: DataFrame, label: Column | str, cluster: Column | str) -> DataFrame:
    return cluster_agreement(df, label, cluster).select("ari")


def nmi(df: DataFrame, label: Column | str, cluster: Column | str) -> DataFrame:
    return cluster_agreement(df, label, cluster).select("nmi")


def _seeds(prepared: DataFrame, sizes: DataFrame, n_init: int, seed: int) -> DataFrame:
    """(group, restart, centres): first centres of every restart, chosen far apart in a sample of each group.

    A group's sample has some twelve rows for each centre, by hashes of their ids.
    """
    chance = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 32)) + 0.5) / float(1 << 32)
    # One row per group.
    sample = prepared.join(F.broadcast(sizes), "group").where(chance * F.col("rows") <= 12 * F.col("labels") + 384)

    def choose(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        points, k = as_matrix(table.column("v"), table.num_rows)[order], table.column("labels")[0].as_py()
        found = []
        for restart in range(n_init):
            rng = np.random.default_rng([seed, restart])
            chosen = [int(rng.integers(len(points)))]
            gap = ((points - points[chosen[0]]) ** 2).sum(axis=1)
            while len(chosen) < k:
                # The best of a few draws by squared distance to the nearest centre.
                total = gap.sum()
                draws = rng.choice(len(points), 2 + int(np.log(k)), p=gap / total if total > 0 else None)
                gaps = np.minimum(gap[None, :], ((points[None, :, :] - points[draws][:, None, :]) ** 2).sum(axis=2))
                best = int(gaps.sum(axis=1).argmin())
                chosen.append(int(draws[best]))
                gap = gaps[best]
            found.append(points[chosen].ravel().tolist())
        group = [table.column("group")[0].as_py()] * n_init
        return pa.table({
            "group": pa.array(group, pa.string()), "restart": pa.array(range(n_init), pa.int32()),
            "centres": pa.array(found, pa.list_(pa.float64())),
        })

    return sample.groupBy("group").applyInArrow(choose, "group string, restart int, centres array<double>")


def _moved(prepared: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """(group, restart, cluster, n, cost, s): rows, squared distances and sums by nearest centre, all groups and restarts in one pass."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {g: np.zeros((c.shape[0], c.shape[1], c.shape[2] + 2)) for g, c in centres.items()}
        for batch in batches:
            names = batch.column("group").to_numpy(zero_copy_only=False)
            points = as_matrix(pa.chunked_array([batch.column("v")]), batch.num_rows)
            for g in set(names) & set(centres):
                x, c = points[names == g], centres[g]
                # Columns: the vector, its count, its squared distance.
                wide = np.concatenate([x, np.ones((len(x), 1)), (x * x).sum(axis=1)[:, None]], axis=1)
                for restart in range(len(c)):
                    distance = (c[restart] ** 2).sum(axis=1)[None, :] - 2 * x @ c[restart].T
                    nearest = distance.argmin(axis=1)
                    wide[:, -1] = (x * x).sum(axis=1) + distance[np.arange(len(x)), nearest]
                    np.add.at(sums[g][restart], nearest, wide)
        for g, total in sums.items():
            restart, cluster = np.nonzero(total[:, :, -2])
            found = total[restart, cluster]
            yield pa.RecordBatch.from_pydict({
                "group": pa.array([g] * len(found), pa.string()), "restart": restart.astype(np.int32), "cluster": cluster.astype(np.int32),
                "n": found[:, -2], "cost": found[:, -1], "s": pa.array(list(found[:, :-2]), pa.list_(pa.float64())),
            })

    schema = "group string, restart int, cluster int, n double, cost double, s array<double>"
    parts = prepared.select("group", "v").mapInArrow(assign, schema)
    return parts.groupBy("group", "restart", "cluster").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")
    )


def _lloyd(prepared: DataFrame, centres: dict[str, np.ndarray], turns: int) -> dict[str, tuple[float, np.ndarray]]:
    """Cost and centres of the best restart of every group; all of them move in one pass a turn."""
    costs: dict[str, np.ndarray] = {}
    for turn in range(turns + 1):
        fresh = {g: c.copy() for g, c in centres.items()}
        costs = {g: np.zeros(len(c)) for g, c in centres.items()}
        for r in _moved(prepared, centres).toLocalIterator():
            fresh[r.group][r.restart, r.cluster] = np.array(r.s) / r.n
            costs[r.group][r.restart] += r.cost
        moved = max(float(np.abs(fresh[g] - c).max()) for g, c in centres.items())
        # The last turn only tells the costs of the centres that are kept.
        if turn == turns or moved <= TOLERANCE:
            break
        centres = fresh
    return {g: (float(costs[g].min()), centres[g][int(costs[g].argmin())]) for g in centres}


def kmeans_clusters(
    df: DataFrame, label: Column | str, group: Column | str | None = None,
    n_init: int = RESTARTS, seed: int = SEED, components: int | None = None, turns: int = TURNS,
) -> DataFrame:
    """(id, label, group, cluster, cost): k-means on unit vectors, k = labels (of the group).

    Of ``n_init`` restarts the one with the lowest ``cost`` stays, which is the sum of
    squared distances of the group's rows to their centres. All groups and restarts move in
    one pass over the vectors a turn, with sums taken before the shuffle; as many centres as
    ``CENTRE_VALUES`` numbers travel with the tasks at a time, further restarts and groups
    follow in passes of their own. ``components`` reduces the vectors by PCA first. Groups
    without two labels, or with fewer rows than three, have no clusters.
    """
    prepared = df.where(F.col("v").isNotNull()).select(
        "id", label_or_none(label).alias("label"),
        (F.lit("") if group is None else label_or_none(group)).alias("group"), l2_normalize("v").alias("v"),
    )
    # Every turn reads this copy again; it survives lost executors.
    prepared = materialize(spread(prepared), "kmeans")
    if components:
        model = PCA(k=components, inputCol="features", outputCol="reduced").fit(prepared.select(array_to_vector("v").alias("features")))
        reduced = model.transform(prepared.withColumn("features", array_to_vector("v")))
        prepared = materialize(reduced.select("id", "label", "group", vector_to_array("reduced").alias("v")), "reduced")
    sizes = prepared.groupBy("group").agg(F.count("*").alias("rows"), F.count_distinct("label").alias("labels")).where(
        (F.col("rows") >= 3) & (F.col("labels") >= 2)
    )
    # One row per group (a market or the whole table) and restart.
    starts = materialize(_seeds(prepared, sizes, n_init, seed), "centres")
    ks = {r.group: r.labels for r in sizes.toLocalIterator()}
    best: dict[str, tuple[float, np.ndarray]] = {}

    def finished(waiting: dict[str, list[np.ndarray]]) -> None:
        if waiting:
            for g, found in _lloyd(prepared, {g: np.array(c) for g, c in waiting.items()}, turns).items():
                best[g] = min(best.get(g, found), found, key=lambda f: f[0])

    waiting: dict[str, list[np.ndarray]] = {}
    held = 0
    for r in starts.orderBy("group", "restart").toLocalIterator():
        if held and held + len(r.centres) > CENTRE_VALUES:
            finished(waiting)
            waiting, held = {}, 0
        waiting.setdefault(r.group, []).append(np.array(r.centres).reshape(ks[r.group], -1))
        held += len(r.centres)
    finished(waiting)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("group").to_numpy(zero_copy_only=False)
            points = as_matrix(pa.chunked_array([batch.column("v")]), batch.num_rows)
            cluster, cost = np.zeros(len(names), np.int32), np.zeros(len(names))
            for g in set(names) & set(best):
                at = np.flatnonzero(names == g)
                c = best[g][1]
                cluster[at] = ((c ** 2).sum(axis=1)[None, :] - 2 * points[at] @ c.T).argmin(axis=1)
                cost[at] = best[g][0]
            own = [batch.column(n) for n in ("id", "label", "group")]
            out = pa.RecordBatch.from_arrays([*own, pa.array(cluster), pa.array(cost)], ["id", "label", "group", "cluster", "cost"])
            yield out.filter(pa.array(np.isin(names, list(best))))

    kind = prepared.schema["id"].dataType.simpleString()
    return prepared.mapInArrow(assign, f"id {kind}, label string, group string, cluster int, cost double")


def by_group(
    df: DataFrame, label: Column | str, group: Column | str, clusters: DataFrame | None = None,
    ks: tuple[int, ...] = KS,
) -> DataFrame:
    """All label metrics inside every group with at least three rows and two labels.

    ``clusters`` is (id, cluster); by default k-means runs per group.
    """
    rows = df.where(F.col("v").isNotNull()).select(
        "id", "v", label_or_none(label).alias("label"), label_or_none(group).alias("group")
    )
    if clusters is None:
        clusters = kmeans_clusters(rows, "label", "group").select("id", "cluster")
    ranked = knn_join(rows, max(ks), pool=F.col("group"), label=F.col("label"))
    near = neighbour_metrics(ranked.withColumnRenamed("pool", "group"), ks, ["group"])
    agreement = cluster_agreement(rows.join(clusters, "id"), "label", "cluster", "group")
    shape = silhouette(rows, "label", "group")
    return (
        shape.where((F.col("rows") >= 3) & (F.col("labels") >= 2))
        .join(near, "group", "left").join(agreement, "group", "left")
        .select(
            "group", "knn_1_acc", "silhouette", "ari", "nmi",
            *[f"label_consistency_{k}" for k in ks],
            F.col("rows").alias("samples"), F.col("labels").alias("unique_labels"),
        )
    )


def hybrid_recall(
    df: DataFrame, country: Column | str, city: Column | str, section: Column | str, ks: tuple[int, ...] = KS
) -> DataFrame:
    """Pooled recall inside (country, city) pools with the section as relevance, one row.

    Neighbours are ranked inside pools; the number of relevant rows and the pool
    sizes follow from counts per pool and section. Queries without a relevant
    candidate count nowhere. Fewer than three rows give no row.
    """
    pool = F.concat_ws("\x1f", label_or_none(country), label_or_none(city))
    rows = df.where(F.col("v").isNotNull()).select("id", "v", pool.alias("pool"), label_or_none(section).alias("label"))
    ranked = knn_join(rows, max(ks), pool=F.col("pool"), label=F.col("label"))
    found = ranked.agg(*[
        F.coalesce(F.sum(F.when(F.col("same") & (F.col("rank") <= k), 1)), F.lit(0)).cast("double").alias(f"hits_{k}")
        for k in ks
    ])
    sections = rows.groupBy("pool", "label").agg(F.count("*").cast("double").alias("n"))
    n = F.col("n")
    asked = F.when(n > 1, n).otherwise(0.0)
    pools = sections.groupBy("pool").agg(
        F.sum("n").alias("size"), F.sum(asked).alias("asked"), F.sum(n * (n - 1)).alias("relevant")
    )
    totals = pools.agg(
        F.sum("size").alias("rows"), F.sum("asked").alias("asked"), F.sum("relevant").alias("relevant"),
        F.sum(F.col("asked") * (F.col("size") - 1)).alias("pool_sum"),
    )
    t = totals.select(F.struct("rows", "asked", "relevant", "pool_sum").alias("t")).scalar()
    return (
        found.withColumn("t", t).where((F.col("t.rows") >= 3) & (F.col("t.asked") > 0)).select(
            *[F.try_divide(F.col(f"hits_{k}"), F.col("t.relevant")).alias(f"recall_{k}") for k in ks],
            F.col("t.asked").cast("long").alias("queries_evaluated"),
            F.try_divide("t.pool_sum", "t.asked").alias("avg_pool_size"),
        )
    )


def filtered_candidates(
    df: DataFrame, country: Column | str, city: Column | str, section: Column | str
) -> DataFrame:
    """(id, candidates, relevant): other rows of the pool, and those of the same section.

    Counted, not listed: a pool may hold a third of the table.
    """
    rows = df.where(F.col("v").isNotNull()).select(
        "id", label_or_none(country).alias("country"), label_or_none(city).alias("city"),
        label_or_none(section).alias("section"),
    )
    sections = rows.groupBy("country", "city", "section").agg(F.count("*").alias("n"))
    pools = sections.groupBy("country", "city").agg(F.sum("n").alias("size"))
    sized = sections.join(pools, ["country", "city"])
    return rows.join(sized, ["country", "city", "section"]).select(
        "id", (F.col("size") - 1).alias("candidates"), (F.col("n") - 1).alias("relevant")
    )


def precision_map(ranking: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Precision@k and mean average precision@k, one row.

    ``ranking`` is (id, rank, same) and ``relevant`` (id, relevant) with the number
    of relevant rows; queries without one are left out.
    """
    w = Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("same").cast("double")
    running = ranking.where(F.col("rank") <= k).withColumn("__hits", F.sum(same).over(w))
    per_query = running.groupBy("id").agg(
        (F.sum(same) / k).alias("p"), F.sum(same * F.col("__hits") / F.col("rank")).alias("ap")
    )
    judged = per_query.join(relevant.where(F.col("relevant") > 0), "id")
    best = F.least(F.col("relevant"), F.lit(k))
    return judged.agg(
        F.avg("p").alias("precision_at_k"), F.avg(F.col("ap") / best).alias("map_at_k"), F.count("*").alias("n_queries")
    )


def balanced_sample(df: DataFrame, label: Column | str, n: int, key: str = "id") -> DataFrame:
    """At most ``n`` rows per label, chosen by a hash of the key."""
    order = F.md5(F.col(key).cast("string"))
    w = Window.partitionBy("__label").orderBy(order, key)
    return (
        df.withColumn("__label", label_or_none(label)).withColumn("__rn", F.row_number().over(w))
        .where(F.col("__rn") <= n).drop("__label", "__rn")
    )

