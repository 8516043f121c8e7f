"""Registered queries: silhouette, assignment, k-means sweeps and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import clustering as cl
from cohortloom.operators import latent as lat
from cohortloom.operators.silhouette import silhouette
from cohortloom.operators.silhouette import silhouette_squared as squared_form
from cohortloom.operators.tree import tree_labels, tree_table
from cohortloom.plans.queries_latent import Z, stored_zscores
from cohortloom.plans.registry import Registry, rounded, rounded_sql
from cohortloom.plans.star_panel import FEATURES_SQL, VARIED, numeric_features, table
from cohortloom.session import materialise

registry = Registry()
query = registry.query

_PAIR_SQL = (
    "WITH pairs AS (SELECT a.vec_id, a.label AS own, b.label AS other, b.vec_id AS other_id,"
    " list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d"
    " FROM embeddings a, embeddings b),"
    " sums AS (SELECT vec_id, own, other, sum(CASE WHEN vec_id = other_id THEN 0 ELSE d END) AS s,"
    " count(*) AS n FROM pairs GROUP BY ALL),"
    " ab AS (SELECT vec_id, own, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a,"
    " min(CASE WHEN own <> other THEN s / n END) AS b, max(CASE WHEN own = other THEN n END)"
    " AS own_n FROM sums GROUP BY vec_id, own),"
    " scores AS (SELECT vec_id, own, CASE WHEN own_n > 1 THEN coalesce((b - a)"
    " / nullif(greatest(a, b), 0), 0) ELSE 0 END AS s FROM ab)"
)


@query(
    f"{_PAIR_SQL} SELECT 'label' AS labelling, count(DISTINCT own) AS n_clusters,"
    f" {rounded_sql('avg(s)')} AS silhouette FROM scores"
)
def silhouette_exact(spark, sf_dir):
    found = silhouette(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    return found.withColumn("silhouette", rounded("silhouette"))


@query(
    f"{_PAIR_SQL} SELECT vec_id, 'label' AS labelling, own AS cluster,"
    f" {rounded_sql('s')} AS silhouette FROM scores"
)
def silhouette_per_point(spark, sf_dir):
    found = silhouette(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"], per_point=True
    )
    return found.withColumn("silhouette", rounded("silhouette"))


@query(
    _PAIR_SQL.replace(
        "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d",
        "power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2) AS d",
    )
    + f" SELECT 'label' AS labelling, {rounded_sql('avg(s)')} AS silhouette FROM scores"
)
def silhouette_squared(spark, sf_dir):
    """The linear-time form with squared distances."""
    found = squared_form(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return spark.createDataFrame([("label", found)], "labelling string, silhouette double").select(
        "labelling", rounded("silhouette").alias("silhouette")
    )


_CENTROID_SQL = (
    "WITH cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,"
    " generate_subscripts(embedding, 1) AS i FROM embeddings),"
    " centers AS (SELECT label AS cluster, i, avg(x) AS m FROM cells GROUP BY ALL),"
    " distances AS (SELECT vec_id, label, cluster, sqrt(sum((x - m) * (x - m))) AS d"
    " FROM cells JOIN centers USING (i) GROUP BY ALL),"
    " widths AS (SELECT vec_id, label, min(d) FILTER (cluster = label) AS own,"
    " min(d) FILTER (cluster <> label) AS other FROM distances GROUP BY ALL)"
)


@query(
    f"{_CENTROID_SQL} SELECT vec_id, label, {rounded_sql('own')} AS own, {rounded_sql('other')} AS other,"
    f" {rounded_sql('coalesce((other - own) / nullif(greatest(own, other), 0), 0)')} AS silhouette FROM widths"
)
def silhouette_to_centroids(spark, sf_dir):
    """The silhouette of every row from Euclidean distances to centroids, in linear time."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")
    )
    found = cl.centroid_silhouette(rows, "embedding", "label")
    return found.select(
        "vec_id", "label", *(rounded(c).alias(c) for c in ("own", "other", "silhouette"))
    )


@query(
    "WITH cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,"
    " generate_subscripts(embedding, 1) AS i FROM embeddings),"
    " centers AS (SELECT label AS cluster, i, avg(x) AS m FROM cells GROUP BY ALL),"
    " distances AS (SELECT vec_id, cluster, sqrt(sum((x - m) * (x - m))) AS distance"
    " FROM cells JOIN centers USING (i) GROUP BY ALL)"
    " SELECT vec_id, arg_min(cluster, row(distance, cluster)) AS cluster,"
    f" {rounded_sql('min(distance)')} AS distance FROM distances GROUP BY vec_id"
)
def nearest_centroid(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")
    )
    centers = cl.centroids_of(rows, "embedding", "label")
    found = cl.nearest_centroid(rows, "embedding", centers)
    return found.select("vec_id", "cluster", rounded("distance").alias("distance"))


@query()
def kmeans_sweep(spark, sf_dir):
    """Every k from 2 to 12 over the standardised mean features of all entities."""
    features = numeric_features(spark, sf_dir).select("entity_id", *VARIED)
    return cl.silhouette_sweep(
        materialise(features, "features"), "entity_id", VARIED, "means", n_init=1
    )


@query(
    f"WITH {FEATURES_SQL} SELECT CAST(3 AS BIGINT) AS n_k, CAST(2 AS INTEGER) AS lowest,"
    " CAST(4 AS INTEGER) AS highest, TRUE AS in_range, TRUE AS cost_falls,"
    " count(*) AS n_scored, count(*) AS n_entities FROM features"
)
def sweep_consistency(spark, sf_dir):
    """What must hold for any sweep: every k scored within [-1, 1], at falling cost."""
    features = numeric_features(spark, sf_dir).select("entity_id", *VARIED)
    stored = materialise(features, "features")
    report = cl.silhouette_sweep(stored, "entity_id", VARIED, "s", range(2, 5), n_init=2)
    costs = F.transform(F.array_sort(F.collect_list(F.struct("k", "cost"))), lambda s: s["cost"])
    return report.agg(
        F.count("*").alias("n_k"),
        F.min("k").alias("lowest"),
        F.max("k").alias("highest"),
        F.min(F.col("silhouette").between(-1.0, 1.0)).alias("in_range"),
        (costs == F.sort_array(F.collect_list("cost"), asc=False)).alias("cost_falls"),
        F.min("n_scored").alias("n_scored"),
    ).withColumn("n_entities", stored.agg(F.count("*")).scalar())


def _final(spark, sf_dir):
    features = numeric_features(spark, sf_dir).select("entity_id", *VARIED)
    stored = materialise(features, "features")
    return stored, cl.kmeans_fit(stored, "entity_id", VARIED, k=3, n_init=3)


@query()
def kmeans_final(spark, sf_dir):
    _, fit = _final(spark, sf_dir)
    return fit.labels


@query()
def kmeans_centroids(spark, sf_dir):
    _, fit = _final(spark, sf_dir)
    return fit.centroids


@query(
    f"WITH {FEATURES_SQL} SELECT count(*) AS n_entities, CAST(3 AS BIGINT) AS n_clusters,"
    " TRUE AS largest_first, CAST(0 AS BIGINT) AS n_misplaced FROM features"
)
def kmeans_consistency(spark, sf_dir):
    """What must hold for any k-means result: everyone labelled, and by the nearest centroid."""
    stored, fit = _final(spark, sf_dir)
    z = cl.standardise(stored, "entity_id", VARIED).select(
        "entity_id", F.array(*VARIED).alias("x")
    )
    ordered = F.transform(
        F.array(*[F.lit(c) for c in VARIED]), lambda c: F.col("by_feature")[c]
    )
    centers = (
        fit.centroids.groupBy("cluster")
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("by_feature"))
        .select("cluster", ordered.alias("center"))
    )
    nearest = cl.nearest_centroid(z, "x", centers, "nearest").select("entity_id", "nearest")
    joined = fit.labels.join(nearest, "entity_id")
    sizes = joined.groupBy("cluster").agg(
        F.count("*").alias("n"), F.count_if(F.col("cluster") != F.col("nearest")).alias("off")
    )
    in_order = F.transform(
        F.array_sort(F.collect_list(F.struct("cluster", "n"))), lambda s: s["n"]
    )
    return sizes.agg(
        F.sum("n").alias("n_entities"),
        F.count("*").alias("n_clusters"),
        (F.sort_array(F.collect_list("n"), asc=False) == in_order).alias("largest_first"),
        F.sum("off").alias("n_misplaced"),
    )


def _spaces(spark, sf_dir):
    z = stored_zscores(spark, sf_dir)
    fit = lat.fit_pca(z, Z)
    scores = materialise(lat.pca_scores(z, "entity_id", fit), "scores")
    factors = lat.factor_scores(scores, "entity_id", lat.fit_varimax(fit, 4))
    return {
        "EFA_F1-4": (factors, ["F1", "F2", "F3", "F4"]),
        "EFA_F1-2": (factors, ["F1", "F2"]),
        "PCA_PC1-4": (scores, ["PC1", "PC2", "PC3", "PC4"]),
        "PCA_PC1-2": (scores, ["PC1", "PC2"]),
    }


@query()
def space_compare(spark, sf_dir):
    """Four spaces, each swept over k on all rows."""
    return cl.compare_spaces(_spaces(spark, sf_dir), "entity_id", ks=range(2, 6), n_init=1)


@query()
def space_winner(spark, sf_dir):
    """The best k of every space, best space first."""
    report = cl.compare_spaces(_spaces(spark, sf_dir), "entity_id", ks=range(2, 4), n_init=1)
    return cl.best_per_group(report)


@query()
def bisecting_sweep(spark, sf_dir):
    features = numeric_features(spark, sf_dir).select("entity_id", *VARIED)
    return cl.bisecting_sweep(
        materialise(features, "features"), "entity_id", VARIED, ks=range(2, 9)
    )


@query(
    f"WITH {FEATURES_SQL} SELECT CAST(4 AS BIGINT) AS n_k, TRUE AS all_leaves, TRUE AS cost_falls,"
    " TRUE AS below_total, count(*) AS n_entities FROM features"
)
def bisecting_consistency(spark, sf_dir):
    """What must hold down the tree: k leaves, a falling cost, below that of one cluster.

    In a standardised space one cluster costs rows times varied columns.
    """
    features = numeric_features(spark, sf_dir).select("entity_id", *VARIED)
    stored = materialise(features, "features")
    report = cl.bisecting_sweep(stored, "entity_id", VARIED, ks=range(2, 6))
    n = stored.agg(F.count("*")).scalar()
    costs = F.transform(F.array_sort(F.collect_list(F.struct("k", "cost"))), lambda s: s["cost"])
    return report.agg(
        F.count("*").alias("n_k"),
        F.min(F.col("k") == F.col("n_leaves")).alias("all_leaves"),
        (costs == F.sort_array(F.collect_list("cost"), asc=False)).alias("cost_falls"),
        (F.max("cost") <= F.max(n) * len(VARIED)).alias("below_total"),
        F.max(n).alias("n_entities"),
    )


def _tree_sql(k: int) -> str:
    """CTEs of the tree over one column: a<i> (entity_id, x, node) after i splits.

    In one dimension the best pair of clusters is the best cut of the sorted values.
    """
    steps = [
        f"{FEATURES_SQL}, moments AS (SELECT avg(mean_num_quantity) AS m, stddev_pop(mean_num_quantity) AS s"
        " FROM features), a0 AS MATERIALIZED (SELECT entity_id, coalesce((mean_num_quantity - m) / s, 0) AS x,"
        " 1 AS node FROM features, moments)"
    ]
    for i in range(k):
        steps.append(
            f"s{i} AS MATERIALIZED (SELECT node, count(*) AS n, sum(x) AS t,"
            f" sum(x * x) - sum(x) * sum(x) / count(*) AS cost FROM a{i} GROUP BY node)"
        )
    for i in range(k - 1):
        steps.append(
            f"top{i} AS MATERIALIZED (SELECT * FROM s{i} ORDER BY cost DESC, node LIMIT 1),"
            f" places{i} AS (SELECT x, sum(c) OVER (ORDER BY x) AS n1, sum(v) OVER (ORDER BY x) AS t1 FROM"
            f" (SELECT x, count(*) AS c, sum(x) AS v FROM a{i} JOIN top{i} USING (node) GROUP BY x)),"
            f" cut{i} AS MATERIALIZED (SELECT x AS cut FROM places{i}, top{i} WHERE n1 < n"
            " ORDER BY t1 * t1 / n1 + (t - t1) * (t - t1) / (n - n1) DESC, x LIMIT 1),"
            f" a{i + 1} AS MATERIALIZED (SELECT entity_id, x, CASE WHEN a.node <> top.node THEN a.node"
            f" WHEN x <= cut THEN {2 * i + 2} ELSE {2 * i + 3} END AS node FROM a{i} a, top{i} top, cut{i})"
        )
    # Statistics of a<i> are needed before the split that follows them.
    heads = [s for s in steps if s.startswith("s")]
    body = [steps[0]]
    for i in range(k):
        body.append(heads[i])
        if i < k - 1:
            body.append(next(s for s in steps if s.startswith(f"top{i} ")))
    return "WITH " + ", ".join(body)


_TREE_K = 5
_TREE_ROWS_SQL = " UNION ALL ".join(
    ["SELECT 1 AS node, NULL AS parent, n, cost FROM s0"]
    + [
        f"SELECT s.node, top.node, s.n, s.cost FROM s{i + 1} s, top{i} top WHERE s.node IN ({2 * i + 2}, {2 * i + 3})"
        for i in range(_TREE_K - 1)
    ]
)
_TREE_SPLITS_SQL = " UNION ALL ".join(f"SELECT node, {i} AS split FROM top{i}" for i in range(_TREE_K - 1))
_TREE_LEVELS_SQL = " UNION ALL ".join(
    f"SELECT {i + 1} AS k, node, count(*) AS n, {rounded_sql('min(x)')} AS low, {rounded_sql('max(x)')} AS high"
    f" FROM a{i} GROUP BY node"
    for i in range(_TREE_K)
)


def _line_tree(spark, sf_dir):
    features = numeric_features(spark, sf_dir, ["quantity"]).select("entity_id", "mean_num_quantity")
    return cl.grow_tree(materialise(features, "features"), "entity_id", ["mean_num_quantity"], _TREE_K)


@query(
    f"{_tree_sql(_TREE_K)} SELECT CAST(r.node AS BIGINT) AS node, CAST(parent AS BIGINT) AS parent,"
    f" CAST(split AS BIGINT) AS split, n AS size, {rounded_sql('cost', 4)} AS height"
    f" FROM ({_TREE_ROWS_SQL}) r LEFT JOIN ({_TREE_SPLITS_SQL}) t ON r.node = t.node"
)
def cluster_tree_line(spark, sf_dir):
    """The tree over one feature, whose best splits have a closed form."""
    _, tree = _line_tree(spark, sf_dir)
    found = tree_table(tree, spark)
    return found.select("node", "parent", "split", "size", rounded("height", 4).alias("height"))


@query(
    f"{_tree_sql(_TREE_K)} SELECT CAST(k AS INTEGER) AS k, CAST(node AS BIGINT) AS node, n AS size, low, high"
    f" FROM ({_TREE_LEVELS_SQL})"
)
def cluster_tree_levels(spark, sf_dir):
    """Sizes and value ranges of the clusters at every k, from the labels of all rows."""
    points, tree = _line_tree(spark, sf_dir)
    labels = tree_labels(points, tree, "entity_id", "string", list(range(1, _TREE_K + 1)))
    values = points.select(F.col("key").alias("entity_id"), F.col("x")[0].alias("x"))
    return labels.join(values, "entity_id").groupBy("k", "node").agg(
        F.count("*").alias("size"),
        rounded(F.min("x")).alias("low"),
        rounded(F.max("x")).alias("high"),
    )


@query()
def cluster_tree(spark, sf_dir):
    """The tree over all varied mean features, with eight leaves."""
    features = numeric_features(spark, sf_dir).select("entity_id", *VARIED)
    _, tree = cl.grow_tree(materialise(features, "features"), "entity_id", VARIED, 8)
    return tree_table(tree, spark)


@query()
def embedding_clusters(spark, sf_dir):
    """Embeddings standardised, swept over k, and labelled by the sweep's own fit of the best k."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = cl.sweep({"embedding": (rows, "embedding")}, "vec_id", range(2, 7), n_init=1)
    space, k = cl.winner(found.report)
    return found.labels(space, k, "vec_id").withColumn("k", F.lit(k))


# Three groups of parts that lie far apart, so that the best fit is known: the groups themselves.
_GROUPS = {"line": ["far"], "plane": ["far", "wide"]}
_GROUP_COLUMNS = {
    "far": "CAST((p_size % 3) * (p_size % 3) * 1000 + p_size AS DOUBLE)",
    "wide": "CAST(CASE p_size % 3 WHEN 2 THEN 3000 ELSE 0 END + p_size % 7 AS DOUBLE)",
}


def _groups_sql() -> str:
    """CTE `scored`: rows (space, entity_id, g, cost, s) of the true groups in standardised spaces."""
    columns = ", ".join(f"{e} AS {n}" for n, e in _GROUP_COLUMNS.items())
    spaces = []
    for space, names in _GROUPS.items():
        values = ", ".join(f"({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER ()" for n in names)
        spaces.append(f"SELECT '{space}' AS space, entity_id, g, [{values}] AS z FROM raw")
    return (
        "WITH raw AS (SELECT CAST(p_partkey AS VARCHAR) AS entity_id, p_size % 3 AS g,"
        f" {columns} FROM part), spaced AS ({' UNION ALL '.join(spaces)}),"
        " cells AS (SELECT space, g, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM spaced),"
        " means AS (SELECT space, g, list(m ORDER BY i) AS m, list(t ORDER BY i) AS t, sum(p) AS p, max(n) AS n"
        " FROM (SELECT space, g, i, avg(v) AS m, sum(v) AS t, sum(v * v) AS p, count(*) AS n FROM cells"
        " GROUP BY ALL) GROUP BY space, g),"
        " far AS (SELECT a.space, entity_id, a.g, b.g AS h, n,"
        " n * list_inner_product(z, z) - 2 * list_inner_product(z, t) + p AS total,"
        " power(list_distance(z, m), 2) AS square FROM spaced a JOIN means b ON a.space = b.space),"
        " ab AS (SELECT space, entity_id, g, max(CASE WHEN g = h THEN total / (n - 1) END) AS a,"
        " min(CASE WHEN g <> h THEN total / n END) AS b, max(CASE WHEN g = h THEN square END) AS cost"
        " FROM far GROUP BY space, entity_id, g),"
        " scored AS (SELECT space, entity_id, g, cost, (b - a) / greatest(a, b) AS s FROM ab)"
    )


def _group_sweep(spark, sf_dir):
    columns = [F.expr(e).alias(n) for n, e in _GROUP_COLUMNS.items()]
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), *columns)
    stored = materialise(parts, "groups")
    return cl.sweep({s: (stored, names) for s, names in _GROUPS.items()}, "entity_id", range(2, 5), n_init=3)


@query(
    f"{_groups_sql()} SELECT space, CAST(3 AS INTEGER) AS k, {rounded_sql('avg(s)')} AS silhouette,"
    f" {rounded_sql('sum(cost)', 4)} AS cost, count(*) AS n_scored FROM scored GROUP BY space"
)
def group_sweep_winners(spark, sf_dir):
    """The best k of two spaces, with its score and cost, where the best fit is known."""
    found = cl.best_per_group(_group_sweep(spark, sf_dir).report)
    return found.select(
        "space", "k", rounded("silhouette").alias("silhouette"), rounded("cost", 4).alias("cost"), "n_scored"
    )


@query(
    f"{_groups_sql()}, ranked AS (SELECT g, CAST(row_number() OVER (ORDER BY count(*) DESC, g) - 1 AS INTEGER)"
    " AS cluster FROM scored WHERE space = 'plane' GROUP BY g)"
    " SELECT entity_id, cluster FROM scored JOIN ranked USING (g) WHERE space = 'plane'"
)
def group_sweep_labels(spark, sf_dir):
    """Labels of all rows by the sweep's own fit, clusters numbered by size."""
    return _group_sweep(spark, sf_dir).labels("plane", 3, "entity_id")
