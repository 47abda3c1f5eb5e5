"""Ingredient clusters: lookups, counts, cross-tabs and the clustering model."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweek.session import materialise, spread

# Number of clusters.
CLUSTERS = 7
# end of fixed values
#: Decimals that features, distances and centres keep: sums in any order agree there.
DIGITS = 9


def cluster_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("items"))


def cluster_mix(assigned: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Cluster by category cross-tab with zeros; pass the categories to spare a job."""
    return assigned.groupBy("cluster").pivot("category", categories).count().na.fill(0)


def known_ingredients(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """Clustered ingredients that occur in the name list.

    Repeated names collapse before the join, inside the scan tasks first.
    """
    return assigned.join(names.select("item").distinct(), "item", "left_semi")


def feature_pipeline(categorical: list[str], numeric: list[str], flags: list[str]) -> Pipeline:
    """One-hot categories, numbers and 0/1 flags as one scaled vector."""
    index = [f"{c}_index" for c in categorical]
    hot = [f"{c}_hot" for c in categorical]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=categorical, outputCols=index, handleInvalid="keep"),
            OneHotEncoder(inputCols=index, outputCols=hot),
            VectorAssembler(inputCols=[*hot, *numeric, *flags], outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=False),
        ]
    )


def squared_distance(features: Column, centre: list[float]) -> Column:
    parts = F.zip_with(features, F.lit(centre), lambda a, b: (a - b) * (a - b))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def nearest(features: Column, centres: list[list[float]]) -> Column:
    """``(distance, cluster)`` of the nearest centre; the lowest cluster of equally near ones."""
    return F.array_min(F.array(*[
        F.struct(F.round(squared_distance(features, c), DIGITS).alias("distance"), F.lit(k).alias("cluster"))
        for k, c in enumerate(centres)
    ]))


def measure(centres: list[list[float]]):
    """Function from Arrow features to ``(matrix, rounded distances, clusters)``: whole batches at
    once, by the rule of :func:`nearest`."""

    def measured(features):
        import numpy as np

        x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)
        away = np.stack([((x - np.array(c)) ** 2).sum(axis=1) for c in centres]).round(DIGITS)
        return x, away.min(axis=0), away.argmin(axis=0)

    return measured


def start_centres(rows: DataFrame, k: int) -> list[list[float]]:
    """Farthest-first: a row chosen by the hash of its item, then ever the row farthest from all
    chosen ones. Depends on the rows alone, not on their order or partitions; one row a step
    comes to the driver. Fewer distinct rows than ``k`` give fewer centres.

    ``rows`` has ``features`` and ``by``, the hash."""
    import pyarrow as pa

    first = rows.agg(F.min_by("features", "by").alias("features")).first()
    centres = [] if first is None or first.features is None else [list(first.features)]
    while centres and len(centres) < k:
        measured = measure(centres)

        def farthest(frames):
            for frame in frames:
                if not frame.num_rows:
                    continue
                _, away, _ = measured(frame.column("features"))
                by = frame.column("by").to_pylist()
                best = min((away == away.max()).nonzero()[0].tolist(), key=by.__getitem__)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([away[best]]), *(frame.column(n).slice(best, 1) for n in ("by", "features"))],
                    names=["away", "by", "features"],
                )

        found = rows.select("by", "features").mapInArrow(farthest, "away double, by string, features array<double>").agg(
            F.max("away").alias("away"), F.min_by("features", F.struct(-F.col("away"), "by")).alias("features")
        ).first()
        if found.away <= 0:
            break
        centres.append(list(found.features))
    return centres


def cluster_means(rows: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``(cluster, mean)`` of the rows nearest to each centre; ``n`` items have a row's features."""
    import pyarrow as pa

    measured = measure(centres)

    def sums(frames):
        for frame in frames:
            if not frame.num_rows:
                continue
            x, _, cluster = measured(frame.column("features"))
            n = frame.column("n").to_numpy().astype(float)
            own = [k for k in range(len(centres)) if (cluster == k).any()]
            weights = [float(n[cluster == k].sum()) for k in own]
            means = [n[cluster == k] @ x[cluster == k] / w for k, w in zip(own, weights)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array(weights), pa.array([m.tolist() for m in means], pa.list_(pa.float64()))],
                names=["cluster", "n", "mean"],
            )

    parts = rows.select("features", "n").mapInArrow(sums, "cluster int, n double, mean array<double>")
    return parts.groupBy("cluster").agg(Summarizer.mean(array_to_vector("mean"), F.col("n")).alias("mean"))


def cluster_items(
    ingredients: DataFrame, categorical: list[str], numeric: list[str], flags: list[str],
    k: int = CLUSTERS, rounds: int = 100,
) -> tuple[DataFrame, list[list[float]]]:
    """``(item, features, distance, cluster)`` of every row, and the centres.

    K-means over categories, numbers and flags from :func:`start_centres`: rows go to their
    nearest centre, centres to the mean of their rows, until no centre moves. The rows stay
    distributed, those with equal values as one with their number; ``k`` centres come to the
    driver a round. Sums are rounded, so labels don't depend on how the rows are partitioned. A
    centre that loses all rows stays where it is. Rows with a null item, number or flag take no
    part; null categories are a category of their own; an empty table gives no rows and no centres.
    """
    whole = ingredients.dropna(subset=["item", *numeric, *flags])
    if whole.isEmpty():
        none = whole.select("item", F.array(F.lit(0.0)).alias("features"), F.lit(0.0).alias("distance"), F.lit(0).alias("cluster"))
        return none, []
    # An encoder takes no null and no empty name.
    named = whole.withColumns({c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in categorical})
    # Many rows fit in a small file, which one task would read in every pass.
    named = materialise(spread(named.select("item", *categorical, *numeric, *flags), "item"))
    model = feature_pipeline(categorical, numeric, flags).fit(named)
    scaled = F.transform(vector_to_array("features"), lambda x: F.round(x, DIGITS))
    by = F.md5(F.col("item").cast("string").cast("binary"))
    kinds = named.groupBy(*categorical, *numeric, *flags).agg(F.min(by).alias("by"), F.count("*").alias("n"))
    rows = materialise(spread(model.transform(kinds).select("by", "n", scaled.alias("features")), "by"))
    centres = start_centres(rows, k)
    for _ in range(rounds):
        moved = list(centres)
        for row in cluster_means(rows, centres).collect():
            moved[row.cluster] = [round(float(x), DIGITS) for x in row.mean]
        if moved == centres:
            break
        centres = moved
    return model.transform(named).select("item", scaled.alias("features")).select(
        "item", "features", nearest(F.col("features"), centres).alias("at")
    ).select("item", "features", "at.distance", "at.cluster"), centres
