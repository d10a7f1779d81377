"""Density clustering, cluster summary and spatial ordering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dbscan as D
from ..operators import spatial as S
from . import common as C
from .registry import query

# the two configurations the reference runs (eps in planar metres, D10)
CONFIGS = [(1000.0, 5), (5000.0, 10)]
SAMPLES = 5


@C.memo
def clusters(spark, sf):
    pts = S.with_xy(C.addresses(spark, sf)).select("gnaf_pid", "x", "y")
    out = None
    for eps, min_pts in CONFIGS:
        r = C.cut(D.dbscan(pts, "gnaf_pid", eps, min_pts)).withColumn(
            "config", F.lit(f"eps{int(eps)}_min{min_pts}"))
        out = r if out is None else out.unionByName(r)
    return out


@query("dbscan")
def dbscan(spark, sf):
    """DBSCAN over every address for both configurations (eps 1000 m / 5 points, eps 5000 m / 10 points);
    label null = noise."""
    return clusters(spark, sf)


@query("cluster_summary")
def cluster_summary(spark, sf):
    """Per cluster size and 5 sample addresses (bounded top-5, not a collected cluster), cluster count, noise."""
    c = clusters(spark, sf)
    a = C.addresses(spark, sf).select("gnaf_pid", "formatted_address")
    member = c.filter(F.col("cluster").isNotNull())
    size = member.groupBy("config", "cluster").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("config", "cluster").orderBy("gnaf_pid")
    top = member.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= SAMPLES).join(a, "gnaf_pid")
    samples = top.groupBy("config", "cluster").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", "formatted_address"))), lambda x: x["formatted_address"]), " | ")
        .alias("samples"))
    totals = c.groupBy("config").agg(F.countDistinct("cluster").alias("n_clusters"),
                                     F.count_if(F.col("cluster").isNull()).alias("noise"))
    return size.join(samples, ["config", "cluster"]).join(totals, "config")


@query("geohash")
def geohash(spark, sf):
    """X13 + W10: geohash (8 characters) per address, written in spatial order: range partitions on the
    grid cell, then sorted by geohash inside each partition (parquet min/max skipping on the cell)."""
    a = C.unsaved(spark, sf)[0].select("gnaf_pid", "latitude", "longitude", "state_code")
    g = a.withColumn("geohash", D.geohash(F.col("latitude"), F.col("longitude"), 8)).withColumn(
        "cell", F.substring("geohash", 1, 4))
    return g.repartitionByRange("cell").sortWithinPartitions("geohash")
