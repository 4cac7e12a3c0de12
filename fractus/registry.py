"""Queries of the voxel engine, by name, over volumes derived from the driver's tables, and the SQL they equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import axes, fields
from .operators import distance, graph, regions, resolve, snap, stencil
from .plans import splitters
from .plans.fixpoint import measured_joins
from .sources import volumes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# --- the derived volumes in SQL -------------------------------------------------

VOX = """
ball AS (
  SELECT n_regionkey AS sv_id, 4 + (n_nationkey * 11) % 32 AS cx, 4 + (n_nationkey * 7) % 16 AS cy, 4 + (n_nationkey * 5) % 8 AS cz, 3 + n_nationkey % 3 AS r FROM nation
), vox AS (
  SELECT DISTINCT CAST(sv_id AS BIGINT) AS sv_id, CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x
  FROM ball, range(16) AS gz(z), range(24) AS gy(y), range(40) AS gx(x)
  WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) <= r * r
)"""
SEEDS = """
seed AS (
  SELECT CAST(n_regionkey AS BIGINT) AS sv_id, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS side, n_nationkey AS seed_idx,
    CAST(4.5 + (n_nationkey * 5) % 8 AS DOUBLE) AS z, CAST(4.25 + (n_nationkey * 7) % 16 AS DOUBLE) AS y, CAST(3.5 + (n_nationkey * 11) % 32 AS DOUBLE) AS x FROM nation
)"""
STENCIL = """
stencil AS (
  SELECT a - 1 AS dz, b - 1 AS dy, c - 1 AS dx FROM range(3) AS g1(a), range(3) AS g2(b), range(3) AS g3(c) WHERE NOT (a = 1 AND b = 1 AND c = 1)
)"""
COMPONENTS = """
num AS (SELECT *, (z * 24 + y) * 40 + x AS v FROM vox),
e AS (
  SELECT a.sv_id, a.v AS a, b.v AS b FROM num a, stencil s JOIN num b ON b.sv_id = a.sv_id AND b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx
),
cc(sv_id, v, comp) USING KEY (sv_id, v) AS (
  SELECT sv_id, v, v FROM num
  UNION
  SELECT e.sv_id, e.b, min(cc.comp) FROM cc JOIN e ON e.sv_id = cc.sv_id AND e.a = cc.v JOIN recurring.cc AS r ON r.sv_id = e.sv_id AND r.v = e.b
  WHERE cc.comp < r.comp GROUP BY e.sv_id, e.b
)"""
EDT = """
cell AS (
  SELECT i.sv_id, z, y, x FROM (SELECT DISTINCT sv_id FROM vox) i, range(16) AS gz(z), range(24) AS gy(y), range(40) AS gx(x)
), bg AS (SELECT * FROM cell ANTI JOIN vox USING (sv_id, z, y, x)),
edt AS (
  SELECT v.sv_id, v.z, v.y, v.x, min((v.x - b.x) * (v.x - b.x) + 4 * (v.y - b.y) * (v.y - b.y) + 9 * (v.z - b.z) * (v.z - b.z)) AS d2
  FROM vox v JOIN bg b ON b.sv_id = v.sv_id GROUP BY ALL
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            measured_joins(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet")


def _blobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nation = _nation(spark, sf_dir)
    return volumes.nation_blobs(nation), volumes.blob_volumes(nation), volumes.blob_seeds(nation)


def _longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns or [n for n, t in df.dtypes if t in ("int", "tinyint", "smallint")]})


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns that stand for arrival times, some of them infinite."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = F.when(F.col("l_quantity") == 13, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    return li.select("l_orderkey", "l_linenumber", a.alias("ta"), (F.col("l_tax") * 100 + F.col("l_discount") * 400).alias("tb"))


ARRIVALS = """
arr AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 13 THEN CAST('inf' AS DOUBLE) ELSE l_quantity END AS ta, l_tax * 100 + l_discount * 400 AS tb FROM lineitem
)"""


# --- scans, orders, scalar functions --------------------------------------------


@query(f"WITH {VOX} SELECT * FROM vox")
def scan_voxels(spark, sf_dir):
    """Sparse foreground of derived volumes."""
    return _longs(_blobs(spark, sf_dir)[0])


@query("""
WITH c AS (SELECT ascii(l_returnflag) AS sv_id, CAST(floor(l_quantity) AS BIGINT) % 8 AS z, l_suppkey % 10 AS y, l_partkey % 16 AS x FROM lineitem)
SELECT CAST(sv_id AS BIGINT) AS sv_id, CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM c GROUP BY ALL HAVING count(*) >= 4
""")
def scan_lineitem_voxels(spark, sf_dir):
    """Cells with enough line items."""
    return _longs(volumes.lineitem_voxels(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), 4))


@query("""
SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice / 8, 0) AS BIGINT) AS z, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS y, CAST(round_even(l_tax * 50, 0) AS BIGINT) AS x,
  CAST(floor(l_quantity / 2 + 0.5) AS BIGINT) AS half_up, CAST(floor(l_quantity / 3) AS BIGINT) AS below, CAST(ceil(l_quantity / 3) AS BIGINT) AS above, CAST(least(greatest(l_quantity, 5), 40) AS BIGINT) AS clamped
FROM lineitem
""")
def seed_coordinates(spark, sf_dir):
    """Seeds to z, y, x with halves to even; the other roundings and the clamp."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.col("l_quantity")
    raw = li.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_tax") * 50).alias("px"), (q / 2).alias("py"), (F.col("l_extendedprice") / 8).alias("pz"))
    out = axes.seeds_to_zyx(raw, ("px", "py", "pz"), "xyz")
    return out.select("l_orderkey", "l_linenumber", "z", "y", "x", axes.half_up(q / 2).alias("half_up"), F.floor(q / 3).alias("below"), F.ceil(q / 3).alias("above"), axes.clamped(q, 5, 40).cast("long").alias("clamped"))


@query(f"""
WITH {ARRIVALS}, f AS (
  SELECT *, CASE WHEN isfinite(ta) AND isfinite(tb) THEN abs(ta - tb) / (ta + tb + 1e-12) ELSE 0 END AS rd,
    ta / (1 + 2 * exp(-greatest(tb, 0))) AS ca, tb / (1 + 2 * exp(-greatest(ta, 0))) AS cb FROM arr
)
SELECT l_orderkey, l_linenumber, round(rd, 6) AS reldiff, isfinite(ta) AND isfinite(tb) AND rd <= 0.08 AS band,
  CAST(CASE WHEN isfinite(ta) AND isfinite(tb) AND rd <= 0.08 THEN CASE WHEN ca <= cb THEN 1 ELSE 2 END WHEN ta <= tb THEN 1 ELSE 2 END AS BIGINT) AS label
FROM f
""")
def narrow_band_labels(spark, sf_dir):
    """Relative difference, band and label from two arrivals."""
    ta, tb = F.col("ta"), F.col("tb")
    band = fields.in_band(ta, tb)
    return _arrivals(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(fields.relative_difference(ta, tb), 6).alias("reldiff"), band.alias("band"), fields.label_of(band, ta, tb).cast("long").alias("label"))


# --- regions ----------------------------------------------------------------------


@query(f"WITH {VOX} SELECT sv_id, min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM vox GROUP BY sv_id")
def bounding_box(spark, sf_dir):
    return _longs(regions.bounding_box(_blobs(spark, sf_dir)[0]))


@query(f"""
WITH {VOX} SELECT sv_id, greatest(0, min(z) - 2) AS z0, least(16, max(z) + 3) AS z1, greatest(0, min(y) - 3) AS y0, least(24, max(y) + 4) AS y1,
  greatest(0, min(x) - 4) AS x0, least(40, max(x) + 5) AS x1 FROM vox GROUP BY sv_id
""")
def padded_box(spark, sf_dir):
    v, shape, _ = _blobs(spark, sf_dir)
    return _longs(regions.padded_box(v, shape, (2, 3, 4)))


@query(f"""
WITH {VOX}, b AS (SELECT sv_id, greatest(0, min(z) - 1) AS z0, greatest(0, min(y) - 1) AS y0, greatest(0, min(x) - 1) AS x0 FROM vox GROUP BY sv_id)
SELECT sv_id, z - z0 AS z, y - y0 AS y, x - x0 AS x FROM vox JOIN b USING (sv_id)
""")
def crop_to_foreground(spark, sf_dir):
    v, shape, _ = _blobs(spark, sf_dir)
    return _longs(regions.crop_to_foreground(v, shape))


@query(f"WITH {VOX} SELECT sv_id, z // 2 AS z, y // 2 AS y, x AS x FROM vox WHERE z % 2 = 0 AND y % 2 = 0")
def strided_grid(spark, sf_dir):
    return _longs(regions.stride(_blobs(spark, sf_dir)[0], (2, 2, 1)))


@query(f"""
WITH {VOX}, c AS (SELECT sv_id, z // 2 AS zc, y // 2 AS yc, x AS xc, 1 + (x + y + z) % 3 AS label FROM vox WHERE z % 2 = 0 AND y % 2 = 0)
SELECT v.*, CAST(coalesce(label, 0) AS BIGINT) AS label FROM vox v LEFT JOIN c ON c.sv_id = v.sv_id AND zc = z // 2 AND yc = y // 2 AND xc = x
""")
def upsampled_labels(spark, sf_dir):
    v = _blobs(spark, sf_dir)[0]
    coarse = regions.stride(v.withColumn("label", (1 + (F.col("x") + F.col("y") + F.col("z")) % 3).cast("tinyint")), (2, 2, 1))
    return _longs(regions.upsample(coarse, (2, 2, 1), v).fillna(0, ["label"]))


@query(f"WITH {VOX} SELECT sv_id, z, y, x FROM (SELECT *, row_number() OVER (PARTITION BY sv_id ORDER BY z, y, x) - 1 AS i FROM vox) WHERE i % 3 = 0")
def every_third_voxel(spark, sf_dir):
    return _longs(regions.every_nth(_blobs(spark, sf_dir)[0], 3))


@query(f"WITH {VOX} SELECT sv_id, least(count(*), 500) AS n FROM vox GROUP BY sv_id")
def sampled_voxels(spark, sf_dir):
    """Sizes of samples of a stated number of voxels."""
    return regions.sample(_blobs(spark, sf_dir)[0], 500).groupBy("sv_id").agg(F.count("*").alias("n"))


@query(f"""
WITH {VOX}, l AS (SELECT *, 1 + (x * 7 + y * 3 + z) % 3 AS label FROM vox)
SELECT sv_id, count(*) FILTER (label = 1) AS n_source, count(*) FILTER (label = 2) AS n_sink, count(*) FILTER (label = 3) AS n_stray FROM l GROUP BY sv_id
""")
def label_histogram(spark, sf_dir):
    return regions.histogram(_labels(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _blobs(spark, sf_dir)[0]
    return v.withColumn("label", (1 + (F.col("x") * 7 + F.col("y") * 3 + F.col("z")) % 3).cast("tinyint"))


@query(f"""
WITH {VOX}, {SEEDS}, l AS (SELECT * FROM (SELECT *, 1 + (x * 7 + y * 3 + z) % 3 AS label FROM vox) WHERE x % 2 = 0),
s AS (SELECT sv_id, CAST(floor(z) AS BIGINT) AS z, CAST(floor(y) AS BIGINT) AS y, CAST(floor(x) AS BIGINT) AS x, max(side) AS side FROM seed GROUP BY ALL)
SELECT v.sv_id, v.z, v.y, v.x, CAST(coalesce(s.side, l.label, 1) AS BIGINT) AS label FROM vox v LEFT JOIN l USING (sv_id, z, y, x) LEFT JOIN s USING (sv_id, z, y, x)
""")
def written_back_labels(spark, sf_dir):
    """Labels of a part over a default, seeds forced."""
    v, _, seeds = _blobs(spark, sf_dir)
    placed = seeds.withColumns({a: F.floor(a).cast("int") for a in "zyx"})
    return _longs(regions.force_seeds(regions.with_defaults(v, _labels(spark, sf_dir).where("x % 2 = 0")), placed))


@query(f"WITH {VOX} SELECT sv_id, count(*) AS n_source, 0 AS n_sink, 0 AS n_stray FROM vox GROUP BY sv_id")
def noop_split(spark, sf_dir):
    v, shape, seeds = _blobs(spark, sf_dir)
    return regions.histogram(splitters.NoopSplitter().split(v, seeds, shape).labels)


# --- stencils -----------------------------------------------------------------------


@query(f"""
WITH {VOX}, {STENCIL}, n AS (
  SELECT a.sv_id, a.z, a.y, a.x, count(b.x) AS k FROM vox a, stencil s LEFT JOIN vox b ON b.sv_id = a.sv_id AND b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx GROUP BY ALL
) SELECT sv_id, z, y, x FROM n WHERE k < 26
""")
def boundary_voxels(spark, sf_dir):
    return _longs(stencil.boundary(_blobs(spark, sf_dir)[0]))


@query(f"""
WITH {VOX}, o AS (SELECT a - 1 AS dz, b - 1 AS dy, c - 1 AS dx FROM range(3) AS g1(a), range(3) AS g2(b), range(3) AS g3(c) WHERE abs(a - 1) + abs(b - 1) + abs(c - 1) <= 1)
SELECT DISTINCT v.sv_id, v.z + dz AS z, v.y + dy AS y, v.x + dx AS x FROM vox v, o SEMI JOIN vox w ON w.sv_id = v.sv_id AND w.z = v.z + dz AND w.y = v.y + dy AND w.x = v.x + dx WHERE v.x % 5 = 0
""")
def dilated_voxels(spark, sf_dir):
    v = _blobs(spark, sf_dir)[0]
    return _longs(stencil.dilate(v.where("x % 5 = 0"), 1, v))


@query(f"WITH RECURSIVE {VOX}, {STENCIL}, {COMPONENTS} SELECT num.sv_id, z, y, x, comp FROM num JOIN cc ON cc.sv_id = num.sv_id AND cc.v = num.v")
def connected_components(spark, sf_dir):
    v, shape, _ = _blobs(spark, sf_dir)
    return _longs(stencil.components(v, shape))


@query(f"""
WITH RECURSIVE {VOX}, {STENCIL}, {COMPONENTS}, s AS (SELECT sv_id, comp, count(*) AS n FROM cc GROUP BY ALL)
SELECT sv_id, comp, n, n_components FROM (SELECT *, row_number() OVER (PARTITION BY sv_id ORDER BY n DESC, comp) AS i, count(*) OVER (PARTITION BY sv_id) AS n_components FROM s) WHERE i = 1
""")
def largest_components(spark, sf_dir):
    v, shape, _ = _blobs(spark, sf_dir)
    return stencil.largest_component(stencil.components(v, shape))


# --- distances ------------------------------------------------------------------------


@query(f"WITH {VOX}, {EDT} SELECT sv_id, z, y, x, CAST(d2 AS BIGINT) AS d2 FROM edt")
def squared_distance(spark, sf_dir):
    v, shape, _ = _blobs(spark, sf_dir)
    return _longs(distance.squared_distance(v, shape), "z", "y", "x", "d2")


@query(f"""
WITH {VOX}, {EDT}, n AS (SELECT *, sqrt(d2) / max(sqrt(d2)) OVER (PARTITION BY sv_id) AS dn FROM edt)
SELECT sv_id, z, y, x, round(1 / least(greatest(pow(dn, 1.6), 1e-6), 1), 6) AS cost, round(1 / (1e-6 + pow(dn, 2)), 6) AS ridge FROM n
""")
def cost_fields(spark, sf_dir):
    v, shape, _ = _blobs(spark, sf_dir)
    out = distance.cost_fields(distance.squared_distance(v, shape))
    return _longs(out, "z", "y", "x").withColumns({"cost": F.round("cost", 6), "ridge": F.round("ridge", 6)})


# --- joins with seeds ---------------------------------------------------------------------


@query(f"""
WITH {VOX}, {SEEDS}, m AS (
  SELECT s.sv_id, side, seed_idx, v.z AS vz, v.y AS vy, v.x AS vx, 9 * (v.z - s.z) * (v.z - s.z) + 4 * (v.y - s.y) * (v.y - s.y) + (v.x - s.x) * (v.x - s.x) AS d2, s.z, s.y, s.x
  FROM seed s JOIN vox v ON v.sv_id = s.sv_id WHERE v.x % 4 = 0
)
SELECT sv_id, CAST(side AS BIGINT) AS side, CAST(seed_idx AS BIGINT) AS seed_idx, vz, vy, vx, d2 FROM (SELECT *, row_number() OVER (PARTITION BY sv_id, side, seed_idx ORDER BY d2, vz, vy, vx) AS i FROM m) WHERE i = 1
""")
def nearest_voxels(spark, sf_dir):
    v, shape, seeds = _blobs(spark, sf_dir)
    return _longs(snap.nearest(seeds, v.where("x % 4 = 0"), shape).drop("z", "y", "x"))


@query(f"""
WITH {VOX}, {STENCIL}, {SEEDS}, n AS (
  SELECT a.sv_id, a.z, a.y, a.x, count(b.x) AS k FROM vox a, stencil s LEFT JOIN vox b ON b.sv_id = a.sv_id AND b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx GROUP BY ALL
), m AS (
  SELECT s.sv_id, side, seed_idx, v.z AS vz, v.y AS vy, v.x AS vx, 9 * (v.z - s.z) * (v.z - s.z) + 4 * (v.y - s.y) * (v.y - s.y) + (v.x - s.x) * (v.x - s.x) AS d2, s.z, s.y, s.x
  FROM seed s JOIN n v ON v.sv_id = s.sv_id AND k < 26
), w AS (SELECT *, row_number() OVER (PARTITION BY sv_id, side, seed_idx ORDER BY d2, vz, vy, vx) AS i FROM m)
SELECT sv_id, CAST(side AS BIGINT) AS side, count(*) FILTER (round_even(z, 0) <> vz OR round_even(y, 0) <> vy OR round_even(x, 0) <> vx) AS moved_count FROM w WHERE i = 1 GROUP BY sv_id, side
""")
def snapped_seeds(spark, sf_dir):
    """Seeds moved onto the boundary, counted by side."""
    v, shape, seeds = _blobs(spark, sf_dir)
    return _longs(snap.moved_count(snap.snap_seeds(seeds, v, shape, downsample=False)))


@query(f"""
WITH {SEEDS} SELECT a.sv_id, CAST(a.side AS BIGINT) AS side, CAST(a.seed_idx AS BIGINT) AS a, CAST(b.seed_idx AS BIGINT) AS b,
  9 * (a.z - b.z) * (a.z - b.z) + 4 * (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS d2
FROM seed a JOIN seed b ON a.sv_id = b.sv_id AND a.side = b.side AND a.seed_idx < b.seed_idx
""")
def seed_graph(spark, sf_dir):
    _, shape, seeds = _blobs(spark, sf_dir)
    return _longs(graph.seed_graph(seeds, shape))


@query(f"""
WITH RECURSIVE {SEEDS}, g AS (
  SELECT a.sv_id, a.side, a.seed_idx AS a, b.seed_idx AS b, 9 * (a.z - b.z) * (a.z - b.z) + 4 * (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS d2
  FROM seed a JOIN seed b ON a.sv_id = b.sv_id AND a.side = b.side AND a.seed_idx <> b.seed_idx
), t AS (
  SELECT sv_id, side, 0 AS step, CAST(NULL AS INTEGER) AS a, min(seed_idx) AS b, [min(seed_idx)] AS inside FROM seed GROUP BY sv_id, side
  UNION ALL
  SELECT sv_id, side, step + 1, a, b, list_append(inside, b) FROM (
    SELECT t.sv_id, t.side, t.step, t.inside, g.a, g.b, row_number() OVER (PARTITION BY t.sv_id, t.side ORDER BY g.d2, g.b, g.a) AS i
    FROM t JOIN g ON g.sv_id = t.sv_id AND g.side = t.side AND list_contains(t.inside, g.a) AND NOT list_contains(t.inside, g.b)
  ) WHERE i = 1
)
SELECT sv_id, CAST(side AS BIGINT) AS side, CAST(step AS BIGINT) AS step, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM t WHERE step > 0
""")
def seed_spanning_tree(spark, sf_dir):
    _, shape, seeds = _blobs(spark, sf_dir)
    return _longs(graph.spanning_tree(seeds, shape))


@query(f"""
WITH RECURSIVE {VOX}, {STENCIL}, {SEEDS}, num AS (SELECT *, (z * 24 + y) * 40 + x AS v FROM vox),
e AS (SELECT a.sv_id, a.v AS a, b.v AS b FROM num a, stencil s JOIN num b ON b.sv_id = a.sv_id AND b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx),
t(sv_id, side, v, d) USING KEY (sv_id, side, v) AS (
  SELECT num.sv_id, side, v, 0 FROM num JOIN seed ON seed.sv_id = num.sv_id AND num.z = floor(seed.z) AND num.y = floor(seed.y) AND num.x = floor(seed.x)
  UNION
  SELECT e.sv_id, t.side, e.b, min(t.d + 1) FROM t JOIN e ON e.sv_id = t.sv_id AND e.a = t.v LEFT JOIN recurring.t AS r ON r.sv_id = e.sv_id AND r.side = t.side AND r.v = e.b
  WHERE r.d IS NULL OR t.d + 1 < r.d GROUP BY e.sv_id, t.side, e.b
)
SELECT num.sv_id, z, y, x, CAST(coalesce(2 * a.d, -1) AS BIGINT) AS t_a, CAST(coalesce(2 * b.d, -1) AS BIGINT) AS t_b FROM num
LEFT JOIN t a ON a.sv_id = num.sv_id AND a.v = num.v AND a.side = 1 LEFT JOIN t b ON b.sv_id = num.sv_id AND b.v = num.v AND b.side = 2
""")
def arrival_times(spark, sf_dir):
    """Arrival from both sides over unit cost, -1 where there is no way; the mean voxel size is 2."""
    v, shape, seeds = _blobs(spark, sf_dir)
    placed = seeds.withColumns({a: F.floor(a) for a in "zyx"})
    return _longs(graph.arrival(v.withColumn("cost", F.lit(1.0)), placed, shape, "dj3d").fillna(-1, ["t_a", "t_b"]), "z", "y", "x", "t_a", "t_b")


# --- set operations and repair of labels -----------------------------------------------------


@query(f"""
WITH {VOX}, a AS (SELECT * FROM vox WHERE x % 2 = 0), b AS (SELECT * FROM vox WHERE y % 3 = 0),
u AS (SELECT 'union' AS op, * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersect', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b))
SELECT op, sv_id, count(*) AS n, CAST(sum((z * 24 + y) * 40 + x) AS BIGINT) AS total FROM u GROUP BY op, sv_id
""")
def set_operations(spark, sf_dir):
    v = _blobs(spark, sf_dir)[0]
    a, b = v.where("x % 2 = 0"), v.where("y % 3 = 0")
    parts = {"union": a.union(b).distinct(), "except": a.join(b, stencil.KEY, "left_anti"), "intersect": a.join(b, stencil.KEY, "left_semi")}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("op"), *stencil.KEY)
        out = part if out is None else out.unionByName(part)
    total = F.sum(axes.linear(F.col("z"), F.col("y"), F.col("x"), F.lit(24), F.lit(40)))
    return out.groupBy("op", "sv_id").agg(F.count("*").alias("n"), total.alias("total"))


STRAYS = VOX.replace("vox AS (", "foreground AS (").rstrip() + """, lab AS (
  SELECT *, CASE WHEN (x // 4 + y // 4) % 3 = 0 THEN 3 WHEN x < 20 THEN 1 ELSE 2 END AS label FROM foreground
), vox AS (SELECT sv_id, z, y, x FROM lab WHERE label = 3)"""


def _stray_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _blobs(spark, sf_dir)[0]
    stray = (F.floor(F.col("x") / 4) + F.floor(F.col("y") / 4)) % 3 == 0
    return v.withColumn("label", F.when(stray, 3).when(F.col("x") < 20, 1).otherwise(2).cast("tinyint"))


VOTE = """
touch AS (
  SELECT num.sv_id, cc.comp, num.v, bool_or(l.label = 1) AS a, bool_or(l.label = 2) AS b FROM num JOIN cc ON cc.sv_id = num.sv_id AND cc.v = num.v, stencil s
  LEFT JOIN lab l ON l.sv_id = num.sv_id AND l.z = num.z + s.dz AND l.y = num.y + s.dy AND l.x = num.x + s.dx AND l.label <> 3 GROUP BY ALL
), vote AS (
  SELECT sv_id, comp, count(*) AS n, count(*) FILTER (a) AS n_source, count(*) FILTER (b) AS n_sink FROM touch GROUP BY ALL
)"""


@query(f"""
WITH RECURSIVE {STRAYS}, {STENCIL}, {COMPONENTS}, {VOTE}
SELECT sv_id, comp, n, n_source, n_sink, CAST(CASE WHEN n_source > n_sink THEN 1 WHEN n_sink > n_source THEN 2 ELSE 0 END AS BIGINT) AS side FROM vote
""")
def border_votes(spark, sf_dir):
    return _longs(resolve.border_vote(_stray_labels(spark, sf_dir), _blobs(spark, sf_dir)[1]))


@query(f"""
WITH RECURSIVE {STRAYS}, {STENCIL}, {SEEDS}, {COMPONENTS}, near AS (
  SELECT num.sv_id, comp, num.v, min(CASE WHEN side = 1 THEN d END) AS a, min(CASE WHEN side = 2 THEN d END) AS b FROM (
    SELECT num.*, side, 9 * (num.z - s.z) * (num.z - s.z) + 4 * (num.y - s.y) * (num.y - s.y) + (num.x - s.x) * (num.x - s.x) AS d FROM num JOIN seed s ON s.sv_id = num.sv_id
  ) num JOIN cc ON cc.sv_id = num.sv_id AND cc.v = num.v GROUP BY ALL
)
SELECT sv_id, comp, CAST(CASE WHEN 2 * count(*) FILTER (b < a) > count(*) THEN 2 ELSE 1 END AS BIGINT) AS side FROM near WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL
""")
def nearest_sides(spark, sf_dir):
    v, shape, seeds = _blobs(spark, sf_dir)
    strays = stencil.components(_stray_labels(spark, sf_dir).where("label = 3").drop("label"), shape)
    return _longs(resolve.nearest_side(strays, seeds, shape))


def _components_of(k: int, label: int, labels: str) -> str:
    """Common tables that end in part{k}: the voxels of a label with their components."""
    named = COMPONENTS.replace("vox", f"vox{k}").replace("num", f"num{k}").replace("cc", f"cc{k}").replace("e AS", f"e{k} AS").replace("JOIN e ON e.", f"JOIN e{k} AS e ON e.")
    return f"""
vox{k} AS MATERIALIZED (SELECT sv_id, z, y, x FROM {labels} WHERE label = {label}),{named},
part{k} AS MATERIALIZED (SELECT v.sv_id, v.z, v.y, v.x, c.comp FROM num{k} v JOIN cc{k} c ON c.sv_id = v.sv_id AND c.v = v.v)"""


def _enforced(k: int, side: int, labels: str) -> str:
    """Common tables that keep the components of a side which hold its seeds, else the largest: lab{k} from ``labels``."""
    return f"""{_components_of(k, side, labels)},
size{k} AS (
  SELECT sv_id, comp, count(*) AS n, bool_or(EXISTS (FROM place s WHERE s.side = {side} AND s.sv_id = p.sv_id AND s.z = p.z AND s.y = p.y AND s.x = p.x)) AS seeded FROM part{k} p GROUP BY ALL
), kept{k} AS MATERIALIZED (
  SELECT sv_id, comp FROM (SELECT *, bool_or(seeded) OVER (PARTITION BY sv_id) AS any_seeded, row_number() OVER (PARTITION BY sv_id ORDER BY n DESC, comp) AS i FROM size{k}) WHERE CASE WHEN any_seeded THEN seeded ELSE i = 1 END
), lab{k} AS MATERIALIZED (
  SELECT l.sv_id, l.z, l.y, l.x, CASE WHEN l.label = {side} AND kept{k}.comp IS NULL THEN 3 ELSE l.label END AS label FROM {labels} l
  LEFT JOIN part{k} USING (sv_id, z, y, x) LEFT JOIN kept{k} USING (sv_id, comp)
)"""


@query(f"""
WITH RECURSIVE {STRAYS.replace("lab AS (", "lab AS MATERIALIZED (").split(", vox AS (")[0]}, {STENCIL}, {SEEDS},
place AS MATERIALIZED (SELECT sv_id, side, CAST(floor(z) AS BIGINT) AS z, CAST(floor(y) AS BIGINT) AS y, CAST(floor(x) AS BIGINT) AS x FROM seed), {_components_of(0, 3, "lab")},
touch AS (
  SELECT p.sv_id, comp, p.z, p.y, p.x, bool_or(l.label = 1) AS a, bool_or(l.label = 2) AS b FROM part0 p, stencil s
  LEFT JOIN lab l ON l.sv_id = p.sv_id AND l.z = p.z + s.dz AND l.y = p.y + s.dy AND l.x = p.x + s.dx AND l.label <> 3 GROUP BY ALL
), near AS (
  SELECT p.sv_id, comp, p.z, p.y, p.x, min(CASE WHEN side = 1 THEN d END) AS a, min(CASE WHEN side = 2 THEN d END) AS b FROM (
    SELECT p.*, s.side, 9 * (p.z - s.z) * (p.z - s.z) + 4 * (p.y - s.y) * (p.y - s.y) + (p.x - s.x) * (p.x - s.x) AS d FROM part0 p JOIN place s ON s.sv_id = p.sv_id
  ) p GROUP BY ALL
), nearer AS (
  SELECT sv_id, comp, CASE WHEN 2 * count(*) FILTER (b < a) > count(*) THEN 2 ELSE 1 END AS side FROM near WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL
), vote AS (SELECT sv_id, comp, count(*) FILTER (a) AS n_source, count(*) FILTER (b) AS n_sink FROM touch GROUP BY ALL
), chosen AS MATERIALIZED (
  SELECT sv_id, comp, CASE WHEN n_source > n_sink THEN 1 WHEN n_sink > n_source THEN 2 ELSE nearer.side END AS side FROM vote LEFT JOIN nearer USING (sv_id, comp)
), lab0 AS MATERIALIZED (
  SELECT lab.sv_id, lab.z, lab.y, lab.x, coalesce(chosen.side, label) AS label FROM lab LEFT JOIN part0 USING (sv_id, z, y, x) LEFT JOIN chosen USING (sv_id, comp)
), {_enforced(1, 1, 'lab0')}, {_enforced(2, 2, 'lab1')}
SELECT sv_id, count(*) FILTER (label = 1) AS n_source, count(*) FILTER (label = 2) AS n_sink, count(*) FILTER (label = 3) AS n_stray FROM lab2 GROUP BY sv_id
""")
def resolved_labels(spark, sf_dir):
    """Strays given to sides, then one component kept for each side."""
    _, shape, seeds = _blobs(spark, sf_dir)
    placed = seeds.withColumns({a: F.floor(a).cast("int") for a in "zyx"})
    out = resolve.resolve_strays(_stray_labels(spark, sf_dir), placed, shape)
    for side in (1, 2):
        out = resolve.enforce_components(out, placed, shape, side)
    return regions.histogram(out)


# --- splitters ----------------------------------------------------------------------------------


@query()
def geodesic_split(spark, sf_dir):
    """Final label counts of every fragment."""
    v, shape, seeds = _blobs(spark, sf_dir)
    return regions.histogram(splitters.GeodesicSplitter(backend="mcp").split(v, seeds, shape).labels)


@query()
def geodesic_split_dumbbell(spark, sf_dir):
    """Labels of a dumbbell for each region."""
    v, shape, seeds = volumes.dumbbells(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("sv_id")))
    return splitters.GeodesicSplitter(backend="mcp").split(v, seeds, shape).labels


@query()
def ridge_seeds(spark, sf_dir):
    v, shape, seeds = _blobs(spark, sf_dir)
    return splitters.RidgeConnectPrep().prepare(v, seeds, shape).seeds.groupBy("sv_id", "side").agg(F.count("*").alias("n"))


@query()
def watershed_split(spark, sf_dir):
    v, shape, seeds = _blobs(spark, sf_dir)
    return regions.histogram(splitters.WatershedSplitter().split(v, seeds, shape).labels)
