"""Queries of searches, ridges and whole splits over fragments that grow with the supplier table, and the SQL they equal.

Costs use exponents of 1 and 2, whose products are exact, so that both engines
compare the same sums. The SQL is dense where paths cross background.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import distance, graph, labels, regions, resolve, ridge, snap, stencil
from .plans.fixpoint import cut
from .plans.splitters import GeodesicSplitter, RidgeConnectPrep
from .registry import SEEDS, SQL, STENCIL, VOX, _blobs, _components_of, _enforced, _longs, query
from .sources import chunks, volumes

EXACT = {"downsample": False}
SUPPLIERS = "FROM (SELECT s_suppkey AS n_nationkey, s_suppkey // 5 AS n_regionkey FROM supplier) AS nation"
VOXELS = VOX.replace("FROM nation", SUPPLIERS).replace("vox AS (", "vox AS MATERIALIZED (")
POINTS = SEEDS.replace("FROM nation", SUPPLIERS)


def _fragments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Balls, a fragment for each five suppliers; volumes; a seed for each supplier."""
    key = F.col("s_suppkey").cast("long")
    named = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key.alias("n_nationkey"), F.floor(key / 5).alias("n_regionkey"))
    return volumes.nation_blobs(named), volumes.blob_volumes(named), volumes.blob_seeds(named)


def _snapped(v: DataFrame, shape: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fragments with their seeds on the boundary, both written once: each is used many times."""
    v = cut(v)
    placed = seeds.withColumns({a: F.rint(a) for a in "zyx"})
    found = snap.snap_seeds(placed, v, shape, **EXACT)
    return v, shape, cut(found.select("sv_id", "side", "seed_idx", *(F.col(f"v{a}").alias(a) for a in "zyx")))


SNAPPED = """
bnd AS MATERIALIZED (
  SELECT a.sv_id, a.z, a.y, a.x FROM vox a, stencil s LEFT JOIN vox b ON b.sv_id = a.sv_id AND b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx GROUP BY ALL HAVING count(b.x) < 26
), place AS MATERIALIZED (
  SELECT sv_id, side, seed_idx, z, y, x FROM (
    SELECT s.sv_id, side, seed_idx, v.z, v.y, v.x, row_number() OVER (PARTITION BY s.sv_id, side, seed_idx ORDER BY 9 * (v.z - s.z) * (v.z - s.z) + 4 * (v.y - s.y) * (v.y - s.y) + (v.x - s.x) * (v.x - s.x), v.z, v.y, v.x) AS i
    FROM (SELECT sv_id, side, seed_idx, round_even(z, 0) AS z, round_even(y, 0) AS y, round_even(x, 0) AS x FROM seed) s JOIN bnd v ON v.sv_id = s.sv_id
  ) WHERE i = 1
)"""


def _edt(voxels: str, shape: tuple[int, int, int], weights: tuple[int, int, int]) -> str:
    """edt: squared distances; the nearest background always lies beside a voxel."""
    return f"""
shell AS MATERIALIZED (
  SELECT DISTINCT v.sv_id, v.z + dz AS z, v.y + dy AS y, v.x + dx AS x FROM {voxels} v, stencil
  ANTI JOIN {voxels} w ON w.sv_id = v.sv_id AND w.z = v.z + dz AND w.y = v.y + dy AND w.x = v.x + dx
  WHERE v.z + dz BETWEEN 0 AND {shape[0] - 1} AND v.y + dy BETWEEN 0 AND {shape[1] - 1} AND v.x + dx BETWEEN 0 AND {shape[2] - 1}
), edt AS MATERIALIZED (
  SELECT v.sv_id, v.z, v.y, v.x, CAST(min({weights[2]} * (v.x - b.x) * (v.x - b.x) + {weights[1]} * (v.y - b.y) * (v.y - b.y) + {weights[0]} * (v.z - b.z) * (v.z - b.z)) AS DOUBLE) AS d2
  FROM {voxels} v JOIN shell b ON b.sv_id = v.sv_id GROUP BY ALL
), dist AS MATERIALIZED (SELECT sv_id, z, y, x, sqrt(d2) / sqrt(max(d2) OVER (PARTITION BY sv_id)) AS dn FROM edt)"""


ARRIVAL = """
num AS MATERIALIZED (SELECT *, (z * 24 + y) * 40 + x AS v FROM grid),
e AS MATERIALIZED (
  SELECT a.sv_id, a.v AS a, b.v AS b, 0.5 * (a.cost + b.cost) * sqrt((dz * 3.0 * a.kz) * (dz * 3.0 * a.kz) + (dy * 2.0 * a.ky) * (dy * 2.0 * a.ky) + (dx * 1.0 * a.kx) * (dx * 1.0 * a.kx)) AS w
  FROM num a, stencil s JOIN num b ON b.sv_id = a.sv_id AND b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx
),
t(sv_id, search, v, d) USING KEY (sv_id, search, v) AS (
  SELECT DISTINCT num.sv_id, search, v, CAST(0 AS DOUBLE) FROM num JOIN origin USING (sv_id, z, y, x)
  UNION
  SELECT e.sv_id, t.search, e.b, min(t.d + e.w) FROM t JOIN e ON e.sv_id = t.sv_id AND e.a = t.v LEFT JOIN recurring.t AS r ON r.sv_id = e.sv_id AND r.search = t.search AND r.v = e.b
  WHERE r.d IS NULL OR t.d + e.w < r.d GROUP BY e.sv_id, t.search, e.b
)"""
FINE = "grid AS MATERIALIZED (SELECT sv_id, z, y, x, 1.0 / least(greatest(dn, 1e-6), 1.0) AS cost, 1 AS kz, 1 AS ky, 1 AS kx, true AS inside FROM dist)"
SIDES = "origin AS MATERIALIZED (SELECT DISTINCT sv_id, side AS search, z, y, x FROM place)"
WHOLE = (16, 24, 40), (9, 4, 1)
#: Up to t: arrivals from both sides' snapped seeds over the cost of all voxels.
TIMES = f"{VOXELS}, {STENCIL}, {POINTS}, {SNAPPED}, {_edt('vox', *WHOLE)}, {FINE}, {SIDES}, {ARRIVAL}"


def _cost(v: DataFrame, shape: DataFrame) -> DataFrame:
    return cut(distance.cost_fields(cut(distance.squared_distance(v, shape)), 1.0).select("sv_id", "z", "y", "x", "cost"))


def _arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, shape, seeds = _snapped(*_fragments(spark, sf_dir))
    return cut(graph.arrival(_cost(v, shape), seeds, shape, "mcp")), seeds


@query(f"""
WITH RECURSIVE {TIMES}
SELECT num.sv_id, num.z, num.y, num.x, round(a.d, 6) AS t_a, round(b.d, 6) AS t_b FROM num
LEFT JOIN t a ON a.sv_id = num.sv_id AND a.v = num.v AND a.search = 1 LEFT JOIN t b ON b.sv_id = num.sv_id AND b.v = num.v AND b.search = 2
WHERE a.d IS NOT NULL AND b.d IS NOT NULL
""")
def arrival_over_cost(spark, sf_dir):
    """Arrivals by the mean cost of both ends, at voxels that both sides reach."""
    out, _ = _arrivals(spark, sf_dir)
    return _longs(out.where("t_a IS NOT NULL AND t_b IS NOT NULL"), "z", "y", "x").withColumns({c: F.round(c, 6) for c in ("t_a", "t_b")})


def _labelled(grid: str = "num") -> str:
    """mark: labels of the grid from t, seeds forced; band decided by fragment."""
    return f"""
arr AS MATERIALIZED (
  SELECT n.sv_id, n.z, n.y, n.x, coalesce(a.d, CAST('inf' AS DOUBLE)) AS ta, coalesce(b.d, CAST('inf' AS DOUBLE)) AS tb FROM {grid} n
  LEFT JOIN t a ON a.sv_id = n.sv_id AND a.v = n.v AND a.search = 1 LEFT JOIN t b ON b.sv_id = n.sv_id AND b.v = n.v AND b.search = 2 WHERE n.inside
), core AS MATERIALIZED (SELECT sv_id, z, y, x FROM arr WHERE isfinite(ta) AND isfinite(tb) AND abs(ta - tb) / (ta + tb + 1e-12) <= 0.08),
band AS MATERIALIZED (
  SELECT DISTINCT a.sv_id, a.z, a.y, a.x FROM arr a, (SELECT * FROM stencil WHERE abs(dz) + abs(dy) + abs(dx) = 1 UNION ALL SELECT 0, 0, 0) o
  JOIN core c ON c.sv_id = a.sv_id AND c.z = a.z + o.dz AND c.y = a.y + o.dy AND c.x = a.x + o.dx
), wide AS MATERIALIZED (SELECT sv_id FROM band GROUP BY sv_id HAVING count(*) >= 64), mark AS MATERIALIZED (
  SELECT a.sv_id, a.z, a.y, a.x, coalesce(o.search, CASE WHEN CASE WHEN w.sv_id IS NULL OR b.sv_id IS NOT NULL THEN ta / (1 + 2 * exp(-greatest(tb, 0))) <= tb / (1 + 2 * exp(-greatest(ta, 0))) ELSE ta <= tb END THEN 1 ELSE 2 END) AS label
  FROM arr a LEFT JOIN band b USING (sv_id, z, y, x) LEFT JOIN wide w ON w.sv_id = a.sv_id LEFT JOIN (SELECT sv_id, z, y, x, max(search) AS search FROM origin GROUP BY ALL) o USING (sv_id, z, y, x)
)"""


@query(f"WITH RECURSIVE {TIMES}, {_labelled()} SELECT sv_id, z, y, x, CAST(label AS BIGINT) AS label FROM mark")
def grid_labels(spark, sf_dir):
    """Labels of all voxels from real arrivals; each fragment decides if its band is wide enough."""
    times, seeds = _arrivals(spark, sf_dir)
    return _longs(regions.force_seeds(labels.grid_labels(times), seeds))


def _resolved(k: int, source: str) -> str:
    """Common tables that give the strays of ``source`` to sides: lab{k}."""
    return f"""{_components_of(k, 3, source)},
touch{k} AS (
  SELECT p.sv_id, comp, p.z, p.y, p.x, bool_or(l.label = 1) AS a, bool_or(l.label = 2) AS b FROM part{k} p, stencil s
  LEFT JOIN {source} l ON l.sv_id = p.sv_id AND l.z = p.z + s.dz AND l.y = p.y + s.dy AND l.x = p.x + s.dx AND l.label <> 3 GROUP BY ALL
), near{k} AS (
  SELECT p.sv_id, comp, p.z, p.y, p.x, min(CASE WHEN side = 1 THEN d END) AS a, min(CASE WHEN side = 2 THEN d END) AS b FROM (
    SELECT p.*, s.side, 9 * (p.z - s.z) * (p.z - s.z) + 4 * (p.y - s.y) * (p.y - s.y) + (p.x - s.x) * (p.x - s.x) AS d FROM part{k} p JOIN place s ON s.sv_id = p.sv_id
  ) p GROUP BY ALL
), nearer{k} AS (
  SELECT sv_id, comp, CASE WHEN 2 * count(*) FILTER (b < a) > count(*) THEN 2 ELSE 1 END AS side FROM near{k} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL
), vote{k} AS (SELECT sv_id, comp, count(*) FILTER (a) AS n_source, count(*) FILTER (b) AS n_sink FROM touch{k} GROUP BY ALL
), chosen{k} AS MATERIALIZED (
  SELECT sv_id, comp, CASE WHEN n_source > n_sink THEN 1 WHEN n_sink > n_source THEN 2 ELSE n.side END AS side FROM vote{k} LEFT JOIN nearer{k} n USING (sv_id, comp)
), lab{k} AS MATERIALIZED (
  SELECT l.sv_id, l.z, l.y, l.x, max(coalesce(c.side, l.label)) AS label FROM {source} l LEFT JOIN part{k} USING (sv_id, z, y, x) LEFT JOIN chosen{k} c USING (sv_id, comp) GROUP BY ALL
)"""


def _again(k: int) -> str:
    """once{k}: lab{k} grouped, as DuckDB fails to pass some of its encoded columns on from one recursion to the next."""
    return f"once{k} AS MATERIALIZED (SELECT sv_id, z, y, x, max(label) AS label FROM lab{k} GROUP BY ALL)"


#: Enforced, resolved, enforced again; what didn't move stays as it is when enforced again.
REPAIRED = ", ".join((_enforced(1, 1, "first"), _again(1), _enforced(2, 2, "once1"), _again(2), _resolved(3, "once2"), _enforced(4, 1, "lab3"), _again(4), _enforced(5, 2, "once4"), _again(5)))
#: The longest statements run over the five fragments of the nation table, as a recursion over all suppliers' takes minutes.
NATION = f"{VOX.replace('vox AS (', 'vox AS MATERIALIZED (')}, {STENCIL}, {SEEDS}, {SNAPPED}"
COUNTS = "sv_id, count(*) FILTER (label = 1) AS n_source, count(*) FILTER (label = 2) AS n_sink, count(*) FILTER (label = 3) AS n_stray"


@query(f"""
WITH RECURSIVE {NATION},
first AS MATERIALIZED (SELECT sv_id, z, y, x, 1 + CAST((x // 3 + y // 5) % 4 = 0 OR (x // 4 + z // 3) % 3 = 0 AS BIGINT) AS label FROM vox), {REPAIRED}
SELECT sv_id, z, y, x, CAST(label AS BIGINT) AS label FROM once5
""")
def repaired_labels(spark, sf_dir):
    """Components enforced, strays resolved, components enforced again where strays moved."""
    v, shape, seeds = _snapped(*_blobs(spark, sf_dir))
    stripes = ((F.floor(F.col("x") / 3) + F.floor(F.col("y") / 5)) % 4 == 0) | ((F.floor(F.col("x") / 4) + F.floor(F.col("z") / 3)) % 3 == 0)
    return _longs(resolve.repair(v.withColumn("label", F.when(stripes, 2).otherwise(1).cast("tinyint")), seeds, shape).labels)


@query(f"WITH RECURSIVE {NATION}, {_edt('vox', *WHOLE)}, {FINE}, {SIDES}, {ARRIVAL}, {_labelled()}, first AS MATERIALIZED (SELECT * FROM mark), {REPAIRED} SELECT {COUNTS} FROM once5 GROUP BY sv_id")
def geodesic_split_plain(spark, sf_dir):
    """The whole split without preparation: label counts of every fragment."""
    v, shape, seeds = _blobs(spark, sf_dir)
    return regions.histogram(GeodesicSplitter(backend="mcp", seed_prep="none", gamma_neck=1.0, snap=EXACT).split(v, seeds, shape).labels)


def _coarse(kz: int, ky: int, kx: int) -> str:
    """grid and origin of each fragment: every k-th cell of its box with background, or all if a side's seeds all miss."""
    steps = f"{kz} AS kz, {ky} AS ky, {kx} AS kx"
    on = f"(z - z0) % {kz} = 0 AND (y - y0) % {ky} = 0 AND (x - x0) % {kx} = 0"
    return f"""
box AS MATERIALIZED (
  SELECT sv_id, greatest(0, min(z) - 1) AS z0, greatest(0, min(y) - 1) AS y0, greatest(0, min(x) - 1) AS x0, least(16, max(z) + 2) AS z1, least(24, max(y) + 2) AS y1, least(40, max(x) + 2) AS x1 FROM vox GROUP BY sv_id
), every AS MATERIALIZED (
  SELECT sv_id, z, y, x, z0, y0, x0, coalesce(1.0 / least(greatest(dn, 1e-6), 1.0), 1e12) AS cost, dn IS NOT NULL AS inside
  FROM (SELECT box.*, CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM box, range(16) AS gz(z), range(24) AS gy(y), range(40) AS gx(x) WHERE z >= z0 AND z < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1) LEFT JOIN dist USING (sv_id, z, y, x)
), low AS MATERIALIZED (
  SELECT DISTINCT p.sv_id, p.side, (p.z - z0) // {kz} AS z, (p.y - y0) // {ky} AS y, (p.x - x0) // {kx} AS x FROM place p JOIN box USING (sv_id)
  SEMI JOIN (SELECT sv_id, (z - z0) // {kz} AS z, (y - y0) // {ky} AS y, (x - x0) // {kx} AS x FROM every WHERE inside AND {on}) c ON c.sv_id = p.sv_id AND c.z = (p.z - z0) // {kz} AND c.y = (p.y - y0) // {ky} AND c.x = (p.x - x0) // {kx}
), ok AS MATERIALIZED (SELECT sv_id FROM low GROUP BY sv_id HAVING count(DISTINCT side) = 2), grid AS MATERIALIZED (
  SELECT sv_id, (z - z0) // {kz} AS z, (y - y0) // {ky} AS y, (x - x0) // {kx} AS x, cost, {steps}, inside FROM every SEMI JOIN ok USING (sv_id) WHERE {on}
  UNION ALL SELECT sv_id, z - z0, y - y0, x - x0, cost, 1, 1, 1, inside FROM every ANTI JOIN ok USING (sv_id)
), origin AS MATERIALIZED (
  SELECT sv_id, side AS search, z, y, x FROM low SEMI JOIN ok USING (sv_id)
  UNION SELECT sv_id, side, z - z0, y - y0, x - x0 FROM place JOIN box USING (sv_id) ANTI JOIN ok USING (sv_id)
)"""


STEPS = (2, 2, 3)


@query(f"""
WITH RECURSIVE {NATION}, {_edt('vox', *WHOLE)}, {_coarse(*STEPS)}, {ARRIVAL}, {_labelled()},
forced AS MATERIALIZED (SELECT sv_id, z, y, x, max(side) AS side FROM place GROUP BY ALL), first AS MATERIALIZED (
  SELECT v.sv_id, v.z, v.y, v.x, max(CASE WHEN coalesce(f.side, m.label, 1) = 2 THEN 2 ELSE 1 END) AS label FROM vox v JOIN box USING (sv_id) LEFT JOIN ok USING (sv_id)
  LEFT JOIN mark m ON m.sv_id = v.sv_id AND m.z = (v.z - z0) // CASE WHEN ok.sv_id IS NULL THEN 1 ELSE {STEPS[0]} END AND m.y = (v.y - y0) // CASE WHEN ok.sv_id IS NULL THEN 1 ELSE {STEPS[1]} END AND m.x = (v.x - x0) // CASE WHEN ok.sv_id IS NULL THEN 1 ELSE {STEPS[2]} END
  LEFT JOIN forced f ON f.sv_id = v.sv_id AND f.z = v.z AND f.y = v.y AND f.x = v.x GROUP BY ALL
), {REPAIRED} SELECT {COUNTS} FROM once5 GROUP BY sv_id
""")
def coarse_split(spark, sf_dir):
    """The split on a coarse grid; fragments of which that grid loses a side take the fine one in the same run."""
    v, shape, seeds = _blobs(spark, sf_dir)
    return regions.histogram(GeodesicSplitter(backend="mcp", seed_prep="none", gamma_neck=1.0, snap=EXACT, downsample_geodesic=STEPS).split(v, seeds, shape).labels)


#: The padded box around the seeds is the whole volume; every second plane and line of it, with its ridge cost.
RIDGE = f"""{VOXELS}, {STENCIL}, {POINTS}, {SNAPPED},
coarse AS MATERIALIZED (SELECT sv_id, z // 2 AS z, y // 2 AS y, x FROM vox WHERE z % 2 = 0 AND y % 2 = 0),
{_edt('coarse', (8, 12, 40), (36, 16, 1))}, grid AS MATERIALIZED (
  SELECT sv_id, z, y, x, coalesce(1.0 / (1e-6 + dn * dn), 1e12) AS cost, 2 AS kz, 2 AS ky, 1 AS kx FROM (SELECT sv_id, CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM (SELECT DISTINCT sv_id FROM coarse), range(8) AS gz(z), range(12) AS gy(y), range(40) AS gx(x)) LEFT JOIN dist USING (sv_id, z, y, x)
), spot AS MATERIALIZED (
  SELECT sv_id, side, seed_idx, z, y, x FROM (
    SELECT s.sv_id, side, seed_idx, c.z, c.y, c.x, row_number() OVER (PARTITION BY s.sv_id, side, seed_idx ORDER BY 36 * (c.z - s.z / 2) * (c.z - s.z / 2) + 16 * (c.y - s.y / 2) * (c.y - s.y / 2) + (c.x - s.x) * (c.x - s.x), c.z, c.y, c.x) AS i FROM place s JOIN coarse c ON c.sv_id = s.sv_id
  ) WHERE i = 1
), gap AS MATERIALIZED (
  SELECT a.sv_id, a.side, a.seed_idx AS a, b.seed_idx AS b, 36 * (a.z - b.z) * (a.z - b.z) + 16 * (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS d2 FROM spot a JOIN spot b ON a.sv_id = b.sv_id AND a.side = b.side AND a.seed_idx <> b.seed_idx
), tree AS (
  SELECT sv_id, side, 0 AS step, CAST(NULL AS INTEGER) AS a, CAST(min(seed_idx) AS INTEGER) AS b, [min(seed_idx)] AS held FROM spot GROUP BY sv_id, side
  UNION ALL
  SELECT sv_id, side, step + 1, a, b, list_append(held, b) FROM (
    SELECT tree.sv_id, tree.side, tree.step, tree.held, gap.a, gap.b, row_number() OVER (PARTITION BY tree.sv_id, tree.side ORDER BY gap.d2, gap.b, gap.a) AS i
    FROM tree JOIN gap ON gap.sv_id = tree.sv_id AND gap.side = tree.side AND list_contains(tree.held, gap.a) AND NOT list_contains(tree.held, gap.b)
  ) WHERE i = 1
), link AS MATERIALIZED (SELECT sv_id, side, side * CAST(4294967296 AS BIGINT) + step AS search, a, b FROM tree WHERE step > 0),
origin AS MATERIALIZED (SELECT l.sv_id, search, s.z, s.y, s.x FROM link l JOIN spot s ON s.sv_id = l.sv_id AND s.side = l.side AND s.seed_idx = l.a), {ARRIVAL},
prior AS MATERIALIZED (
  SELECT h.sv_id, h.search, h.v, arg_min(p.v, (p.d + e.w, p.v)) AS p FROM t h JOIN e ON e.sv_id = h.sv_id AND e.b = h.v JOIN t p ON p.sv_id = h.sv_id AND p.search = h.search AND p.v = e.a AND p.d < h.d GROUP BY ALL
), way AS (
  SELECT l.sv_id, search, n.v FROM link l JOIN spot s ON s.sv_id = l.sv_id AND s.side = l.side AND s.seed_idx = l.b JOIN num n ON n.sv_id = s.sv_id AND n.z = s.z AND n.y = s.y AND n.x = s.x
  UNION ALL SELECT w.sv_id, w.search, p.p FROM way w JOIN prior p ON p.sv_id = w.sv_id AND p.search = w.search AND p.v = w.v
)"""


def _ridge_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v, shape, seeds = _snapped(*_fragments(spark, sf_dir))
    boxes = regions.padded_box(seeds, shape, (24, 48, 48))
    coarse, wide = cut(regions.stride(regions.crop(v, boxes), (2, 2, 1))), cut(regions.box_volumes(boxes, shape, (2, 2, 1)))
    return coarse, cut(regions.seeds_near_grid(seeds, (2, 2, 1), coarse, shape)), wide


@query(f"WITH RECURSIVE {RIDGE} SELECT DISTINCT w.sv_id, CAST(w.search // CAST(4294967296 AS BIGINT) AS BIGINT) AS side, w.search, n.z, n.y, n.x FROM way w JOIN num n ON n.sv_id = w.sv_id AND n.v = w.v")
def least_paths(spark, sf_dir):
    """Cells of the least ridge paths along each side's spanning tree, some of them over background."""
    return _longs(ridge.ridge_paths(*_ridge_grid(spark, sf_dir)))


AUGMENTED = """covered AS MATERIALIZED (
  SELECT DISTINCT v.sv_id, w.side, v.z, v.y, v.x FROM vox v JOIN (SELECT DISTINCT w.sv_id, w.search // CAST(4294967296 AS BIGINT) AS side, n.z, n.y, n.x FROM way w JOIN num n ON n.sv_id = w.sv_id AND n.v = w.v) w ON w.sv_id = v.sv_id AND w.z = v.z // 2 AND w.y = v.y // 2 AND w.x = v.x
), grown AS MATERIALIZED (
  SELECT sv_id, CAST(side AS BIGINT) AS side, z, y, x FROM place
  UNION SELECT v.sv_id, CAST(c.side AS BIGINT), v.z, v.y, v.x FROM vox v, (SELECT * FROM stencil WHERE abs(dz) + abs(dy) + abs(dx) = 1 UNION ALL SELECT 0, 0, 0) o JOIN covered c ON c.sv_id = v.sv_id AND c.z = v.z + o.dz AND c.y = v.y + o.dy AND c.x = v.x + o.dx
)"""
SQL["ridge_seeds"] = f"WITH RECURSIVE {RIDGE.replace(SUPPLIERS, 'FROM nation')}, {AUGMENTED} SELECT sv_id, CAST(side AS TINYINT) AS side, count(*) AS n FROM grown GROUP BY ALL"


@query(f"WITH RECURSIVE {RIDGE}, {AUGMENTED} SELECT * FROM grown")
def augmented_seeds(spark, sf_dir):
    """Seeds of either side with the voxels of the ridge paths that join them."""
    v, shape, seeds = _fragments(spark, sf_dir)
    v = cut(v)
    return _longs(RidgeConnectPrep(snap=EXACT).prepare(v, seeds, shape).seeds)


@query(f"WITH {VOXELS} SELECT * FROM vox")
def voxels_from_chunks(spark, sf_dir):
    """Voxels through packed chunks and back, every chunk laid out x first."""
    return _longs(chunks.from_chunks(cut(chunks.to_chunks(_fragments(spark, sf_dir)[0], 16, "xyz"))))


# --- operators that had no query, or one that compared sizes alone ----------------------------------


@query(f"""
WITH {VOXELS}, r AS (SELECT *, row_number() OVER (PARTITION BY sv_id ORDER BY md5('7,' || sv_id || ',' || z || ',' || y || ',' || x)) AS i FROM vox)
SELECT sv_id, z, y, x FROM r WHERE i <= 200
""")
def drawn_voxels(spark, sf_dir):
    """A uniform sample of 200 voxels of each fragment, which ones included."""
    return _longs(regions.sample(_fragments(spark, sf_dir)[0], 200, seed=7))


@query(f"""
WITH {VOXELS}, {STENCIL}, one AS MATERIALIZED (
  SELECT a.sv_id, a.z, a.y, a.x FROM vox a, stencil s JOIN vox b ON b.sv_id = a.sv_id AND b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx GROUP BY ALL HAVING count(*) = 26
), two AS (SELECT a.sv_id, a.z, a.y, a.x FROM one a, stencil s JOIN one b ON b.sv_id = a.sv_id AND b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx GROUP BY ALL HAVING count(*) = 26)
SELECT * FROM vox ANTI JOIN two USING (sv_id, z, y, x)
""")
def boundary_two_deep(spark, sf_dir):
    """Voxels that two rounds of erosion remove."""
    return _longs(stencil.boundary(_fragments(spark, sf_dir)[0], 2))


@query(f"""
WITH {VOXELS}, {POINTS}, thin AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sv_id ORDER BY z, y, x) AS i FROM vox) WHERE (i - 1) % 3 = 0)
SELECT sv_id, CAST(side AS BIGINT) AS side, CAST(seed_idx AS BIGINT) AS seed_idx, vz, vy, vx, moved FROM (
  SELECT s.sv_id, side, seed_idx, v.z AS vz, v.y AS vy, v.x AS vx, round_even(s.z, 0) <> v.z OR round_even(s.y, 0) <> v.y OR round_even(s.x, 0) <> v.x AS moved,
    row_number() OVER (PARTITION BY s.sv_id, side, seed_idx ORDER BY 9 * (v.z - s.z) * (v.z - s.z) + 4 * (v.y - s.y) * (v.y - s.y) + (v.x - s.x) * (v.x - s.x), v.z, v.y, v.x) AS i FROM seed s JOIN thin v ON v.sv_id = s.sv_id
) WHERE i = 1
""")
def snapped_to_every_third(spark, sf_dir):
    """Seeds on the nearest of every third voxel, within a window around them."""
    v, shape, seeds = _fragments(spark, sf_dir)
    out = snap.snap_seeds(seeds, v, shape, use_boundary=False, downsample_stride=3, use_bbox=True)
    return _longs(out.select("sv_id", "side", "seed_idx", "vz", "vy", "vx", "moved"))


@query(f"""
WITH {VOXELS}, {POINTS}, coarse AS MATERIALIZED (SELECT sv_id, z // 2 AS z, y // 2 AS y, x // 3 AS x FROM vox WHERE z % 2 = 0 AND y % 2 = 0 AND x % 3 = 0)
SELECT p.sv_id, CAST(side AS BIGINT) AS side, CAST(seed_idx AS BIGINT) AS seed_idx, p.z, p.y, p.x FROM (SELECT sv_id, side, seed_idx, CAST(floor(z / 2) AS BIGINT) AS z, CAST(floor(y / 2) AS BIGINT) AS y, CAST(floor(x / 3) AS BIGINT) AS x FROM seed) p
SEMI JOIN coarse c ON c.sv_id = p.sv_id AND c.z = p.z AND c.y = p.y AND c.x = p.x
""")
def seeds_on_coarse_grid(spark, sf_dir):
    """Seeds by integer division on a coarse grid, where they meet its foreground."""
    v, _, seeds = _fragments(spark, sf_dir)
    return _longs(regions.seeds_on_grid(seeds, (2, 2, 3), regions.stride(v, (2, 2, 3))).select("sv_id", "side", "seed_idx", "z", "y", "x"))


@query(f"""
WITH {VOXELS}, {STENCIL} SELECT DISTINCT sv_id, z + dz AS z, y + dy AS y, x + dx AS x FROM vox, stencil WHERE z + dz BETWEEN 0 AND 15 AND y + dy BETWEEN 0 AND 23 AND x + dx BETWEEN 0 AND 39
""")
def places_beside(spark, sf_dir):
    """Places beside voxels that lie in the volume."""
    v, shape, _ = _fragments(spark, sf_dir)
    return _longs(stencil.places_in_volume(v, shape))

