"""Registered queries of the engine over the shared tables, and DuckDB SQL for those that it can express.

E is ``embeddings`` as a matrix, L four scaled columns of ``lineitem`` with rows in no order that matters.
Results are cells or scalars, rounded alike on both sides, so that the order of sums doesn't show.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import MatrixFrame, shared_folder
from .functions import kernels, metrics, prep
from .functions.losses import Loss, Regularizer
from .operators import admm as admm_
from .operators import kmeans as km
from .operators import linalg as la
from .operators import solvers, svd
from .plans import physical
from .sources import synthetic
from .sources.readers import parse_libsvm_line, read_csv, read_libsvm, read_parquet, write_label_pairs, write_parquet

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CELLS = """cells AS (SELECT vec_id AS row_id, CAST(i - 1 AS BIGINT) AS col_id, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, range(1, 65) t(i))"""
SCALED = "l_quantity / 50 AS q, l_extendedprice / 100000 AS p, l_discount * 10 AS d, l_tax * 10 AS t"


def solved(name: str, width: str) -> str:
    """CTEs that eliminate, from ``{name}(i, l)``, rows of a square matrix and right-hand sides behind it, all but
    those sides: ``{name}_x(i, l)``. The matrix is positive definite, so rows needn't be exchanged."""
    return f"""{name}_n AS (SELECT {width} AS n),
  {name}_0 AS (SELECT list(l ORDER BY i) AS m FROM {name}),
  {name}_g AS (SELECT CAST(1 AS BIGINT) AS k, m, m[1] AS p FROM {name}_0 UNION ALL
    SELECT k + 1, nm, nm[k + 1] FROM (SELECT k, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(p, lambda x: x / p[k])
      ELSE list_transform(list_zip(r, p), lambda z: z[1] - z[2] * (r[k] / p[k])) END) AS nm FROM {name}_g WHERE k <= {width})),
  {name}_x AS (SELECT i, m[i][{width} + 1:] AS l FROM {name}_g, range(1, {width} + 1) t(i) WHERE k = {width} + 1)"""


def weights(w: np.ndarray, phase: np.ndarray | None = None) -> str:
    """A CTE ``w(k, w, phase)``: the rows of a feature map's seeded weights, which SQL can't draw."""
    phase = np.zeros(len(w)) if phase is None else phase
    rows = ", ".join(f"({k}, [{', '.join(map(repr, map(float, r)))}], {float(p)!r})" for k, (r, p) in enumerate(zip(w, phase, strict=True)))
    return f"w AS (SELECT CAST(k AS BIGINT) AS k, CAST(w AS DOUBLE[]) AS w, CAST(phase AS DOUBLE) AS phase FROM (VALUES {rows}) t(k, w, phase))"


def cosines(n: int, sigma: str = "1.0", of: str = "CAST(embedding AS DOUBLE[])") -> str:
    return f"sqrt(2.0 / {n}) * cos(list_dot_product({of}, w) / {sigma} + phase)"


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark, sf_dir) -> MatrixFrame:
    return MatrixFrame.from_df(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", check=False)


def labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("row_id"), F.col("label").cast("long").alias("label"))


def label_matrix(spark, sf_dir) -> MatrixFrame:
    return MatrixFrame(labels(spark, sf_dir).select("row_id", F.array(F.col("label").cast("double")).alias("features")))


def lineitem(spark, sf_dir) -> MatrixFrame:
    """Row ids only tell rows apart; sums over rows don't depend on them."""
    df = table(spark, sf_dir, "lineitem")
    f = F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return MatrixFrame(df.select(F.monotonically_increasing_id().alias("row_id"), f.alias("features")))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def cells(a: MatrixFrame, digits: int = 6) -> DataFrame:
    return rounded(a.to_coo(), "value", digits=digits)


def row(spark, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


# -- shape, norms, statistics


@query("SELECT count(*) AS n_rows, CAST(max(len(embedding)) AS BIGINT) AS n_cols FROM embeddings")
def dims(spark, sf_dir):
    """Counted where ids and rows are checked as well."""
    n, m = MatrixFrame.from_df(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").dims()
    return row(spark, n_rows=n, n_cols=m)


@query(f"WITH {CELLS} SELECT round(sqrt(sum(value * value)), 6) AS norm FROM cells")
def frobenius_norm(spark, sf_dir):
    return la.squared_norm(embeddings(spark, sf_dir)).select(F.round(F.sqrt("squared_norm"), 6).alias("norm"))


@query(f"""WITH {CELLS} SELECT col_id, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS variance,
  round(max(abs(value)), 6) AS max_abs, round(sqrt(sum(value * value)), 6) AS norm FROM cells GROUP BY col_id""")
def column_stats(spark, sf_dir):
    return rounded(la.column_stats(embeddings(spark, sf_dir)), "mean", "variance", "max_abs", "norm")


@query(f"WITH {CELLS} SELECT col_id, round(sum(value * (2 * value + 1)), 6) + 0.0 AS value FROM cells GROUP BY col_id")
def column_dots(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(la.column_dots(e, e.map_rows(F.transform("features", lambda v: 2 * v + 1), 64)), "value")


# -- products and transposes

_GRAM = f"""WITH {CELLS} SELECT a.col_id AS row_id, b.col_id AS col_id, round(sum(a.value * b.value), 6) + 0.0 AS value
  FROM cells a JOIN cells b USING (row_id) GROUP BY a.col_id, b.col_id"""


@query(_GRAM)
def gram(spark, sf_dir):
    return cells(la.gram(embeddings(spark, sf_dir)))


@query(_GRAM)
def gram_coo(spark, sf_dir):
    return rounded(physical.gram_coo(embeddings(spark, sf_dir).to_coo()), "value")


@query(f"""WITH l AS (SELECT {SCALED} FROM lineitem),
  c AS (SELECT [q, p, d, t] AS f FROM l)
  SELECT CAST(i - 1 AS BIGINT) AS row_id, CAST(j - 1 AS BIGINT) AS col_id, round(sum(f[i] * f[j]), 5) + 0.0 AS value
  FROM c, range(1, 5) a(i), range(1, 5) b(j) GROUP BY i, j""")
def gram_lineitem(spark, sf_dir):
    return cells(la.gram(lineitem(spark, sf_dir)), digits=5)


_MATMUL = f"""WITH {CELLS}, g AS (SELECT a.col_id AS i, b.col_id AS j, sum(a.value * b.value) AS v
    FROM cells a JOIN cells b USING (row_id) GROUP BY a.col_id, b.col_id)
  SELECT row_id, j AS col_id, round(sum(value * v), 6) + 0.0 AS value FROM cells JOIN g ON col_id = i GROUP BY row_id, j"""


@query(_MATMUL)
def matmul_gram(spark, sf_dir):
    """E·(EᵀE): the expression layer reads EᵀE as one pass and broadcasts it."""
    e = embeddings(spark, sf_dir)
    return cells((e @ (e.T @ e).frame()).frame())


@query(_MATMUL)
def matmul_blocks(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return cells(la.matmul(e, la.gram(e), "blocks"))


@query(_MATMUL)
def matmul_coo(spark, sf_dir):
    e = embeddings(spark, sf_dir).to_coo()
    return rounded(physical.coo_product(e, physical.gram_coo(e)), "value")


@query(f"WITH {CELLS} SELECT row_id, round(sum(value * (col_id + 1) / 64.0), 6) + 0.0 AS value FROM cells GROUP BY row_id")
def matvec(spark, sf_dir):
    out = la.matvec(embeddings(spark, sf_dir), (np.arange(64) + 1) / 64)
    return cells(out).select("row_id", "value")


@query(f"""WITH {CELLS}, y AS (SELECT row_id, sum(value * (col_id + 1) / 64.0) AS y FROM cells GROUP BY row_id)
  SELECT col_id, round(sum(value * y), 6) + 0.0 AS value FROM cells JOIN y USING (row_id) GROUP BY col_id""")
def atax(spark, sf_dir):
    out = la.atax(embeddings(spark, sf_dir), (np.arange(64) + 1) / 64)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(out)], "col_id long, value double"), "value")


@query(f"""WITH {CELLS} SELECT CAST(label AS BIGINT) AS col_id, col_id AS row_id, round(sum(value), 6) + 0.0 AS value
  FROM cells JOIN embeddings ON row_id = vec_id GROUP BY label, col_id""")
def cross_product(spark, sf_dir):
    """EᵀY for one-hot labels: sums a class."""
    y = MatrixFrame(labels(spark, sf_dir).select("row_id", prep.one_hot(F.col("label"), 10).alias("features")))
    return cells((embeddings(spark, sf_dir).T @ y).frame())


@query(f"WITH {CELLS} SELECT col_id AS row_id, row_id AS col_id, round(value, 6) + 0.0 AS value FROM cells")
def transpose_coo(spark, sf_dir):
    return rounded(physical.transposed_coo(embeddings(spark, sf_dir).to_coo()), "value")


@query(f"WITH {CELLS} SELECT col_id AS row_id, row_id AS col_id, round(value, 6) + 0.0 AS value FROM cells")
def transpose_row(spark, sf_dir):
    return cells(la.transpose(embeddings(spark, sf_dir)))


# -- element-wise


@query(f"""WITH {CELLS} SELECT row_id, CAST(col_id + 64 * r AS BIGINT) AS col_id, round(value, 6) + 0.0 AS value FROM cells, range(3) t(r)""")
def replicate_columns(spark, sf_dir):
    return cells(la.replicate_columns(embeddings(spark, sf_dir), 3))


@query(f"WITH {CELLS} SELECT row_id, col_id, round(value * (col_id + 1), 6) + 0.0 AS value FROM cells")
def scale_columns(spark, sf_dir):
    return cells(la.scale_columns(embeddings(spark, sf_dir), np.arange(64) + 1))


@query(f"WITH {CELLS} SELECT row_id, col_id, round(value * value, 6) + 0.0 AS value FROM cells")
def hadamard(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return cells(la.hadamard(e, e))


@query(f"WITH {CELLS} SELECT row_id, col_id, round(2.5 * value + value * (col_id + 1), 6) + 0.0 AS value FROM cells")
def axpy(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return cells(la.axpy(2.5, e, la.scale_columns(e, np.arange(64) + 1)))


@query(f"""WITH {CELLS} SELECT row_id, col_id, round(value + 0.5 * label * (col_id + 1), 6) + 0.0 AS value
  FROM cells JOIN embeddings ON row_id = vec_id""")
def rank_one_update(spark, sf_dir):
    return cells(la.rank_one_update(embeddings(spark, sf_dir), 0.5, label_matrix(spark, sf_dir), np.arange(64) + 1))


@query(f"WITH {CELLS} SELECT row_id, col_id, round(value * label, 6) + 0.0 AS value FROM cells JOIN embeddings ON row_id = vec_id")
def scale_rows(spark, sf_dir):
    return cells(la.scale_rows(embeddings(spark, sf_dir), label_matrix(spark, sf_dir)))


@query(f"""WITH {CELLS}, s AS (SELECT col_id, avg(value) AS m, var_pop(value) AS v FROM cells GROUP BY col_id)
  SELECT row_id, col_id, round((value - m) / CASE WHEN v < 1e-5 THEN 1 ELSE sqrt(v) END, 6) + 0.0 AS value FROM cells JOIN s USING (col_id)""")
def normalize_columns(spark, sf_dir):
    return cells(la.normalize_columns(embeddings(spark, sf_dir)))


@query(f"""WITH {CELLS}, s AS (SELECT col_id, max(abs(value)) AS m FROM cells GROUP BY col_id),
  y AS (SELECT vec_id, label - (SELECT avg(label) FROM embeddings) AS label FROM embeddings)
  SELECT row_id, round(label, 6) + 0.0 AS label, col_id, round(CASE WHEN m = 0 THEN 0 ELSE value / m END, 6) + 0.0 AS value
  FROM cells JOIN s USING (col_id) JOIN y ON row_id = vec_id""")
def maxabs_normalize(spark, sf_dir):
    df = embeddings(spark, sf_dir).df.join(labels(spark, sf_dir).withColumn("label", F.col("label").cast("double")), "row_id")
    out = prep.max_abs_normalize(df).select("row_id", "label", F.posexplode("features").alias("col_id", "value"))
    return rounded(out.withColumn("col_id", F.col("col_id").cast("long")), "label", "value")


# -- preparation and scoring


@query("""SELECT vec_id AS row_id, CAST(j AS BIGINT) AS col_id, CASE WHEN j = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
  FROM embeddings, range(10) t(j)""")
def one_hot(spark, sf_dir):
    return MatrixFrame(labels(spark, sf_dir).select("row_id", prep.one_hot(F.col("label"), 10).alias("features"))).to_coo()


@query("SELECT vec_id AS row_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS predicted FROM embeddings")
def argmax_decode(spark, sf_dir):
    return embeddings(spark, sf_dir).df.select("row_id", prep.argmax(F.col("features")).alias("predicted"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS row_id FROM customer")
def row_index(spark, sf_dir):
    return prep.index_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "row_id")


@query("SELECT count(*) AS n, count(*) AS ids, CAST(0 AS BIGINT) AS lo, count(*) - 1 AS hi, true AS moved, true AS mixed FROM customer")
def permute_rows(spark, sf_dir):
    """Every number once, hardly a row where it was, and no trend from old places to new ones."""
    p = prep.permute_rows(table(spark, sf_dir, "customer").select("c_custkey"), 3)
    same = F.avg((F.col("row_id") == F.col("c_custkey") - 1).cast("double"))
    return p.agg(
        F.count("row_id").alias("n"), F.countDistinct("row_id").alias("ids"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"),
        (same < 0.1).alias("moved"), (F.abs(F.corr("row_id", "c_custkey")) < 0.3).alias("mixed"),
    )


@query("SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM embeddings GROUP BY label")
def label_histogram(spark, sf_dir):
    return metrics.cluster_sizes(labels(spark, sf_dir), "label")


@query(f"""WITH {CELLS} SELECT round(sqrt(avg(d2)), 6) AS sigma FROM (SELECT a.row_id, b.row_id, sum((a.value - b.value) ** 2) AS d2
  FROM cells a JOIN cells b USING (col_id) GROUP BY a.row_id, b.row_id)""")
def sigma_estimate(spark, sf_dir):
    return row(spark, sigma=round(kernels.estimate_sigma(embeddings(spark, sf_dir)), 6))


_SKETCH = f"""WITH {CELLS} SELECT row_id, CAST((col_id * 7 + 3) % 16 AS BIGINT) AS col_id,
  round(sum(CASE WHEN (col_id * 5 + 1) % 3 = 0 THEN -value ELSE value END), 6) + 0.0 AS value FROM cells GROUP BY 1, 2"""


@query(_SKETCH)
def countsketch(spark, sf_dir):
    j = np.arange(64)
    return cells(kernels.count_sketch(embeddings(spark, sf_dir), 16, table=((j * 7 + 3) % 16, np.where((j * 5 + 1) % 3 == 0, -1.0, 1.0))))


@query(_SKETCH)
def countsketch_coo(spark, sf_dir):
    j = F.col("col_id")
    sketch = spark.range(64).select(F.col("id").alias("col_id")).select("col_id", ((j * 7 + 3) % 16).alias("bucket"), F.when((j * 5 + 1) % 3 == 0, -1.0).otherwise(1.0).alias("sign"))
    return rounded(kernels.count_sketch_coo(embeddings(spark, sf_dir).to_coo(), F.broadcast(sketch)), "value")  # 64 rows


_PRED = "p AS (SELECT vec_id AS row_id, label, (list_position(embedding, list_max(embedding)) - 1) % 10 AS predicted FROM embeddings)"


def _predicted(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).df.select("row_id", (prep.argmax(F.col("features")) % 10).alias("predicted"))


@query(f"WITH {_PRED} SELECT CAST(label AS BIGINT) AS label, CAST(predicted AS BIGINT) AS predicted, count(*) AS n FROM p GROUP BY label, predicted")
def contingency(spark, sf_dir):
    return metrics.contingency(_predicted(spark, sf_dir).join(labels(spark, sf_dir), "row_id"), "label", "predicted")


@query(f"WITH {_PRED} SELECT round(avg(CASE WHEN label <> predicted THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM p")
def misclassification(spark, sf_dir):
    return rounded(metrics.misclassification(_predicted(spark, sf_dir), labels(spark, sf_dir)), "error_rate")


@query(f"""WITH {_PRED}, n AS (SELECT count(*)::DOUBLE AS n FROM p), c AS (SELECT label, predicted, count(*)::DOUBLE AS c FROM p GROUP BY 1, 2),
  a AS (SELECT label, count(*)::DOUBLE AS a FROM p GROUP BY 1), b AS (SELECT predicted, count(*)::DOUBLE AS b FROM p GROUP BY 1),
  mi AS (SELECT sum(c / n * ln(c * n / (a * b))) AS mi FROM c JOIN a USING (label) JOIN b USING (predicted), n),
  ha AS (SELECT -sum(a / n * ln(a / n)) AS ha FROM a, n), hb AS (SELECT -sum(b / n * ln(b / n)) AS hb FROM b, n)
  SELECT round(mi / ((ha + hb) / 2), 6) + 0.0 AS nmi FROM mi, ha, hb""")
def nmi(spark, sf_dir):
    return rounded(metrics.nmi(_predicted(spark, sf_dir).join(labels(spark, sf_dir), "row_id"), "label", "predicted"), "nmi")


# -- clustering


def _lloyd(rounds: int) -> str:
    """k-means with the first ten rows as centres, unrolled."""
    parts = [CELLS, "c0 AS (SELECT row_id AS k, col_id, value AS c FROM cells WHERE row_id < 10)"]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT row_id, k, sum((value - c) ** 2) AS d2 FROM cells JOIN c{i} USING (col_id) GROUP BY row_id, k)")
        parts.append(f"a{i} AS (SELECT row_id, arg_min(k, struct_pack(d := d2, k := k)) AS k, min(d2) AS d2 FROM d{i} GROUP BY row_id)")
        parts.append(f"c{i + 1} AS (SELECT k, col_id, avg(value) AS c FROM cells JOIN a{i} USING (row_id) GROUP BY k, col_id)")
    return "WITH " + ",\n  ".join(parts)


@query(_lloyd(0) + " SELECT row_id, CAST(k AS INTEGER) AS cluster FROM a0")
def kmeans_assign(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return km.cluster_ids(km.assign(e, km.initial_centers(e, 10, "first_k")))


@query(_lloyd(0) + " SELECT CAST(k AS BIGINT) AS row_id, col_id, round(c, 6) + 0.0 AS value FROM c1")
def kmeans_step(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    sums, counts, _ = km.step(e, km.initial_centers(e, 10, "first_k"))
    return cells(MatrixFrame.from_numpy(spark, sums / counts[:, None]))


@query(_lloyd(2) + " SELECT CAST(k AS BIGINT) AS row_id, col_id, round(c, 6) + 0.0 AS value FROM c3")
def kmeans_fixed3(spark, sf_dir):
    return cells(MatrixFrame.from_numpy(spark, km.kmeans(embeddings(spark, sf_dir), 10, 3, 0.0, "first_k").centers))


@query(_lloyd(3) + " SELECT round(sum(d2), 6) AS objective FROM a3")
def kmeans_objective(spark, sf_dir):
    return row(spark, objective=round(km.kmeans(embeddings(spark, sf_dir), 10, 3, 0.0, "first_k").objective, 6))


@query()
def kmeans_parallel(spark, sf_dir):
    """k-means|| and Lloyd rounds to convergence: the clusters and their sizes."""
    found = km.kmeans(embeddings(spark, sf_dir), 10, 50)
    return metrics.cluster_sizes(km.cluster_ids(found.assignments), "cluster")


@query("SELECT CAST(label AS BIGINT) AS label, count(*) AS n, CAST(1 AS BIGINT) AS clusters FROM embeddings GROUP BY label")
def kmeans_planted(spark, sf_dir):
    """k-means|| on rows moved apart by label: each label is one cluster, whatever its number."""
    e = embeddings(spark, sf_dir)
    y = MatrixFrame(labels(spark, sf_dir).select("row_id", prep.one_hot(F.col("label"), 10).alias("features")), e.n_rows, 10)
    apart = e.beside(y).map_blocks(lambda ids, x: np.column_stack([x[:, :64], 40 * x[:, 64:]]), 74)
    found = km.kmeans(apart, 10)
    both = km.cluster_ids(found.assignments).join(labels(spark, sf_dir), "row_id")
    sizes = both.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("label")
    return sizes.agg(F.sum("n").alias("n"), F.countDistinct("cluster").alias("clusters"))


# -- least squares


def _columns(spark, sf_dir, *sides: tuple[int, ...]) -> list[MatrixFrame]:
    """Columns of lineitem as matrices over the same rows, which operators read together: no row numbers are joined,
    so scans may split in any way."""
    both = lineitem(spark, sf_dir)
    both.dims()
    return [both.map_rows(F.array(*[F.element_at("features", i) for i in at]), len(at)) for at in sides]


@query("""WITH l AS (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem)
  SELECT round(sum(x * y) / (sum(x * x) + 0.01 * count(*)), 8) AS w FROM l""")
def ridge_1d(spark, sf_dir):
    x, y = _columns(spark, sf_dir, (1,), (2,))
    return row(spark, w=round(float(solvers.ridge_cg(x, y, 0.01)[0, 0]), 8))


_NORMAL = f"""WITH RECURSIVE {CELLS}, g AS (SELECT a.col_id AS i, b.col_id AS j, sum(a.value * b.value) AS v
    FROM cells a JOIN cells b USING (row_id) GROUP BY a.col_id, b.col_id),
  b AS (SELECT col_id AS i, sum(value * label) AS v, sum(value * label * label) AS v2 FROM cells JOIN embeddings ON row_id = vec_id GROUP BY col_id),
  s AS (SELECT g.i, list(g.v ORDER BY j) || [any_value(b.v), any_value(b.v2)] AS l FROM g JOIN b USING (i) GROUP BY g.i),
  {solved("s", "64")}
  SELECT CAST(i - 1 AS BIGINT) AS row_id, CAST(c - 1 AS BIGINT) AS col_id, round(l[c], 6) + 0.0 AS value FROM s_x, range(1, 3) t(c)"""


def _label_powers(spark, sf_dir) -> MatrixFrame:
    return label_matrix(spark, sf_dir).map_rows(F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.pow(F.element_at("features", 1), k)), 2)


@query(_NORMAL)
def lsqr_embeddings(spark, sf_dir):
    """Two right-hand sides over all 64 columns, by the triangle of one pass."""
    e = embeddings(spark, sf_dir)
    return cells(MatrixFrame.from_numpy(spark, solvers.lsqr(e, _label_powers(spark, sf_dir), max_iters=200)))


@query(_NORMAL)
def lsqr_by_rows(spark, sf_dir):
    """The same by one pass over the rows a step, as where no triangle fits."""
    e = embeddings(spark, sf_dir)
    return cells(MatrixFrame.from_numpy(spark, solvers.lsqr(e, _label_powers(spark, sf_dir), tol=1e-13, triangle_bytes=0)))


_TWO = """WITH l AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_extendedprice / 100000 AS y FROM lineitem),
  s AS (SELECT sum(a * a) + {r} AS aa, sum(a * b) AS ab, sum(b * b) + {r} AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM l)
  SELECT round((ay * bb - yb * ab) / (aa * bb - ab * ab), 8) AS w1, round((aa * yb - ab * ay) / (aa * bb - ab * ab), 8) AS w2 FROM s"""


def _two(spark, sf_dir):
    return _columns(spark, sf_dir, (1, 3), (2,))


@query(_TWO.format(r="0.01 * count(*)"))
def ridge_2d(spark, sf_dir):
    w = solvers.ridge_cg(*_two(spark, sf_dir), 0.01)[:, 0]
    return row(spark, w1=round(float(w[0]), 8), w2=round(float(w[1]), 8))


@query(_TWO.format(r="0"))
def lsqr_2d(spark, sf_dir):
    w = solvers.lsqr(*_two(spark, sf_dir))[:, 0]
    return row(spark, w1=round(float(w[0]), 8), w2=round(float(w[1]), 8))


@query("SELECT CAST(i AS BIGINT) AS col_id, 0.0::DOUBLE AS value FROM range(64) t(i)")
def lsqr_residual_orthogonality(spark, sf_dir):
    """Aᵀ(AX − B) vanishes at the least squares solution."""
    e, y = embeddings(spark, sf_dir), label_matrix(spark, sf_dir)
    x = solvers.lsqr(e, y)
    both = physical.side_by_side(e, y)
    g = both.sum_blocks(lambda ids, z: z[:, :64].T @ (z[:, :64] @ x - z[:, 64:]), (64, 1))
    return cells(g).select(F.col("row_id").alias("col_id"), "value")


@query("""WITH l AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_extendedprice / 100000 AS y FROM lineitem),
  s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM l),
  w AS (SELECT (ay * bb - yb * ab) / (aa * bb - ab * ab) AS w1, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS w2 FROM s)
  SELECT round(sum((y - a * w1 - b * w2) ** 2), 5) AS residual FROM l, w""")
def residual(spark, sf_dir):
    a, y = _two(spark, sf_dir)
    return row(spark, residual=round(metrics.residual(a, solvers.lsqr(a, y), y), 5))


@query(_TWO.format(r="0.01 * count(*)").replace(", 8)", ", 6)"))
def admm_squared_l2(spark, sf_dir):
    """Squared loss with an L2 penalty of 0.01 n has the ridge solution."""
    a, y = _two(spark, sf_dir)
    found = admm_.admm(a, y, True, Loss.SQUARED, Regularizer.L2, lam=0.01 * a.n_rows, max_iters=60, tol=1e-10, rho=0.3)
    w = found.coefficients[:, 0]
    return row(spark, w1=round(float(w[0]), 6), w2=round(float(w[1]), 6))


@query("""WITH l AS (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem),
  s AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, 0.05 * count(*) AS t FROM l)
  SELECT round(sign(xy) * greatest(abs(xy) - t, 0) / xx, 6) + 0.0 AS w FROM s""")
def admm_squared_l1(spark, sf_dir):
    """One feature under an L1 penalty has the soft threshold as its solution."""
    a, y = _columns(spark, sf_dir, (1,), (2,))
    found = admm_.admm(a, y, True, Loss.SQUARED, Regularizer.L1, lam=0.05 * a.n_rows, max_iters=80, tol=1e-11, rho=0.3)
    return row(spark, w=round(float(found.coefficients[0, 0]), 6))


@query("""WITH n AS (SELECT count(*)::DOUBLE AS n FROM embeddings), c AS (SELECT label, count(*)::DOUBLE AS c FROM embeddings GROUP BY label)
  SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS col_id, round(ln(c / (n - c)), 5) AS value FROM c, n""")
def admm_logistic_classes(spark, sf_dir):
    """A constant feature, each class against all others: the log odds of the classes."""
    y = label_matrix(spark, sf_dir)
    one = y.map_rows(F.array(F.lit(1.0)), 1)
    found = admm_.admm(one, y, False, Loss.LOGISTIC, Regularizer.NOREG, max_iters=80, tol=1e-10, rho=0.2)
    return cells(MatrixFrame.from_numpy(spark, found.coefficients), digits=5).select("col_id", "value")


@query("SELECT CASE WHEN 2 * count(*) FILTER (label < 3) > count(*) THEN 1.0 ELSE -1.0 END::DOUBLE AS w FROM embeddings")
def admm_hinge_constant(spark, sf_dir):
    """A constant feature: the hinge loss is least at the margin of the more frequent class."""
    y = label_matrix(spark, sf_dir).map_rows(F.transform("features", lambda v: F.when(v < 3, 1.0).otherwise(0.0)), 1)
    one = y.map_rows(F.array(F.lit(1.0)), 1)
    found = admm_.admm(one, y, False, Loss.HINGE, Regularizer.NOREG, max_iters=80, tol=1e-10)
    return row(spark, w=round(float(found.coefficients[0, 0]), 5))


@query()
def admm_hinge_l1(spark, sf_dir):
    """A sparse linear separator of label 0 from the rest: its nonzero coefficients."""
    y = label_matrix(spark, sf_dir).map_rows(F.transform("features", lambda v: F.when(v == 0, 1.0).otherwise(0.0)), 1)
    found = admm_.admm(embeddings(spark, sf_dir), y, False, Loss.HINGE, Regularizer.L1, lam=1.0)
    return cells(MatrixFrame.from_numpy(spark, found.coefficients)).where("value <> 0")


# -- singular values


@query(f"WITH {CELLS} SELECT round(sum(value * value), 6) AS energy FROM cells")
def thin_svd_energy(spark, sf_dir):
    return row(spark, energy=round(float((svd.thin_svd(embeddings(spark, sf_dir))[1] ** 2).sum()), 6))


@query("SELECT CAST(i AS BIGINT) AS row_id, CAST(j AS BIGINT) AS col_id, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM range(64) a(i), range(64) b(j)")
def svd_orthonormality(spark, sf_dir):
    return cells(la.gram(svd.thin_svd(embeddings(spark, sf_dir))[0]))


@query("SELECT 0.0::DOUBLE AS error")
def svd_reconstruction_error(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    u, s, v = svd.thin_svd(e)
    back = physical.times_local(u, (v * s).T)
    return la.squared_norm(la.axpy(-1.0, e, back)).select((F.round(F.sqrt("squared_norm"), 6) + 0.0).alias("error"))


@query(f"WITH {CELLS} SELECT row_id, col_id, round(value, 6) + 0.0 AS value FROM cells")
def svd_reconstruction(spark, sf_dir):
    """U·Σ·Vᵀ by all components of the truncated decomposition gives the matrix back, cell by cell."""
    u, s, v = svd.truncated_svd(embeddings(spark, sf_dir), 64)
    return cells(physical.times_local(u, (v * s).T))


_POWERS = f"""WITH {CELLS}, g AS (SELECT a.col_id AS i, b.col_id AS j, sum(a.value * b.value) AS v
    FROM cells a JOIN cells b USING (row_id) GROUP BY a.col_id, b.col_id),
  g2 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY a.i, b.j)
  SELECT round((SELECT sum(v) FROM g WHERE i = j), 5) AS p1, round((SELECT sum(v) FROM g2 WHERE i = j), 4) AS p2,
    round((SELECT sum(g2.v * g.v) FROM g2 JOIN g ON g2.j = g.i AND g2.i = g.j), 3) AS p3"""


def _power_sums(spark, s: np.ndarray) -> DataFrame:
    return row(spark, **{f"p{k}": round(float((s ** (2 * k)).sum()), 6 - k) for k in (1, 2, 3)})


@query(_POWERS)
def spectrum_by_gram(spark, sf_dir):
    """Sums of powers of all singular values are traces of powers of AᵀA."""
    return _power_sums(spark, svd.truncated_svd(embeddings(spark, sf_dir), 64, method=1)[1])


@query(_POWERS)
def spectrum_by_lanczos(spark, sf_dir):
    return _power_sums(spark, svd.truncated_svd(embeddings(spark, sf_dir), 64, method=0)[1])


def _squared(times: int) -> str:
    """AᵀA over its trace, squared again and again, has all its weight on the largest singular direction."""
    parts = [f"{CELLS}, g AS (SELECT a.col_id AS i, b.col_id AS j, sum(a.value * b.value) AS v FROM cells a JOIN cells b USING (row_id) GROUP BY a.col_id, b.col_id)",
             "q0 AS (SELECT i, j, v / (SELECT sum(v) FROM g WHERE i = j) AS v FROM g)"]
    for t in range(times):
        parts.append(f"r{t} AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM q{t} a JOIN q{t} b ON a.j = b.i GROUP BY a.i, b.j)")
        parts.append(f"q{t + 1} AS (SELECT i, j, v / (SELECT sum(v) FROM r{t} WHERE i = j) AS v FROM r{t})")
    return "WITH " + ",\n  ".join(parts) + f" SELECT round(sqrt(sum(q.v * g.v)), 6) AS norm FROM q{times} q JOIN g ON q.j = g.i AND q.i = g.j"


@query(_squared(14))
def spectral_norm(spark, sf_dir):
    """The largest singular value, the last of 20 by Lanczos."""
    s = svd.truncated_svd(embeddings(spark, sf_dir), 20, method=0)[1]
    return row(spark, norm=round(float(s[-1]), 6))


_SVD2 = """WITH l AS (SELECT l_quantity / 50 AS a, l_extendedprice / 100000 AS b FROM lineitem),
  s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM l),
  e AS (SELECT (aa + bb) / 2 AS m, sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS r FROM s)
  SELECT round(sqrt(m + r), 6) AS s1, round(sqrt(m - r), 6) AS s2 FROM e"""


def _pair(spark, sf_dir):
    both = lineitem(spark, sf_dir)
    return MatrixFrame(both.df.select("row_id", F.slice("features", 1, 2).alias("features")))


@query(_SVD2)
def svd_2col(spark, sf_dir):
    s = svd.thin_svd(_pair(spark, sf_dir))[1]
    return row(spark, s1=round(float(s[0]), 6), s2=round(float(s[1]), 6))


@query(_SVD2)
def truncated_svd_gram(spark, sf_dir):
    s = svd.truncated_svd(_pair(spark, sf_dir), 2, method=1)[1]
    return row(spark, s1=round(float(s[1]), 6), s2=round(float(s[0]), 6))


@query(_SVD2)
def truncated_svd_lanczos(spark, sf_dir):
    s = svd.truncated_svd(_pair(spark, sf_dir), 2, method=0)[1]
    return row(spark, s1=round(float(s[1]), 6), s2=round(float(s[0]), 6))


@query()
def truncated_spectrum(spark, sf_dir):
    """The 20 largest singular values, ascending."""
    s = svd.truncated_svd(embeddings(spark, sf_dir), 20)[1]
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(s)], "k long, value double")


@query(f"""WITH {CELLS} SELECT round(sum(value * value) FILTER (col_id >= 20), 6) AS error,
  round(sum(value * value) FILTER (col_id >= 20) / sum(value * value), 6) AS share FROM cells""")
def rank_k_error(spark, sf_dir):
    """What 20 orthogonal directions, here axes, leave of A: the squares of its other columns."""
    error, share = metrics.rank_k_error(embeddings(spark, sf_dir), np.eye(64)[:, :20])
    return row(spark, error=round(error, 6), share=round(share, 6))


# -- kernels


@query(f"""WITH {weights(*kernels.seeded_gaussian_weights(64, 32, 1.0, kernels.SEED, kernels.SEED + 1))}
  SELECT vec_id AS row_id, k AS col_id, round({cosines(32)}, 6) + 0.0 AS value FROM embeddings, w""")
def rff_features(spark, sf_dir):
    return cells(kernels.random_fourier_features(embeddings(spark, sf_dir), 32, 1.0))


KRR_FEATURES = 256


@query(f"""WITH RECURSIVE {CELLS}, {weights(*kernels.seeded_gaussian_weights(64, KRR_FEATURES, 1.0))},
  sg AS (SELECT sqrt(2 * sum(v)) AS sigma FROM (SELECT var_pop(value) AS v FROM cells GROUP BY col_id)),
  z AS (SELECT vec_id AS r, label, k, {cosines(KRR_FEATURES, "sigma")} AS z FROM embeddings, w, sg),
  g AS (SELECT a.k AS i, b.k AS j, sum(a.z * b.z) AS v FROM z a JOIN z b USING (r) GROUP BY a.k, b.k),
  y AS (SELECT k AS i, list(v ORDER BY c) AS l FROM (SELECT k, c, sum(CASE WHEN label = c THEN z ELSE 0 END) AS v FROM z, range(10) t(c) GROUP BY k, c) GROUP BY k),
  s AS (SELECT g.i, list(v + CASE WHEN g.i = j THEN 1e-4 * (SELECT count(*) FROM embeddings) ELSE 0 END ORDER BY j) || any_value(y.l) AS l FROM g JOIN y USING (i) GROUP BY g.i),
  {solved("s", str(KRR_FEATURES))},
  p AS (SELECT r, any_value(label) AS label, c, sum(z * l[c]) AS v FROM z JOIN s_x ON k = i - 1, range(1, 11) t(c) GROUP BY r, c),
  best AS (SELECT r, any_value(label) AS label, arg_max(c, v) - 1 AS predicted FROM p GROUP BY r)
  SELECT avg(CASE WHEN predicted <> label THEN 1.0 ELSE 0.0 END) AS error_rate FROM best""")
def krr_classification(spark, sf_dir):
    """Flagship: width from the data, random Fourier features, ridge by CG, argmax, error rate on the rows learned from."""
    e, y = embeddings(spark, sf_dir), labels(spark, sf_dir)
    z = kernels.rbf_features(e, KRR_FEATURES, kernels.estimate_sigma(e))
    onehot = MatrixFrame(y.select("row_id", prep.one_hot(F.col("label"), 10).alias("features")), e.n_rows, 10)
    x = solvers.ridge_cg(z, onehot, 1e-4)
    predicted = physical.times_local(z, x).df.select("row_id", prep.argmax(F.col("features")).alias("predicted"))
    return metrics.misclassification(predicted, y)


@query()
def kernel_maps(spark, sf_dir):
    """A feature map of every kernel: its width and the mean of its squared features."""
    e = embeddings(spark, sf_dir)
    positive = e.map_rows(F.transform("features", F.abs), 64)
    out = None
    for k in kernels.Kernel:
        z = kernels.feature_map(positive, k, 64, 2.0 if k == kernels.Kernel.POLYNOMIAL else 1.0)
        part = z.df.agg(F.lit(k.name).alias("kernel"), F.max(F.size("features")).alias("width"), F.avg(la.dot(F.transform("features", lambda v: v * v))).alias("mean_square"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "mean_square")


def _seeded_map_sql() -> str:
    """Every kernel's map of |E| from its seeded weights: the mean over rows of the squared features."""
    rng = lambda: np.random.default_rng(kernels.SEED)
    n = 64
    maps = {}
    r = rng()
    maps["GAUSSIAN"] = weights(kernels.normal_quantile(kernels.halton(n, 64, start=1 + kernels.SEED % 97)), r.uniform(0, 2 * np.pi, n))
    r = rng()
    maps["LAPLACIAN"] = weights(r.standard_cauchy((n, 64)), r.uniform(0, 2 * np.pi, n))
    r = rng()
    student = r.normal(size=(n, 64)) / np.sqrt(r.chisquare(2.0, (n, 1)) / 2.0)
    maps["MATERN"] = weights(student, r.uniform(0, 2 * np.pi, n))
    maps["EXPSEMIGROUP"] = weights(0.5 / np.maximum(rng().normal(size=(n, 64)) ** 2, 1e-300))
    parts = ["x AS (SELECT vec_id AS r, list_transform(CAST(embedding AS DOUBLE[]), lambda v: abs(v)) AS x FROM embeddings)"]
    found = []
    for name, w in maps.items():
        z = f"exp(-list_dot_product(x, w)) / sqrt({n}.0)" if name == "EXPSEMIGROUP" else cosines(n, "1.0", "x")
        parts.append(f"{name.lower()}_{w}")
        found.append(f"SELECT '{name}' AS kernel, r, sum(({z}) ** 2) AS q FROM x, {name.lower()}_w GROUP BY r")
    cells_ = "SELECT r, i - 1 AS j, x[i] AS v FROM x, range(1, 65) t(i)"
    table = lambda b, s: "(VALUES " + ", ".join(f"({j}, {int(k)}, {float(v)!r})" for j, (k, v) in enumerate(zip(b, s, strict=True))) + ")"
    parts.append(f"lin AS (SELECT r, b, sum(v * s::DOUBLE) AS z FROM ({cells_}) JOIN {table(*kernels.count_sketch_table(64, n, kernels.SEED))} t(j, b, s) USING (j) GROUP BY r, b)")
    found.append("SELECT 'LINEAR' AS kernel, r, sum(z * z) AS q FROM lin GROUP BY r")
    r = rng()
    for t in ("one", "two"):
        parts.append(f"{t} AS (SELECT r, b, v * s::DOUBLE AS v FROM ({cells_}) JOIN {table(r.integers(0, n, 64), r.choice([-1.0, 1.0], 64))} t(j, b, s) USING (j))")
    parts.append(f"poly AS (SELECT r, (one.b + two.b) % {n} AS b, sum(one.v * two.v) AS z FROM one JOIN two USING (r) GROUP BY 1, 2)")
    found.append("SELECT 'POLYNOMIAL' AS kernel, r, sum(z * z) AS q FROM poly GROUP BY r")
    return f"WITH {', '.join(parts)} SELECT kernel, CAST({n} AS INTEGER) AS width, round(avg(q), 6) + 0.0 AS mean_square FROM ({' UNION ALL '.join(found)}) GROUP BY kernel"


ORACLES["kernel_maps"] = _seeded_map_sql()


# -- sources


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_AS_READ = f"WITH {CELLS} SELECT row_id, col_id, value FROM cells"


def _read_cells(df: DataFrame, row_id: str = "label") -> DataFrame:
    out = df.select(F.col(row_id).cast("long").alias("row_id"), F.posexplode("features").alias("col_id", "value"))
    return out.select("row_id", F.col("col_id").cast("long").alias("col_id"), "value")


@query(_AS_READ)
def libsvm_file(spark, sf_dir):
    """E in a libsvm file, whose columns count from 1, with the row number as label, and read back."""
    path = _folder(spark, "libsvm")
    pairs = F.transform("features", lambda v, j: F.concat_ws(":", (j + 1).cast("string"), v.cast("string")))
    embeddings(spark, sf_dir).df.select(F.concat_ws(" ", F.col("row_id").cast("string"), F.array_join(pairs, " "))).write.text(path)
    return _read_cells(read_libsvm(spark, path, 64))


@query(_AS_READ)
def csv_file(spark, sf_dir):
    """E in a headerless CSV file behind a label that counts from 1, and read back."""
    path = _folder(spark, "csv")
    columns = [F.element_at("features", j + 1).alias(f"f{j}") for j in range(64)]
    embeddings(spark, sf_dir).df.select((F.col("row_id") + 1).alias("label"), *columns).write.csv(path)
    return _read_cells(read_csv(spark, path, 64))


@query(_AS_READ)
def parquet_file(spark, sf_dir):
    path = _folder(spark, "parquet")
    write_parquet(embeddings(spark, sf_dir), path)
    return read_parquet(spark, path).to_coo()


@query(f"WITH {_PRED} SELECT label || ' ' || predicted AS line, count(*) AS n FROM p GROUP BY 1")
def label_pairs_file(spark, sf_dir):
    """True and predicted labels as lines of text, read back and counted."""
    path = _folder(spark, "pairs")
    write_label_pairs(_predicted(spark, sf_dir).join(labels(spark, sf_dir), "row_id"), path, "label", "predicted")
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS} SELECT row_id, CAST(label AS INTEGER) AS label, col_id, value FROM cells JOIN embeddings ON row_id = vec_id")
def libsvm_lines(spark, sf_dir):
    """Rows written as libsvm lines and parsed again."""
    e = embeddings(spark, sf_dir).df.join(labels(spark, sf_dir), "row_id")
    pairs = F.transform("features", lambda v, j: F.concat_ws(":", j.cast("string"), v.cast("string")))
    lines = e.select("row_id", F.concat_ws(" ", F.col("label").cast("string"), F.array_join(pairs, " ")).alias("line"))
    parsed = lines.select("row_id", parse_libsvm_line(F.col("line"), 64).alias("p")).select("row_id", "p.label", F.posexplode("p.features").alias("col_id", "value"))
    return parsed.withColumn("col_id", F.col("col_id").cast("long"))


@query("SELECT CAST(i AS BIGINT) AS row_id, CAST(j AS BIGINT) AS col_id, CASE WHEN i = j THEN 0.5 * (i + 1) ELSE 0.0 END::DOUBLE AS value FROM range(200) a(i), range(50) b(j)")
def diagonal_source(spark, sf_dir):
    return synthetic.diagonal(spark, 200, 50, 0.5).to_coo()
