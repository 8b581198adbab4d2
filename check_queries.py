"""One query per operator, on the given tables. ``check_sql`` holds the SQL of each.

Views: the tall matrix is lineitem (price on quantity, discount, tax); the wide matrix is
embeddings (64 variables, label and its parity as responses); allele pairs come from
lineitem flags and from orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.functions import significant, t_pvalue
from gramloom.functions.text import anova_lines, coefficient_lines
from gramloom.operators import alleles, matrix, ols, terms
from gramloom.operators.gram import gram_moments
from gramloom.operators.scan import (
    best_candidate, marginal_scan, scan, side_columns,
)
from gramloom.plans import lasso as lasso_plan
from gramloom.plans.association import sample_source, tall_source
from gramloom.plans.stepwise import run_stepwise
from gramloom.sources import Matrix, read_delimited, read_epiq, read_pedmap
from gramloom.sources.shared import new_path
from gramloom.sources.sinks import write_epiq, write_lasso_json, write_report

PAIR_THRESHOLD = 0.001
#: The term that the scans' model holds.
MODEL_TERM = (3,)
SINGLE_THRESHOLD = 0.2
LASSO_PENALTY = 0.01


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A fresh folder in the one that driver and executors share."""
    return new_path(spark)


def _round(c, digits=7):
    return F.round(c, digits) + F.lit(0.0)


# ---- views ---------------------------------------------------------------------------

TALL_X = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}


def _tall(spark, sf):
    return _table(spark, sf, "lineitem")


def _tall_columns():
    return {k: F.col(v) for k, v in TALL_X.items()}


def _tall_moments(spark, sf):
    return gram_moments(_tall(spark, sf), {**_tall_columns(), "price": F.col("l_extendedprice")})


def _tall_fit(spark, sf):
    return ols.fit_moments(_tall_moments(spark, sf), "price", list(TALL_X))


def _wide(spark, sf):
    return _table(spark, sf, "embeddings")


def _wide_size(spark, sf) -> tuple[int, int]:
    row = _wide(spark, sf).agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    return row[0], row[1]


def _responses():
    return {"label": F.col("label").cast("double"), "odd": (F.col("label") % 2).cast("double")}


def _wide_index(spark, sf) -> DataFrame:
    """(pos, name) of the wide matrix."""
    width = _wide(spark, sf).agg(F.max(F.size("embedding")).alias("w"))
    return width.select(F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("pos")).select(
        "pos", F.format_string("e%02d", "pos").alias("name")
    )


def _wide_features(spark, sf) -> DataFrame:
    packed = matrix.pack_arrays(_wide(spark, sf), "vec_id", "embedding")
    return packed.select(F.format_string("e%02d", "pos").alias("name"), "pos", "values")


def _wide_samples(spark, sf) -> DataFrame:
    return _wide(spark, sf).select(
        F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("sample"), F.col("vec_id").cast("int").alias("idx")
    )


def _wide_phenotypes(spark, sf) -> DataFrame:
    r = _responses()
    packed = matrix.pack_arrays(_wide(spark, sf).select("vec_id", F.array(*r.values()).alias("y")), "vec_id", "y")
    names = F.array(*[F.lit(n) for n in r])
    return packed.select(F.get(names, F.col("pos")).alias("name"), "pos", "values")


def _wide_calls(spark, sf) -> DataFrame:
    return _wide(spark, sf).select(
        "vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value")
    )


def _named(df):
    return df.withColumn("name", F.format_string("e%02d", "pos"))


def _wide_source(spark, sf, epistatic=True, responses=None):
    return _source_of(_wide(spark, sf), responses or _responses(), epistatic)


def _source_of(wide, responses, epistatic, collinear="exclude"):
    """Source of a wide matrix (vec_id, embedding); variables are named by their place."""
    n, m = wide.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    index = wide.sparkSession.range(m).select(F.col("id").cast("int").alias("pos"), F.format_string("e%02d", "id").alias("name"))
    return sample_source(wide, "vec_id", "embedding", m, n, responses, index, epistatic, collinear=collinear)


def _e(i: int):
    return F.col("embedding")[i].cast("double")


#: Of the removal queries: variables whose sum, with another variable, stands in for them until they enter, and the response.
STAND_IN, NOISE, COPIED = 21, 11, 1


def _removal(spark, sf) -> DataFrame:
    """The wide matrix with a variable that stands in for others (e21), a copy (e11 of e01) and a response ``y``.

    The stand-in enters first, leaves when what it stands for has entered, sits out a scan and comes back once e15 has taken
    enough of the error.
    """
    stand_in = _e(5) + _e(10) + _e(STAND_IN)
    y = _e(5) + _e(10) + 0.012 * _e(STAND_IN) + 0.25 * _e(15) + 0.1 * _e(NOISE)
    made = {STAND_IN: stand_in, NOISE: _e(COPIED)}
    wide = _wide(spark, sf)
    n = wide.agg(F.max(F.size("embedding"))).first()[0]
    return wide.select("vec_id", F.array(*[made.get(i, _e(i)) for i in range(n)]).alias("embedding"), y.alias("y"))


#: Variables of the query with pairs at the default threshold.
PAIRED = 12


def _dependent(spark, sf) -> DataFrame:
    """The wide matrix with two more variables: a constant and a copy of e03."""
    more = F.array(F.lit(2.5), _e(MODEL_TERM[0]))
    return _wide(spark, sf).withColumn("embedding", F.concat(F.transform("embedding", lambda v: v.cast("double")), more))


def _wide_names(spark, sf):
    return [f"e{i:02d}" for i in range(_wide_size(spark, sf)[1])]


# ---- sources and sinks ---------------------------------------------------------------


def _long(m: Matrix) -> DataFrame:
    return (
        matrix.calls_from_features(m.features)
        .join(m.samples.withColumnRenamed("idx", "sample_idx"), "sample_idx")
        .select("name", "sample", "value")
    )


def q_scan_epiq(spark, sf):
    path = _scratch(spark)
    write_epiq(Matrix(_wide_samples(spark, sf), _wide_features(spark, sf)), path)
    return _long(read_epiq(spark, path))


def q_scan_pheno(spark, sf):
    path = _scratch(spark)
    write_epiq(Matrix(_wide_samples(spark, sf), _wide_phenotypes(spark, sf)), path)
    return _long(read_epiq(spark, path))


def q_scan_delimited(spark, sf):
    """Samples as lines, '|' between fields, one column too many (the label, at place 1)."""
    path = _scratch(spark)
    names = _wide_names(spark, sf)
    body = _wide(spark, sf).select(
        F.col("vec_id").alias("n"),
        F.concat_ws(
            "|", F.concat(F.lit("s"), F.col("vec_id").cast("string")), F.col("label").cast("string"),
            F.transform(F.col("embedding").cast("array<double>"), lambda v: v.cast("string")),
        ).alias("value"),
    )
    header = spark.createDataFrame([(-1, "|".join(["Sample", "label", *names]))], "n long, value string")
    header.unionByName(body).orderBy("n").select("value").write.text(path)
    return _long(read_delimited(spark, path, r"\|", (1,), columns_are_variants=True))


def _ped_orders(spark, sf):
    """Three markers per order: many alleles, two alleles with missing calls, one allele."""
    o = _table(spark, sf, "orders")
    missing = F.col("o_custkey") % 10 == 0
    letter = lambda c: F.when(c % 3 == 0, "C").otherwise("A")
    return o.select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).alias("a0"), F.col("o_orderstatus").alias("b0"),
        F.when(missing, "0").otherwise(letter(F.col("o_orderkey"))).alias("a1"),
        F.when(missing, "0").otherwise(letter(F.col("o_custkey"))).alias("b1"),
        F.lit("G").alias("a2"), F.lit("G").alias("b2"),
    )


def q_scan_pedmap(spark, sf):
    ped, map_ = _scratch(spark), _scratch(spark)
    orders = _ped_orders(spark, sf)
    orders.orderBy("o_orderkey").select(
        F.concat_ws(" ", F.lit("f"), F.col("o_orderkey").cast("string"), F.lit("0 0 0 0"),
                    "a0", "b0", "a1", "b1", "a2", "b2").alias("value")
    ).write.text(ped)
    spark.createDataFrame([(f"1 m{i} 0.0 {i}",) for i in range(3)], "value string").coalesce(1).write.text(map_)
    return _long(read_pedmap(spark, map_, ped))


def q_write_epiq(spark, sf):
    """The very lines written."""
    path = _scratch(spark)
    write_epiq(Matrix(_wide_samples(spark, sf), _wide_phenotypes(spark, sf)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _report_fits(spark, sf, width=3):
    cols = {f"e{i:02d}": F.get("embedding", F.lit(i)).cast("double") for i in range(width)}
    m = gram_moments(_wide(spark, sf), {**cols, **_responses()})
    return [ols.fit_moments(m, r, list(cols)) for r in _responses()]


def q_model_report(spark, sf):
    path = _scratch(spark)
    write_report(anova_lines(ols.anova_frame(spark, _report_fits(spark, sf))), path)
    return spark.read.text(path).select("phenotype", F.col("value").alias("line"))


def q_model_report_wide(spark, sf):
    """The report of models of all variables."""
    path = _scratch(spark)
    write_report(anova_lines(ols.anova_frame(spark, _report_fits(spark, sf, _wide_size(spark, sf)[1]))), path)
    return spark.read.text(path).select("phenotype", F.col("value").alias("line"))


def q_ols_summary_text(spark, sf):
    lines = coefficient_lines(ols.terms_frame(spark, _report_fits(spark, sf)))
    return lines.select("phenotype", F.col("line_no").cast("int").alias("line_no"), "line")


def _lasso(spark, sf, solver):
    models = lasso_plan.fit_lasso(_wide(spark, sf), "embedding", _responses(), solver, LASSO_PENALTY)
    return models


def q_lasso_model_json(spark, sf):
    models = _lasso(spark, sf, "sgd")
    weights = lasso_plan.weights_frame(spark, models, _wide_index(spark, sf))
    path = _scratch(spark)
    write_lasso_json(weights, lasso_plan.models_frame(spark, models), path)
    read = spark.read.schema("phenotype string, weights array<map<string,double>>, intercept double").json(path)
    return read.select("phenotype", "intercept", F.explode("weights").alias("w")).select(
        "phenotype", "intercept", F.explode("w").alias("name", "weight")
    ).withColumn("weight", _round("weight"))


# ---- projections, joins --------------------------------------------------------------


def q_delete_columns(spark, sf):
    return matrix.delete_columns(_tall(spark, sf), [1, 2, 9])


def q_select_column(spark, sf):
    return matrix.select_column(_tall(spark, sf), 5)


def q_column_catalogue(spark, sf):
    return matrix.column_catalogue(_table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"))


#: Numeric columns of lineitem.
LINE_NUMBERS = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def q_column_catalogue_all(spark, sf):
    """All numeric columns of the largest table."""
    return matrix.column_catalogue(_tall(spark, sf).select("l_orderkey", *LINE_NUMBERS))


def q_transpose_matrix(spark, sf):
    names = _wide_names(spark, sf)
    return matrix.transpose_features(_wide_features(spark, sf)).select(
        F.col("sample_idx").alias("vec_id"), *[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)]
    )


def _low_mean(spark, sf):
    return _named(_wide_calls(spark, sf).groupBy("pos").agg(F.avg("value").alias("m")).where("m < 0")).select("name")


def q_exclude_variants(spark, sf):
    return matrix.calls_from_features(
        matrix.exclude_variables(_wide_features(spark, sf), _low_mean(spark, sf))
    ).select("name", "sample_idx", "value")


def q_keep_variants(spark, sf):
    return matrix.calls_from_features(
        matrix.keep_variables(_wide_features(spark, sf), _low_mean(spark, sf))
    ).select("name", "sample_idx", "value")


def q_encode_genotypes(spark, sf):
    li = _tall(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    table = alleles.major_minor(alleles.allele_counts(li, "l_linenumber", "l_returnflag", "l_linestatus"))
    return alleles.encode_genotypes(li, table, "l_linenumber", "l_returnflag", "l_linestatus")


def q_allele_counts(spark, sf):
    return alleles.allele_counts(_tall(spark, sf), "l_linenumber", "l_returnflag", "l_linestatus")


def q_major_minor(spark, sf):
    return alleles.major_minor(q_allele_counts(spark, sf))


def _customer_samples(spark, sf):
    return _table(spark, sf, "customer").select(
        F.col("c_custkey").alias("sample"), F.col("c_custkey").alias("idx")
    )


def q_sample_mismatch(spark, sf):
    buyers = _table(spark, sf, "orders").select(F.col("o_custkey").alias("sample")).distinct()
    right = buyers.withColumn("idx", F.col("sample") - F.when(F.col("sample") % 7 == 0, 1).otherwise(0))
    return matrix.sample_mismatch(_customer_samples(spark, sf), right)


def q_align_samples(spark, sf):
    c = _table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    order = _customer_samples(spark, sf).select("sample", (F.lit(1_000_000_000) - F.col("idx")).alias("idx"))
    return matrix.align_samples(c, order, "c_custkey")


def q_join_tables(spark, sf):
    left = _table(spark, sf, "customer").select(F.col("c_custkey").alias("sample"), "c_acctbal")
    right = _table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top_price")
    )
    return matrix.join_tables(left, right)


def _small_features(spark, sf):
    """One variable per part with two values: many equal vectors."""
    return _table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_partkey").cast("int").alias("pos"),
        F.array(F.col("p_size").cast("double"), (F.col("p_retailprice") > 1000).cast("double")).alias("values"),
    )


def q_dedup_features(spark, sf):
    return matrix.dedup_features(_small_features(spark, sf)).select(
        "name", "pos", F.get("values", F.lit(0)).alias("v0"), F.get("values", F.lit(1)).alias("v1")
    )


def q_duplicate_groups(spark, sf):
    return matrix.duplicate_groups(_small_features(spark, sf))


# ---- terms ---------------------------------------------------------------------------


def _supplier_index(spark, sf):
    s = _table(spark, sf, "supplier")
    return s.select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("int").alias("pos")), s.count()


def q_pairwise_terms(spark, sf):
    index, m = _supplier_index(spark, sf)
    return terms.pairwise_terms(index, m)


def q_all_terms(spark, sf):
    index, m = _supplier_index(spark, sf)
    return terms.all_terms(index, m)


def q_candidate_terms(spark, sf):
    """All terms but the single of each 5th supplier and the pair of each supplier with the next."""
    index, m = _supplier_index(spark, sf)
    singles = index.where("pos % 5 = 0").select(F.col("name").alias("a"), F.lit(None).cast("string").alias("b"))
    pairs = index.alias("x").join(index.alias("y"), F.col("y.pos") == F.col("x.pos") + 1).select(
        F.col("x.name").alias("a"), F.col("y.name").alias("b")
    )
    return terms.candidate_terms(terms.all_terms(index, m), singles.unionByName(pairs)).select("a", "b", "label")


def q_pair_product(spark, sf):
    _, m = _wide_size(spark, sf)
    zero = F.lit(0.0)
    return terms.pair_product(_wide_features(spark, sf), m).select(
        F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.size("values").alias("n"),
        significant(F.aggregate("values", zero, lambda s, v: s + v)).alias("total"),
        significant(F.aggregate("values", zero, lambda s, v: s + v * v)).alias("sum_squares"),
        F.array_max("values").alias("top"),
    )


# ---- statistics ----------------------------------------------------------------------


def q_feature_moments(spark, sf):
    out = _named(matrix.feature_moments(_wide_calls(spark, sf), ["pos"]))
    return out.select("name", "n", *[significant(F.col(c)).alias(c) for c in ("total", "mean", "sum_squares")])


def q_gram_matrix(spark, sf):
    names = list(TALL_X)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    m = gram_moments(_tall(spark, sf), {**_tall_columns(), "price": F.col("l_extendedprice")}, pairs)
    labels = [ols.term_label(n) for n in m.names]
    rows = [(a, b, float(m.cross[i, j])) for i, a in enumerate(labels) for j, b in enumerate(labels) if i <= j]
    return spark.createDataFrame(rows, "a string, b string, cross_product double").withColumn(
        "cross_product", significant(F.col("cross_product"), 6)
    )


def q_ols_coefficients(spark, sf):
    rows = ols.terms_frame(spark, [_tall_fit(spark, sf)])
    return rows.select("term", significant(F.col("estimate")).alias("estimate"))


def q_ols_terms(spark, sf):
    rows = ols.terms_frame(spark, [_tall_fit(spark, sf)])
    return rows.select(
        "term", *[significant(F.col(c)).alias(c) for c in ("estimate", "std_error", "t")], _round("p").alias("p")
    )


def q_ols_terms_pinv(spark, sf):
    """The same model with a copied and a constant column, by the pseudo-inverse of X'X."""
    more = {"quantity_again": F.col("l_quantity"), "two": F.lit(2.0)}
    m = gram_moments(_tall(spark, sf), {**_tall_columns(), **more, "price": F.col("l_extendedprice")})
    rows = ols.terms_frame(spark, [ols.fit_moments(m, "price", [*TALL_X, *more], "pinv")])
    return rows.select(
        "term", *[significant(F.col(c), 7).alias(c) for c in ("estimate", "std_error", "t")], _round("p").alias("p")
    )


def q_ols_fit_stats(spark, sf):
    rows = ols.stats_frame(spark, [_tall_fit(spark, sf)])
    cols = ["ss_model", "rss", "sst", "ms_model", "ms_error", "rse", "r2", "adj_r2", "f"]
    return rows.select(
        "n", F.col("df_model").cast("long").alias("df_model"), "df_error",
        *[significant(F.col(c)).alias(c) for c in cols], _round("p").alias("p"),
    )


def q_ols_information(spark, sf):
    rows = ols.stats_frame(spark, [_tall_fit(spark, sf)])
    return rows.select(*[significant(F.col(c)).alias(c) for c in ("log_likelihood", "aic", "bic")])


def q_ols_fitted(spark, sf):
    fit = _tall_fit(spark, sf)
    value = F.lit(float(fit.beta[-1]))
    for name, b in zip(fit.terms, fit.beta):
        value = value + F.lit(float(b)) * F.col(TALL_X[name])
    return _tall(spark, sf).select(
        "l_orderkey", "l_linenumber", F.round(value, 1).alias("fitted"),
        _round(F.col("l_extendedprice") - value, 1).alias("residual"),
    )


def q_anova_type3(spark, sf):
    rows = ols.anova_frame(spark, [_tall_fit(spark, sf)])
    return rows.select(
        "source", "df", *[significant(F.col(c)).alias(c) for c in ("ss", "ms", "f")], _round("p").alias("p")
    )


def q_marginal_scan(spark, sf):
    out = _named(marginal_scan(_wide_calls(spark, sf), ["pos"], "value", F.col("label").cast("double")))
    return out.select(
        "name", F.col("n").cast("long").alias("n"),
        *[_round(F.col(c)).alias(c) for c in ("slope", "intercept", "t", "p")], significant(F.col("rss")).alias("rss"),
    )


# ---- scans and models ----------------------------------------------------------------

def _scan_next_to_one_term(source, best_only):
    """All terms next to a model that holds variable e03 already."""
    seed = {"best": source.best({r: ([], set(), {MODEL_TERM}, None) for r in range(2)})}  # learn the sums of e03
    assert all(t == MODEL_TERM for t, _ in seed["best"].values())
    cross = source.cross
    states = [cross.state(r, [MODEL_TERM], [0], {MODEL_TERM}, None) for r in range(2)]
    weights = side_columns(source.tiles, source.responses, cross.y_mean, [MODEL_TERM], [cross.mean[MODEL_TERM]])
    found = scan(source.layout, weights, 2, 1, states, best_only)
    names = F.array(*[F.lit(n) for n in source.names])
    scored = best_candidate(found) if best_only else found.withColumn(
        "pos_b", F.when(F.col("pos_b") >= 0, F.col("pos_b"))
    )
    df = F.lit(states[0].df)
    return scored.where(F.col("t").isNotNull() & ~F.isnan("t")).select(
        F.get(names, F.col("response")).alias("response"),
        F.format_string("e%02d", "pos_a").alias("a"),
        F.when(F.col("pos_b").isNotNull(), F.format_string("e%02d", "pos_b")).alias("b"),
        _round(F.col("t")).alias("t"),
        _round(t_pvalue(F.col("t"), df), 6).alias("p"),
    )


def q_forward_scan(spark, sf):
    return _scan_next_to_one_term(_wide_source(spark, sf), False)


def q_best_candidate(spark, sf):
    return _scan_next_to_one_term(_wide_source(spark, sf), True)


def q_scan_pinv(spark, sf):
    """Singles next to e03 under the pseudo-inverse rule: e64 is constant, e65 is e03 again."""
    return _scan_next_to_one_term(_source_of(_dependent(spark, sf), _responses(), False, "pinv"), False).drop("b")


def _trace(result, spark):
    return result.trace_frame(spark).select(
        "phenotype", "iteration", "event", "term", _round("t").alias("t"), _round("p").alias("p")
    )


def _model_terms(result, spark):
    rows = ols.terms_frame(spark, result.models())
    return rows.select(
        "phenotype", "row", "term", *[significant(F.col(c), 7).alias(c) for c in ("estimate", "std_error", "t")],
        _round("p").alias("p"),
    )


def _run(spark, sf, epistatic=True, threshold=PAIR_THRESHOLD, responses=None):
    source = _wide_source(spark, sf, epistatic, responses)
    try:
        return run_stepwise(source, threshold)
    finally:
        source.close()


def q_stepwise_terms(spark, sf):
    return _model_terms(_run(spark, sf), spark)


def q_stepwise_trace(spark, sf):
    return _trace(_run(spark, sf), spark)


def q_stepwise_multi(spark, sf):
    return _trace(_run(spark, sf), spark)


def q_stepwise_additive(spark, sf):
    return _trace(_run(spark, sf, epistatic=False, threshold=SINGLE_THRESHOLD), spark)


def q_stepwise_tall(spark, sf):
    """Six terms on all of lineitem: one aggregation, no further job."""
    source = tall_source(_tall(spark, sf), _tall_columns(), {"price": F.col("l_extendedprice")})
    return _trace(run_stepwise(source), spark).select(
        "phenotype", "iteration", "event", "term", significant(F.col("t")).alias("t"), "p"
    )


def _run_on(source, spark):
    try:
        return _trace(run_stepwise(source), spark)
    finally:
        source.close()


def q_stepwise_removal(spark, sf):
    """A term enters, leaves, sits out a scan and comes back: tiles, default threshold."""
    return _run_on(_source_of(_removal(spark, sf), {"y": F.col("y")}, False), spark)


def q_stepwise_removal_tall(spark, sf):
    """The same from one aggregation over the rows."""
    made = _removal(spark, sf)
    n = made.agg(F.max(F.size("embedding"))).first()[0]
    return _run_on(tall_source(made, {f"e{i:02d}": F.col("embedding")[i] for i in range(n)}, {"y": F.col("y")}, epistatic=False), spark)


def q_stepwise_default_pairs(spark, sf):
    """Singles and pairs of the first variables at the default threshold, for both responses."""
    few = _wide(spark, sf).select("vec_id", "label", F.slice("embedding", 1, PAIRED).alias("embedding"))
    return _run_on(_source_of(few, _responses(), True), spark)


def q_stepwise_shifted(spark, sf):
    """A predictor a thousand million from zero, which a sum of its squares would hide."""
    far = {"quantity": F.col("l_quantity").cast("double") + 1e9, "discount": F.col("l_discount"), "tax": F.col("l_tax")}
    y = {"price": F.col("l_extendedprice") + 1000 * F.col("l_quantity")}
    trace = _run_on(tall_source(_tall(spark, sf), far, y, epistatic=False), spark)
    return trace.withColumn("t", significant(F.col("t"), 6))


def _weights(spark, sf, solver):
    models = _lasso(spark, sf, solver)
    return lasso_plan.weights_frame(spark, models, _wide_index(spark, sf))


def q_lasso_weights(spark, sf):
    return _weights(spark, sf, "exact").select("phenotype", "name", _round("weight", 4).alias("weight"))


def q_lasso_weights_sgd(spark, sf):
    return _weights(spark, sf, "sgd").select("phenotype", "name", _round("weight").alias("weight"))


def q_lasso_keep(spark, sf):
    return lasso_plan.lasso_keep(_weights(spark, sf, "sgd")).select("phenotype", "name")


def q_lasso_remove(spark, sf):
    return lasso_plan.lasso_remove(_weights(spark, sf, "sgd")).select("phenotype", "name")


def q_lasso_anova(spark, sf):
    models = _lasso(spark, sf, "sgd")
    fits = lasso_plan.refit(_wide(spark, sf), "embedding", _responses(), models, _wide_names(spark, sf))
    rows = ols.anova_frame(spark, [f for f in fits if f is not None])
    return rows.select(
        "phenotype", "source", "df", *[significant(F.col(c), 7).alias(c) for c in ("ss", "ms", "f")],
        _round("p").alias("p"),
    )


def q_lasso_then_stepwise(spark, sf):
    n, _ = _wide_size(spark, sf)
    result = lasso_plan.lasso_then_stepwise(
        _wide(spark, sf), "vec_id", "embedding", n, _responses(), _wide_names(spark, sf), "sgd",
        LASSO_PENALTY, PAIR_THRESHOLD,
    )
    return _trace(result, spark)


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
