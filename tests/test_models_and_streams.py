"""Training and scoring, the drifting stream, exact splits, sinks, and restart of streams."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.draws import digest_number
from sparkloom.operators import consensus, drift, drift_stream, metrics, models
from sparkloom.sources import files
from sparkloom.shipping import checkpoint
from sparkloom.streaming import replay
from sparkloom.streaming.retrain import Policy, RetrainFlow


def test_split_is_exact_by_class(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 90 + ["b"] * 9 + [None])) for i in range(500)] + [(500 + i, "few") for i in range(3)]
    df = spark.createDataFrame(rows, "id long, kind string")
    got = metrics.stratified_split(df, "kind", "id", bits=4).withColumn("key", digest_number(F.col("id"), "42")).collect()
    assert len(got) == len(rows) and sum(r["in_train"] for r in got) == 503 - 101
    for kind in ("a", "b", None, "few"):
        mine = sorted((r["key"], r["in_train"]) for r in got if r["kind"] == kind)
        taken = [t for _, t in mine]
        assert taken == sorted(taken, reverse=True)  # the smallest digests
        assert abs(sum(taken) - 402 / 503 * len(mine)) < 1


def test_split_of_odd_tables(spark):
    df = spark.createDataFrame([(None, None), (1, "x"), (1, "x")], "id long, kind string")
    assert metrics.stratified_split(df, "kind", "id").count() == 3
    assert metrics.stratified_split(df.where("false"), "kind", "id").count() == 0


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2), "text") for i in range(1200)]
    return spark.createDataFrame([(i, a, b, t, int(a + b > 5)) for i, a, b, t in rows], "id long, a double, b double, note string, label int")


def test_target_and_features_are_inferred(table):
    assert models.detect_target(table) == "label"
    assert models.detect_target(table.drop("label")) == "note"
    assert models.numeric_features(table, "label") == ["id", "a", "b"]
    with pytest.raises(ValueError):
        models.build(["a"], "label", "nearest_star")


@pytest.mark.parametrize("kind,settings", [("logistic_regression", {"maxIter": 30}), ("random_forest", {"numTrees": 10})])
def test_models_train_score_and_are_kept(spark, table, tmp_path, kind, settings):
    t = models.train(table, "id", model_type=kind, settings=settings)
    m = t.metrics.first()
    assert m["accuracy"] > 0.9 and m["auc"] > 0.95 and m["tp"] + m["fp"] + m["fn"] + m["tn"] == 240
    models.save(t, f"{tmp_path}/{kind}")
    again = models.load(spark, f"{tmp_path}/{kind}")
    assert (again.features, again.target) == (["a", "b"], "label")
    odd = table.limit(20).select("id", F.col("a").cast("string").alias("a"), F.lit("none").alias("b"))
    want = {r["id"]: r["prediction"] for r in models.predict(t.model, odd, t.features).collect()}
    log = models.predict_and_log(again.model, odd, again.features, "id", 7, f"{tmp_path}/log")
    assert {r["id"]: r["prediction"] for r in log.collect()} == want
    models.predict_and_log(again.model, odd, again.features, "id", 8, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 40


def test_stream_drifts_from_its_onset(spark, table):
    base, pool = drift_stream.split_baseline(table, "id")
    shifts = {"a": drift_stream.Shift("mean_shift_up", 0.5, 4), "b": drift_stream.Shift("variance_inflation", 0.5, 6), "gone": drift_stream.Shift("mean_shift_down", 1.0, 1)}
    s = drift_stream.stream(pool, base, "id", "label", shifts).cache()
    both = s.join(pool.select("id", F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("label").alias("y0")), "id")
    std, mean = base.agg(F.stddev_pop("a")).first()[0], base.agg(F.avg("b")).first()[0]
    for r in both.collect():
        assert r["a"] == pytest.approx(r["a0"] + 0.5 * max(0, r["batch"] - 3) * std)
        assert r["b"] == pytest.approx(mean + (r["b0"] - mean) * (1 + 0.5 * max(0, r["batch"] - 5)))
        assert r["batch"] >= 7 or r["label"] == r["y0"]
    flips = both.where("batch >= 7").agg(F.avg((F.col("label") != F.col("y0")).cast("double"))).first()[0]
    assert 0.05 < flips < 0.25
    told = {r["batch"]: r for r in drift_stream.manifest(s, shifts).collect()}
    assert [b for b in sorted(told) if told[b]["clean"]] == [1, 2, 3] and told[6]["drifting"] == "a=3,b=1"
    assert drift_stream.stream(pool.where("false"), base, "id", "label", shifts).count() == 0
    assert drift_stream.formula("b", shifts["b"]).startswith("b' = mu")
    with pytest.raises(ValueError):
        drift_stream.Shift("sideways", 1.0, 1)


def test_reasons_of_the_decision(spark):
    def decide(significant, labelled):
        s = spark.createDataFrame([(10, significant, significant / 10)], "n_checked long, n_significant long, fraction double")
        return drift.retrain_decision(s, labelled).first()

    assert decide(3, 500)["reason"] == "No retrain: 3/10 features significant (fraction 0.30 <= 0.30)"
    assert "only 5 labelled rows available (need 60)" in decide(4, 5)["reason"]
    assert decide(4, 60)["decision"] == "retrain" and "retrained on 60 recent" in decide(4, 60)["reason"]


def test_logs_converge(spark):
    rows = [(1, n, i, f"t{i}") for n in range(3) for i in range(4)] + [(2, 0, 0, "x"), (2, 1, 0, "y"), (2, 0, 1, "z"), (2, 1, 1, "z"), (2, 0, 2, "w")]
    got = {r["seed"]: (r["n_nodes"], r["n_indexes"], r["n_diverged"]) for r in consensus.convergence(spark.createDataFrame(rows, "seed int, node_id int, index int, entry string")).collect()}
    assert got == {1: (3, 4, 0), 2: (2, 3, 2)}


def test_sinks(spark, table, tmp_path):
    source = f"{tmp_path}/source.csv"
    with open(source, "w") as f:
        f.write("Mean Radius,the-target\n1.5,1\n2.5,0\n")
    for _ in range(2):
        got = files.base_table(spark, source, f"{tmp_path}/kept.csv")
        assert got.columns == ["mean_radius", "the_target"] and got.count() == 2
    base, pool = drift_stream.split_baseline(table, "id")
    s = drift_stream.stream(pool, base, "id", "label", {})
    files.save_batches(s, f"{tmp_path}/stream")
    assert {r["batch"] for r in files.batch_names(spark, f"{tmp_path}/stream").collect()} == set(range(1, 13))
    assert spark.read.csv(f"{tmp_path}/stream", header=True).count() == pool.count()
    files.save_manifest(drift_stream.manifest(s, {}), f"{tmp_path}/manifest")
    assert spark.read.json(f"{tmp_path}/manifest").count() == 12


def test_a_named_stream_goes_on(spark, tmp_path):
    folder = f"{tmp_path}/in"
    spark.range(5).write.parquet(folder)
    count = lambda df: df.agg(F.count("*").alias("n"))
    assert sum(r["n"] for r in replay.replay(replay.table_stream(spark, folder, 100), count, "again").collect()) == 5
    spark.range(3).write.mode("append").parquet(folder)
    assert sorted(r["n"] for r in replay.replay(replay.table_stream(spark, folder, 100), count, "again").collect()) == [3, 5]


def test_training_runs_are_recorded(spark, table, tmp_path):
    t = models.run_training(table, "id", f"{tmp_path}", 3, model_name="m", settings={"maxIter": 20}, notes="first")
    row = spark.read.parquet(f"{tmp_path}/runs").where("run_id = 3").first()
    assert (row["status"], row["notes"], row["n_training_rows"], row["features"], row["target"]) == ("completed", "first", 960, ["a", "b"], "label")
    assert row["metrics"]["accuracy"] > 0.9 and row["seconds"] > 0
    kept = spark.read.parquet(f"{tmp_path}/snapshots/run_id=3")
    assert kept.columns == t.features and kept.exceptAll(table.select("a", "b")).count() == 0
    with pytest.raises(ValueError):
        models.run_training(table.select("note", "label"), "id", f"{tmp_path}", 4, features=[], target="label", notes="none")
    failed = spark.read.parquet(f"{tmp_path}/runs").where("run_id = 4").first()
    assert failed["status"] == "failed" and failed["notes"].startswith("none\nERROR: ")


def test_penalty_is_that_of_one_over_n(table):
    last = models.train(table, "id", settings={"maxIter": 5}).model.stages[-1]
    assert last.getOrDefault("regParam") == pytest.approx(1 / 960)
    assert models.build(["a"], "label", "random_forest").getStages()[-1].getMaxDepth() == 30


def test_logged_rows_are_those_of_the_call(spark, table, tmp_path):
    t = models.train(table, "id", settings={"maxIter": 5})
    rows = spark.createDataFrame([(1, "0.5", "x", 1), (2, None, "7", None)], "id long, a string, b string, y int")
    first = models.predict_and_log(t.model, rows, t.features, "id", 7, f"{tmp_path}/log", "y", 0)
    again = models.predict_and_log(t.model, rows.limit(1), t.features, "id", 7, f"{tmp_path}/log", "y", 1)
    assert first.count() == 2
    first = models.predict_and_log(t.model, rows, t.features, "id", 7, f"{tmp_path}/log", "y", 0)  # replaces
    assert first.count() == 2 and again.count() == 1 and spark.read.parquet(f"{tmp_path}/log").count() == 3
    told = {r["id"]: (r["features"], r["actual_label"]) for r in first.collect()}
    assert told == {1: ({"a": 0.5, "b": None}, 1), 2: ({"a": None, "b": 7.0}, None)}


def test_payload_shapes(spark):
    rows = lambda p: [tuple(r) for r in models.payload_rows(spark, p).select("a", "actual_label").collect()]
    assert rows({"a": 1.5}) == rows({"features": {"a": 1.5}}) == rows({"features": [{"a": 1.5}]}) == [("1.5", None)]
    assert rows({"records": [{"a": 1}, {"b": 2}], "actual_labels": [0, None]}) == [("1", 0), (None, None)]
    for bad in ({"features": []}, {"features": [1]}, {"records": [{"a": 1}], "actual_labels": [0, 1]}):
        with pytest.raises(ValueError):
            models.payload_rows(spark, bad)


@pytest.fixture(scope="module")
def drifting(spark, table):
    base, pool = drift_stream.split_baseline(table.drop("note"), "id")
    shifts = {"a": drift_stream.Shift("mean_shift_up", 2.0, 2), "b": drift_stream.Shift("mean_shift_up", 2.0, 2)}
    return checkpoint(base), checkpoint(drift_stream.stream(pool, base, "id", "label", shifts, batches=5))


def flow_over(spark, folder, drifting, name, batches, policy):
    base, rows = drifting
    flow = RetrainFlow(spark, folder, "id", "label", policy, settings={"maxIter": 10})
    if not (spark._jvm.java.io.File(f"{folder}/runs").exists()):
        flow.start(base)
    for b in batches:
        if not spark._jvm.java.io.File(f"{folder}/in/batch={b}").exists():
            rows.where(F.col("batch") == b).drop("batch").write.parquet(f"{folder}/in/batch={b}")
        flow.run(spark.readStream.schema(rows.drop("batch").schema).parquet(f"{folder}/in/*"), name)
    return flow


def told(flow):
    return sorted((r["batch_id"], r["run_id"], r["decision"], r["n_significant"], r["n_labelled"], r["new_run_id"]) for r in flow.events().collect())


def test_a_killed_batch_runs_again_without_doubles(spark, tmp_path, drifting, monkeypatch):
    policy = Policy(window=80, every=2)
    want = flow_over(spark, f"{tmp_path}/whole", drifting, f"whole-{tmp_path.name}", range(1, 6), policy)
    assert [e[2] for e in told(want)] == ["retrain"] and told(want)[0][:2] == (1, 0)
    usual, calls = models.run_training, []

    def killed(*args, **kwargs):
        if args[3] and not calls:
            calls.append(1)
            usual(*args, **kwargs)  # dies after the new model is kept, before the audit row is
            raise RuntimeError("killed")
        return usual(*args, **kwargs)

    monkeypatch.setattr(models, "run_training", killed)
    name = f"killed-{tmp_path.name}"
    with pytest.raises(Exception, match="killed"):
        flow_over(spark, f"{tmp_path}/killed", drifting, name, range(1, 6), policy)
    got = flow_over(spark, f"{tmp_path}/killed", drifting, name, range(1, 6), policy)
    assert calls and told(got) == told(want)
    rows = lambda f: sorted((r["batch_id"], r["id"], r["run_id"], r["prediction"]) for r in f.log().collect())
    assert rows(got) == rows(want) and len(rows(got)) == len({r[1] for r in rows(got)}) == drifting[1].count()
    assert {r[2] for r in rows(got) if r[0] <= 1} == {0} and {r[2] for r in rows(got) if r[0] > 1} == {2}


def test_checks_go_on_without_labels_and_after_retraining(spark, tmp_path, drifting):
    base, rows = drifting
    bare = (base, rows.withColumn("label", F.when(F.col("batch") > 2, F.col("label"))))
    flow = flow_over(spark, f"{tmp_path}/bare", bare, f"bare-{tmp_path.name}", range(1, 6), Policy(window=80, every=1, once=False))
    decisions = [e[2] for e in told(flow)]
    assert decisions[0] == "no_action" and decisions[1] == "insufficient_labels" and "retrain" in decisions[2:]
    assert flow.window(0, 1).count() == 80


def test_window_state_keeps_the_newest(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.random()) for i in range(400)]
    folder = f"{tmp_path}/in"
    df = spark.createDataFrame(rows, "k long, o long, x double").withColumn("f", F.create_map(F.lit("x"), F.col("x"), F.lit("none"), F.lit(None).cast("double")))
    held = lambda: replay.newest_rows(replay.table_stream(spark, folder, 1), "k", "o", "f", rows=25, name=f"held-{tmp_path.name}")
    df.where("o % 3 = 0").coalesce(1).write.parquet(folder)
    held()
    df.where("o % 3 > 0").repartition(3).write.mode("append").parquet(folder)
    got = sorted((r["k"], r["o"], r["feature"], r["x"]) for r in held().where("feature = 'x'").collect())
    want = [(k, o, "x", x) for k in (1, 2) for k2, o, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])[-25:]]
    assert got == want


def test_training_splits_once(spark, table):
    """Only the split reads the rows; fitting, measuring and the metrics, however often they are asked for, do not."""
    seen = spark.sparkContext.accumulator(0)

    def read(x):
        seen.add(1)
        return x

    odd = table.select("id", "label", "b", F.udf(read, "double").asNondeterministic()("a").alias("a"))
    trained = models.train(odd, "id", "label", settings={"maxIter": 3})
    assert seen.value == 1200
    assert trained.metrics.count() == trained.metrics.count() == 1 and trained.rows.count() == 960
    assert seen.value == 1200
