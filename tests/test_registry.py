import pytest

from catalift import plans

VERSIONS = "name STRING, version STRING, current_stage STRING, has_signature BOOLEAN"


@pytest.fixture(scope="module")
def versions(spark):
    data = [("m", str(v), "None", True) for v in range(1, 9)]
    data += [
        ("m", "9", "Production", True),
        ("m", "10", "Production", False),
        ("m", "11", "Staging", None),
        ("m", "12", "Archived", True),
        ("n", "2", "Staging", True),
        ("n", "10", "Archived", True),
    ]
    return spark.createDataFrame(data, VERSIONS).repartition(5)


def planned(df):
    return {(r.name, r.version): (r.status, r.dest_version) for r in df.collect()}


def test_latest_is_numeric(versions, rows):
    assert rows(plans.latest_version(versions)) == [("m", 12), ("n", 10)]


def test_latest_of_nothing(versions):
    assert plans.latest_version(versions.where("name = 'none'")).count() == 0


def test_stage_alias(versions, rows):
    assert rows(plans.stage_alias(versions)) == [
        ("m", "Challenger", 11),
        ("m", "Champion", 10),
        ("n", "Challenger", 2),
    ]


def test_plan_numbers_signed_versions_in_numeric_order(versions):
    plan = plans.upgrade_plan(versions, "main", "models")
    assert plan.columns == [
        "name", "version", "dest_name", "status", "dest_version", "source", "run_id", "description", "model_description",
    ]
    assert {r.dest_name for r in plan.collect()} == {"main.models.m", "main.models.n"}
    found = planned(plan)
    assert [found["m", v] for v in range(1, 13)] == [("READY", v) for v in range(1, 10)] + [
        ("NO_SIGNATURE", None),
        ("NO_SIGNATURE", None),
        ("READY", 10),
    ]
    assert (found["n", 2], found["n", 10]) == (("READY", 1), ("READY", 2))


@pytest.mark.parametrize("span", [1, 4])
def test_plan_is_the_same_for_any_span(versions, rows, span):
    whole = plans.upgrade_plan(versions, "main", "models")
    assert rows(plans.upgrade_plan(versions, "main", "models", span=span)) == rows(whole)


def test_supplied_signatures(spark, versions):
    supplied = spark.createDataFrame([("m", "10"), ("m", "10"), ("n", "99")], "name STRING, version STRING")
    found = planned(plans.upgrade_plan(versions, "main", "models", signatures=supplied))
    assert found["m", 10] == ("READY", 10)
    assert found["m", 11] == ("NO_SIGNATURE", None)
    assert found["m", 12] == ("READY", 11)
    assert len(found) == 14


def test_existing_model_is_kept_and_followed(spark, versions):
    existing = spark.createDataFrame(
        [("main.models.m", 40), ("main.models.m", 41), ("other.models.n", 7)],
        "dest_name STRING, latest_version INT",
    )
    found = planned(plans.upgrade_plan(versions, "main", "models", existing=existing))
    assert found["m", 1] == ("READY", 42)
    assert found["m", 12] == ("READY", 51)
    assert found["n", 2] == ("READY", 1)


def test_a_second_run_skips_what_was_moved(spark, versions):
    moved = spark.createDataFrame(
        [("main.models.m", "1"), ("main.models.m", "2"), ("main.other.n", "2")],
        "dest_name STRING, source_version STRING",
    )
    existing = spark.createDataFrame([("main.models.m", 2)], "dest_name STRING, latest_version INT")
    found = planned(
        plans.upgrade_plan(versions, "main", "models", migrated=moved, existing=existing)
    )
    assert found["m", 1] == found["m", 2] == ("EXISTS", None)
    assert found["m", 3] == ("READY", 3)
    assert found["n", 2] == ("READY", 1)


def test_rejected_names_and_versions(spark):
    data = [
        ("ok", "1"), ("ok", "x"), ("ok", "y"), ("ok", "3"),
        ("a.b", "1"), ("a b", "1"), ("a/b", "1"), ("tab\t", "1"), ("n" * 256, "1"), ("n" * 255, "1"),
    ]
    versions = spark.createDataFrame([(*d, "None", True) for d in data], VERSIONS)
    plan = plans.upgrade_plan(versions, "main", "models")
    found = {(r.name, r.version): r.status for r in plan.collect()}
    assert plan.count() == len(data)
    assert found["ok", None] == "INVALID_VERSION"
    assert planned(plan)["ok", 3] == ("READY", 2)
    assert found["n" * 255, 1] == "READY"
    for name in ("a.b", "a b", "a/b", "tab\t", "n" * 256):
        assert found[name, 1] == "INVALID_NAME"


def test_models_without_versions(spark, versions):
    models = spark.createDataFrame([("m",), ("n",), ("bare",), ("b.re",)], "name STRING")
    plan = plans.upgrade_plan(versions, "main", "models", models=models)
    assert plan.count() == versions.count() + 2
    found = planned(plan)
    assert found["bare", None] == ("NO_VERSIONS", None)
    assert found["b.re", None] == ("INVALID_NAME", None)


def test_what_a_version_carries(spark):
    versions = spark.createDataFrame(
        [("m", "1", True, "s3://a", "r1", "first"), (None, "1", True, "s3://b", "r2", None), ("m", "9000000000", True, None, None, None)],
        "name STRING, version STRING, has_signature BOOLEAN, source STRING, run_id STRING, description STRING",
    )
    models = spark.createDataFrame([("m", "the model"), ("n", "none yet"), (None, "?")], "name STRING, description STRING")
    plan = plans.upgrade_plan(versions, "main", "models", models=models)
    found = {(r.name, r.version): r for r in plan.collect()}
    first = found["m", 1]
    assert (first.status, first.source, first.run_id, first.description, first.model_description) == (
        "READY", "s3://a", "r1", "first", "the model",
    )
    assert (found["m", 9000000000].status, found["m", 9000000000].dest_version) == ("READY", 2)
    assert (found[None, 1].status, found[None, 1].dest_version) == ("INVALID_NAME", None)
    assert (found["n", None].status, found["n", None].model_description) == ("NO_VERSIONS", "none yet")
    assert {r.status for r in plans.upgrade_plan(versions, "ma in", "models").collect()} == {"INVALID_NAME"}


def test_models_without_their_versions(spark, versions):
    models = spark.createDataFrame([("new", "d"), ("m", "e"), ("a b", "f")], "name STRING, description STRING")
    existing = spark.createDataFrame([("main.models.n", 3)], "dest_name STRING, latest_version INT")
    plan = plans.upgrade_plan(versions, "main", "models", models, existing, upgrade_versions=False)
    found = {r.name: (r.status, r.version, r.model_description) for r in plan.collect()}
    assert found == {
        "m": ("READY", None, "e"), "n": ("EXISTS", None, None), "new": ("READY", None, "d"), "a b": ("INVALID_NAME", None, "f"),
    }
