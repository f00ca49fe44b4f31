import pytest

from catalift import plans
from catalift.plans import catalogue

VERSIONS = "name STRING, version STRING, current_stage STRING, has_signature BOOLEAN, run_id STRING"


def _versions(spark, n, production):
    rows = [("m", str(v), "Production" if v == production else "None", v != 3, f"r{v}") for v in range(1, n + 1)]
    return spark.createDataFrame(rows + [("n", "1", "Staging", True, "x")], VERSIONS)


def _plan(spark, versions, path):
    state = plans.read_registry(spark, path)
    return plans.upgrade_plan(versions, "c", "s", existing=state.existing(), migrated=state.migrated())


def _tables(state):
    versions = {(r.dest_name, r.version): (r.source_version, r.run_id) for r in state.versions.collect()}
    return versions, {(r.name, r.alias): r.version for r in state.aliases.collect()}


def test_plan_apply_plan_again(spark, tmp_path):
    path = f"{tmp_path}/registry"
    first = _versions(spark, 4, production=2)
    state = plans.apply_plan(spark, _plan(spark, first, path), path, plans.stage_alias(first))
    assert state.number == 1
    assert _tables(state) == (
        {("c.s.m", 1): (1, "r1"), ("c.s.m", 2): (2, "r2"), ("c.s.m", 3): (4, "r4"), ("c.s.n", 1): (1, "x")},
        {("c.s.m", "Champion"): 2, ("c.s.n", "Challenger"): 1},
    )
    assert {r.status for r in _plan(spark, first, path).collect()} == {"EXISTS", "NO_SIGNATURE"}

    later = _versions(spark, 6, production=6)
    plan = _plan(spark, later, path)
    after = plans.apply_plan(spark, plan, path, plans.stage_alias(later))
    versions, aliases = _tables(after)
    assert aliases == {("c.s.m", "Champion"): 5, ("c.s.n", "Challenger"): 1}
    assert versions["c.s.m", 4] == (5, "r5") and versions["c.s.m", 5] == (6, "r6") and len(versions) == 6
    # a plan that was applied may be applied again, and what was read before stays
    assert _tables(plans.apply_plan(spark, plan, path)) == (versions, aliases)
    assert _tables(state)[1]["c.s.m", "Champion"] == 2


def test_an_alias_of_a_version_that_did_not_move_stays(spark, tmp_path):
    path = f"{tmp_path}/registry"
    first = _versions(spark, 4, production=2)
    plans.apply_plan(spark, _plan(spark, first, path), path, plans.stage_alias(first))
    unsigned = _versions(spark, 4, production=3)
    state = plans.apply_plan(spark, _plan(spark, unsigned, path), path, plans.stage_alias(unsigned))
    assert _tables(state)[1]["c.s.m", "Champion"] == 2


def test_readers_see_the_old_state_until_the_pointer(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/registry"
    assert plans.read_registry(spark, path).versions.count() == 0
    first = _versions(spark, 2, production=1)
    old = _tables(plans.apply_plan(spark, _plan(spark, first, path), path, plans.stage_alias(first)))
    later = _versions(spark, 5, production=5)
    with monkeypatch.context() as m:
        m.setattr(catalogue, "_point", lambda *_: (_ for _ in ()).throw(SystemExit))
        with pytest.raises(SystemExit):
            plans.apply_plan(spark, _plan(spark, later, path), path, plans.stage_alias(later))
    assert _tables(plans.read_registry(spark, path)) == old
    state = plans.apply_plan(spark, _plan(spark, later, path), path, plans.stage_alias(later))
    assert state.number == 2 and _tables(state)[1]["c.s.m", "Champion"] == 4


def test_a_taken_number_is_refused(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/registry"
    versions = _versions(spark, 2, production=1)
    plan = _plan(spark, versions, path)
    point = catalogue._point

    def outrun(spark, path, number, folder):
        monkeypatch.setattr(catalogue, "_point", point)
        plans.apply_plan(spark, plan, path)
        point(spark, path, number, folder)

    monkeypatch.setattr(catalogue, "_point", outrun)
    with pytest.raises(Exception, match="already exists"):
        plans.apply_plan(spark, plan, path)
    assert plans.read_registry(spark, path).number == 1
