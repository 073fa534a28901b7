import os

from glossator.sources import intermediate


def _there(spark):
    folder = intermediate.own_folder(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.exists(folder) else set()


def test_scopes_delete_what_was_stored_in_them(spark):
    before = _there(spark)
    with intermediate.scope(spark):
        with intermediate.scope(spark):
            pass
        outer = intermediate.stored(spark.range(3), "outer")
        with intermediate.scope(spark):
            intermediate.stored(spark.range(2), "inner")
            assert len(_there(spark) - before) == 2
        assert len(_there(spark) - before) == 1 and outer.count() == 3
    assert _there(spark) == before


def test_a_settled_result_stays_and_goes_with_the_scope_around_it(spark):
    before = _there(spark)
    found = intermediate.settled(spark, "result", lambda: intermediate.stored(spark.range(5), "step"))
    (left,) = _there(spark) - before
    assert left.startswith("result-") and found.count() == 5
    intermediate.forget(found)
    with intermediate.scope(spark):
        intermediate.settled(spark, "result", lambda: spark.range(1))
    assert _there(spark) == before


def test_a_failure_leaves_nothing(spark):
    before = _there(spark)
    try:
        with intermediate.scope(spark):
            intermediate.stored(spark.range(1), "step")
            raise ValueError
    except ValueError:
        pass
    assert _there(spark) == before


def test_clean_deletes_all_of_the_application(spark):
    intermediate.stored(spark.range(1), "left")
    intermediate.clean(spark)
    assert _there(spark) == set()
