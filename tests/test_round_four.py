"""Cases of the fourth round."""

from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import facts
from corpusloom.plans.base import table


def test_state_tables_takes_all_events(spark):
    """Users whose events are all small have states too."""
    sf = "/root/testdata/sf0.01"
    users = {r.user_id for r in table(spark, sf, "events").select("user_id").distinct().collect()}
    assert {r.user_id for r in catalog.queries()["state_tables"](spark, sf).collect()} == users


def _patterns(df):
    """How many regular expressions the plan of a table works out."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")


def test_version_keys_are_made_once_a_row(spark):
    """A record needs its two bounds and the asked version, once for each bound."""
    rows = spark.createDataFrame([("3.9", "3.11", "confirmed"), (None, "3.10.0", "superseded")], "introduced_in string, valid_to string, status string")
    found = facts.with_state(rows, F.concat(F.lit("3.1"), F.element_at(F.array(F.lit("0")), F.length("status") - F.length("status") + 1)))
    assert [r.state for r in found.collect()] == ["applicable", "excluded"]
    assert _patterns(found.select("state")) <= 4


def test_answered_questions_shuffles_no_questions(spark, sf):
    """Questions meet the few numbers as one broadcast row."""
    plan = catalog.queries()["answered_questions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "LeftOuter" not in plan
