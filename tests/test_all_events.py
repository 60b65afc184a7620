"""Every event takes part."""

from confab.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_event_is_appended_once(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id").collect()
    got = catalog.QUERIES["events_append_unseen"](spark, SF).select("event_id", "user_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, events))


def test_every_event_renames(spark):
    want = {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: r.event_id):
        want[r.user_id, "seed"], want[r.user_id, r.event_type] = "0", str(r.event_id)
    got = catalog.QUERIES["names_upsert"](spark, SF).collect()
    assert {(r.user_id, r.name): r.value for r in got} == want and len(got) == len(want)
