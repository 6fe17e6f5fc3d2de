"""Itineraries are built from all stop times."""

from pyspark.sql import functions as F

from headway.plans import catalog, itineraries
from headway.plans import views as v

SF = "/root/testdata/sf0.001"


def test_every_trip_is_evaluated(spark):
    times = v.stop_times(spark, SF).toPandas()
    rides = {k: g.sort_values("seq") for k, g in times.groupby("trip_id") if len(g) > 1}
    trips = v.trips(spark, SF).toPandas().set_index("trip_id")
    rides = {k: g for k, g in rides.items() if k in trips.index}
    got = {int(r.itinerary_id): r for r in itineraries._itineraries(spark, SF).collect()}
    assert set(got) == set(rides) and len(got) > 1000
    for k, r in got.items():
        a, b = rides[k].iloc[0], rides[k].iloc[-1]
        assert r.departure == a.departure - 120 and tuple(r.legs[0].alternatives[0]) == (a.departure, b.arrival)
        assert [x.departure for x in r.legs[0].alternatives] == sorted(x.departure for x in r.legs[0].alternatives)
    both = [r for r in got.values() if len(r.legs) == 2]
    assert both and all(r.legs[1].alternatives[0].departure >= r.legs[0].alternatives[0].arrival + 60 for r in both)
    assert any(len(x.alternatives) > 1 for r in got.values() for x in r.legs)
    rows = catalog.QUERIES["lognormal_cdf"](spark, SF)
    assert rows.count() == len(times) and rows.filter(F.col("cdf_900") < F.col("cdf_60")).count() == 0
