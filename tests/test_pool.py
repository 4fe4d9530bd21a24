from signetry.operators import interventions as iv


def test_proposals_that_hit_little_still_fill_the_pool(spark):
    home = lambda i: 0 if i < 10 else 1 if i < 20 else 2
    partition = spark.createDataFrame([(i, home(i)) for i in range(2000)], "node_id bigint, community int")
    gray = spark.createDataFrame([(0, 1, g) for g in (100, 200, 300)], "community_1 int, community_2 int, node_id bigint")
    occupied = spark.createDataFrame([(0, 100), (100, 200)], "source bigint, target bigint")
    whole = {(r["source"], r["target"]) for r in iv.candidate_pool(gray, partition, occupied, 100, 17).collect()}
    assert len(whole) == 3 * 20 + 3 - 2
    for cap in (30, 100):
        found = {(r["source"], r["target"]) for r in iv.candidate_pool(gray, partition, occupied, cap, 17, exact=0).collect()}
        assert len(found) == min(cap, len(whole)) and found <= whole
