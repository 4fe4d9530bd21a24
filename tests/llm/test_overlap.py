import random

from pyspark.sql import functions as F

from signetry.llm.overlap import event_overlaps, node_aliases, prefix_candidates, prefix_join

EVENTS = "event_id bigint, source bigint, target bigint, sign int, timestamp bigint, extra string, low string"
T0 = 1_400_000_000


def _pairs(df):
    return sorted((r["split_name"], r["train_event_id"], r["eval_event_id"]) for r in df.collect())


def test_overlaps_against_all_pairs(spark):
    r = random.Random(5)

    def events(first, n):
        out = []
        for i in range(n):
            t = T0 + r.randint(0, 3000)
            stamp = r.choice([t, t * 1000 + 7, t * 1_000_000 + 9, None, 0, -1]) if r.random() < 0.4 else t
            out.append((first + i, r.choice([0, 1, 2, 3, None]), r.randint(0, 4), r.choice([1, -1, None]), stamp, "x", "y"))
        return out + out[:5]

    train, val, test = events(0, 150), events(1000, 60), events(2000, 60)
    mapping = spark.createDataFrame([(0, "Ann B"), (4, "ann_b\t"), (1, "c"), (2, None), (3, "d"), (3, "d"), (None, "c")], "node_id bigint, raw_node_id string")
    frames = [spark.createDataFrame(x, EVENTS) for x in (train, val, test)]
    got = _pairs(event_overlaps(frames[0], {"val": frames[1], "test": frames[2]}, mapping))

    def usable(e):
        s, t, stamp = (None if e[1] is None else 0 if e[1] == 4 else e[1]), (0 if e[2] == 4 else e[2]), e[4]
        if s is None or s == t or not stamp or stamp <= 0:
            return None
        while stamp >= 10**11:
            stamp //= 1000
        return (min(s, t), max(s, t)), stamp

    want = set()
    for name, part in (("val", val), ("test", test)):
        for a in train:
            for b in part:
                x, y = usable(a), usable(b)
                if x and y and x[0] == y[0] and abs(x[1] - y[1]) <= 120:
                    want.add((name, a[0], b[0]))
    assert got == sorted(want) and want


def test_the_limit_is_inclusive(spark):
    train = spark.createDataFrame([(1, 5, 6, 1, T0, "", "")], EVENTS)
    val = spark.createDataFrame([(10 + d, 6, 5, -1, T0 + d, "", "") for d in (-121, -120, 0, 120, 121)], EVENTS)
    mapping = spark.createDataFrame([], "node_id bigint, raw_node_id string")
    assert [p[2] - 10 for p in _pairs(event_overlaps(train, {"val": val}, mapping))] == [-120, 0, 120]
    assert _pairs(event_overlaps(train.limit(0), {"val": val}, mapping)) == []
    assert _pairs(event_overlaps(train, {"val": val.limit(0)}, mapping)) == []


def test_aliases_go_from_node_to_node(spark, rows):
    mapping = spark.createDataFrame([(1, "A"), (2, "a_"), (2, "B"), (3, " b"), (4, "z")], "node_id bigint, raw_node_id string")
    assert rows(node_aliases(mapping)) == [(2, 1), (3, 1)]


def test_prefix_join_equals_all_pairs(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(40)]

    def table(n, first):
        return [(first + i, sorted({r.choice(words[: r.choice([5, 40])]) for _ in range(r.randint(0, 9))}), "same") for i in range(n)] + [(first + n, None, "same")]

    a, b = table(80, 0), table(80, 1000)
    b[3] = (b[3][0], a[5][1], "same")
    x, y = (spark.createDataFrame(t, "key bigint, shingles array<string>, note string") for t in (a, b))
    for args in ({"jaccard": 0.5}, {"jaccard": 0.8}, {"overlap": 3}, {"overlap": 1}):
        got = {(p["train"]["key"], p["evaluation"]["key"]) for p in prefix_join(x.withColumn("shingles", F.col("shingles")), y, **args).collect()}
        want = set()
        for k, s, _ in a:
            for j, t, _ in b:
                if s and t:
                    common = len(set(s) & set(t))
                    if common >= args["overlap"] if "overlap" in args else common / len(set(s) | set(t)) >= args["jaccard"] - 1e-12:
                        want.add((k, j))
        assert got == want, args


def test_each_filter_keeps_pairs_from_the_verification(spark):
    """Of the evaluation records' shingles r1, r2 and z occur once, c9 twice, c0 to c8 three times."""
    schema, common = "key bigint, shingles array<string>", [f"c{i}" for i in range(10)]
    evaluation = spark.createDataFrame([(10, common[:9] + ["r1"]), (11, common), (12, ["r2", "z"]), (13, common)], schema)

    def candidates(shingles, **args):
        found = prefix_candidates(spark.createDataFrame([(1, shingles)], schema), evaluation, **args)
        return {(r[0], r[1]) for r in found.select("evaluation.record.key", "shingle").collect()}

    assert candidates(["r2", "q1", "q2", "q3"], jaccard=0.2) == {(12, "r2")}
    assert candidates(["r2", "q1", "q2", "q3"], jaccard=0.3) == set()  # places: three absent ones come before r2
    assert candidates(["r2", "z", *common[:8]], jaccard=0.25) <= {(10, c) for c in common} | {(11, c) for c in common} | {(13, c) for c in common}  # sizes
    assert candidates(["c9", "q"], overlap=2) == set()  # too few shingles that any evaluation record has
    assert candidates(["c8", "c9"], overlap=2) == {(11, "c9"), (13, "c9")}  # the rarest alone is the prefix
    assert {s for k, s in candidates(["c6", "c7", "c8", "c9"], jaccard=0.2) if k == 10} == {"c6"}  # behind c7 too few are left


def test_the_found_query_uses_the_general_path(spark):
    """Two events a grid border apart share two of three shingles, those two borders apart are no candidates."""
    from signetry.llm import overlap

    assert overlap.GRIDS - 1 > 1
    train = spark.createDataFrame([(1, 5, 6, 1, 363 * 4_000_000, "", "")], EVENTS)
    for d, hit in ((0, True), (120, True), (-120, True), (121, False), (250, False)):
        val = spark.createDataFrame([(2, 6, 5, 1, 363 * 4_000_000 + d, "", "")], EVENTS)
        mapping = spark.createDataFrame([], "node_id bigint, raw_node_id string")
        assert bool(_pairs(event_overlaps(train, {"val": val}, mapping))) == hit
