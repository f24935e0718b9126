import copy
import math
import random
from collections import Counter
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from namesmith.functions import canopies, vectors
from namesmith.operators import blocking, evaluate, features, hierarchy, pairwise, terms
from namesmith.operators.components import components
from namesmith.plans import registry
from namesmith.schema import author, complete


def mentions(spark, rows):
    df = spark.createDataFrame([(i, f, l, co) for i, f, l, co in rows], "mentionId string, f string, l string, co array<string>")
    me = F.struct(F.col("f").alias("firstName"), F.array().cast("array<string>").alias("middleNames"), F.col("l").alias("lastName"), F.array().cast("array<string>").alias("suffixes"), F.array().cast("array<string>").alias("emails"), F.array().cast("array<string>").alias("institutions"))
    others = F.transform("co", lambda c: F.struct(F.lit("").alias("firstName"), F.array().cast("array<string>").alias("middleNames"), c.alias("lastName"), F.array().cast("array<string>").alias("suffixes"), F.array().cast("array<string>").alias("emails"), F.array().cast("array<string>").alias("institutions")))
    return complete(df.select("mentionId", me.alias("self"), others.alias("coauthors"), F.lit("c").alias("canopy")))


def by_hand(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(0, 60)], [(5, 5)], [], [(i, (i * 7) % 50) for i in range(1, 50)], [(1, 2), (2, 1), (1, 2), (9, 8), (8, 7)]])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    assert dict(map(tuple, components(df).collect())) == by_hand([e for e in edges if e[0] != e[1]])


def test_baseline_rule(spark):
    rows = [("1", "maria", "x", ["p", "q"]), ("2", "mario", "x", ["q"]), ("3", "m", "x", ["q"]), ("4", "maria", "y", ["q"]), ("5", "maria", "x", []), ("6", "alexander", "x", ["q"])]
    df = mentions(spark, rows)
    assert sorted(map(tuple, pairwise.matches(df).collect())) == [("1", "2")]
    got = dict(map(tuple, pairwise.resolve_pairwise(df).collect()))
    assert got == {"1": "1", "2": "1", "3": "3", "4": "4", "5": "5", "6": "6"}
    preset = df.withColumn("entityId", F.when(F.col("mentionId") == "5", "kept"))
    assert dict(map(tuple, pairwise.resolve_pairwise(preset).collect()))["5"] == "kept"


def test_deterministic_rule(spark):
    rows = [("1", "a", "x", ["p", "q"]), ("2", "abcdefg", "x", ["q", "p"]), ("3", "abcdefghijk", "x", ["p", "q"]), ("4", "a", "x", ["q"])]
    assert sorted(map(tuple, pairwise.matches(mentions(spark, rows), pairwise.deterministic).collect())) == [("1", "2"), ("2", "3")]


def test_scores(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")], "mention_id string, entity_id string")
    g = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "mention_id string, entity_id string")
    s = evaluate.pairwise_scores(p, g).first()
    assert (s.tp, s.fp, s.fn, s.precision, s.recall) == (1, 1, 2, 0.5, pytest.approx(1 / 3))
    single = p.withColumn("entity_id", F.col("mention_id"))
    empty = evaluate.pairwise_scores(single, single).first()
    assert empty.tp == 0 and empty.precision != empty.precision
    c = evaluate.cluster_scores(p, p).first()
    assert c.b3_f1 == 1 and c.muc_f1 == 1
    with pytest.raises(Exception, match="only one clustering"):
        evaluate.pairwise_scores(p, g.where("mention_id <> 'a'")).collect()
    with pytest.raises(Exception, match="repeated"):
        evaluate.pairwise_scores(p.union(p.limit(1)), g).collect()
    assert evaluate.markdown_row(evaluate.pairwise_scores(p, g), ["precision"]).first().row == "| 50.00 |"


def test_renumber(spark):
    rows = [(f"{i:04d}", f"e{(i * 37) % 91}") for i in range(400)]
    got = dict(map(tuple, evaluate.renumber(spark.createDataFrame(rows, "mention_id string, entity_id string").repartition(7)).collect()))
    numbers = {}
    assert got == {i: str(numbers.setdefault(e, len(numbers))) for i, e in rows}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_renumber_many(spark, adaptive):
    """Many ranges, each of several partitions' rows: numbers are the dense rank, row for row."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        ids = spark.range(300_000).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("mention_id"), F.xxhash64(F.col("id") % 200_000).cast("string").alias("entity_id"))
        got = evaluate.renumber(ids).select(F.sum(F.when(F.col("entity_id").cast("long") == F.col("mention_id").cast("long") % 200_000, 1).otherwise(0)).alias("right"), F.count("*").alias("n")).first()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert (got.right, got.n) == (300_000, 300_000)


def sample_mentions(spark):
    rng = random.Random(1)
    rows = []
    for e in range(12):
        first, last = rng.choice(["maria", "mario", "jo", "ann"]), rng.choice(["x", "y"])
        friends = [f"c{e}{k}" for k in range(3)]
        rows += [(f"m{e:02d}{k}", first, last, rng.sample(friends, 2)) for k in range(4)]
    return mentions(spark, rows)


def test_sampler_invariants(spark):
    df, levels = sample_mentions(spark), [canopies.first_and_last, canopies.last_and_first_n(1)]
    run = lambda d, **k: dict(map(tuple, hierarchy.resolve(d, levels, hierarchy.Model(**k)).collect()))
    one = run(df)
    assert len(one) == df.count()
    assert one == run(df.repartition(5)), "partitioning must not matter"
    block = {r.mentionId: (r.self.lastName, r.self.firstName[:1]) for r in df.collect()}
    assert all(block[m] == block[e] for m, e in one.items())
    greedy = run(df, greedy=True)
    gold = df.select(F.col("mentionId").alias("mention_id"), F.substring("mentionId", 1, 3).alias("entity_id"))
    scored = evaluate.pairwise_scores(spark.createDataFrame(list(greedy.items()), "mention_id string, entity_id string"), gold).first()
    assert scored.f1 > 0.5


def test_groups_larger_than_a_task(spark):
    """What a cap makes of a group is what one task makes of it.

    This model gains by drawing in lone mentions, whoever they are, so one task
    ends with one entity; so must tasks of 20.
    """
    rows = [(f"m{e}{k:03d}", "ann", "x", [f"c{e}", f"d{e}"]) for e in range(3) for k in range(60)]
    run = lambda most: dict(map(tuple, hierarchy.resolve(mentions(spark, rows), [canopies.first_and_last], hierarchy.Model(greedy=True, size_weight=0.0), most=most).collect()))
    whole, capped = run(1000), run(20)
    assert len(whole) == len(capped) == 180
    assert set(whole.values()) == set(capped.values()) == {"m0000"}


def plain_sample(leaves, model, rng):
    """The sampler by copies of whole trees, every score made anew."""
    nodes = list(leaves)
    for _ in range(len(nodes) * model.steps_per_node):
        a, b = rng.sample(range(len(nodes)), 2)
        options = hierarchy.moves(nodes[a], nodes[b])
        results = []
        for i in range(len(options)):
            kind, big, small = options[i]
            copied = copy.deepcopy(nodes)
            at = {id(x): c for x, c in zip(nodes, copied)}
            big, small = at[id(big)], at[id(small)]
            gone, made = [], []
            if kind == "up":
                new = hierarchy.Node({k: Counter() for k in big.bags}, [0.0] * len(big.vec))
                for x in (big, small):
                    x.parent = new
                    new.children.append(x)
                made = [new]
            else:
                moved = small if kind == "left" else big
                if parent := moved.parent:
                    parent.children = [c for c in parent.children if c is not moved]
                    moved.parent = None
                    if len(parent.children) == 1 and not parent.leaf:
                        only = parent.children[0]
                        only.parent = parent.parent
                        if parent.parent:
                            parent.parent.children = [only if c is parent else c for c in parent.parent.children]
                        gone = [parent]
                if kind == "left":
                    moved.parent = big
                    big.children.append(moved)
            copied = [x for x in copied if not any(x is g for g in gone)] + made
            results.append(copied)
        if not options:
            continue
        gains = [sum(hierarchy.node_score(x, model) for x in summed(r)) - sum(hierarchy.node_score(x, model) for x in summed(nodes)) for r in results]
        gains = [0.0, *gains]
        best = max(gains)
        pick = rng.choices(range(len(gains)), [math.exp(g - best) for g in gains])[0]
        if pick:
            nodes = results[pick - 1]
    return sorted(sorted(x.leaf for x in n.leaves()) for n in nodes if n.parent is None)


def summed(nodes):
    """Inner nodes with bags, vectors and counts summed from their leaves."""
    for n in nodes:
        if not n.leaf:
            found = [x for x in n.nodes() if x.leaf]
            n.bags = {k: sum((x.bags[k] for x in found), Counter()) for k in n.bags}
            n.count, n.vec = sum(x.count for x in found), [sum(v) for v in zip(*(x.vec for x in found))]
            n.squares = {k: sum(v * v for v in c.values()) for k, c in n.bags.items()}
    return nodes


@pytest.mark.parametrize("seed", range(6))
def test_sampler_against_a_plain_one(seed):
    def leaves():
        rng = random.Random(seed)
        bag = lambda words: Counter(rng.choices(words, k=rng.randrange(3)))
        out = []
        for i in range(9):
            bags = {k: bag(["p", "q", "r"]) for k in hierarchy.BAGS} | {"firstNames": Counter([rng.choice(["ann", "a", "bob"])])}
            out.append(hierarchy.Node(bags, [rng.random(), rng.random()], f"m{i}", 1))
        return out

    model = hierarchy.Model(steps_per_node=8)
    got = hierarchy.sample(leaves(), model, random.Random(seed))
    assert sorted(sorted(x.leaf for x in r.leaves()) for r in got) == plain_sample(leaves(), model, random.Random(seed))
    for r in got:
        for x in r.nodes():
            assert x.score == pytest.approx(hierarchy.node_score(x, model))


@pytest.mark.parametrize("seed", range(3))
def test_wide_nodes_are_scored_as_columns(seed, monkeypatch):
    """Children scored one by one or as columns: the same trees, and scores that are those made anew."""

    def leaves():
        rng = random.Random(seed)
        bag = lambda words, most: Counter(rng.choices(words, k=rng.randrange(most)))
        some = lambda: {k: bag([f"{k}{i}" for i in range(12)], 3) for k in hierarchy.BAGS} | {"firstNames": Counter(["ann"]), "middleNames": Counter(["b"])}
        return [hierarchy.Node(some(), [], f"m{i:03d}", 1) for i in range(60)]

    found = []
    for wide in (10**9, 3):
        monkeypatch.setattr(hierarchy, "WIDE", wide)
        roots = hierarchy.sample(leaves(), hierarchy.Model(steps_per_node=40), random.Random(seed))
        found.append(sorted(sorted(x.leaf for x in r.leaves()) for r in roots))
        for x in (x for r in roots for x in r.nodes()):
            assert x.score == pytest.approx(hierarchy.node_score(x, hierarchy.Model()))
            if x.parent:
                assert {k: x.over[k] for k in x.over} == {k: hierarchy.bag_dot(x.bags[k], x.parent.bags[k]) for k in x.over}
    assert found[0] == found[1] and len(found[0]) < 60


def test_name_score():
    w = hierarchy.Name(initial=20, name=10, saturation=40, missing=25, weight=2)
    assert hierarchy.name_score(Counter("abcdef"), True, w) == -80
    assert hierarchy.name_score(Counter(), True, w) == -50
    assert hierarchy.name_score(Counter(["ann", "bob"]), False, w) == -2 * (20 + 30)
    assert hierarchy.name_score(Counter(["ann", "a"]), False, w) == 0


def test_vectors(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(vectors.dot(lit(1, 2), lit(3, 4))) == 11
    nan = one(vectors.cosine(lit(0, 0), lit(1, 0)))
    assert nan != nan
    with pytest.raises(Exception, match="differ in length"):
        one(vectors.dot(lit(1), lit(1, 2)))
    bag = vectors.bag(F.array(F.lit("a"), F.lit("b"), F.lit("a")))
    assert one(bag) == {"a": 2.0, "b": 1.0}
    assert one(vectors.bag_minus(vectors.bag_sum(bag, bag), bag)) == {"a": 2.0, "b": 1.0}
    none = F.create_map().cast("map<string,double>")
    assert one(vectors.bag_cosine(bag, none)) == 0 and one(vectors.bag_entropy(none)) == 0 and one(vectors.size_prior(none)) == 0


def test_pooled_and_nearest(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("z", [0.0, 0.0])], "word string, vec array<double>")
    rows = spark.createDataFrame([(1, ["a", "b", "zz"]), (2, []), (3, ["a", "a", "b"])], "id int, words array<string>")
    assert {r.id: r.vec for r in features.pooled(rows, "id", "words", store, 2).collect()} == {1: [0.5, 0.5], 2: [0.0, 0.0], 3: [pytest.approx(2 / 3), pytest.approx(1 / 3)]}
    assert {r.id: r.vec for r in features.pooled(rows, "id", "words", store, 2, mean=False).collect()}[3] == [2.0, 1.0]
    assert [r.word for r in features.nearest(store, "a", 2).collect()] == ["a", "c"]
    assert features.nearest(store, "nobody", 2).count() == 0


def planted(spark, entities=40, size=12, seed=2):
    """One block of mentions; each has three of its entity's five coauthors and words that all share."""
    rng = random.Random(seed)
    rows = [(f"m{e:02d}{k:02d}", "ann", "x", rng.sample([f"c{e}_{j}" for j in range(5)], 3)) for e in range(entities) for k in range(size)]
    return mentions(spark, rows)


#: Separates the planted entities: without a shared coauthor a node does not belong.
STRICT = hierarchy.Model(bags={"coauthors": hierarchy.Bag(40, -0.25)}, names={}, size_weight=0.0)


def test_groups_over_the_cap_meet_as_if_there_were_none(spark):
    """Pair recall where 480 roots meet in tasks of 60 is that of one task."""
    df = planted(spark)
    gold = df.select(F.col("mentionId").alias("mention_id"), F.substring("mentionId", 1, 3).alias("entity_id"))
    score = {}
    for most, model in ((10_000, replace(STRICT, steps_per_node=300)), (60, STRICT)):  # about as many proposals in all
        found = hierarchy.resolve(df, [canopies.first_and_last], model, most=most)
        score[most] = evaluate.pairwise_scores(found, gold).first()
    assert score[60].precision > 0.98
    assert score[60].recall >= score[10_000].recall - 0.03
    assert score[60].recall > 0.9


def test_every_two_lots_meet_once_a_sweep(spark):
    """On planes of several orders: two roots of different lots share one line in a sweep, two of one lot all."""
    for order in (2, 5, 7):
        rows = spark.range(200).select(F.col("id").cast("string").alias("node"))
        turns = range(order + 1)
        lines = rows.select("node", *(hierarchy.line(F.col("node"), F.lit(order), 3, t).alias(f"t{t}") for t in turns)).collect()
        for r in lines[:40]:
            for s in lines:
                meetings = sum(r[f"t{t}"] == s[f"t{t}"] for t in turns)
                assert meetings in (1, order + 1)
    assert [hierarchy.prime(n) for n in (1, 2, 4, 9, 14, 20)] == [2, 2, 5, 11, 17, 23]
    assert hierarchy.plane(2000, 2000) == 1 and hierarchy.plane(2001, 2000) == 2 and hierarchy.plane(10**6, 2000) == 557


def test_results_do_not_depend_on_partitions_over_the_cap(spark):
    df = planted(spark, 12, 6)
    run = lambda d: dict(map(tuple, hierarchy.resolve(d, [canopies.first_and_last], STRICT, most=20).collect()))
    assert run(df) == run(df.repartition(7))


def test_two_and_eight_shared_values_by_prefixes(spark):
    """The whole rule against every pair of a block, and how many pairs the count filter saves."""
    rng = random.Random(11)
    rows = []
    for i in range(160):
        some = lambda head, kinds, n: [f"{head}{min(rng.randrange(kinds), rng.randrange(kinds))}" for _ in range(rng.randint(0, n))]
        rows.append((f"m{i:03d}", rng.choice(["ann", "anna", "annabellissima", ""]), rng.choice("xy"), some("c", 60, 8), some("e", 400, 2), some("o", 300, 2), some("t", 40, 25), some("k", 4, 2)))
    rows += [(r[0] + "z", *r[1:]) for r in rows[:5]]
    df = spark.createDataFrame(rows, "mentionId string, f string, l string, c array<string>, e array<string>, o array<string>, topics array<string>, keywords array<string>")
    m = complete(df.select("mentionId", author(F.col("f"), None, F.col("l"), None, F.col("e"), F.col("o")).alias("self"), F.transform("c", lambda c: author(None, None, c)).alias("coauthors"), "topics", "keywords"))
    m = blocking.assign(m, canopies.last_and_first_n(1)).repartition(3)
    edits = lambda a, b: hierarchy.edits(a, b)
    share = lambda x, y, k: len(set(x[k]) & set(y[k]))
    want = {
        (x[0], y[0]) for x in rows for y in rows
        if x[0] < y[0] and x[2] == y[2] and x[1][:1] == y[1][:1] and edits(x[1], y[1]) < 8 and (share(x, y, 4) or share(x, y, 5) or share(x, y, 3) >= 2 or (share(x, y, 6) >= 8 and share(x, y, 7)))
    }
    assert set(map(tuple, pairwise.matches(m, pairwise.deterministic).collect())) == want and len(want) > 100
    assert any(share(x, y, 6) >= 8 for x in rows for y in rows if (x[0], y[0]) in want)
    pairs = lambda e: pairwise.candidates(pairwise.keys(m), e).alias("x").join(pairwise.candidates(pairwise.keys(m), e).alias("y"), F.expr("x.canopy = y.canopy and x.mark = y.mark and x.id < y.id")).count()
    assert pairs((("coauthors", 2),)) < 0.6 * pairs((("coauthors", 1),))
    assert pairs((("topics", 8),)) < 0.25 * pairs((("topics", 1),))


@pytest.mark.parametrize("pack", [1, 3, 256])
def test_rows_that_a_rule_cannot_tell_apart(spark, pack, monkeypatch):
    """Packs of equal rows, dense and sparse blocks, and repeated ids give the pairs of the plain rule, each once."""
    monkeypatch.setattr(pairwise, "PACK", pack)
    monkeypatch.setattr(pairwise, "SHARE", 2)
    rng = random.Random(pack)
    rows = [(f"{i:02d}", rng.choice(["maria", "mario", "alexander"]), rng.choice("xy"), rng.choice([["p"], ["q", "p"], ["p", "q"], ["r"], [f"s{i}"]])) for i in range(40)]
    rows += [rows[0], (rows[1][0], "maria", "x", ["p", "q"])]
    df = mentions(spark, rows)
    x, y = (pairwise.keys(df).alias(n) for n in "xy")
    for rule in (pairwise.baseline, pairwise.deterministic):
        want = sorted(set(map(tuple, x.join(y, F.expr("x.id < y.id") & rule("x", "y")).select("x.id", "y.id").collect())))
        assert sorted(map(tuple, pairwise.matches(df, rule).collect())) == want and len(want) > 10


@pytest.mark.parametrize("pack", [2, 256])
def test_equal_pairs(spark, pack, monkeypatch):
    monkeypatch.setattr(pairwise, "PACK", pack)
    rows = [(i, "ab"[i % 2] if i % 5 else None, i % 3) for i in range(30)]
    got = sorted(map(tuple, pairwise.equal_pairs(spark.createDataFrame(rows, "id long, k string, n int"), "id", ["k", "n"]).collect()))
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1:] == b[1:])


def test_outcome_counts(spark):
    """Counts from the contingency table are those of the listed pairs; an outcome without pairs has no row."""
    rng = random.Random(3)
    p, g = (spark.createDataFrame([(f"m{i}", rng.choice("abc")) for i in range(60)], "mention_id string, entity_id string") for _ in "pg")
    for x, y in ((p, g), (p, p)):
        assert sorted(map(tuple, evaluate.outcome_counts(x, y).collect())) == sorted(map(tuple, evaluate.pair_outcomes(x, y).groupBy("outcome").count().collect()))


def test_pooled_makes_no_row_for_each_dimension(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, None])], "word string, vec array<double>")
    rows = spark.createDataFrame([(1, ["a", "a", "b", "c"])], "id int, words array<string>")
    found = features.pooled(rows, "id", "words", store, 2)
    assert found.first().vec == [0.75, pytest.approx(1 / 3)]
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["score_terms", "score_terms_of_people"])
def test_a_name_is_not_one_task(spark, name):
    """Rows of one name are dealt to tasks by id."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "GroupsInPandas" not in plan


def test_terms_of_many_pairs_are_those_of_nodes(spark):
    """Scores alone and gains as columns against trees of one and two nodes, for the whole model and each term."""
    from namesmith.plans.file_queries import TERMS

    rng = random.Random(4)
    bag = lambda k: {f"{k}{t}": float(n) for t, n in Counter(rng.choices("abcdef", k=rng.randrange(6))).items()}
    rows = []
    for i in range(40):
        name = {n: 1.0 for n in rng.sample(["ann", "a", "bob", "annabel"], rng.randrange(3))}
        rows.append((f"m{i:02d}", rng.choice([[0.0, 0.0, 0.0], [rng.uniform(-1, 1) for _ in range(3)]]), *(name if k == "firstNames" else bag(k) for k in hierarchy.BAGS)))
    one = terms.measured(spark.createDataFrame(rows, "id string, vec array<double>, " + ", ".join(f"{k} map<string,double>" for k in hierarchy.BAGS)))
    whole = one.select("id", F.struct("*").alias("one"))
    found = whole.join(whole.select(F.col("id").alias("before"), F.col("one").alias("other")), F.expr("before = 'm' || lpad(cast(substr(id, 2) as int) + 1, 2, '0')"), "left")
    found = terms.paired(found).toPandas().sort_values("id")
    assert found["two"].sum() == 39
    for model in (hierarchy.Model(), *TERMS.values()):
        alone, gain = terms.scores(found, model)
        for i, (r, s) in enumerate(zip(rows, [*rows[1:], None])):
            a, *rest = (hierarchy.Node({k: Counter({t: int(n) for t, n in b.items()}) for k, b in zip(hierarchy.BAGS, x[2:])}, x[1], x[0], 1) for x in (r, s) if x)
            a.score = hierarchy.node_score(a, model)
            assert alone[i] == pytest.approx(a.score, abs=1e-11)
            for b in rest:
                b.score = hierarchy.node_score(b, model)
                trial = hierarchy.Trial(model)
                trial.do(("up", a, b))
                assert gain[i] == pytest.approx(trial.gain(), abs=1e-11)
                trial.undo()
            assert rest or gain[i] != gain[i]


def test_numbers_of_bags_and_of_what_they_share():
    """A batch's numbers against counters, with empty and absent bags."""
    rng = random.Random(5)
    bags = [[Counter(rng.choices("abcdef", k=rng.randrange(8))) if rng.random() < 0.9 else None for _ in range(60)] for _ in range(2)]
    column = lambda s, kind, use: pa.array([None if b is None else list(use(b)) for b in s], pa.list_(kind))
    got = terms.numbers(*((column(s, pa.string(), lambda b: b), column(s, pa.float64(), lambda b: map(float, b.values()))) for s in bags))
    assert set(got) == set(terms.NUMBERS)
    weighed = lambda ns: sum(n * math.log(n) for n in ns)
    for i, (a, b) in enumerate(zip(*(map(lambda x: x or Counter(), s) for s in bags), strict=True)):
        both = a.keys() & b.keys()
        for x, bag in (("", a), ("2", b)):
            assert [got[f"{n}{x}"][i] for n in ("kinds", "sum", "square")] == [len(bag), bag.total(), sum(n * n for n in bag.values())]
            assert got[f"weighed{x}"][i] == pytest.approx(weighed(bag.values()))
        assert (got["kinds_both"][i], got["dot_both"][i]) == (len(both), sum(a[t] * b[t] for t in both))
        assert got["more_both"][i] == pytest.approx(weighed((a + b).values()) - weighed(a.values()) - weighed(b.values()))
    nothing = (pa.array([[], None], pa.list_(pa.string())), pa.array([[], None], pa.list_(pa.float64())))
    assert all(x.dtype == float and not x.any() for x in terms.numbers(nothing, nothing).values())
