"""Pairs of items, top N, names and mixing."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cinelake.llm import mixing, names, pairs, topn


def brute_pairs(rows, least):
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    n = Counter(i for s in baskets.values() for i in s)
    both = Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    return {(a, b, k, n[a], n[b], len(baskets)) for (a, b), k in both.items() if k >= least}


@pytest.mark.parametrize("chunk", [256, 4, 7])
def test_pairs_in_blocks(spark, chunk):
    rng = random.Random(1)
    rows = [(b, f"i{rng.randrange(25)}") for b in range(12) for _ in range(rng.choice([1, 4, 30]))]
    rows += rows[:10] + [(None, "i1"), (3, None)]
    df = spark.createDataFrame([(b, i, "x", 0) for b, i in rows], "basket long, thing string, item string, n int")
    got = pairs.together(df, "basket", "thing", 2, chunk)
    assert {tuple(r)[:6] for r in got.collect()} == brute_pairs(rows, 2)
    r = got.first()
    assert math.isclose(r.lift, r.n_both * r.baskets / (r.n_a * r.n_b))


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "b long, i string")
    assert pairs.together(df, "b", "i").count() == 0


def top(rows, n):
    groups = defaultdict(set)
    for g, i, s, t in rows:
        if None not in (g, i, s) and not math.isnan(s) and 0 <= s <= 1:
            groups[g].add((-s, math.inf if t is None else t, i))
    return {(g, i, k + 1) for g, x in groups.items() for k, (_, _, i) in enumerate(sorted(x)[:n])}


def test_top_n_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(topn, "GROUP_ROWS", 700)
    monkeypatch.setattr(topn, "ROW_GROUP_ROWS", 200)
    rng = random.Random(2)
    rows = [(7 if k % 3 == 0 else rng.randrange(40), k, rng.choice([0.1, 0.5, 0.9, 0.99, rng.random()]), rng.choice([None, 1.0, 2.0])) for k in range(9000)]
    rows += rows[:50] + [(1, 99_001, float("nan"), 0.0), (1, 99_002, 1.5, 0.0), (1, 99_003, -0.1, 0.0), (None, 99_004, 0.5, 0.0), (1, None, 0.5, 0.0), (1, 99_005, None, 0.0), (1, 99_006, float("inf"), 0.0)]
    df = spark.createDataFrame([(g, i, s, t, 1, "x") for g, i, s, t in rows], "grp long, id long, sc double, tie double, g int, score string")
    got = topn.top_n(df, 3, "grp", "sc", "id", "tie", 0.0, 1.0)
    assert {(r.group_id, r.item_id, r["rank"]) for r in got.collect()} == top(rows, 3)
    assert topn.top_n(df.limit(0), 3, "grp", "sc", "id").count() == 0


def test_row_groups_of_a_hot_group_are_passed_over(spark):
    df = spark.range(60_000).selectExpr("case when id % 3 = 0 then 7L else id end as g", "id", "cast(xxhash64(id) % 1000 as double) / 1000 as sc").filter("sc >= 0")
    path = topn.cluster(df, "g", "sc", "id")
    got = topn.skips(spark, path, 3).first()
    assert got.passed_over >= 2 and got.read + got.passed_over == topn.skips(spark, path, 10**9).first().read
    want = {(r.group_id, r.item_id, r["rank"]) for r in topn.top_of(spark, path, 3).collect()}
    assert want == top([(r.g, r.id, r.sc, None) for r in df.collect()], 3)
    assert tuple(topn.skips(spark, topn.cluster(df.limit(0), "g", "sc", "id"), 3).first())[1] == 0


def test_row_groups_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.range(200_000).selectExpr("5L as g", "double(id) / 200000 as score", "0D as tie", "id").coalesce(1).sortWithinPartitions("g", F.desc("score"))
    df.write.option("parquet.block.size", 64 << 10).option("parquet.page.size", 16 << 10).parquet(path)
    file = next(tmp_path.glob("c/*.parquet"))
    best, read, skipped = topn._scan("file:" + str(file), 3)
    assert best["id"].to_pylist() == [199_999, 199_998, 199_997] and skipped > 0 and read <= 2


PEOPLE = [
    (1, "Benjamin Falstirkeirbit"), (2, "Ben Falstirkeirbit [archive]"), (3, "FALSTIRKEIRBIT, BENJAMIN"), (4, "Benjamin J Falstirkerbit"), (5, "B. Falstirkeirbit"), (6, "BenjaminFálstirkeirbit"), (7, "Falstirkeirbit Benjamin - channel"),
    (8, "Rosa Falstirkeirbit"), (9, "Benjamin Kuzmertdar"), (10, None), (11, ""), (12, "???"), (13, "Rosa Falstirkeirbit"), (14, "Benjamin Otto Falstirkeirbit"),
]
STUDIOS = [(1, "Feilkgosk-Hullwamb Saffron Entertainment"), (2, "The Feilkgoskhullwamb Saffron Ent. Ltd."), (3, "Feilkgoskhullwamb Granite Media"), (4, "feilkgokshullwamb_saffron"), (5, "Med. Feilkgoskhullwamb Granite"), (6, "Feilkgoskhullwamb G. Media GmbH"), (7, "Other Saffron Entertainment")]


def linked(spark, rows, kind):
    extra = [(1000 + k, f"{a} Zurn{b}drad{k}") for k, (a, b) in enumerate(itertools.product(("Benjamin", "Rosa", "Otto", "Saffron", "Granite"), "abcdefghijkl"))]
    df = spark.createDataFrame([(i, n, "x") for i, n in rows + extra + rows[:3]], "id long, name string, form string")
    entity = {r.id: r.entity for r in names.link([("k", df, kind)])[0].collect()}
    return entity


def test_variants_of_people(spark):
    got = linked(spark, PEOPLE, "person")
    assert {got.get(i) for i in (1, 2, 3, 4, 5, 6, 7, 14)} == {1}
    assert got[8] == got[13] == 8 and not {9, 10, 11, 12} & set(got)


def test_variants_of_organisations(spark):
    got = linked(spark, STUDIOS, "organisation")
    assert got[1] == got[2] == got[4] == 1 and got[3] == got[5] == got[6] == 3 and 7 not in got


def test_initials_that_fit_two_people_link_with_neither(spark):
    got = linked(spark, [(1, "Basil Klirnwotbank"), (2, "Benjamin Klirnwotbank"), (3, "B. Klirnwotbank")], "person")
    assert not {1, 2, 3} & set(got)


def test_kinds_do_not_mix_and_scores_are_rarities(spark):
    people = spark.createDataFrame([(5, "Rosa Falstirkeirbit"), (6, "Falstirkeirbit, Rosa"), (7, "Otto Zurndrad")], "id long, name string")
    firms = spark.createDataFrame([(5, "Rosa Falstirkeirbit Films"), (6, "Granite Falstirk Media"), (7, "Rosa Falstirkeirbit Film Ltd")], "id long, name string")
    entity, links = names.link([("p", people, "person"), ("o", firms, "organisation")])
    assert sorted((r.kind, r.id, r.entity, r.score) for r in entity.collect()) == [(k, i, 5, round(math.log(3), 6)) for k, i in (("o", 5), ("o", 7), ("p", 5), ("p", 6))]
    assert {(r.kind, r.a, r.b) for r in links.collect()} == {("p", 6, 5), ("o", 7, 5)}


def test_a_form_that_most_names_have_links_nothing(spark):
    rows = [(i, f"Rosa Gellkind{' ' * i}[{i}]") for i in range(6)] + [(10, "Otto Zurndrad")]
    assert names.link([("p", spark.createDataFrame(rows, "id long, name string"), "person")])[0].count() == 0


def test_no_names(spark):
    df = spark.createDataFrame([], "id long, name string")
    assert names.link([("p", df, "person"), ("o", df, "organisation")])[0].count() == 0


def test_a_hot_name_forms_stars(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'Rosa Gellkind' else concat('Otto Zurndrad', id) end as name")
    entity, links = names.link([("p", df, "person")])
    assert entity.filter("entity = 0").count() == 1000 and links.count() < 20_000


@pytest.fixture
def documents(spark):
    rows = [(i, "word " * (i % 9 + 1), [" Alpha ", "alpha", "be-ta", "BE_TA", "gamma", None][i % 6], "x") for i in range(3000)]
    rows += [(9001, None, "alpha", "x"), (9002, "", "alpha", "x"), (9003, "y" * 200_000, "delta", "x"), (9004, "😀 odd \x00", "delta", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")


def mix(spark, documents, targets, total=None):
    sized = mixing.tokens(documents, "doc_id", "text", [mixing.source_key(F.col("source")).alias("source")])
    rate = mixing.rates(sized, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), total)
    chosen = mixing.select(sized, rate)
    return chosen, {r.source: r for r in mixing.report(chosen, rate).collect()}


def test_shares_are_reached_under_the_caps(spark, documents):
    chosen, got = mix(spark, documents, [("alpha", 0.6, 3), ("be_ta", 0.3, 1), ("nothing", 0.1, 5)])
    assert abs(got["alpha"].actual_share - 2 / 3) < 0.03 and abs(got["be_ta"].actual_share - 1 / 3) < 0.03
    assert got["nothing"].selected == 0 and got["nothing"].available == 0
    assert chosen.agg(F.max("copies")).first()[0] <= 3 and chosen.filter("source = 'gamma'").count() == 0


def test_a_given_total_stays_under_caps_and_is_repeatable(spark, documents):
    a, got = mix(spark, documents, [("alpha", 0.5, 2), ("gamma", 0.5, 1)], 1_000_000)
    assert got["gamma"].rate == 1.0 and got["alpha"].rate == 2.0
    b, _ = mix(spark, documents.repartition(7), [("alpha", 0.5, 2), ("gamma", 0.5, 1)], 1_000_000)
    assert sorted(map(tuple, a.select("id", "copies").collect())) == sorted(map(tuple, b.select("id", "copies").collect()))


def test_token_counts(spark, documents):
    n = {r.id: r.tokens for r in mixing.tokens(documents, "doc_id", "text", []).filter("id >= 9001 or id = 4").collect()}
    assert n[4] == 6 and n[9001] == n[9002] == 0 and n[9003] > 10_000 and n[9004] > 2


@pytest.mark.parametrize("text", ["y" * 200_000, "a line of words\n" * 12_000, " " * 60_000 + "x", "αβγ, δ! " * 20_000])
def test_long_texts_are_counted_whole(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert mixing.tokens(df, "doc_id", "text", []).first().tokens == len(mixing._tokenizer(mixing.VOCABULARY).encode_ordinary(text))


def test_mixing_nothing(spark, documents):
    chosen, got = mix(spark, documents.limit(0), [("alpha", 1.0, 2)])
    assert chosen.count() == 0 and got["alpha"].actual_share == 0.0
    assert mix(spark, documents, [])[0].count() == 0


def test_mixing_equals_sql(spark):
    import duckdb

    from cinelake.llm.queries import _mix
    from tests.compare import DATA, assert_equal

    sized, rate = _mix(spark, DATA)
    chosen = mixing.select(sized, rate)
    db = duckdb.connect()
    tokens, picked = sized.toPandas(), chosen.toPandas()
    db.register("tokens", tokens), db.register("picked", picked)
    encode = mixing._tokenizer(mixing.VOCABULARY).encode_ordinary
    texts = {r.doc_id: len(encode(r.text)) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert texts == dict(zip(tokens.id.tolist(), tokens.tokens.tolist()))
    rates = f"""WITH t AS (SELECT nullif(regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g'), '') AS source, sum(target_share) AS share, max(max_repeats) AS cap FROM '{DATA}/mix_targets.parquet' GROUP BY 1),
h AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS available FROM tokens WHERE source IS NOT NULL GROUP BY 1), b AS (SELECT t.source, share, cap, coalesce(available, 0) AS available FROM t LEFT JOIN h USING (source)),
w AS (SELECT sum(share) AS whole, min(available * cap / share) AS most FROM b WHERE available > 0)
SELECT source, share AS target_share, available, CASE WHEN available > 0 THEN least(cap, most * share / available) ELSE 0 END AS rate FROM b, w"""
    assert_equal(rate, db, rates)
    report = f"""WITH r AS ({rates}), g AS (SELECT source, count(*) AS documents, CAST(sum(tokens * copies) AS BIGINT) AS selected FROM picked GROUP BY 1)
SELECT r.*, coalesce(documents, 0) AS documents, coalesce(selected, 0) AS selected, coalesce(selected, 0) / (SELECT sum(selected) FROM g) AS actual_share FROM r LEFT JOIN g USING (source)"""
    assert_equal(mixing.report(chosen, rate), db, report)
    odd = db.execute(f"SELECT count(*) FROM tokens JOIN ({rates}) r USING (source) LEFT JOIN picked p ON p.id = tokens.id WHERE coalesce(p.copies, 0) NOT IN (floor(r.rate), floor(r.rate) + 1)").fetchall()
    assert odd == [(0,)] and len(picked) > 0


def typed(name, rng):
    """One way in which a person may type a name."""
    first, last = name.split(" ", 1)
    pet = {"Robert": "Bob", "Margaret": "Peggy", "James": "Jim", "Richard": "Rick", "Susanna": "Susie"}
    slip = last[:3] + last[4:]
    return rng.choice([f"{last}, {first}", f"{first.upper()} {last.upper()}", f"{first}  {last} (official)", f"{pet.get(first, first)} {last}", f"{first} {slip}", f"{first} M. {last}", f"{last} {first} - clips", f"{first} {last.replace('e', 'é', 1)}"])


def test_labelled_spellings(spark):
    rng = random.Random(8)
    part = lambda: "".join(rng.choice(["bral", "kund", "vest", "torm", "gelp", "wick", "dros", "hamf", "lund", "perz"]) for _ in range(3)).capitalize()
    people = [f"{rng.choice(['Robert', 'Margaret', 'James', 'Richard', 'Susanna', 'Petra', 'Hugo'])} {part()}" for _ in range(120)]
    rows, entity = [], {}
    for k, name in enumerate(dict.fromkeys(people)):
        for _ in range(rng.choice([1, 2, 3])):
            entity[len(rows)] = k
            rows.append((len(rows), name if rng.random() < 0.3 else typed(name, rng)))
    got = {(r.id_a, r.id_b) for r in names.pairs(names.link([("p", spark.createDataFrame(rows, "id long, name string"), "person")])[0]).collect()}
    want = {(a, b) for a in entity for b in entity if a < b and entity[a] == entity[b]}
    assert len(got & want) >= 0.95 * len(want) > 80 and len(got - want) <= 0.02 * len(got)
