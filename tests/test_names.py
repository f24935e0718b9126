import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from namesmith.functions import canopies, names, text
from namesmith.schema import AUTHOR, author

CASES = [
    ("  John Michael ", [], "Smith, Jr.", ("john", ["michael"], "smith", ["jr"])),
    ("JM", ["X"], "Lee", ("j", ["m"], "lee", [])),
    ("Yi", [], "Liu", ("yi", [], "liu", [])),
    ("yi", [], "liu", ("y", ["i"], "liu", [])),
    ("José", [], "Müller-Łuk", ("jose", [], "mulleruk", [])),
    ("Ann", ["ann", "B.", "b."], "Lee", ("ann", ["b"], "lee", [])),
    ("A{umlaut over (n)}a", [], "De La Cruz", ("ana", [], "delacruz", [])),
    ("", [], "", ("", [], "", [])),
    ("A B  C", [], ",", ("a", ["b", "c"], "", [])),
]


def people(spark, rows):
    return spark.createDataFrame([(i, (f, m, l, [], ["e@x"], ["inst"])) for i, (f, m, l) in enumerate(rows)], f"i int, a {AUTHOR.simpleString()}")


def test_default_chain(spark):
    df = people(spark, [c[:3] for c in CASES]).withColumn("n", names.case_insensitive_reevaluating(F.col("a")))
    for r in df.collect():
        assert (r.n.firstName, r.n.middleNames, r.n.lastName, r.n.suffixes) == CASES[r.i][3], CASES[r.i]
        assert r.n.emails == ["e@x"] and r.n.institutions == ["inst"]


def test_chain_on_coauthors(spark):
    df = people(spark, [c[:3] for c in CASES]).agg(F.array_sort(F.collect_list("a")).alias("all"))
    got = df.select(F.transform("all", lambda a: names.case_insensitive_reevaluating(a)).alias("all")).first()["all"]
    assert sorted((a.firstName, a.lastName) for a in got) == sorted((c[3][0], c[3][2]) for c in CASES)


@pytest.mark.parametrize(("name", "same"), [("identity", names.identity), ("ReEvaluatingNameProcessor", names.reevaluating), ("lowerCaseAllNames", names.lower_all), ("CaseInsensitiveReEvaluating", names.case_insensitive_reevaluating)])
def test_by_name(name, same):
    assert names.from_name(name) is same


def test_unknown_names():
    with pytest.raises(KeyError):
        names.from_name("nobody")
    with pytest.raises(ValueError):
        canopies.from_name("lastAndFirstofFirst")


def test_equality_and_emptiness(spark):
    rows = [("a", ["x", "y"], "b"), ("a", ["y", "x", "x"], "b"), ("a", ["x"], "b"), ("", [""], "")]
    df = people(spark, rows)
    got = {(r.x, r.y) for r in df.alias("p").crossJoin(df.alias("q")).where(names.same_name(F.col("p.a"), F.col("q.a"))).select(F.col("p.i").alias("x"), F.col("q.i").alias("y")).collect()}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 3)}
    assert [r.i for r in df.where(names.is_empty(F.col("a"))).collect()] == [3]


def test_normalised_and_formatted(spark):
    row = people(spark, [(" ÉRIC  Paul ", ["", "Bo"], "Ünal")]).select(names.normalized(F.col("a")).alias("n"), names.formatted(F.col("a")).alias("f"), names.middle_initials(F.col("a")).alias("m")).first()
    assert (row.n.firstName, row.n.lastName, row.n.emails, row.m) == ("eric paul", "unal", [], ["B"])
    assert row.f == "Ünal,  ÉRIC  Paul   Bo"


def test_canopies(spark):
    df = people(spark, [("maria", ["j", "k"], "lopez"), ("", [], "x")])
    by = {n: [r[0] for r in df.orderBy("i").select(canopies.from_name(n)(F.col("a"))).collect()] for n in (*canopies.DEFAULT, "LASTANDFIRST12OFFIRST")}
    assert by["fullName"] == ["LAST_lopez_FIRST_maria_MIDDLE_j_k", "LAST_x_FIRST__MIDDLE_"]
    assert by["lastAndFirst3ofFirst"] == ["LAST_lopez_FIRST_mar", "LAST_x_FIRST_"]
    assert by["LASTANDFIRST12OFFIRST"][0] == "LAST_lopez_FIRST_maria"


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.split_trimmed(F.lit("a\tb\t\t"), "\t")) == ["a", "b"]
    assert one(text.split_trimmed(F.lit(""), "\t")) == [""]
    assert one(text.split_trimmed(F.lit(",,"), ",")) == []
    assert one(text.strip_accents(F.lit("Crème brûlée"))) == "Creme brulee"
    assert one(text.trim_ends(F.lit("\t\n a b \x0b"))) == "a b"
    assert one(text.remove_punctuation(F.lit("a.b-c!$"), " ")) == "a b c  "
    assert one(text.year_of(F.lit("May 12345"))) == "1234" and one(text.year_of(F.lit(None).cast("string"))) == ""
    assert one(text.stem_of_file(F.lit("/x/y.z.txt"))) == "y"
    assert one(text.tag_values(F.lit("<n> a <b>c</b></n><n></n>"), "n")) == ["a <b>c</b>", ""]
    assert one(text.first_tag_value(F.lit("<f>x"), "f")) is None
    assert one(text.clean_institutions(F.array(F.lit("Univ.,MIT\n Lab,the,u")))) == ["mit lab"]
    assert one(text.clean_journals(F.array(F.lit("Nature 12 year: 1999,Proc.,x")))) == ["nature  "]
    assert one(text.clean_journals(F.array(F.lit("Nature year: 1999")), False)) == ["nature year "]
    assert one(text.clean_emails(F.array(F.lit("A1@B.com, c")))) == ["a@b.com", "c"]
    assert one(author(None, None, F.lit("x"))).firstName == ""


def test_accents_query_strips_whole_texts(spark, tmp_path, monkeypatch):
    """What strip_accents leaves beyond ASCII counts wherever it stands."""
    from namesmith.plans import queries

    from hashlib import md5

    rows = [(1, "a" * 300 + "é"), (2, "plain"), (3, "é" + "b" * 300), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hashed = lambda i, t, n: (i, md5(t.encode()).hexdigest(), n)
    want = [hashed(1, "a" * 300 + "e", 301), hashed(2, "plain", 5), hashed(3, "e" + "b" * 300, 301), (4, None, None)]
    assert [tuple(r) for r in queries.accents(spark, str(tmp_path)).orderBy("doc_id").collect()] == want
    monkeypatch.setattr(queries.text, "strip_accents", lambda x: x)
    assert [tuple(r) for r in queries.accents(spark, str(tmp_path)).orderBy("doc_id").collect()] != want


def test_accents_in_time_that_follows_the_text(spark):
    """Every character of the basic plane, alone and in a long text, against unicodedata; no list of forms is searched for each letter."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if ord(c) < 128)
    kept = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000 and not set(plain(chr(i))) & {"=", ";"}]
    texts = ["".join(kept[i : i + 500]) for i in range(0, len(kept), 500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.t for r in rows.select("i", text.strip_accents(F.col("t")).alias("t")).collect()} == {i: plain(t) for i, t in enumerate(texts)}
    began = time.time()
    long = spark.range(200, numPartitions=4).select(F.repeat(F.lit("é ü ñ "), 5000).alias("t"))
    assert long.select(F.sum(F.length(text.strip_accents(F.col("t"))))).first()[0] == 200 * 5000 * 6
    assert time.time() - began < 40
