import json

import pytest
from pyspark.sql import functions as F

from namesmith.operators import blocking, convert, evaluate, pairwise
from namesmith.functions import canopies
from namesmith.schema import author
from namesmith.sources import bibtex, readers, writers


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_json_mentions(spark, tmp_path):
    rows = [{"mentionId": "1", "self": {"firstName": "a", "lastName": "b"}, "coauthors": [{"lastName": "c"}]}, {"mentionId": "2", "extra": 1}]
    write(tmp_path, "m/x.json", "\n".join([*map(json.dumps, rows), "{broken"]))
    got = readers.json_mentions(spark, str(tmp_path / "m")).orderBy("mentionId").collect()
    assert [r.mentionId for r in got] == ["1", "2"]
    assert got[0].self.middleNames == [] and got[0].coauthors[0].firstName == "" and got[1].self.lastName == ""
    assert (got[1].canopy, got[1].source, got[1].topics, got[1].title) == ("GENERIC_CANOPY", "UNK_SOURCE", [], None)
    writers.json_lines(readers.json_mentions(spark, str(tmp_path / "m")), str(tmp_path / "out"))
    assert readers.json_mentions(spark, str(tmp_path / "out")).count() == 2
    writers.store(readers.json_mentions(spark, str(tmp_path / "m")), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    with pytest.raises(ValueError):
        writers.store(spark.createDataFrame([("a",), ("a",)], "mentionId string"), str(tmp_path / "twice"))


TEI = """<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title level="a"> A Title </title></titleStmt>
<publicationStmt><date type="published" when="2003-05-01">May</date></publicationStmt><sourceDesc><biblStruct><analytic>
<author><persName><forename type="first">Ann</forename><forename type="middle">B</forename><surname>Lee</surname></persName></author>
<author><persName><forename type="first">Ann</forename><surname>Lee</surname></persName></author><author><persName><forename type="first">No</forename></persName></author></analytic>
<!-- <author><persName><surname>Nobody</surname></persName></author> --><monogr><title>Venue X</title></monogr></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>Some text.</p></abstract></profileDesc></teiHeader>
<text><back><listBibl><biblStruct><analytic><title>Other</title><author><persName><forename type="first">X</forename><surname>Cited</surname></persName></author></analytic><monogr><title>Y</title></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_tei(spark, tmp_path):
    write(tmp_path, "t/P01.tei.xml", TEI)
    write(tmp_path, "t/P02.xml", TEI.replace('<date type="published" when="2003-05-01">May</date>', ""))
    write(tmp_path, "t/bad.xml", "<TEI><unclosed>")
    papers = {r.paperId: r for r in readers.tei_papers(spark, str(tmp_path / "t")).collect()}
    assert set(papers) == {"P01", "P02"}
    p = papers["P01"]
    assert (p.title, p.year, p.venues, p.abstractText) == ("A Title", "2003", ["Venue X"], "Some text.")
    assert [(a.firstName, a.middleNames, a.lastName) for a in p.authors] == [("Ann", ["B"], "Lee"), ("Ann", [], "Lee")]
    assert papers["P02"].year == ""
    rows = readers.paper_mentions(readers.tei_papers(spark, str(tmp_path / "t")))
    assert sorted(r.mentionId for r in rows.collect()) == [f"P0{i}_LN_Lee_FN_Ann{j}" for i in (1, 2) for j in ("", "_1")]
    assert [r.mentionId for r in readers.paper_mentions(readers.tei_papers(spark, str(tmp_path / "t")), apart=False).where("paperId = 'P01'").collect()] == ["P01_LN_Lee_FN_Ann"] * 2
    assert [r.path.split("/")[-1] for r in readers.tei_failures(spark, str(tmp_path / "t")).collect()] == ["bad.xml"]
    write(tmp_path, "t/P03.xml", TEI.replace("A Title", "R &amp; D &#233;").replace(">B<", ">B&lt;<").replace(">Lee<", ">O&apos;Neil<"))
    odd = readers.tei_papers(spark, str(tmp_path / "t")).where("paperId = 'P03'").first()
    assert (odd.title, odd.authors[0].lastName, odd.authors[0].middleNames) == ("R & D \u00e9", "O'Neil", ["B<"])
    topics = spark.createDataFrame([("P01_LN_Lee_FN_Ann", ["t1"])], "id string, v array<string>")
    m = {r.mentionId: r for r in convert.paper_to_mention(rows, topics).collect()}
    first = m["P01_LN_Lee_FN_Ann"]
    assert (first.self.firstName, first.topics, first.venues[0].name, first.titleEmbeddingKeywords, first.tokenizedText) == ("ann", ["t1"], "Venue X", ["a", "title"], ["some", "text"])
    assert m["P02_LN_Lee_FN_Ann_1"].topics == [] and len(first.coauthors) == 1


RECORD = """title: On Things = and more
email:a@b.c
email: D@e.f , x1@y.z
institution:Dept. of X, MIT
author-in-focus:<n><f>Ann</f><f>B</f><m>Q</m><l>Lee</l></n>
author-in-focus-score=0.5
authorlist:<n><f>Ann</f><f>B</f><l>Lee</l></n><n><f>Bo</f><l>Kim</l></n>
alt-authorlist:<n><f>bo</f><l>KIM</l></n><n><f>No</f></n>
title:Last title: wins
keyword:Keywords: deep, the
journal:Journal, Nature 5
nonsense
"""


def test_tagged_records(spark, tmp_path):
    write(tmp_path, "root/lee_a/e1/r1", RECORD)
    write(tmp_path, "root/lee_a/e2/r2", "year:1999")
    rows = {r.groundTruth: r for r in readers.tagged_records(spark, str(tmp_path / "root")).collect()}
    r = rows["e1"]
    assert (r.canopy, r.authorInFocusScore, r.emails, r.institutions) == ("lee_a", 0.5, ["a@b.c", "d@e.f", "x@y.z"], ["dept of x", " mit"])
    assert r.title == "Last title: wins" and (r.authorInFocus.firstName, r.authorInFocus.middleNames) == ("Ann", ["B"])
    assert rows["e2"].year == "1999" and rows["e2"].emails == [] and rows["e2"].authorInFocus is None
    m = convert.record_to_mention(readers.tagged_records(spark, str(tmp_path / "root"))).collect()
    assert len(m) == 1 and m[0].goldEntityId == "e1"
    assert [(a.firstName, a.lastName) for a in m[0].coauthors] == [("bo", "kim"), ("no", "")]
    counts = {r.field: (r.occurrences, r.repeated) for r in readers.field_counts(spark, str(tmp_path / "root")).collect()}
    assert counts["email"] == (2, 1) and counts["year"] == (1, 0)
    assert readers.tagged_records(spark, str(tmp_path / "root"), keep_middles=True).where("authorInFocus is not null").first().authorInFocus.middleNames == ["B", "Q"]


BIB = """@string{jx = "Journal of X"}
@comment{ignored}
@article{k1, title = {A {Nested} title}, author = "Ludwig van Beethoven and Knuth, Donald E. and others", journal = jx # { Y}, abstract = {One
two}, keywords = "p q", school={S}, month = jan}
@misc(k2, author = {de la Cruz, Jr., Ana}, title = "T2", booktitle="B", publisher={P})
"""


def test_bibtex(spark, tmp_path):
    write(tmp_path, "b/good.one.bib", BIB)
    write(tmp_path, "b/latin.bib", "@misc{x, author={José Ruiz}, title={Ü}}", "iso-8859-1")
    write(tmp_path, "b/broken.bib", "@article{k, title = {never closed")
    parsed = bibtex.entries(spark, str(tmp_path / "b"))
    m = {r.mentionId: r for r in bibtex.mentions(parsed).collect()}
    assert set(m) == {"good-0-0", "good-0-1", "good-1-0", "latin-0-0"}
    a = m["good-0-0"]
    assert (a.self.firstName, a.self.middleNames, a.self.lastName, a.self.institutions) == ("Ludwig", ["van"], "Beethoven", ["S"])
    assert (a.title, a.venues[0].name, a.text, a.keywords) == ("A {Nested} title", "Journal of X Y", "One two", ["p", "q"])
    assert [(c.firstName, c.lastName) for c in a.coauthors] == [("Donald E.", "Knuth")]
    b = m["good-1-0"]
    assert (b.self.firstName, b.self.middleNames, b.self.lastName, [v.name for v in b.venues]) == ("Ana", ["de", "la"], "Cruz", ["B", "P"])
    assert m["latin-0-0"].self.firstName == "José"
    assert [(r.path.split("/")[-1], r.reason) for r in bibtex.failures(spark, str(tmp_path / "b")).collect()] == [("broken.bib", "value not closed")]
    assert sorted(r.text for r in bibtex.training_text(parsed).collect())[0].startswith("A {Nested} title One two p q")


def test_tables(spark, tmp_path):
    p = write(tmp_path, "pairs.tsv", "a\t1\nb\t2\t\n")
    assert sorted(map(tuple, readers.tsv_pairs(spark, p).collect())) == [("a", "1"), ("b", "2")]
    with pytest.raises(Exception, match="not two columns"):
        readers.tsv_pairs(spark, write(tmp_path, "bad.tsv", "a\tb\tc\n")).collect()
    lists = readers.tsv_lists(spark, write(tmp_path, "lists.tsv", "k\tv1\tv2\nj\nk\tv3\n"))
    assert {r.mentionId: r["values"] for r in lists.collect()} == {"k": ["v3"], "j": []}
    e = readers.embeddings(spark, write(tmp_path, "e.txt", "a 1 2\nb 1\na 3 4\n"), 2)
    assert {r.word: r.vec for r in e.collect()} == {"a": [3.0, 4.0]}
    e = readers.embeddings(spark, write(tmp_path, "h.txt", "2 2\nA 1 2\nb 5 6\n"), lower=True)
    assert {r.word: r.vec for r in e.collect()} == {"a": [1.0, 2.0], "b": [5.0, 6.0]}
    assert [r.value for r in readers.lines(spark, write(tmp_path, "l.txt", "x\ny\nz\n"), 1, 2).collect()] == ["y"]
    long = write(tmp_path, "long.txt", "".join(f"{i} {i} 0\n" for i in range(20_000)))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert readers.placed(spark, long).select("block").distinct().count() > 5
        assert sorted(int(r.value.split()[0]) for r in readers.lines(spark, long, 7_000, 7_500).collect()) == list(range(7_000, 7_500))
        twice = readers.embeddings(spark, write(tmp_path, "w.txt", "".join(f"w{i % 500} {i} 0\n" for i in range(20_000))), 2)
        assert {r.word: r.vec[0] for r in twice.collect()} == {f"w{i}": 19_500 + i for i in range(500)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_tasks_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("1", ("al", [], "b", [], [], [])), ("2", ("ak", [], "b", [], [], [])), ("3", ("z", [], "c", [], [], []))], "mentionId string, self struct<firstName:string,middleNames:array<string>,lastName:string,suffixes:array<string>,emails:array<string>,institutions:array<string>>").withColumn("canopy", F.lit(""))
    tasks = blocking.tasks(m, canopies.last_and_first_n(1))
    writers.write_tasks(tasks, str(tmp_path / "tasks"))
    back = readers.tasks(spark, str(tmp_path / "tasks"))
    assert sorted((r.canopy, r.mention_ids) for r in back.collect()) == [("LAST_b_FIRST_a", ["1", "2"]), ("LAST_c_FIRST_z", ["3"])]
    assert blocking.fetch(back, m).count() == 3
    bad = spark.createDataFrame([("a\tb", ["1"])], "canopy string, mention_ids array<string>")
    with pytest.raises(Exception, match="not a task name"):
        writers.task_lines(bad).collect()
    clusters = spark.createDataFrame([("1", "e"), ("2", "e")], "mention_id string, entity_id string")
    writers.write_clusters(clusters, str(tmp_path / "c"))
    assert readers.tsv_pairs(spark, str(tmp_path / "c")).count() == 2
    writers.write_clusters(clusters.withColumn("task", F.lit("LAST_x/y")), str(tmp_path / "d"), "task")
    assert (tmp_path / "d" / "prefix=misc").exists()
    assert pairwise.block_pairs(m.withColumn("canopy", F.col("self.lastName"))).count() == 1
    assert evaluate.entity_members(clusters).first().members == ["1", "2"]


def test_ids_of_a_paper_are_made_once(spark):
    """Not again for each author: the only expression that makes them stands below the one that makes rows of authors."""
    papers = spark.createDataFrame([("1",)], "paperId string").select("paperId", F.array(*(author(F.lit(f), None, F.lit("Lee")) for f in "aab")).alias("authors"), F.lit("t").alias("title"), F.lit("").alias("year"), F.array(F.lit("v")).alias("venues"), F.lit("").alias("abstractText"))
    found = readers.paper_mentions(papers.repartition(2))
    assert sorted(r.mentionId for r in found.collect()) == ["1_LN_Lee_FN_a", "1_LN_Lee_FN_a_1", "1_LN_Lee_FN_b"]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "regexp_replace" not in above


def test_small_files_are_written_by_many_tasks(spark):
    """However small the rows are, folders are dealt to all parts of the shuffle."""
    from namesmith.plans.file_queries import as_text

    path = as_text(spark.range(40).select(F.col("id").cast("string").alias("value"), F.col("id").alias("key")), "small", "key")
    found = readers.files(spark, path, "*.txt").select(F.regexp_extract("path", r"part-(\d+)", 1).alias("task"), "text").collect()
    assert sorted(int(r.text) for r in found) == list(range(40))
    assert len({r.task for r in found}) > 1
