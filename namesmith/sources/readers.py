"""Readers: each gives a typed DataFrame; all work on paths that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesmith.functions.text import clean_editors, clean_emails, clean_institutions, clean_journals, clean_keywords, first_tag_value, non_empty, split_trimmed, stem_of_file, tag_values, trim_ends, year_of
from namesmith.schema import MENTION, author, complete


def json_mentions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Mentions from JSON lines (files or folders); lines that don't parse are dropped, missing keys are absent values."""
    return complete(spark.read.schema(MENTION).option("mode", "DROPMALFORMED").json(paths))


def placed(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, value): lines in the order of file, block and nth. Files are split as usual: nth rises within a block."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")


def lines(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """(line_no, value) of the lines in [start, end) of each file. Blocks are counted first, so files are still read in splits."""
    if not start and end is None:
        return spark.read.text(path)
    rows = placed(spark, path)
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    numbered = rows.join(sizes.select("file", "block", "first", before.alias("before")), ["file", "block"]).select((F.col("before") + F.col("nth") - F.col("first")).alias("line_no"), "value")
    return numbered.where((F.col("line_no") >= start) & (F.lit(True) if end is None else F.col("line_no") < end))


def files(spark: SparkSession, path: str, glob: str = "*", encoding: str | None = None) -> DataFrame:
    """(path, text) of all files under a folder; names that begin with a dot or underscore are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = F.decode("content", encoding or "UTF-8")
    return found.select("path", text.alias("text"))


def tsv_pairs(spark: SparkSession, path: str, names: tuple[str, str] = ("point", "cluster")) -> DataFrame:
    """Two columns exactly; other lines fail the query."""
    parts = split_trimmed(F.col("value"), "\t")
    good = F.when(F.size("p") == 2, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not two columns: "), F.col("value"))).cast("array<string>"))
    return spark.read.text(path).select("value", parts.alias("p")).select(good.alias("p")).select(F.col("p")[0].alias(names[0]), F.col("p")[1].alias(names[1]))


def tsv_lists(spark: SparkSession, path: str, key: str = "mentionId", values: str = "values") -> DataFrame:
    """Key and its values; of a repeated key the last line counts."""
    parts = placed(spark, path).where("value <> ''").select(F.struct("file", "block", "nth").alias("place"), split_trimmed(F.col("value"), "\t").alias("p"))
    return parts.groupBy(F.col("p")[0].alias(key)).agg(F.max_by(F.slice("p", F.lit(2), F.size("p")), "place").alias(values))


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """(canopy, mention_ids) from name and comma-joined ids; other lines fail."""
    return tsv_pairs(spark, path, ("canopy", "ids")).select("canopy", split_trimmed(F.col("ids"), ",").alias("mention_ids"))


def embeddings(spark: SparkSession, path: str, dim: int | None = None, sep: str = r"\s+", lower: bool = False) -> DataFrame:
    """(word, vec): one word and ``dim`` numbers a line, or after a first line with count and dim if none is given.

    Lines of another length are skipped, as is the first line by that; of a
    repeated word the last counts. Vectors of one number need ``dim``.
    """
    parts = placed(spark, path).where("value <> ''").select(F.struct("file", "block", "nth").alias("place"), F.split(F.rtrim("value"), sep).alias("p"))
    if dim is None:
        head = parts.where("place.block = 0").orderBy("place").select(F.get("p", F.lit(1)).try_cast("int").alias("dim")).first()
        dim = (head["dim"] or 0) if head else 0
        if dim == 1:
            raise ValueError("a first line with count and dim looks like a vector of one number: give dim")
    word = F.lower(F.col("p")[0]) if lower else F.col("p")[0]
    vec = F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x.try_cast("double"))
    return parts.where(F.size("p") == dim + 1).groupBy(word.alias("word")).agg(F.max_by(vec, "place").alias("vec"))


# Papers with a TEI header


def tei_trees(spark: SparkSession, path: str, encoding: str | None) -> DataFrame:
    """path, paperId, xml, good: whether a file is XML. Spark's xpath needs no namespace, so declarations and comments are removed first."""
    plain = files(spark, path, "*", encoding).select("path", stem_of_file(F.col("path")).alias("paperId"), F.regexp_replace(F.regexp_replace("text", r"\s+xmlns(:\w+)?=\x22[^\x22]*\x22", ""), r"<!DOCTYPE[^>]*>|<\?xml[^>]*\?>|<!--[\s\S]*?-->", "").alias("xml"))
    tree = F.from_xml("xml", "teiHeader string, _corrupt_record string", {"mode": "PERMISSIVE"})
    return plain.withColumn("tree", tree).withColumn("good", F.expr("tree is not null and tree._corrupt_record is null")).drop("tree")


def tei_failures(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(path) of the files that aren't XML."""
    return tei_trees(spark, path, encoding).where("not good").select("path")


def tei_papers(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """paperId, title, authors, year, venues, abstractText from TEI headers; files that aren't XML are skipped (``tei_failures`` lists them).

    Authors are those of the header; what a text cites isn't read.
    """
    known = tei_trees(spark, path, encoding).where("good").withColumn("xml", F.regexp_extract("xml", r"<teiHeader\b[\s\S]*</teiHeader\s*>", 0)).where("xml <> ''")
    head = "//teiHeader"
    first = lambda path: trim_ends(F.coalesce(F.xpath_string("xml", F.lit(path)), F.lit("")))
    # xpath takes constant paths only, so each author's element is cut out and asked for its parts.
    blocks = F.regexp_extract_all("xml", F.lit(r"<author\b[^>]*>[\s\S]*?</author>"), F.lit(0))

    def person(block: Column) -> Column:
        names = lambda kind: F.transform(F.xpath(block, F.lit(f"//persName//forename[@type='{kind}']//text()")), lambda x: trim_ends(x))
        return author(F.get(names("first"), F.lit(0)), names("middle"), trim_ends(F.coalesce(F.xpath_string(block, F.lit("//persName//surname")), F.lit(""))))

    authors = F.filter(F.transform(blocks, person), lambda a: a["lastName"] != "")
    when = F.get(F.xpath("xml", F.lit(f"{head}//publicationStmt//date[@type='published']/@when")), F.lit(0))
    return known.select("paperId", first(f"{head}//titleStmt//title").alias("title"), authors.alias("authors"), year_of(when).alias("year"), F.array(first(f"{head}//sourceDesc//monogr//title")).alias("venues"), first(f"{head}//profileDesc//abstract").alias("abstractText"))


def paper_mentions(papers: DataFrame, apart: bool = True) -> DataFrame:
    """One row per author with a last name; the others are coauthors.

    The id joins paper, last and first name. Of authors on one paper with equal
    ids the first keeps it; apart: the others get their place added.
    """
    name = lambda a: F.regexp_replace(F.concat(F.col("paperId"), F.lit("_LN_"), a["lastName"], F.lit("_FN_"), a["firstName"]), "[^A-Za-z0-9_-]", "")
    # Ids are made once a paper, before it becomes a row for each author.
    own = papers.withColumn("authors", F.filter("authors", lambda a: a["lastName"] != "")).withColumn("_names", F.transform("authors", name))
    each = own.select("*", F.posexplode("authors").alias("place", "self"))
    mention = F.get("_names", F.col("place"))
    again = F.array_position("_names", mention) <= F.col("place")
    others = F.filter("authors", lambda a, i: i != F.col("place"))
    return each.select((F.when(again, F.concat(mention, F.lit("_"), F.col("place").cast("string"))).otherwise(mention) if apart else mention).alias("mentionId"), "paperId", "self", others.alias("coauthors"), "title", "year", "venues", "abstractText")


# Tagged-text records

MANY = ("email", "institution", "authorlist", "alt-authorlist")
ONCE = ("abstract", "altTitle", "author-in-focus", "author-in-focus-score", "body", "editor", "venue", "journal", "keyword", "title", "year")


def tagged_author(text: Column, keep_middles: bool = False) -> Column:
    """First <f>, further <f> as middle names, first <l>; <m> values only if keep_middles."""
    firsts = tag_values(text, "f")
    middles = F.slice(firsts, F.lit(2), F.greatest(F.size(firsts) - 1, F.lit(0)))
    return author(F.get(firsts, F.lit(0)), F.concat(middles, tag_values(text, "m")) if keep_middles else middles, first_tag_value(text, "l"))


def tagged_records(spark: SparkSession, root: str, keep_middles: bool = False, clean: bool = True) -> DataFrame:
    """Records under root/canopy/entity/file: canopy and gold entity from the path, fields from ``name:value`` or ``name=value`` lines."""
    found = files(spark, root)
    at = lambda i: F.element_at(F.split("path", "/"), F.lit(i))
    each = found.select(F.col("path").alias("id"), at(-3).alias("canopy"), at(-2).alias("groundTruth"), F.posexplode_outer(F.split("text", r"\r?\n")).alias("n", "entry"))
    parts = each.withColumn("p", split_trimmed(F.coalesce("entry", F.lit("")), "[:=]"))
    named = parts.select("id", "canopy", "groundTruth", "n", F.coalesce(F.get("p", F.lit(0)), F.lit("")).alias("field"), trim_ends(F.array_join(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), ":")).alias("value"))
    once = [F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("n"))).alias(f) for f in ONCE]
    many = [F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == f, F.struct("n", "value")))), lambda x: x["value"]).alias(f) for f in MANY]
    rows = named.groupBy("id", "canopy", "groundTruth").agg(*once, *many)
    people = lambda f: F.flatten(F.transform(F.col(f"`{f}`"), lambda v: F.transform(tag_values(v, "n"), lambda n: tagged_author(n, keep_middles))))
    one = lambda f: F.array(F.coalesce(F.col(f), F.lit("")))
    same = lambda xs: xs
    use = lambda f: f if clean else same
    focus = F.when(F.col("`author-in-focus`").isNotNull(), tagged_author(F.col("`author-in-focus`"), keep_middles))
    keyword = F.regexp_replace("keyword", "(?i)keywords:", "")
    return rows.select(
        "id", "canopy", "groundTruth", F.col("abstract").alias("abstractText"), people("alt-authorlist").alias("altAuthorlist"), "altTitle", focus.alias("authorInFocus"), F.col("`author-in-focus-score`").try_cast("double").alias("authorInFocusScore"),
        people("authorlist").alias("authorlist"), "body", use(clean_editors)(one("editor")).alias("editor"), use(clean_emails)(F.col("email")).alias("emails"), use(clean_institutions)(F.col("institution")).alias("institutions"),
        use(clean_journals)(non_empty(one("venue"))).alias("venue"), use(clean_journals)(one("journal")).alias("journal"), use(clean_keywords)(F.array(F.coalesce(keyword, F.lit("")))).alias("keyword"), "title", "year",
    )


def field_counts(spark: SparkSession, root: str) -> DataFrame:
    """(field, files, repeated): files that have a field, and that have it more than once."""
    entries = files(spark, root).select("path", F.explode(F.split("text", r"\r?\n")).alias("entry")).where("entry <> ''")
    each = entries.groupBy("path", F.get(F.split("entry", "[:=]"), F.lit(0)).alias("field")).agg(F.count("*").alias("n"))
    return each.groupBy("field").agg(F.sum("n").alias("occurrences"), F.count_if(F.col("n") > 1).alias("repeated"))


def last_line_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    own = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")


def bucketed_store(spark: SparkSession, name: str, path: str, buckets: int, key: str = "mentionId") -> DataFrame:
    """The store that ``writers.bucketed_store`` wrote, also in a session whose catalog doesn't know it yet."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
