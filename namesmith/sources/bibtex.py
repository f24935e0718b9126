"""BibTeX: entries with nested braces, @string abbreviations and von-names, parsed file by file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.schema import AUTHOR, author, complete

#: The encodings that are tried in turn.
CODECS = ("utf-8", "iso-8859-1", "us-ascii")
ENTRIES = "path string, entry int, kind string, key string, fields map<string,string>, people array<struct<first:string,von:string,last:string,jr:string>>"


def parse(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(kind, key, fields) of all entries; raises ValueError where braces or quotes don't close."""
    known = {m.lower(): m for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()}  # noqa: SIM905
    out, at = [], 0

    def value(i: int) -> tuple[str, int]:
        parts = []
        while True:
            i = re.compile(r"\s*").match(text, i).end()
            if i >= len(text):
                raise ValueError("value missing")
            if text[i] in '{"':
                close, depth, j = ("}", 1, i + 1) if text[i] == "{" else ('"', 0, i + 1)
                while True:
                    if j >= len(text):
                        raise ValueError("value not closed")
                    c = text[j]
                    if c == close and (depth == (1 if close == "}" else 0)):
                        break
                    depth += (c == "{") - (c == "}")
                    j += 2 if c == "\\" else 1
                parts.append(text[i + 1 : j])
                i = j + 1
            else:
                word = re.compile(r"[^\s,#{}()=]+").match(text, i)
                if not word:
                    raise ValueError("value missing")
                parts.append(known.get(word[0].lower(), word[0]))
                i = word.end()
            more = re.compile(r"\s*#").match(text, i)
            if not more:
                return "".join(parts), i
            i = more.end()

    for m in re.compile(r"@\s*(\w+)\s*[{(]").finditer(text):
        if m.start() < at:
            continue
        kind, i, fields, key = m[1].lower(), m.end(), {}, ""
        if kind in ("comment", "preamble"):
            continue
        if kind != "string":
            head = re.compile(r"\s*([^,\s{}()]*)\s*,?").match(text, i)
            key, i = head[1], head.end()
        while True:
            name = re.compile(r"[\s,]*([\w:+.-]+)\s*=").match(text, i)
            if not name:
                break
            fields[name[1].lower()], i = value(name.end())
        end = re.compile(r"[\s,]*[})]").match(text, i)
        if not end:
            raise ValueError(f"entry {key} not closed")
        at = end.end()
        if kind == "string":
            known.update({k.lower(): v for k, v in fields.items()})
        else:
            out.append((kind, key, fields))
    return out


def split_outside(text: str, pattern: str) -> list[str]:
    """Split at a pattern outside of braces."""
    parts, depth, last = [], 0, 0
    for m in re.finditer(rf"[{{}}]|{pattern}", text):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif depth == 0:
            parts.append(text[last : m.start()])
            last = m.end()
    return [p.strip() for p in [*parts, text[last:]]]


def person(name: str) -> dict[str, str]:
    """First, von, last, jr of one BibTeX name."""
    parts = split_outside(name, ",")
    words = split_outside(re.sub(r"\s+", " ", parts[0]), " ")
    small = [i for i, w in enumerate(words) if w[:1].islower()]
    if len(parts) == 1:
        cut = small[0] if small else len(words) - 1
        end = small[-1] + 1 if small else cut
        end = min(end, len(words) - 1)
        return {"first": " ".join(words[: min(cut, end)]), "von": " ".join(words[min(cut, end) : end]), "last": " ".join(words[end:]), "jr": ""}
    end = 0
    while end < len(words) - 1 and words[end][:1].islower():
        end += 1
    return {"first": parts[-1], "von": " ".join(words[:end]), "last": " ".join(words[end:]), "jr": parts[1] if len(parts) > 2 else ""}


def people(text: str) -> list[dict[str, str]]:
    return [person(p) for p in split_outside(re.sub(r"\s+", " ", text), r"\s+and\s+") if p]


def entries(spark: SparkSession, path: str, glob: str = "*.bib") -> DataFrame:
    """One row per entry; files are tried in each of ``CODECS``, and skipped if they don't parse (``failures`` lists them)."""
    return parsed(spark, path, glob).where("entry is not null")


def failures(spark: SparkSession, path: str, glob: str = "*.bib") -> DataFrame:
    """(path, reason) of the files that don't parse."""
    return parsed(spark, path, glob).where("entry is null").select("path", F.col("key").alias("reason"))


def parsed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Entries, and for a file that doesn't parse a row without entry, its key the reason."""
    read, names, codecs = parse, people, CODECS

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                reason = ""
                for codec in codecs:
                    try:
                        found = read(bytes(content).decode(codec))
                    except ValueError as e:
                        reason = reason or str(e)
                        continue
                    rows += [(file, i, kind, key, fields, names(fields.get("author", ""))) for i, (kind, key, fields) in enumerate(found)]
                    break
                else:
                    rows.append((file, None, "", reason, {}, []))
            frame = pd.DataFrame(rows, columns=["path", "entry", "kind", "key", "fields", "people"])
            yield frame.astype({"entry": "Int32"})

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", "content").mapInPandas(emit, ENTRIES)


def mentions(parsed: DataFrame) -> DataFrame:
    """A mention per author; ids come from file name, entry and author position, and don't depend on order of work."""
    clean = lambda c: F.translate(c, "\n\t", "  ")
    field = lambda k: F.try_element_at("fields", F.lit(k))
    listed = lambda *ks: F.array_compact(F.array(*(field(k) for k in ks)))
    offices = listed("department", "school")
    middles = lambda p: F.filter(F.split(clean(p["von"]), " "), lambda w: w != "")
    authors = F.transform(F.filter("people", lambda p: p["last"] != "others"), lambda p: author(clean(p["first"]), middles(p), clean(p["last"]), None, None, F.col("offices")))
    each = parsed.withColumn("offices", offices).withColumn("authors", authors).select("*", F.posexplode("authors").alias("place", "self"))
    stem = F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("."), F.lit(1))
    title = F.coalesce(field("title"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(F.coalesce(field("abstract"), F.lit("")), r"[\n\t]", " "), r"\s\s", " ")
    others = F.filter("authors", lambda a, i: i != F.col("place"))
    venues = F.transform(listed("journal", "booktitle", "conference", "publisher"), lambda v: F.struct(v.alias("name")))
    return complete(
        each.select(
            F.concat_ws("-", stem, F.col("entry").cast("string"), F.col("place").cast("string")).alias("mentionId"), F.col("self").cast(AUTHOR).alias("self"), others.alias("coauthors"), title.alias("title"), F.split(title, " ").alias("titleEmbeddingKeywords"),
            text.alias("text"), F.split(text, " ").alias("tokenizedText"), venues.alias("venues"), F.split(F.coalesce(field("keywords"), F.lit("")), " ").alias("keywords"),
        )
    )


def training_text(parsed: DataFrame) -> DataFrame:
    """Title, abstract and keywords of each entry in one line."""
    parts = F.array(*(F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("")) for k in ("title", "abstract", "keywords")))
    return parsed.select(F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " ")).alias("text")).where("text <> ''")
