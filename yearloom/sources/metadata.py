"""Document metadata in its dialects, and lookups in it."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import METADATA

_COLUMNS = [f.name for f in METADATA]
_MOVIES = r"^(\d+)\t(\d+)\t(\d+)\t([^\t]*)\t(\d{4})(?:\t([^\t]*))?"


def candidates(name: str) -> list[str]:
    """Archives that may hold the metadata of a corpus, in the order in which they are tried."""
    return list(dict.fromkeys(["sources.zip", f"sources_{name}.zip", f"sources_{name.lower()}.zip"]))


def dialect(header: str, second: str = "") -> str:
    """movies, glowbe or coca by the first lines of a text table."""
    low = header.lower()
    if "fileid" in low:
        return "movies"
    if "country" in low and "genre" in low:
        return "glowbe"
    fields = header.split("\t")
    if header[:1].isdigit() and len(fields) > 1 and re.fullmatch(r"\d{4}", fields[1].strip()):
        return "coca"
    raise ValueError("unknown metadata layout")


def _full(df: DataFrame) -> DataFrame:
    have = {"year": "int", "genre": "string", "title": "string", "author": "string", "words": "long"}
    for c, t in have.items():
        df = df.withColumn(c, F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t))
    return df.where("text_id is not null").select(*_COLUMNS)


def parse_movies(lines: DataFrame) -> DataFrame:
    """Keyed by the file's id, the second field."""
    g = lambda i: F.regexp_extract("value", _MOVIES, i)
    return _full(lines.where(F.col("value").rlike(_MOVIES)).select(g(2).cast("long").alias("text_id"), g(3).alias("words"), F.lower(g(4)).alias("genre"), g(5).alias("year"), F.nullif(g(6), F.lit("")).alias("title")))


def parse_coca(lines: DataFrame) -> DataFrame:
    p = F.split("value", "\t")
    at = lambda i: F.try_element_at(p, F.lit(i))
    return _full(lines.select(at(1).try_cast("long").alias("text_id"), at(2).alias("year"), F.lower(F.trim(at(3))).alias("genre")))


def parse_glowbe(lines: DataFrame, year: int = 2012) -> DataFrame:
    """lines have n, their place: the first two are headings. All texts are of one year; the genre stays as it is."""
    p = F.split("value", "\t")
    at = lambda i: F.try_element_at(p, F.lit(i))
    return _full(lines.where("n >= 2").select(at(1).try_cast("long").alias("text_id"), at(2).alias("words"), F.trim(at(3)).alias("genre"), F.lit(year).alias("year")))


def parse_xlsx(spark: SparkSession, content: bytes) -> DataFrame:
    """The first sheet's rows after the heading: id, words, genre, year, title, author. A metadata sheet is small: it is read on the driver."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = ElementTree.fromstring(z.read(sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]))
    rows = []
    for r in sheet.iter(f"{{{ns['m']}}}row"):
        cells: dict[str, str] = {}
        for i, c in enumerate(r.findall("m:c", ns)):
            v = c.find("m:v", ns)
            text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if v is None else v.text or ""
            cells[re.sub(r"\d", "", c.get("r") or chr(65 + i))] = shared[int(text)] if c.get("t") == "s" else text
        rows.append(tuple(cells.get(k) or None for k in "ABCDEF"))
    named = spark.createDataFrame(rows[1:], "text_id string, words string, genre string, year string, title string, author string")
    whole = lambda c: F.col(c).try_cast("double").cast("long")
    return _full(named.withColumns({"text_id": whole("text_id"), "words": whole("words"), "year": whole("year"), "genre": F.lower("genre")}))


def lookup(docs: DataFrame, metadata: DataFrame, *columns: str) -> DataFrame:
    """docs with columns (year and genre, if none are named) of metadata by text_id, null where it is unknown."""
    return docs.join(metadata.select("text_id", *(columns or ("year", "genre"))), "text_id", "left")
