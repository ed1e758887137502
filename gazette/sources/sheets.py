"""Spreadsheets as tables of cells: a reader, the questionnaire and source sheets built on it, and a writer for reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators.dedup import keep_first

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of a sheet that a spreadsheet program opens.
MOST_ROWS = 1_048_576
#: The cell that begins the indicators' section; columns of the source sheet with their sides, and its rows.
SECTION = "资讯需映射到的指标"
SIDES = {3: "seller", 4: "buyer", 5: "media"}
SOURCE_ROWS = (4, 9)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _cells(raw: bytes) -> Iterator[tuple[int, str, int, int, str]]:
    """(place of the sheet, its name, row, column, value) of the cells with a value."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for place, sheet in enumerate(ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
        target = targets[sheet.get(f"{_REL}id")].lstrip("/")
        for c in ET.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}c"):
            kind, v = c.get("t"), c.find(f"{_MAIN}v")
            value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if kind == "inlineStr" else shared[int(v.text)] if kind == "s" and v is not None else v.text if v is not None else None
            if value:
                yield place, sheet.get("name"), int(re.search(r"\d+", c.get("r"))[0]), _column(c.get("r")), value


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, place, sheet, row, col, value of the cells of workbooks; a file that is no workbook has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame.path, frame.content, strict=True):
                try:
                    rows = [(name, *c) for c in _cells(raw)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "place", "sheet", "row", "col", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, place int, sheet string, row int, col int, value string")


def sources(cells: DataFrame) -> DataFrame:
    """pos, platform, side, source_url of the first sheet's block: every URL in a side's cell, each once."""
    first, last = SOURCE_ROWS
    block = cells.where((F.col("place") == 0) & F.col("row").between(first, last))
    names = block.where("col = 2").select("path", "row", text.clean(F.col("value")).alias("platform"))
    side = F.try_element_at(F.create_map(*(x for k, v in SIDES.items() for x in (F.lit(k), F.lit(v)))), F.col("col"))
    found = block.where(F.col("col").isin(*SIDES)).select("path", "row", "col", side.alias("side"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(https?://[^\s\x{3000}]+)"), F.lit(1))).alias("i", "source_url"))
    rows = found.join(names, ["path", "row"], "left").select((F.col("row") * 1_000_000 + F.col("col") * 100_000 + F.col("i")).cast("long").alias("pos"), F.coalesce("platform", F.lit("")).alias("platform"), "side", urls.canonical(F.col("source_url")).alias("source_url"))
    return keep_first(rows.where("source_url <> ''"), "platform", "side", "source_url")


def indicators(cells: DataFrame) -> DataFrame:
    """pos, dimension, question_id, prompt_en, prompt_zh of the first sheet with the section; the dimension carries forward.

    Two blank rows after an indicator end the section. The id stands in the third column where that looks like one, else in the
    second; the prompts follow it. A questionnaire is a sheet that a person writes: its rows make one window.
    """
    begin = cells.where((F.col("col") == 1) & F.contains("value", F.lit(SECTION))).groupBy("path", "place").agg(F.min("row").alias("begin"))
    begin = begin.groupBy("path").agg(F.min(F.struct("place", "begin")).alias("b")).select("path", "b.*")
    wide = cells.join(begin, ["path", "place"]).where(F.col("row") >= F.col("begin") + 2).groupBy("path", "row").agg(*(F.max(F.when(F.col("col") == k, text.clean(F.col("value")))).alias(f"c{k}") for k in range(1, 6)))
    c = {k: F.coalesce(f"c{k}", F.lit("")) for k in range(1, 6)}
    third = text.is_question_id(c[3])
    rows = wide.select(
        "path", "row", F.regexp_replace(c[1], r"\s+", " ").alias("own"), F.when(third, text.question_id(c[3])).otherwise(text.question_id(c[2])).alias("question_id"),
        F.when(third, c[4]).otherwise(c[3]).alias("prompt_en"), F.when(third, c[5]).otherwise(c[4]).alias("prompt_zh"),
    ).where("own <> '' or question_id <> '' or prompt_en <> '' or prompt_zh <> ''")
    order = Window.partitionBy("path").orderBy("row")
    rows = rows.withColumn("dimension", F.last(F.nullif(F.col("own"), F.lit("")), ignorenulls=True).over(order)).withColumn("gap", F.col("row") - F.lag("row").over(order) - 1)
    header = text.is_question_id(F.col("question_id")) & ~F.contains("question_id", F.lit("_")) & (F.col("prompt_en") == "") & (F.col("prompt_zh") == "")
    rows = rows.withColumn("good", F.col("dimension").isNotNull() & (F.col("question_id") != "") & ~header & ((F.col("prompt_en") != "") | (F.col("prompt_zh") != "")))
    before = Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ends", F.coalesce((F.col("gap") >= 2) & F.max("good").over(before), F.lit(False)))
    rows = rows.withColumn("over", F.max("ends").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("good and not over").select(F.col("row").cast("long").alias("pos"), "dimension", "question_id", "prompt_en", "prompt_zh")


def _name(col: int) -> str:
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook(headers: list[str], rows: Iterator[tuple], sheet: str = "Sheet1", links: dict[str, str] | None = None) -> bytes:
    """The bytes of a workbook of one sheet: a bold header, then rows of texts. links: columns that link to another one's URL."""
    links = links or {}
    at = {h: i for i, h in enumerate(headers)}
    body, targets = [], []

    def cell(r: int, c: int, value, style: int = 0) -> str:
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", "" if value is None else str(value))
        return f'<c r="{_name(c)}{r}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    body.append('<row r="1">' + "".join(cell(1, i + 1, h, 1) for i, h in enumerate(headers)) + "</row>")
    count = 1
    for count, row in enumerate(rows, 2):
        if count > MOST_ROWS:
            raise ValueError(f"a sheet holds {MOST_ROWS} rows at most; write the table as CSV")
        body.append(f'<row r="{count}">' + "".join(cell(count, i + 1, v) for i, v in enumerate(row)) + "</row>")
        targets += [(f"{_name(at[c] + 1)}{count}", row[at[u]]) for c, u in links.items() if row[at[u]] and row[at[c]]]
    refs = "".join(f'<hyperlink ref="{ref}" r:id="rId{i}"/>' for i, (ref, _) in enumerate(targets, 1))
    rels = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink" Target="{escape(u, {chr(34): "&quot;"})}" TargetMode="External"/>' for i, (_, u) in enumerate(targets, 1))
    head, ns = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    pack, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook {ns}><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet {ns}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet {ns}><sheetData>{"".join(body)}</sheetData>{f"<hyperlinks>{refs}</hyperlinks>" if refs else ""}</worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": f'{head}<Relationships xmlns="{pack}/relationships">{rels}</Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def write_workbook(table: DataFrame, path: str, sheet: str = "Sheet1", links: dict[str, str] | None = None, order: str | None = None) -> None:
    """A report's table as a workbook, wherever Spark can write. Rows come to the driver one partition at a time; a table beyond
    what a sheet holds is an error, never cut."""
    spark = table.sparkSession
    rows = table.orderBy(order) if order else table
    raw = workbook(table.columns, (tuple(r) for r in rows.toLocalIterator()), sheet, links)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(raw)
    stream.close()
