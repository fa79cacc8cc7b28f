"""Blocks (see ``functions.ir``) as docx and epub: ZIPs of XML.

The XML is built by SQL functions, so a whole column of documents is rendered in
one projection; only packing a document's few members runs in Python.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Namespaces and media types of the two formats.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
EPUB_TYPE = "application/epub+zip"
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def escaped(x: str) -> str:
    """SQL of a text for XML: marked characters as entities, control characters that XML lacks left out."""
    return f"replace(replace(replace(regexp_replace({x}, '[\\\\x00-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x1F\\\\x{{FFFE}}\\\\x{{FFFF}}]', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _each(blocks: str, run: str, heading: str, item: str, code: str, paragraph: str) -> str:
    """SQL of all blocks in order: ``run`` renders a run r; {runs} and {code} stand for what a block b holds, ``n`` numbers items."""
    runs = lambda x: f"array_join(transform({x}, r -> {run}), '')"
    listed = f"array_join(transform(b.items, (i, n) -> {item.format(runs=runs('i'))}), '')"
    kinds = f"case b.type when 'heading' then {heading.format(runs=runs('b.content'))} when 'list' then {listed} when 'code-block' then {code.format(code=escaped('b.code'))} else {paragraph.format(runs=runs('b.content'))} end"
    return f"array_join(transform({blocks}, b -> {kinds}), '')"


def document_xml(blocks: str = "blocks") -> Column:
    """The document part of a docx. Headings have their style, items a bullet or number, right-aligned paragraphs run from right to left."""
    text = f"replace({escaped('r.content')}, '\\n', '</w:t><w:br/><w:t xml:space=\"preserve\">')"
    style = "if(r.bold or r.italic or r.strikethrough, concat('<w:rPr>', if(r.bold, '<w:b/>', ''), if(r.italic, '<w:i/>', ''), if(r.strikethrough, '<w:strike/>', ''), '</w:rPr>'), '')"
    run = f"concat('<w:r>', {style}, '<w:t xml:space=\"preserve\">', {text}, '</w:t></w:r>')"
    number = "if(b.ordered, concat(cast(coalesce(b.start_number, 1) + n as string), '. '), '• ')"
    body = _each(
        f"`{blocks}`", run,
        "concat('<w:p><w:pPr><w:pStyle w:val=\"Heading', b.level, '\"/></w:pPr>', {runs}, '</w:p>')",
        f"concat('<w:p><w:pPr><w:pStyle w:val=\"ListParagraph\"/></w:pPr><w:r><w:t xml:space=\"preserve\">', {number}, '</w:t></w:r>', {{runs}}, '</w:p>')",
        "concat('<w:p><w:pPr><w:pStyle w:val=\"Code\"/></w:pPr><w:r><w:t xml:space=\"preserve\">', replace({code}, '\\n', '</w:t><w:br/><w:t xml:space=\"preserve\">'), '</w:t></w:r></w:p>')",
        "concat('<w:p>', if(b.alignment = 'right', '<w:pPr><w:bidi/></w:pPr>', ''), {runs}, '</w:p>')",
    )
    return F.expr(f"concat('<w:document xmlns:w=\"{WORD}\"><w:body>', {body}, '<w:sectPr/></w:body></w:document>')")


def xhtml_body(blocks: str = "blocks") -> Column:
    """The text of an epub, without its frame."""
    run = f"concat(if(r.bold, '<b>', if(r.italic, '<i>', if(r.strikethrough, '<s>', ''))), replace({escaped('r.content')}, '\\n', '<br/>'), if(r.bold, '</b>', if(r.italic, '</i>', if(r.strikethrough, '</s>', ''))))"
    return F.expr(_each(
        f"`{blocks}`", run,
        "concat('<h', b.level, '>', {runs}, '</h', b.level, '>')",
        "concat('<p class=\"item\">', if(b.ordered, concat(cast(coalesce(b.start_number, 1) + n as string), '. '), '• '), {runs}, '</p>')",
        "concat('<pre>', {code}, '</pre>')",
        "concat('<p', if(b.alignment = 'right', ' dir=\"rtl\"', ''), '>', {runs}, '</p>')",
    ))


def zipped(df: DataFrame, members: dict[str, str], name: str, stored: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a ZIP, under ``name``, of members (file name: text column), the same bytes each time. A null member gives null."""
    columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])
    place = {file: columns.index(column) for file, column in members.items()}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(schema).names
        for batch in batches:
            made = []
            for row in range(batch.num_rows):
                texts = {file: batch.column(i)[row].as_py() for file, i in place.items()}
                if None in texts.values():
                    made.append(None)
                    continue
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for file, text in texts.items():
                        z.writestr(zipfile.ZipInfo(file), text, zipfile.ZIP_STORED if file in stored else zipfile.ZIP_DEFLATED)
                made.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, type=pa.binary())], names=names)

    return df.mapInArrow(run, schema)


def _with_constants(df: DataFrame, texts: dict[str, str | Column]) -> tuple[DataFrame, dict[str, str]]:
    named = {file: f"__qs_{i}" for i, file in enumerate(texts)}
    return df.withColumns({named[f]: (F.lit(t) if isinstance(t, str) else t) for f, t in texts.items()}), named


def render_docx(df: DataFrame, blocks: str = "blocks", name: str = "docx") -> DataFrame:
    """``df`` with its blocks as a docx; null blocks give null."""
    kinds = f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{DOCX_TYPE}.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
    rels = f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{RELATION}/officeDocument" Target="word/document.xml"/></Relationships>'
    links = f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="s1" Type="{RELATION}/styles" Target="styles.xml"/></Relationships>'
    heads = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:pPr><w:outlineLvl w:val="{n - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{36 - 3 * n}"/></w:rPr></w:style>' for n in range(1, 7))
    styles = f'{HEAD}<w:styles xmlns:w="{WORD}">{heads}<w:style w:type="paragraph" w:styleId="ListParagraph"><w:name w:val="List Paragraph"/><w:pPr><w:ind w:left="720"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="Code"><w:name w:val="Code"/><w:rPr><w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/></w:rPr></w:style></w:styles>'
    body = F.concat(F.lit(HEAD), document_xml(blocks))
    made, named = _with_constants(df, {"[Content_Types].xml": kinds, "_rels/.rels": rels, "word/document.xml": body, "word/_rels/document.xml.rels": links, "word/styles.xml": styles})
    return zipped(made, named, name).drop(*named.values())


def render_epub(df: DataFrame, title: str, blocks: str = "blocks", name: str = "epub", language: str = "ar") -> DataFrame:
    """``df`` with its blocks as an epub titled by column ``title``; null blocks give null. Its table of contents names the headings."""
    safe = F.expr(escaped(f"coalesce(`{title}`, '')"))
    page = lambda body: F.concat(F.lit(f'{HEAD}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{language}"><head><title>'), safe, F.lit("</title></head><body>"), body, F.lit("</body></html>"))
    words = escaped("array_join(transform(b.content, r -> r.content), '')")
    heads = F.expr(f"array_join(transform(filter(`{blocks}`, b -> b.type = 'heading'), b -> concat('<li><a href=\"text.xhtml\">', {words}, '</a></li>')), '')")
    entries = F.when(heads == "", F.concat(F.lit('<li><a href="text.xhtml">'), safe, F.lit("</a></li>"))).otherwise(heads)
    opf = F.concat(
        F.lit(f'{HEAD}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">'),
        F.md5(F.to_json(F.struct(blocks))), F.lit("</dc:identifier><dc:title>"), safe,
        F.lit(f'</dc:title><dc:language>{language}</dc:language><meta property="dcterms:modified">1970-01-01T00:00:00Z</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="text" href="text.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="text"/></spine></package>'),
    )
    container = f'{HEAD}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    nav = page(F.concat(F.lit('<nav epub:type="toc"><ol>'), entries, F.lit("</ol></nav>")))
    made, named = _with_constants(df, {"mimetype": EPUB_TYPE, "META-INF/container.xml": container, "OEBPS/content.opf": opf, "OEBPS/nav.xhtml": nav, "OEBPS/text.xhtml": page(xhtml_body(blocks))})
    return zipped(made, named, name, stored=("mimetype",)).drop(*named.values())


def member(column: str, file: str) -> Column:
    """The text of a member of ZIPs in a binary column."""

    @F.pandas_udf(T.StringType())
    def run(packages):
        def one(b):
            with zipfile.ZipFile(io.BytesIO(b)) as z:
                return z.read(file).decode("utf-8")

        return packages.map(one, na_action="ignore")

    return run(F.col(f"`{column}`"))


def member_count(column: str) -> Column:
    """How many members ZIPs in a binary column have."""

    @F.pandas_udf(T.IntegerType())
    def run(packages):
        return packages.map(lambda b: len(zipfile.ZipFile(io.BytesIO(b)).namelist()), na_action="ignore").astype("Int32")

    return run(F.col(f"`{column}`"))
