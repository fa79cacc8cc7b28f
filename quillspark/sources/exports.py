"""What leaves the engine: packages of documents, metrics as text, queue updates, engines as plug-ins."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Profile, formats, metadata, source file, tags, folder path.
PROFILES = (
    ("research", ("md", "json", "pdf", "docx"), True, False, True, True),
    ("archive", ("md", "txt", "json", "pdf", "docx", "epub"), True, True, True, True),
    ("plain", ("txt",), False, False, False, False),
    ("developer", ("json",), True, False, True, True),
)
#: Formats that this engine writes; others need programs outside of it.
WRITTEN = ("md", "txt", "json", "docx", "epub")


def profiles(spark: SparkSession) -> DataFrame:
    """The export profiles as a small table."""
    rows = ", ".join(f"('{n}', array({', '.join(repr(f) for f in fs)}), {m}, {s}, {t}, {p})" for n, fs, m, s, t, p in PROFILES)
    return spark.sql(f"select * from values {rows} as v(profile, formats, metadata, source, tags, folder_path)")


def header(title: str, values: dict[str, str]) -> Column:
    """Front matter with the values that aren't null, in the order given."""
    lines = [F.concat(F.lit("title: "), F.col(title)), *[F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in values.items()]]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def envelope(columns: list[str]) -> Column:
    """A document as JSON, nulls left out."""
    return F.to_json(F.struct(*columns))


def readme(df: DataFrame, key: str, title: str, place: str) -> DataFrame:
    """(key, readme): a numbered index of titles for each export."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(place, title))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x[title]))
    return df.groupBy(key).agg(F.array_join(lines, "\n").alias("readme"))


def planned_files(docs: DataFrame, profile: str) -> DataFrame:
    """``docs`` by the files that an export makes: a row for each format of the document's profile (column ``profile``), with
    ``format`` and the profile's flags. Unknown and null profiles export nothing."""
    known = profiles(docs.sparkSession).withColumnRenamed("profile", profile)
    return docs.join(F.broadcast(known), profile).withColumn("format", F.explode("formats")).drop("formats")  # a row for each profile


def packages(files: DataFrame, keys: list[str], profile: str = "plain") -> DataFrame:
    """(keys, n_files, total_size, package): a ZIP of each export's files (document, title, name, content: string), names in order,
    the same bytes each time, with a manifest of documents, files and sizes, and an index of titles where there are several documents.

    A package is one binary value of one task, so ``keys`` should name batches of bounded size, as requests do (see ``predicates.check_batch``).
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, documents, total = io.BytesIO(), {}, 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for document, title, name, content in sorted(zip(group["document"], group["title"], group["name"], group["content"], strict=True), key=lambda r: r[2]):
                raw = (content or "").encode("utf-8")
                z.writestr(zipfile.ZipInfo(name), raw, zipfile.ZIP_DEFLATED)
                documents.setdefault(document, {"id": document, "title": title, "files": []})["files"].append({"path": name, "size": len(raw), "format": name.rpartition(".")[2]})
                total += len(raw)
            if len(documents) > 1:
                index = "".join(f"{i}. {d['title']}\n" for i, d in enumerate(documents.values(), 1))
                z.writestr(zipfile.ZipInfo("README.md"), index, zipfile.ZIP_DEFLATED)
            manifest = {"export": "/".join(str(group[k].iloc[0]) for k in keys), "profile": profile, "documents": list(documents.values()), "total_size": total}
            z.writestr(zipfile.ZipInfo("manifest.json"), json.dumps(manifest, ensure_ascii=False, indent=2), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({k: [group[k].iloc[0]] for k in keys} | {"n_files": [len(group)], "total_size": [total], "package": [out.getvalue()]})

    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, F.col("document").cast("string").alias("document"), "title", "name", "content").groupBy(*keys).applyInPandas(run, f"{kinds}, n_files bigint, total_size bigint, package binary")


def prometheus(metrics: DataFrame) -> DataFrame:
    """(name, exposition): text of each metric (name, label, label_value, value), help line first."""
    line = F.format_string('%s{%s="%s"} %s', "name", "label", "label_value", F.col("value").cast("string"))
    body = metrics.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("b"))
    return body.select("name", F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" gauge\n"), F.col("b")).alias("exposition"))


def extract_pages(df: DataFrame, engine: Callable[[bytes], list[tuple[str, float]]], key: str, content: str) -> DataFrame:
    """(key, number, text, confidence) by a page-reading engine, called for each content on the executors; no engine is shipped."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, text, confidence) for k, c in zip(batch[key], batch[content], strict=True) for n, (text, confidence) in enumerate(engine(c), 1)]
            yield pd.DataFrame(rows, columns=[key, "number", "text", "confidence"])

    return df.select(key, content).mapInPandas(run, f"{key} {kind}, number int, text string, confidence double")


def better_pages(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Of two passes over pages, each page's reading of higher confidence; the first's among equals."""
    both = first.withColumn("pass", F.lit(0)).unionByName(second.withColumn("pass", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct("text", "confidence"), F.struct("confidence", -F.col("pass"))).alias("b"))
    return best.select(*keys, "b.text", "b.confidence")
