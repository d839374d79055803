"""Files to rows: text files and archives, strict CSV, digests, sinks.

Files are listed by the ``binaryFile`` source, one row a file; an archive is one row, too, and gives
a row for each text member.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of all .txt and .zip files under the paths, each path once."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,TXT,zip,ZIP}").load(paths)
    return df.select("path", "content").dropDuplicates(["path"])


def text_sources(files: DataFrame) -> DataFrame:
    """(source_name, data, error): text files and the text members of archives as 'path!member'.

    What can't be read is a row with null data and the error.
    """

    def members(name: str, data: bytes):
        if not name.lower().endswith(".zip"):
            yield name, bytes(data), None
            return
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for m in z.infolist():
                    if not m.is_dir() and m.filename.lower().endswith(".txt"):
                        try:
                            yield f"{name}!{m.filename}", z.read(m), None
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                            yield f"{name}!{m.filename}", None, f"member_error: {type(e).__name__}"
        except zipfile.BadZipFile:
            yield name, None, "zip_error: BadZipFile"

    def work(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                for row in members(name, data):
                    yield pd.DataFrame([row], columns=["source_name", "data", "error"])

    return files.mapInPandas(work, "source_name string, data binary, error string")


def decode(data: bytes | None) -> tuple[str | None, str]:
    """(text, encoding): UTF-8 with or without mark, GB18030, UTF-16 by its mark, else UTF-8 with
    replacement signs ('utf-8-replace')."""
    if data is None:
        return None, "none"
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace"), "utf-16"
    for name in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace"), "utf-8-replace"


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file as text columns: doubled quotes, line breaks in cells, byte order mark, no nulls.

    Extra columns pass; a missing one is an error.  ``row_index`` is the place in the file.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df.na.fill("")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("errorifexists").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256, bytes) of files."""
    df = spark.read.format("binaryFile").load(paths)
    return df.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def combined_digest(files: DataFrame) -> str:
    """One digest for a set of files, independent of their order on disk."""
    rows = sorted((os.path.basename(r["path"]), r["sha256"]) for r in files.select("path", "sha256").collect())
    return hashlib.sha256("\n".join(f"{n}:{s}" for n, s in rows).encode()).hexdigest()


def strict_json(text: str):
    """JSON without duplicate keys and without non-finite numbers."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("duplicate key")
        return out

    def constant(name):
        raise ValueError(f"not finite: {name}")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def cached(spark: SparkSession, folder: str, key: dict, build) -> DataFrame:
    """The table kept in ``folder`` if its manifest equals ``key``, else built and kept.

    build: () -> DataFrame.  The manifest is written last, so a broken write is built again.
    """
    manifest = f"{folder}/manifest"
    want = json.dumps(key, sort_keys=True, ensure_ascii=False)
    try:
        if spark.read.text(manifest).first()[0] == want:
            return spark.read.parquet(f"{folder}/table")
    except Exception:  # noqa: BLE001 - any unreadable manifest means building again
        pass
    build().write.mode("overwrite").parquet(f"{folder}/table")
    spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    return spark.read.parquet(f"{folder}/table")


def source_problems(files: DataFrame, months: list[int], pattern: str = r"(\d{1,2})月|-(\d{2})\.") -> DataFrame:
    """(problem, detail) of the exports of a period: 'empty_file', 'no_month', 'missing_month',
    'repeated_month'.  files: (path, length).  The month is that in the file's name; names aren't
    given away, only digests of them."""
    name = F.element_at(F.split("path", "/"), -1)
    month = F.coalesce(*[F.nullif(F.regexp_extract(name, pattern, i), F.lit("")) for i in (1, 2)]).cast("int")
    d = files.select(F.substring(F.sha2(name, 256), 1, 12).alias("detail"), month.alias("month"), "length")
    told = F.array_compact(F.array(F.when(F.col("length") == 0, "empty_file"), F.when(F.col("month").isNull(), "no_month")))
    own = d.select(F.explode(told).alias("problem"), "detail")
    wanted = files.sparkSession.createDataFrame([(m,) for m in months], "month int")
    n = wanted.join(d.groupBy("month").agg(F.count("*").alias("n")), "month", "left").select(F.col("month").cast("string").alias("detail"), F.coalesce("n", F.lit(0)).alias("n"))
    return own.unionByName(n.where("n <> 1").select(F.when(F.col("n") == 0, "missing_month").otherwise("repeated_month").alias("problem"), "detail"))


def canonical_digest(domain: str, parts: list):
    """Column: SHA-256 over canonical JSON (sorted keys, no blanks, no escapes) of a domain and columns."""

    def work(rows: pd.DataFrame) -> pd.Series:
        one = lambda r: hashlib.sha256(json.dumps({"domain": domain, "parts": [None if v != v else v for v in r]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        return pd.Series([one(r) for r in rows.astype(object).itertuples(index=False, name=None)], dtype=object)

    def frames(batch: pd.DataFrame) -> pd.Series:
        return work(batch)

    typed = F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])
    frames.__annotations__ = {"batch": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(frames, "string")(typed)
