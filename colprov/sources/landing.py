"""Landed files into DataFrames, with an account of what could not be read.

Every scan that can meet damaged input returns ``(data, rejects)``: a file that
could not be read must never look like a file that held nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprov.functions.text import squeeze

PATH = "_metadata.file_path"


# ------------------------------------------------------------------- tables


def read_table(
    spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", comment: str | None = None,
    null_token: str | None = None, header: bool = True,
) -> DataFrame:
    """A delimited file with an explicit schema, comment lines skipped and a sentinel read as null."""
    r = spark.read.schema(schema).option("sep", sep).option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if comment:
        r = r.option("comment", comment)
    if null_token:
        r = r.option("nullValue", null_token)
    return r.csv(path)


def null_tokens(df: DataFrame, token: str = "?") -> DataFrame:
    """The sentinel as null in every text column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.trim(F.col(c)) != token, F.col(c)) for c in text}) if text else df


def read_headerless(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", null_token: str = "?") -> tuple[DataFrame, DataFrame]:
    """A file without a header, under supplied names. Lines that do not fit the
    schema come back as rejects, whole."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"sep": sep, "mode": "PERMISSIVE", "nullValue": null_token, "columnNameOfCorruptRecord": "_corrupt_record"}
    raw = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_csv("value", F.lit(wide.toDDL()), options).alias("r"))
    good = raw.where("r._corrupt_record IS NULL").select(*[f"r.`{c}`" for c in schema.fieldNames()])
    return good, raw.where("r._corrupt_record IS NOT NULL").select(F.col("value").alias("line"))


def read_arff(spark: SparkSession, path: str, null_token: str = "?") -> tuple[DataFrame, DataFrame]:
    """An attribute-relation file: names from @attribute, rows after @data, comments
    dropped; a column becomes numeric only if no value is lost by it. Values may stand
    in single quotes. Lines with more or fewer values come back as rejects, whole.

    The declarations, a few short lines at the head, are the only thing the driver sees.
    """
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("%"))
    declared = lines.where(F.lower(F.trim("value")).startswith("@attribute")).select(
        F.regexp_extract(F.trim("value"), r"(?i)^@attribute\s+(?:'([^']+)'|\"([^\"]+)\"|(\S+))", 0).alias("d"),
        F.monotonically_increasing_id().alias("i"),
    )
    names = [
        next(g for g in _unquote(r["d"]) if g)
        for r in declared.orderBy("i").collect()
    ]
    ddl = ", ".join([*[f"c{i} string" for i in range(len(names))], "_corrupt_record string"])
    options = {"quote": "'", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "columnNameOfCorruptRecord": "_corrupt_record"}
    raw = lines.where(~F.trim("value").startswith("@")).select("value", F.from_csv("value", F.lit(ddl), options).alias("r"))
    rejects = raw.where("r._corrupt_record IS NOT NULL").select(F.col("value").alias("line"))
    cells = null_tokens(raw.where("r._corrupt_record IS NULL").select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)]), null_token)
    fit = cells.agg(*[(F.count(F.col(f"`{n}`").try_cast("double")) == F.count(f"`{n}`")).alias(f"k{i}") for i, n in enumerate(names)]).first()
    return cells.select(*[F.col(f"`{n}`").cast("double").alias(n) if fit[f"k{i}"] else F.col(f"`{n}`") for i, n in enumerate(names)]), rejects


def _unquote(declaration: str) -> list[str]:
    name = declaration.split(None, 1)[1].strip()
    return [name.strip("'\"")]


# --------------------------------------------------------------------- JSON


def read_json_files(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """One JSON record per file: (records with their file, rejected files). Fields
    that are text in some files and lists in others are declared STRING."""
    raw = spark.read.text(path, wholetext=True).select(F.col(PATH).alias("file"), F.col("value").alias("text"))
    parsed = raw.withColumn("r", F.from_json("text", schema))
    # a record none of whose fields could be read is a file that could not be read
    fields = [f"r.{f.name}" for f in parsed.schema["r"].dataType.fields]
    empty = F.coalesce(*[F.col(f).cast("string") for f in fields]).isNull()
    return parsed.where(~empty).select("file", "r.*"), parsed.where(empty).select("file", F.length(F.regexp_replace("text", r"\s+$", "")).alias("n_chars"))


def read_json_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files that each hold one object {id: text}: (rows, rejected files)."""
    raw = spark.read.text(path, wholetext=True).select(F.col(PATH).alias("file"), F.col("value").alias("text"))
    parsed = raw.withColumn("m", F.from_json("text", "map<string,string>"))
    rows = parsed.select(F.explode("m").alias("id", "text"))
    return rows, parsed.where("m IS NULL").select("file", F.length(F.regexp_replace("text", r"\s+$", "")).alias("n_chars"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("errorifexists")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


# --------------------------------------------------------------- keyed merge


def merge_keyed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the new one where there is one, else the old. Fields the new
    row leaves null keep their old value."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in rest])
    b = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest])
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in rest])


def resumable_sink(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> str:
    """Merge into the latest version under ``path`` and write the next one; readers
    keep the old version until the new one is complete. Returns the new version's path."""
    from colprov.sources.manifest import list_files

    done = sorted({f.split("/version=")[1].split("/")[0] for f in list_files(spark, path) if "/version=" in f and f.endswith("_SUCCESS")}, key=int)
    merged = new if not done else merge_keyed(spark.read.parquet(f"{path}/version={done[-1]}"), new, keys)
    target = f"{path}/version={int(done[-1]) + 1 if done else 0}"
    merged.write.mode("errorifexists").parquet(target)
    return target


def still_to_do(index: DataFrame, cached: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """Index less what is cached and what is known to be dead."""
    return index.join(cached.select(key), key, "left_anti").join(dead.select(key), key, "left_anti")


# ------------------------------------------------------------------ headers


#: Schemes whose files tasks open by themselves; others go through Spark's text reader.
DIRECT_SCHEMES = ("", "file", "hdfs", "viewfs", "s3", "gs", "gcs")
FILES_PER_TASK = 200


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, mtime) of every file with content under a path or pattern; nothing is read but the listing."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


def first_lines(spark: SparkSession, path: str, per_task: int = FILES_PER_TASK) -> DataFrame:
    """(file, line, problem): the first line that is not blank of every file, one row per file.

    Tasks take up to ``per_task`` names and open each file for its first bytes, so what is
    read does not grow with the length of the files. A file without such a line gives
    null, one that cannot be opened null and the problem. Where the scheme is one that only
    Spark can open, its text reader goes over the files instead.
    """
    scheme = path.partition(":")[0].lower() if ":/" in path else ""
    if scheme not in DIRECT_SCHEMES:
        lines = spark.read.text(path).where(F.trim("value") != "").select(
            F.col(PATH).alias("file"), "value", F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at")
        )
        return lines.groupBy("file").agg(F.min_by("value", "at").alias("line")).withColumn("problem", F.lit(None).cast("string"))
    names = files(spark, path).select("file")
    tasks = max(1, -(-names.count() // per_task))
    return names.repartition(tasks, "file").mapInArrow(_first_lines, "file string, line string, problem string")


def _first_lines(batches):
    import re

    import pyarrow as pa
    from pyarrow import fs

    def first(file):
        place = re.sub(r"^file:/+", "/", file)
        system, inner = (fs.LocalFileSystem(), place) if place.startswith("/") else fs.FileSystem.from_uri(file)
        with system.open_input_stream(inner, compression="detect", buffer_size=1 << 16) as f:
            held = b""
            while block := f.read(1 << 16):
                held = held + block if held else block.lstrip()
                if b"\n" in held:
                    held = held[: held.index(b"\n")]
                    break
        return held.rstrip(b"\r\n").decode("utf-8", "replace") or None

    for batch in batches:
        out = []
        for file in batch.column(0).to_pylist():
            try:
                out.append((file, first(file), None))
            except (OSError, pa.ArrowInvalid) as e:
                out.append((file, None, type(e).__name__))
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "line", "problem"), r)) for r in out], schema=pa.schema([(n, pa.string()) for n in ("file", "line", "problem")]))


def read_headers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, col) from the first non-empty line of each CSV or TSV file, and the
    files that gave none, with a reason."""
    first = first_lines(spark, path)
    sep = F.when(F.lower("file").endswith(".tsv"), "\t").otherwise(",")
    cols = F.filter(
        F.transform(F.split(F.regexp_replace(F.coalesce("line", F.lit("")), "﻿", ""), sep), lambda c: F.regexp_replace(F.trim(c), r'^"|"$', "")), lambda c: F.trim(c) != ""
    )
    out = first.withColumn("cols", cols)
    bad = F.when(F.col("problem").isNotNull(), F.concat(F.lit("unreadable: "), "problem")).when(F.size("cols") == 0, "empty header").when(F.size("cols") == 1, "no delimiter in the first line")
    out = out.withColumn("reason", bad)
    return (
        out.where("reason IS NULL").select("file", F.posexplode("cols").alias("pos", "col")),
        out.where("reason IS NOT NULL").select("file", "line", "reason"),
    )


def first_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of several sources of the same columns; an earlier source wins per key."""
    rest = [c for c in parts[0].columns if c not in key]
    every = parts[0].withColumn("_p", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("_p", F.lit(i)))
    return every.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("_p", *rest)).alias("t")).select(*key, "t.*")


# -------------------------------------------------------------- transcripts


def transcript_blocks(docs: DataFrame, header: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Blocks of a transcript, split on a header line whose groups are (ds, cond, seed).
    Blocks with an unreadable id or an empty body are rejects with a reason."""
    rest = [c for c in docs.columns if c != text]
    pat = f"(?m){header}"
    ids = F.transform(
        F.regexp_extract_all(text, F.lit(pat), F.lit(0)),
        lambda h: F.struct(F.regexp_extract(h, pat, 1).alias("ds"), F.regexp_extract(h, pat, 2).try_cast("int").alias("cond"), F.regexp_extract(h, pat, 3).try_cast("int").alias("seed")),
    )
    bodies = F.slice(F.split(text, pat, -1), 2, F.size(F.split(text, pat, -1)))
    b = docs.select(*rest, F.posexplode(F.arrays_zip(ids.alias("id"), bodies.alias("body"))).alias("block", "b")).select(
        *rest, "block", "b.id.ds", "b.id.cond", "b.id.seed", F.trim(F.regexp_replace("b.body", r"^\s+|\s+$", "")).alias("raw")
    )
    reason = F.when(F.col("ds").isNull() | (F.col("ds") == "") | F.col("cond").isNull() | F.col("seed").isNull(), "unreadable id").when(F.col("raw") == "", "empty answer")
    b = b.withColumn("reason", reason)
    return b.where("reason IS NULL").drop("reason"), b.where("reason IS NOT NULL")


# ---- fixed values: coder answer categories and their abbreviations
CATEGORIES = ["REASON", "CONSEQUENCE", "TIMING", "CONTESTED"]
CATEGORY_ALIAS = {"R": "REASON", "C": "CONSEQUENCE", "T": "TIMING", "X": "CONTESTED", "CONS": "CONSEQUENCE", "CONT": "CONTESTED"}
ANSWER_LINE = r"^(\d+)\s*[.):]?\s+([A-Za-z]+)\s*(?:[,\s]\s*([YyNn]))?\s*(\?)?\s*$"


def coder_answers(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(item, category, licensed, unsure) from answer lines such as '13. c, N ?'.
    Blank lines and comments are nothing; anything else unread is a reject."""
    x = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    rest = [c for c in lines.columns if c != line]
    alias = F.create_map(*[y for k, v in CATEGORY_ALIAS.items() for y in (F.lit(k), F.lit(v))])
    c = lines.select(*rest, x.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    said = F.upper(F.regexp_extract("line", ANSWER_LINE, 2))
    c = c.withColumns(
        {
            "item": F.regexp_extract("line", ANSWER_LINE, 1).try_cast("int"),
            "category": F.coalesce(F.element_at(alias, said), said),
            "licensed": F.upper(F.regexp_extract("line", ANSWER_LINE, 3)) != "N",
            "unsure": F.regexp_extract("line", ANSWER_LINE, 4) == "?",
        }
    )
    reason = F.when(F.col("item").isNull(), "unparsed line").when(~F.col("category").isin(CATEGORIES), "unknown category")
    c = c.withColumn("reason", reason)
    return c.where("reason IS NULL").select(*rest, "item", "category", "licensed", "unsure"), c.where("reason IS NOT NULL").select(*rest, "line", "reason")


# -------------------------------------------------------------------- cards


def strip_front_matter(c: Column) -> Column:
    """A card without its leading YAML block."""
    return F.regexp_replace(c, r"(?s)\A---\s*\n.*?\n---\s*\n", "")


def strip_html(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"<[^>]+>", " "))


# ------------------------------------------------------------- nested export


def nested_export(verdicts: DataFrame, reason_chars: int = 400) -> DataFrame:
    """One JSON text per (ds, cond, model): column -> {f: flagged, r: reason}. The
    grain keeps every object as small as one table's column list."""
    entry = F.struct("col", F.struct((F.col("verdict") == "UNAVAILABLE").cast("int").alias("f"), F.left(F.coalesce("reason", F.lit("")), F.lit(reason_chars)).alias("r")))
    return verdicts.groupBy("ds", "cond", "model").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("columns"), F.count(F.lit(1)).alias("n_columns")
    )


def truth_export(truth: DataFrame) -> DataFrame:
    """Per dataset: the truth map and the mechanism map of its positives as JSON."""
    pos = F.struct("col", F.coalesce("subtype", F.lit("CONTESTED")))
    return truth.groupBy("ds").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "is_pos"))))).alias("truth"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("is_pos"), pos))))).alias("mechanism"),
        F.count_if("is_pos").alias("n_pos"),
    )
