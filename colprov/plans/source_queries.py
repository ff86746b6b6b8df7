"""Sources and sinks: driver tables written out in each landed form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprov.plans import frames as fr
from colprov.plans.registry import Tables, query
from colprov.session import scratch
from colprov.sources import landing as L
from colprov.sources import manifest as M

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def text_lines(t: Tables, df, name: str, suffix: str = "") -> str:
    path = scratch(t.spark, name)
    df.write.text(path)
    return path


@query("a1_csv_with_comments", CUSTOMER_SQL)
def a1(t: Tables):
    row = F.concat_ws(",", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    body = t.customer.select(F.explode(F.array(row, F.lit("# a comment, with a comma"))).alias("value"))
    return L.read_table(t.spark, text_lines(t, body, "commented"), CUSTOMER, comment="#", header=False)


@query("a2_semicolon_csv", CUSTOMER_SQL)
def a2(t: Tables):
    path = scratch(t.spark, "semicolon")
    t.customer.write.option("sep", ";").option("header", True).csv(path)
    return L.read_table(t.spark, path, CUSTOMER, sep=";")


@query(
    "a3_sentinel_as_null",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS c_acctbal FROM customer",
)
def a3(t: Tables):
    k = F.col("c_custkey")
    path = scratch(t.spark, "sentinel")
    t.customer.select(k, F.when(k % 3 == 0, "?").otherwise(F.col("c_name")).alias("c_name"), F.when(k % 5 == 0, "?").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal")).write.option("header", True).csv(path)
    return L.read_table(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double", null_token="?")


def headerless(t: Tables):
    k = F.col("s_suppkey")
    good = F.concat_ws(",", k.cast("string"), F.col("s_name"), F.when(k % 4 == 0, F.lit("?")).otherwise(F.col("s_acctbal").cast("string")))
    line = F.when(k % 10 == 3, F.concat_ws(",", F.lit("x"), k.cast("string"), F.lit("y"), F.lit("z"))).otherwise(good)
    schema = T.StructType.fromDDL("s_suppkey bigint, s_name string, s_acctbal double")
    return L.read_headerless(t.spark, text_lines(t, t.supplier.select(line.alias("value")), "headerless"), schema)


@query("a4_headerless_rows", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 10 <> 3")
def a4(t: Tables):
    return headerless(t)[0]


@query("a4_headerless_rejects", "SELECT 'x,' || s_suppkey || ',y,z' AS line FROM supplier WHERE s_suppkey % 10 = 3")
def a4b(t: Tables):
    return headerless(t)[1]


def arff_files(t: Tables):
    """Declarations and comments in one file, the rows in the others of a folder, some of them short."""
    head = ["% parts", "@relation parts", "@attribute id numeric", "@attribute brand {a, b}", "@attribute 'the size' numeric", "@data"]
    path = scratch(t.spark, "arff")
    t.spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.text(path)
    k = F.col("p_partkey")
    brand = F.concat(F.lit("'"), "p_brand", F.when(k % 7 == 2, ", old").otherwise(""), F.lit("'"))
    row = F.concat_ws(",", k.cast("string"), brand, F.when(F.col("p_size") % 6 == 0, F.lit("?")).otherwise(F.col("p_size").cast("string")))
    t.part.select(F.when(k % 10 == 3, k.cast("string")).otherwise(row).alias("value")).write.mode("append").text(path)
    return L.read_arff(t.spark, path)


@query(
    "a5_arff",
    """SELECT p_partkey::DOUBLE AS id, p_brand || CASE WHEN p_partkey % 7 = 2 THEN ', old' ELSE '' END AS brand,
   CASE WHEN p_size % 6 > 0 THEN p_size END::DOUBLE AS "the size" FROM part WHERE p_partkey % 10 <> 3""",
)
def a5(t: Tables):
    return arff_files(t)[0]


@query("a5_arff_rejects", "SELECT p_partkey::VARCHAR AS line FROM part WHERE p_partkey % 10 = 3")
def a5b(t: Tables):
    return arff_files(t)[1]


def record_files(t: Tables):
    """One JSON file per nation-sized batch of suppliers, some of them damaged."""
    path = scratch(t.spark, "records")
    k = F.col("s_suppkey")
    rec = F.to_json(F.struct(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 2 == 0, F.lit('"one"')).alias("x")))
    tag = F.when(k % 2 == 0, F.lit('"blue"')).otherwise(F.lit('["blue", "red"]'))
    rec = F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "name": "'), F.col("s_name"), F.lit('", "tag": '), tag, F.lit("}"))
    rec = F.when(k % 9 == 4, F.lit("NOT FOUND")).otherwise(rec)
    t.supplier.select(rec.alias("value"), k.alias("part")).write.partitionBy("part").text(path)
    return L.read_json_files(t.spark, f"{path}/part=*", "id bigint, name string, tag string")


@query("a6_one_json_per_file", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'blue' ELSE '[\"blue\",\"red\"]' END AS tag FROM supplier WHERE s_suppkey % 9 <> 4")
def a6(t: Tables):
    return record_files(t)[0].select("id", "name", F.replace("tag", F.lit(" "), F.lit("")).alias("tag"))


@query("a6_unreadable_files", "SELECT count(*) AS n, 9 AS n_chars FROM supplier WHERE s_suppkey % 9 = 4")
def a6b(t: Tables):
    return record_files(t)[1].groupBy("n_chars").agg(F.count(F.lit(1)).alias("n"))


def map_files(t: Tables):
    """One object per region, and a damaged file beside each."""
    path = scratch(t.spark, "map")
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_name"))))
    maps = t.nation.groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("part")).agg(F.to_json(entries).alias("value"))
    damaged = t.region.select(F.concat(F.lit("d"), F.col("r_regionkey").cast("string")).alias("part"), F.lit("NOT FOUND").alias("value"))
    maps.unionByName(damaged).write.partitionBy("part").text(path)
    return L.read_json_map(t.spark, f"{path}/part=*")


@query("a7_keyed_json_map", "SELECT 'n' || n_nationkey AS id, n_name AS text FROM nation")
def a7(t: Tables):
    return map_files(t)[0]


@query("a7_unreadable_maps", "SELECT 9 AS n_chars, count(*) AS n FROM region")
def a7b(t: Tables):
    return map_files(t)[1].groupBy("n_chars").agg(F.count(F.lit(1)).alias("n"))


@query("a8_json_lines", "SELECT doc_id, text FROM documents")
def a8(t: Tables):
    path = scratch(t.spark, "lines")
    L.write_jsonl(t.documents.select("doc_id", "text"), path)
    return L.read_jsonl(t.spark, path, "doc_id bigint, text string")


MERGE_SQL = """WITH o AS (SELECT o_orderpriority AS model, o_custkey AS ds, o_orderstatus AS test, max(o_orderkey) AS score, max(o_totalprice) AS price FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL),
 n AS (SELECT o_orderpriority AS model, o_custkey AS ds, o_orderstatus AS test, min(o_orderkey) AS score FROM orders WHERE o_orderkey % 3 < 2 GROUP BY ALL)
 SELECT model, ds, test, coalesce(n.score, o.score) AS score, o.price FROM o FULL JOIN n USING (model, ds, test)"""


def merge_sides(t: Tables):
    keys = [F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("ds"), F.col("o_orderstatus").alias("test")]
    old = t.orders.where("o_orderkey % 3 > 0").groupBy(*keys).agg(F.max("o_orderkey").alias("score"), F.max("o_totalprice").alias("price"))
    new = t.orders.where("o_orderkey % 3 < 2").groupBy(*keys).agg(F.min("o_orderkey").alias("score")).withColumn("price", F.lit(None).cast("double"))
    return old, new


@query("a9_keyed_merge", MERGE_SQL)
def a9(t: Tables):
    return L.merge_keyed(*merge_sides(t), ["model", "ds", "test"])


@query("a9_resumable_sink", MERGE_SQL)
def a9b(t: Tables):
    path = scratch(t.spark, "sink")
    old, new = merge_sides(t)
    L.resumable_sink(t.spark, path, old, ["model", "ds", "test"])
    return t.spark.read.parquet(L.resumable_sink(t.spark, path, new, ["model", "ds", "test"]))


@query("a10_result_sinks", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def a10(t: Tables):
    r = t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    csv, pq = scratch(t.spark, "result"), scratch(t.spark, "result")
    L.write_results(r, csv, "csv")
    L.write_results(L.read_table(t.spark, csv, "flag string, n bigint"), pq)
    return t.spark.read.parquet(pq)


def exported(t: Tables):
    path = scratch(t.spark, "export")
    M.export_frame(t.part, ["p_brand", "p_size", "p_retailprice"], "p_type", path)
    return path, L.read_table(t.spark, path, "p_brand string, p_size int, p_retailprice double, p_type string")


@query("a11_frame_export_manifest", "SELECT 'part' AS ds, count(*) AS n_rows, 3 AS n_cols, count(*) FILTER (WHERE p_type = 'PROMO') AS n_pos FROM part")
def a11(t: Tables):
    return M.frame_manifest(exported(t)[1], "part", ["p_brand", "p_size", "p_retailprice"], "p_type = 'PROMO'")


@query("a12_manifest_verification", "SELECT 'counts' AS what, 'ok' AS status, 1 AS n UNION ALL SELECT 'hashes', 'ok', 1")
def a12(t: Tables):
    """Counts and content hashes checked again after the export."""
    path, back = exported(t)
    counts = M.verify_manifest(
        M.frame_manifest(t.part, "part", ["p_brand", "p_size", "p_retailprice"], "p_type = 'PROMO'"),
        M.frame_manifest(back, "part", ["p_brand", "p_size", "p_retailprice"], "p_type = 'PROMO'"), ["ds"], ["n_rows", "n_cols", "n_pos"],
    )
    recorded = scratch(t.spark, "hashes")
    M.file_hashes(t.spark, path).write.parquet(recorded)
    hashes = M.verify_manifest(t.spark.read.parquet(recorded), M.file_hashes(t.spark, path), ["file"], ["bytes", "sha256"])
    both = counts.select(F.lit("counts").alias("what"), "status").unionByName(hashes.select(F.lit("hashes").alias("what"), "status"))
    return both.groupBy("what", "status").agg(F.lit(1).alias("n"))


def header_files(t: Tables):
    path = scratch(t.spark, "headers")
    b = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    names = t.part.groupBy(b.alias("brand")).agg(F.array_sort(F.collect_set("p_type")).alias("c"))
    first = F.when(F.col("brand") % 6 == 1, "NOT FOUND").otherwise(F.concat(F.lit('"id",'), F.array_join("c", ",")))
    body = names.select("brand", F.concat(first, F.lit("\n1,2,3")).alias("value"))
    body.write.partitionBy("brand").text(path)
    return L.read_headers(t.spark, f"{path}/brand=*")


HEAD_SQL = "b AS (SELECT regexp_extract(p_brand, '(\\d+)$', 1)::INT AS brand, list_sort(list(DISTINCT p_type)) AS c FROM part GROUP BY 1)"


@query("a13_header_harvest", f"WITH {HEAD_SQL}, x AS (SELECT brand, unnest(list_concat(['id'], c)) AS col, unnest(generate_series(0, len(c))) AS pos FROM b WHERE brand % 6 <> 1) SELECT brand, pos, col FROM x")
def a13(t: Tables):
    h = header_files(t)[0]
    return h.select(F.regexp_extract("file", r"brand=(\d+)", 1).cast("int").alias("brand"), F.col("pos").cast("long").alias("pos"), "col")


@query("a13_headers_with_a_reason", f"WITH {HEAD_SQL} SELECT brand, 'no delimiter in the first line' AS reason FROM b WHERE brand % 6 = 1")
def a13b(t: Tables):
    r = header_files(t)[1]
    return r.select(F.regexp_extract("file", r"brand=(\d+)", 1).cast("int").alias("brand"), "reason")


@query(
    "a14_column_union_first_wins",
    """WITH u AS (SELECT 0 AS p, c_nationkey AS ds, c_mktsegment AS col, max(c_acctbal) AS v FROM customer WHERE c_acctbal > 5000 GROUP BY ALL UNION ALL SELECT 1, c_nationkey, c_mktsegment, min(c_acctbal) FROM customer GROUP BY ALL
      UNION ALL SELECT 2, s_nationkey, 'SUPPLIER', max(s_acctbal) FROM supplier GROUP BY ALL) SELECT ds, col, arg_min(v, p) AS v FROM u GROUP BY ds, col""",
)
def a14(t: Tables):
    c = t.customer.select(F.col("c_nationkey").alias("ds"), F.col("c_mktsegment").alias("col"), F.col("c_acctbal").alias("v"))
    s = t.supplier.select(F.col("s_nationkey").alias("ds"), F.lit("SUPPLIER").alias("col"), F.col("s_acctbal").alias("v"))
    return L.first_wins([c.where("v > 5000").groupBy("ds", "col").agg(F.max("v").alias("v")), c.groupBy("ds", "col").agg(F.min("v").alias("v")), s.groupBy("ds", "col").agg(F.max("v").alias("v"))], ["ds", "col"])


HEADER = r"^=== (\w+) C(\w+) seed (\w+) ===$"


def transcripts(t: Tables):
    """One transcript per conversation, one block per turn."""
    n = F.col("turn")
    seed = F.when(n % 5 == 4, F.lit("none")).otherwise(n.cast("string"))
    said = F.when(n % 7 == 3, F.lit("")).otherwise(F.replace("text", F.lit("==="), F.lit("")))
    block = F.concat(F.lit("=== "), "role", F.lit(" C6 seed "), seed, F.lit(" ===\n"), said, F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "")
    return L.transcript_blocks(t.conversations.groupBy("conv_id").agg(text.alias("text")), HEADER)


@query("a15_transcript_blocks", r"SELECT conv_id, role AS ds, 6 AS cond, turn AS seed, regexp_replace(text, '^\s+|\s+$', '', 'g') AS raw FROM conversations WHERE turn % 5 <> 4 AND turn % 7 <> 3")
def a15(t: Tables):
    b = transcripts(t)[0].select("conv_id", "ds", "cond", "seed", "raw")
    return b.withColumn("seed", F.col("seed").cast("long"))


@query("a15_transcript_rejects", "SELECT conv_id, CASE WHEN turn % 5 = 4 THEN 'unreadable id' ELSE 'empty answer' END AS reason, count(*) AS n FROM conversations WHERE turn % 5 = 4 OR turn % 7 = 3 GROUP BY ALL")
def a15b(t: Tables):
    return transcripts(t)[1].groupBy("conv_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def answer_lines(t: Tables):
    d = F.col("doc_id")
    cat = F.element_at(F.array(*[F.lit(x) for x in ("REASON", "c", "T", "Cont", "maybe")]), (d % 5 + 1).cast("int"))
    line = F.concat(d.cast("string"), F.element_at(F.array(*[F.lit(x) for x in (" ", ". ", ") ")]), (d % 3 + 1).cast("int")), cat,
                    F.when(d % 4 == 0, F.lit(", N")).when(d % 4 == 1, F.lit(" y")).otherwise(F.lit("")), F.when(d % 6 == 0, F.lit(" ?")).otherwise(F.lit("")))
    line = F.when(d % 13 == 0, F.lit("# a remark")).when(d % 17 == 0, F.lit("what is this")).otherwise(line)
    return L.coder_answers(t.labels.select("doc_id", line.alias("value")))


@query(
    "a16_coder_answer_lines",
    """SELECT doc_id, doc_id::INT AS item, CASE doc_id % 5 WHEN 0 THEN 'REASON' WHEN 1 THEN 'CONSEQUENCE' WHEN 2 THEN 'TIMING' ELSE 'CONTESTED' END AS category, doc_id % 4 <> 0 AS licensed, doc_id % 6 = 0 AS unsure
   FROM labels WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 5 < 4""",
)
def a16(t: Tables):
    return answer_lines(t)[0]


@query(
    "a16_coder_answer_rejects",
    "SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'unparsed line' ELSE 'unknown category' END AS reason FROM labels WHERE doc_id % 13 <> 0 AND (doc_id % 17 = 0 OR doc_id % 5 = 4)",
)
def a16b(t: Tables):
    return answer_lines(t)[1].select("doc_id", "reason")


@query("a17_front_matter", "SELECT doc_id, text AS card FROM documents")
def a17b(t: Tables):
    card = F.concat(F.lit("---\nlang: "), "lang", F.lit("\ntags:\n- x\n---\n"), "text")
    return t.documents.select("doc_id", L.strip_front_matter(card).alias("card"))


@query("a18_resume_list", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 4) AND o_orderstatus <> 'P'")
def a18(t: Tables):
    cached = t.lineitem.where("l_linenumber < 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.still_to_do(t.orders.select("o_orderkey"), cached, t.orders.where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey")


@query("a19_input_inventory", "SELECT DISTINCT lang AS ds, source || '.csv' AS file, 'archive ' || lang AS provenance, substr(md5(source), 1, 1) < '8' AS present FROM documents")
def a19(t: Tables):
    declared = t.documents.select(F.col("lang").alias("ds"), F.concat("source", F.lit(".csv")).alias("file"), F.concat(F.lit("archive "), "lang").alias("provenance")).distinct()
    return M.input_inventory(declared, t.documents.where("substr(md5(source), 1, 1) < '8'").select(F.concat("source", F.lit(".csv")).alias("file")).distinct())


@query(
    "a20_nested_export",
    f"""WITH {fr.VERDICTS_SQL}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, ds, cond, col ORDER BY seed) AS rn FROM verdicts) WHERE rn = 1)
   SELECT ds, cond, model, '{{' || string_agg('"' || col || '":{{"f":' || (verdict = 'UNAVAILABLE')::INT || ',"r":"q' || confidence::INT || '"}}', ',' ORDER BY col) || '}}' AS columns, count(*) AS n_columns FROM n GROUP BY ALL""",
)
def a20(t: Tables):
    v = fr.verdicts(t, "confidence")
    rest = ["verdict", "confidence"]
    one = v.groupBy("model", "ds", "cond", "col").agg(F.min_by(F.struct(*rest), "seed").alias("t")).select("model", "ds", "cond", "col", "t.*")
    return L.nested_export(one.withColumn("reason", F.concat(F.lit("q"), F.col("confidence").cast("int").cast("string"))))


@query(
    "a20_truth_export",
    f"""WITH {fr.CELL_TRUTH_SQL} SELECT ds, '{{' || string_agg('"' || col || '":' || is_pos::VARCHAR, ',' ORDER BY col) || '}}' AS truth,
   '{{' || coalesce(string_agg('"' || col || '":"' || subtype || '"', ',' ORDER BY col) FILTER (WHERE is_pos), '') || '}}' AS mechanism, count(*) FILTER (WHERE is_pos) AS n_pos FROM cell_truth GROUP BY ds""",
)
def a20b(t: Tables):
    return L.truth_export(fr.cell_truth(t))
