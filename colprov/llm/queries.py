"""The dealt queries over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colprov.llm import ann, bpe, chosen_path, decontaminate, fm_dedup, jaccard_join, periodic_runs, prefix_trie, sharding, suffix_dedup, toxicity, training_order, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op6_suffix_dedup")
def op6(spark, folder):
    """200-byte strings that start anywhere else go."""
    return suffix_dedup.removal_digests(table(spark, folder, "documents"))


@query("op9_fm_dedup")
def op9(spark, folder):
    """50-word windows that a document with a smaller id has go."""
    return fm_dedup.kept_digests(table(spark, folder, "documents"))


def groups_sql(share: int, kept: str = "") -> str:
    """Components of documents whose sets of four-word shingles share so many hundredths of their union."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w) + 1, 2)))) AS i FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {share} * (x.n + y.n - c)),
 reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
 low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id{kept} FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id"""


@query("op3_jaccard_join", groups_sql(85))
def op3(spark, folder):
    """Documents linked by 4-word shingles at a Jaccard similarity of 0.85, as components."""
    return jaccard_join.join(table(spark, folder, "documents"), 4, 85, 100)


@query("op4_bpe")
def op4(spark, folder):
    """Token ids of every text, and their decoding, as digests."""
    return bpe.digests(table(spark, folder, "documents"), *bpe.public_vocabulary())


@query("op5_sharding")
def op5(spark, folder):
    """All documents in 40 shards of near equal bytes."""
    return sharding.assign(table(spark, folder, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


@query("op7_decontamination")
def op7(spark, folder):
    """Documents that hold passages of the benchmark, substitutions allowed."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.verdicts(docs, table(spark, folder, "benchmark")).select("doc_id", "contaminated", "n_items", "item_id", "matched")


@query("op10_warc")
def op10(spark, folder):
    """A WARC record for every page, written and read back."""
    return warc.round_trip(table(spark, folder, "pages"))


@query("op8_ann")
def op8(spark, folder):
    """The 20 nearest vectors of every row whose id is divisible by 20."""
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op2_toxicity")
def op2(spark, folder):
    """Severity of every document, learnt from the labels."""
    return toxicity.assess(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))


@query("op1_training_order")
def op1(spark, folder):
    """Every token sequence at its slot of a keyed order, in shards of fixed stride."""
    docs = table(spark, folder, "documents")
    return training_order.write(docs, *bpe.public_vocabulary()).select("doc_id", "part", "n_tokens", "slot", "shard", "position")


@query("op13_periodic_runs")
def op13(spark, folder):
    """Runs of repeated words in every text, and the texts without the repetitions."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return periodic_runs.digests(periodic_runs.collapse(periodic_runs.rewound(docs)))


#: The trie over prefixes as strings of turn hashes. ``step`` is the table of the checksum, ``h`` the turns taken from the base.
TRIE_SQL = r"""WITH step AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
   FROM (SELECT unnest(range(256)) AS b))),
 ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce([4294967295] || [ascii(x) FOR x IN string_split(conv_id::VARCHAR, '')], lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 4 AS h
   FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), step),
 raw AS (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
 own AS (SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k, words) AS p FROM raw),
 turns AS (SELECT i.conv_id, p, k, words FROM ids i JOIN own o ON o.conv_id = i.conv_id WHERE p > h UNION ALL SELECT i.conv_id, p, k, words FROM ids i JOIN own o ON o.conv_id = i.base WHERE p <= h),
 chain AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(k, '') OVER w AS seq, words FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
 member AS (SELECT conv_id, depth, seq, words FROM chain UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
 ends AS (SELECT conv_id, arg_max(seq, depth) AS seq FROM member GROUP BY conv_id), enders AS (SELECT seq, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS e FROM ends GROUP BY seq),
 node AS (SELECT seq, min(conv_id) AS conv_id, max(depth) AS depth, count(*) AS n_convs, max(words) AS words, CASE WHEN max(depth) > 0 THEN left(seq, len(seq) - 32) END AS over FROM member GROUP BY seq),
 kids AS (SELECT over AS seq, count(*) AS n_children FROM node WHERE over IS NOT NULL GROUP BY over),
 full_node AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids USING (seq)),
 sums AS (SELECT left(seq, 32 * d) AS seq, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM full_node) GROUP BY 1)
 SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
 FROM full_node n JOIN sums s USING (seq) LEFT JOIN enders USING (seq) LEFT JOIN node u ON u.seq = n.over"""


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark, folder):
    """Every common beginning of the rebuilt conversations, with what sharing it would save."""
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, folder, "conversations"))))


@query("op11_chosen_path", groups_sql(80, ", d.doc_id <= coalesce(low.b, d.doc_id) AS kept"))
def op11(spark, folder):
    """Near copies by 4-word shingles at a Jaccard similarity of 0.8, as groups that keep one document."""
    return chosen_path.groups(table(spark, folder, "documents"), 4, 80, 100)
