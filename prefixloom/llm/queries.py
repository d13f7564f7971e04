"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    return shard_rows(_read(spark, sf_dir, "documents"), shards=40)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_token_files, token_path, write_token_files

    docs = _read(spark, sf_dir, "documents")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_files(write_token_files(docs, token_path(spark), tokenizer, added_tokens=True))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good; the share kept is the labelled share of good ones."""
    from .resampling import resample

    labels = _read(spark, sf_dir, "labels").filter("quality is not null")
    keep = labels.agg(F.avg("quality")).first()[0] or 0.0
    return resample(_read(spark, sf_dir, "documents"), labels.filter("quality = 1").select("doc_id"), keep)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .language_id import fit, held_out, predict_languages

    docs = _read(spark, sf_dir, "documents")
    model = fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    asked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict_languages(asked, model).select("doc_id", "held_out", "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    docs = _read(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, keep_ids=False).drop("ids")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the edited text's hash, its lines, and how many were deleted."""
    from .line_dedup import dedup_lines

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs, removed_col="removed_lines").select(
        "doc_id", "removed_lines", F.size(F.split(text, "\n")).alias("kept_lines"), F.sha2(text.cast("binary"), 256).alias("text_sha256")
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir, "documents"))


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every document, with its pass, block, the block's place in the pass and the document's in the block."""
    from .mixing import mix

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, max_repeats=1.5).drop("text")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_token_files, op3_importance_resampling, op4_language_id, op5_jaccard_join, op6_byte_bpe,
        op7_line_dedup, op8_exact_dedup, op9_temperature_mix, op10_ann,
    )
}

# Operators 2, 3, 4, 6, 7, 9 and 10 aren't SQL (tokenizers, models, winnowing, bisection, an approximate search); tests/llm holds
# them against brute force.
SQL: dict[str, str] = {
    "op1_sharding": r"""WITH RECURSIVE
tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
hexed AS (SELECT doc_id, string_split(hex(encode(coalesce(text, ''))), '') AS h, strlen(coalesce(text, '')) AS n FROM documents),
bytes AS (SELECT doc_id, n, list_transform(range(n), lambda i: CAST(instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17 AS BIGINT)) AS b FROM hexed),
crc AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 0 ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) END AS crc
  FROM bytes, tab),
walk AS (SELECT doc_id, CAST(doc_id AS HUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM documents
  UNION ALL SELECT doc_id, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(k2 // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < 41)),
ends AS (SELECT doc_id, max(b) AS grown, max(b) FILTER (b < 40) AS shard FROM walk GROUP BY doc_id)
SELECT doc_id, CAST(n + 16 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM crc JOIN ends USING (doc_id)""",
    "op5_jaccard_join": r"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT x AS doc_id, coalesce(n.n, 0) AS n_shingles, min(y) AS component_id FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY x, n.n""",
    "op8_exact_dedup": r"""WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}
