"""Queries of identity, splits and token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dedup, sequence
from millrace.session import table

BITS, DISTANCE = 63, 2
SENTENCE = ["conv_id", "turn"]
LIMIT = 120


def spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("de", 150), ("en", 600), ("fr", 150), ("xx", 10)], "label string, expected int")


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", F.col("label").alias("block"), dedup.difference_hash(F.col("embedding"), BITS).alias("hash"), F.sha2(F.col("embedding").cast("string"), 256).alias("content")
    )


def words(text: str):
    """The words of a text, split at spaces and line feeds."""
    return F.filter(F.split(text, r"[ \n]+"), lambda w: w != "")


def documents_split(spark: SparkSession, d: str) -> DataFrame:
    return dedup.hash_split(table(spark, d, "documents"), words("text")).select("doc_id", "lang", "text", "split")


def groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal texts with their language and size; those with several languages are for review first (group_conflicts)."""
    each = table(spark, d, "documents").where(F.col("text").isNotNull()).groupBy(dedup.group_id("text").alias("group_id")).agg(
        F.min("lang").alias("label"), F.count("*").cast("int").alias("size"), F.countDistinct("lang").alias("_labels")
    )
    return each.where("_labels <= 1").drop("_labels")


def greedy(spark: SparkSession, d: str) -> DataFrame:
    return dedup.greedy_group_split(groups(spark, d), {"train": 0.7, "validation": 0.15, "test": 0.15})


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Words of conversations with a tag by a rule, and another that is wrong on some of them."""
    rows = table(spark, d, "conversations").select(*SENTENCE, F.posexplode(words("text")).alias("position", "token"))
    n = F.length("token")
    kind = F.when(n % 2 == 0, "NP").otherwise("VP")
    tag = F.when(n % 5 == 0, "O").when(n % 7 < 2, F.concat(F.lit("B-"), kind)).otherwise(F.concat(F.lit("I-"), kind))
    other = F.when((F.col("position") % 9 == 4) & (n > 3), "O").otherwise(tag)
    return rows.select(*SENTENCE, "position", "token", tag.alias("tag"), other.alias("predicted"))


def training_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).where("conv_id % 10 < 7")


def encoded(spark: SparkSession, d: str) -> DataFrame:
    return sequence.encoded(tagged(spark, d).select(*SENTENCE, "position", "token"), sequence.vocabulary(training_tokens(spark, d)))


def padded(spark: SparkSession, d: str) -> DataFrame:
    made = sequence.padded(encoded(spark, d), SENTENCE)
    return made.select(*SENTENCE, F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.array_join(F.col("mask").cast("array<string>"), " ").alias("mask"))


def spans(spark: SparkSession, d: str, tag: str = "tag") -> DataFrame:
    return sequence.spans(tagged(spark, d), SENTENCE, tag)


def epochs(spark: SparkSession, d: str) -> DataFrame:
    """Days as epochs, the number of orders on a weekday as score."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1
    return table(spark, d, "events").groupBy(day.alias("epoch")).agg(F.floor(F.count("*") / 20).alias("score"))


QUERIES = {
    "exact_groups": lambda s, d: dedup.exact_groups(table(s, d, "documents"), "text", "doc_id"),
    "group_conflicts": lambda s, d: dedup.group_conflicts(table(s, d, "documents"), "text", "source"),
    "inventory_vs_spec": lambda s, d: dedup.inventory_vs_spec(table(s, d, "documents"), spec(s), "lang"),
    "near_dup_pairs": lambda s, d: dedup.near_pairs(hashes(s, d), "vec_id", "block", BITS, DISTANCE),
    "hash_split": lambda s, d: documents_split(s, d).select("doc_id", "split"),
    "split_audit": lambda s, d: dedup.split_audit(documents_split(s, d).withColumn("g", dedup.group_id("text")), "g", "lang"),
    "greedy_group_split": greedy,
    "identity_difference": lambda s, d: dedup.missing_from(
        table(s, d, "documents").select("doc_id"), table(s, d, "labels").select((F.col("doc_id") + 3).alias("doc_id")), ["doc_id"]
    ),
    "record_audit": lambda s, d: dedup.record_audit(table(s, d, "documents"), "doc_id", ["n_chars"]),
    "bio_spans": spans,
    "malformed_tags": lambda s, d: sequence.malformed(tagged(s, d).withColumn("tag", F.when(F.col("position") == 3, F.lit("B-")).otherwise(F.col("tag")))).select(*SENTENCE, "position", "tag"),
    "span_metrics": lambda s, d: sequence.span_metrics(spans(s, d), spans(s, d, "predicted"), SENTENCE),
    "token_metrics": lambda s, d: sequence.token_metrics(tagged(s, d)),
    "vocabulary": lambda s, d: sequence.vocabulary(training_tokens(s, d)),
    "encode_oov": encoded,
    "pad_mask": padded,
    "length_guard": lambda s, d: sequence.length_guard(tagged(s, d), SENTENCE, LIMIT),
    "first_best_epoch": lambda s, d: sequence.first_best(epochs(s, d), "score"),
}

_HASH = " + ".join(f"CASE WHEN embedding[{i}] > embedding[{i + 1}] THEN {1 << (BITS - i)} ELSE 0 END" for i in range(1, BITS + 1))
_SPLIT = """
    split_ AS (
        SELECT doc_id, lang, text, sha256('split' || chr(30) || array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> ''), lambda w: lower(w)), chr(31))) AS h FROM documents),
    fractions AS (SELECT *, CAST(('0x' || substr(h, 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0 AS x FROM split_),
    docs AS (SELECT doc_id, lang, text, CASE WHEN x < 0.70 THEN 'train' WHEN x < 0.85 THEN 'validation' ELSE 'test' END AS split FROM fractions)"""
_TAGGED = """
    lists AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS w FROM conversations),
    tokens AS (SELECT conv_id, turn, CAST(unnest(generate_series(1, len(w))) AS INTEGER) - 1 AS position, unnest(w) AS token FROM lists),
    tags AS (
        SELECT *, CASE WHEN length(token) % 5 = 0 THEN 'O' ELSE CASE WHEN length(token) % 7 < 2 THEN 'B-' ELSE 'I-' END || CASE WHEN length(token) % 2 = 0 THEN 'NP' ELSE 'VP' END END AS tag FROM tokens),
    tagged AS (SELECT *, CASE WHEN position % 9 = 4 AND length(token) > 3 THEN 'O' ELSE tag END AS predicted FROM tags)"""


def _spans_sql(tag: str, name: str) -> str:
    return f"""
    {name}_l AS (SELECT conv_id, turn, position, {tag} AS tag, CASE WHEN {tag} <> 'O' THEN substr({tag}, 3) END AS label FROM tagged),
    {name}_o AS (SELECT *, CASE WHEN label IS NOT NULL AND NOT (tag LIKE 'I-%' AND label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY conv_id, turn ORDER BY position)) THEN 1 ELSE 0 END AS opens FROM {name}_l),
    {name}_n AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY position ROWS UNBOUNDED PRECEDING) AS span FROM {name}_o),
    {name} AS (SELECT conv_id, turn, min(label) AS label, min(position) AS "start", max(position) + 1 AS "end" FROM {name}_n WHERE label IS NOT NULL GROUP BY conv_id, turn, span)"""


_VOCAB = """,
    vocab AS (
        SELECT '<pad>' AS value, 0::BIGINT AS index UNION ALL SELECT '<unk>', 1 UNION ALL
        SELECT value, row_number() OVER (ORDER BY value) + 1 FROM (SELECT DISTINCT lower(token) AS value FROM tagged WHERE conv_id % 10 < 7)),
    encoded AS (SELECT conv_id, turn, position, token, coalesce(index, 1) AS token_id FROM tagged LEFT JOIN vocab ON lower(token) = value)"""
_T = "WITH " + _TAGGED

def _greedy_sql() -> str:
    """One group after the other, with what each part has as lists: of all labels (three entries a label), and in all."""
    shares = (0.7, 0.15, 0.15)

    def cost(p: int) -> str:
        have, whole, t, w = f"have[3 * (li - 1) + {p}]", f"whole[{p}]", f"(total * {shares[p - 1]}::DOUBLE)", f"(every * {shares[p - 1]}::DOUBLE)"
        step = f"(size * (2 * ({have} - {t}) + size))"
        own = f"CASE WHEN {have} + size <= {t} THEN {step} WHEN {have} >= {t} THEN 3 * {step} ELSE 3 * ({have} + size - {t}) * ({have} + size - {t}) - ({have} - {t}) * ({have} - {t}) END"
        return f"({own}) / greatest({t}, 1) + 0.25::DOUBLE * size * (2 * ({whole} - {w}) + size) / greatest({w}, 1)"

    return f"""
        WITH RECURSIVE g AS (
            SELECT 'sha256-' || sha256(text) AS group_id, min(lang) AS label, CAST(count(*) AS DOUBLE) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lang) <= 1),
        t AS (SELECT *, sum(size) OVER (PARTITION BY label) AS total, sum(size) OVER () AS every, dense_rank() OVER (ORDER BY label) AS li FROM g),
        o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY size DESC, total, coalesce(label, 'None'), sha256('7|' || group_id)) AS i FROM t),
        step AS (
            SELECT 0::BIGINT AS i, '' AS group_id, 0 AS part, list_transform(range((SELECT 3 * max(li) FROM o)), lambda x: 0::DOUBLE) AS have, [0::DOUBLE, 0::DOUBLE, 0::DOUBLE] AS whole
            UNION ALL
            SELECT i, group_id, part, list_transform(have, lambda x, j: x + CASE WHEN j = 3 * (li - 1) + part THEN size ELSE 0 END), list_transform(whole, lambda x, j: x + CASE WHEN j = part THEN size ELSE 0 END)
            FROM (
                SELECT *, CASE WHEN c1 <= c2 AND c1 <= c3 THEN 1 WHEN c2 <= c3 THEN 2 ELSE 3 END AS part
                FROM (SELECT o.*, have, whole, {cost(1)} AS c1, {cost(2)} AS c2, {cost(3)} AS c3 FROM step JOIN o ON o.i = step.i + 1)))
        SELECT o.group_id, label, CAST(size AS INTEGER) AS size, ['train', 'validation', 'test'][part] AS split FROM step JOIN o USING (i)"""


ORACLE_SQL = {
    "greedy_group_split": _greedy_sql(),
    "exact_groups": "SELECT 'sha256-' || sha256(text) AS group_id, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "group_conflicts": """
        SELECT 'sha256-' || sha256(text) AS group_id, count(DISTINCT source) AS n_labels, array_to_string(list_sort(list(DISTINCT source)), ',') AS labels
        FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""",
    "inventory_vs_spec": """
        WITH spec(label, expected) AS (VALUES ('de', 150), ('en', 600), ('fr', 150), ('xx', 10)),
        seen AS (SELECT lang AS label, count(*) AS observed FROM documents GROUP BY 1)
        SELECT label, CAST(coalesce(expected, 0) AS BIGINT) AS expected, coalesce(observed, 0) AS observed, coalesce(observed, 0) = coalesce(expected, 0) AS agrees
        FROM seen FULL JOIN spec USING (label)""",
    "near_dup_pairs": f"""
        WITH h AS (SELECT vec_id, label, embedding, CAST({_HASH} AS BIGINT) AS hash FROM embeddings)
        SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance
        FROM h a JOIN h b ON a.label = b.label AND a.vec_id < b.vec_id AND a.embedding <> b.embedding WHERE bit_count(xor(a.hash, b.hash)) <= {DISTANCE}""",
    "hash_split": "WITH " + _SPLIT + " SELECT doc_id, split FROM docs",
    "split_audit": "WITH " + _SPLIT + """
        SELECT split, lang, count(*) AS n, (SELECT count(*) FROM (SELECT text FROM docs GROUP BY text HAVING count(DISTINCT split) > 1)) AS crossing_groups FROM docs GROUP BY split, lang""",
    "identity_difference": """
        SELECT doc_id, 'expected' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id + 3 FROM labels)
        UNION ALL SELECT doc_id + 3, 'observed' FROM labels WHERE doc_id + 3 NOT IN (SELECT doc_id FROM documents)""",
    "record_audit": """
        SELECT count(*) AS n_rows, CAST(sum(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_keys,
               CAST(sum(CASE WHEN n_chars > 0 THEN 0 ELSE 1 END) AS BIGINT) AS bad_n_chars,
               (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS repeated FROM documents""",
    "bio_spans": _T + "," + _spans_sql("tag", "spans") + ' SELECT conv_id, turn, label, "start", "end" FROM spans',
    "malformed_tags": _T + " SELECT conv_id, turn, position, 'B-' AS tag FROM tagged WHERE position = 3",
    "span_metrics": _T + "," + _spans_sql("tag", "expected") + "," + _spans_sql("predicted", "guessed") + """,
        joined AS (SELECT label, e.e, p.p FROM (SELECT *, 1 AS e FROM expected) e FULL JOIN (SELECT *, 1 AS p FROM guessed) p USING (conv_id, turn, label, "start", "end")),
        c AS (SELECT label, CAST(sum(CASE WHEN e = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN e IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fp,
              CAST(sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM joined GROUP BY label)
        SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
               round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "token_metrics": _T + """,
        real AS (SELECT tag, count(*) AS support, sum(CASE WHEN tag = predicted THEN 1 ELSE 0 END) AS tp FROM tagged GROUP BY tag),
        said AS (SELECT predicted AS tag, count(*) AS said FROM tagged GROUP BY predicted),
        c AS (SELECT coalesce(support, 0) AS support, coalesce(said, 0) AS said, coalesce(tp, 0) AS tp FROM real FULL JOIN said USING (tag)),
        f AS (SELECT *, coalesce(2 * tp / nullif(support + said, 0), 0) AS f1 FROM c)
        SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""",
    "vocabulary": _T + _VOCAB + " SELECT value, index FROM vocab",
    "encode_oov": _T + _VOCAB + " SELECT * FROM encoded",
    "pad_mask": _T + _VOCAB + """
        , own AS (SELECT conv_id, turn, list(token_id ORDER BY position) AS ids FROM encoded GROUP BY 1, 2),
        longest AS (SELECT max(len(ids)) AS m FROM own)
        SELECT conv_id, turn, array_to_string(list_concat(ids, list_transform(generate_series(1, m - len(ids)), lambda x: 0)), ' ') AS ids,
               array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(generate_series(1, m - len(ids)), lambda x: 0)), ' ') AS mask FROM own, longest""",
    "length_guard": _T + f" SELECT conv_id, turn, count(*) AS length FROM tagged GROUP BY 1, 2 HAVING count(*) > {LIMIT}",
    "first_best_epoch": """
        WITH e AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS epoch, CAST(floor(count(*) / 20) AS BIGINT) AS score FROM events GROUP BY 1)
        SELECT CAST((SELECT epoch FROM e ORDER BY score DESC, epoch LIMIT 1) AS INTEGER) AS best_epoch, max(score) AS best_score,
               min(epoch) = 1 AND max(epoch) = count(*) AS consecutive FROM e""",
}
