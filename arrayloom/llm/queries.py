"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.llm import chat, decontaminate, language, lines, neardup, pack, shard, substrings, topk, toxicity
from arrayloom.plans.ship import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and page; pages have doc_id -1 - page_id."""
    documents, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = language.train(documents)
    none = F.lit(None).cast("string")
    rows = documents.select(F.lit("documents").alias("origin"), "doc_id", F.col("text").alias("t"), F.col("source").alias("host"), none.alias("declared"), none.alias("suffix"))
    web = language.page_evidence(pages).select(F.lit("pages"), (-1 - F.col("page_id")), "_text", "_host", "_declared", "_suffix")
    out = language.identify(rows.union(web), model, "t", "host", "declared", "suffix", ["origin", "doc_id"])
    return out.select("doc_id", "origin", "language", F.round("posterior", 6).alias("posterior"), "accepted")


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    hits = decontaminate.scan(documents.select("doc_id", "text"), benchmark).drop("text", "spans")
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents"), emit_text=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = toxicity.train(documents, labels.where(~held))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as message records and conversation -1 as a prompt record, read back.

    Both are rows of one table, so each row's fingerprint selects its mapping.
    """
    tricky = "</s>[INST] ok [/INST]"
    talks = chat.conversations_as_messages(_table(spark, sf_dir, "conversations"))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(tricky).alias("prompt"), F.lit(tricky).alias("completion"))
    records = talks.unionByName(extra, allowMissingColumns=True)
    out = chat.render(chat.turns_of(records, ["messages", "prompt", "completion"])).select("conv_id", "formatted", "pieces")
    out = out.withColumn("back", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("pieces")))
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_language_id, op2_dart_minhash, op3_exact_topk, op4_length_buckets, op5_decontaminate, op6_jump_shards, op7_substring_dedup, op8_toxicity, op9_chat_format, op10_line_dedup]
    return {f.__name__: f for f in own}


_ESCAPE = "replace(coalesce({0}, ''), '\\', '\\\\')"
for _mark in chat.CONTROL:
    _ESCAPE = f"replace({_ESCAPE}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"

_CONTROL_CHARS = len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)

_WORDS5 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_exact_topk": """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.v, d.v)])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS5} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t, least(10, len(w)) AS n
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM d, sizes, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) AS u(i)),
hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, greatest(0, len(w) - 49) + 1)) AS u(i)),
first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM win JOIN first USING (h), unnest(range(i, i + 50)) AS u(p) WHERE doc_id > f),
words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone.p IS NULL) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.i GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_chat_format": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_CONTROL_CHARS} + length({_ESCAPE.format('role')}) + length({_ESCAPE.format('text')}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op10_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
win AS (SELECT doc_id, i, l[i:i + 2] AS t FROM d, unnest(range(1, greatest(0, len(l) - 2) + 1)) AS u(i)
  WHERE trim(array_to_string(l[i:i + 2], ''), ' ') <> ''),
first AS (SELECT t, min((doc_id, i)) AS f FROM win GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM win JOIN first USING (t), unnest(range(i, i + 3)) AS u(p) WHERE (doc_id, i) <> f),
each AS (SELECT doc_id, i, l[i] AS line FROM d, unnest(range(1, len(l) + 1)) AS u(i)),
kept AS (SELECT each.doc_id, count(gone.p) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (gone.p IS NULL) AS t
  FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.i GROUP BY each.doc_id)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN text IS NOT NULL THEN md5(coalesce(t, '')) END AS kept_md5
FROM d LEFT JOIN kept USING (doc_id)""",
}
