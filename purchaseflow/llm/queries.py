"""The registered queries of this subpackage: thin contracts over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, html_text, lexical_search, minhash, packing, quality_rules, structure_repair, suffix_dedup, toxicity, warc, weak_labels
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = warc.page_ids(warc.round_trip(table(spark, sf_dir, "pages")))
    return seen.select(
        "page_id", F.coalesce("payload_bytes", "to_bytes").alias("payload_bytes"), F.coalesce("payload_sha1", "to_sha1").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("to_page").alias("refers_to"),
    )


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode_decode(table(spark, sf_dir, "documents"), word_vocabulary())
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    sizes = F.transform("spans", lambda s: s["end"] - s["begin"])
    return found.select(
        "doc_id", F.length("data").cast("long").alias("n_bytes"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2(suffix_dedup.remaining(F.col("data"), F.col("spans")), 256).alias("kept_sha256"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", trial), (-7, 1, "assistant", trial)], given.schema)
    return chat.digests(chat.render(given.unionByName(extra)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policies(quality_rules.ledger(table(spark, sf_dir, "documents")))
    base = ~quality_rules.passes(quality_rules.Policy("base", quality_rules.BASE))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col("kept_v3")).alias("kept"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), packing.word_count())


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with the faults that op11_structure_repair is to find, by crc32 of conversation and turn."""
    given = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = given.withColumn("_kind", kind).where("_kind <> 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return changed.drop("_copy")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return structure_repair.digests(structure_repair.repair(damaged(turns), turns))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_bpe": op2_bpe,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_weak_labels": op4_weak_labels,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_chat": op6_chat,
        "op7_quality_rules": op7_quality_rules,
        "op8_packing": op8_packing,
        "op9_html_text": op9_html_text,
        "op10_minhash": op10_minhash,
        "op11_structure_repair": op11_structure_repair,
        "op12_lexical_search": op12_lexical_search,
        "op13_toxicity": op13_toxicity,
    }


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS s FROM pages),
     q AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS m FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to
FROM q
"""

OP6_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + len(regexp_extract_all(text, '(?:<\\*/?s>|\[\\*/?(?:INST|ANS|ROLE))'))
           + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
i AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM i),
p AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM p GROUP BY doc_id),
m AS (
    SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
           length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters,
           length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks
    FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines >= 6 AND 10 * n_dup_lines > 5 * n_lines) OR (n_letters >= 40 AND 10 * n_upper > 6 * n_letters)
            OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)) OR (n_words > 0 AND 10 * n_digits > 3 * word_chars) OR 10 * n_marks > 3 * n_words) AS kept
FROM b
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n_bytes FROM d),
s AS (SELECT doc_id, unnest(range(0, n_bytes - 49)) AS i, h FROM n WHERE n_bytes >= 50),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM s),
o AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) < doc_id AS gone FROM w),
g AS (SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o WHERE gone),
e AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM e GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
c AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last_z, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
      FROM k JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * last_z + 1) END)) AS kept_sha256
FROM n LEFT JOIN c USING (doc_id)
"""


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS_SQL} AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY term, n_docs),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact FROM p JOIN w USING (term), g),
s AS (SELECT item_id, doc_id, CAST(sum(c * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op5_suffix_dedup": OP5_SQL, "op6_chat": OP6_SQL, "op7_quality_rules": OP7_SQL, "op12_lexical_search": OP12_SQL}
