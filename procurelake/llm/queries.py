"""Registered queries of this package, and their checks in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.llm import bpe, caps, chat, collocations, decontaminate, pages, randomness, ranked, simhash, substring, tokenfile, toxicity, warc
from procurelake.llm.shipping import ship
from procurelake.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return chat.digests(chat.format_chats(rows.unionByName(more)))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, length(regexp_replace(text, '([<\[]/?)(\\*)(s>|INST\]|SYS>>|ROLE\]|TEXT\])', '\1\\\2\3', 'g'))
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
      ELSE 20 + length(regexp_replace(role, '([<\[]/?)(\\*)(s>|INST\]|SYS>>|ROLE\]|TEXT\])', '\1\\\2\3', 'g')) END AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


OP4_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
fives AS (SELECT hex, [CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT) FOR i IN range(8)] AS f FROM (SELECT DISTINCT hex FROM p)),
coded AS (SELECT hex, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((f[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1) FOR i IN range(32)], '') AS digest FROM fives),
r AS (SELECT p.*, row_number() OVER w AS n, first_value(page_id) OVER w AS low FROM p
  WINDOW w AS (PARTITION BY hex ORDER BY page_id, url))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN low END AS refers_to
FROM r JOIN coded USING (hex)
"""


def op5_embedding_copies(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_vectors(table(spark, folder, "embeddings"))


def op6_substring(spark: SparkSession, folder: str) -> DataFrame:
    return substring.digests(substring.remove_repeats(table(spark, folder, "documents")))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT r, doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
gone AS (SELECT r, list(s ORDER BY s) AS starts FROM windows JOIN firsts USING (h) WHERE low < doc_id GROUP BY r),
covered AS (SELECT r, list(DISTINCT p) AS places FROM (SELECT r, unnest(range(s, s + 50)) AS p
  FROM (SELECT r, unnest(starts) AS s FROM gone)) GROUP BY r),
words AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
taken AS (SELECT DISTINCT r, unnest(places) AS i FROM covered),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN taken USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_text(table(spark, folder, "pages"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = f"{scratch_path(spark, 'tokens')}/ids"
    tokenfile.write(table(spark, folder, "documents"), target)
    return tokenfile.digests(spark, target)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("text_key")


def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return randomness.digests(randomness.scan(table(spark, folder, "documents")))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    list_filter(regexp_split_to_array(unnest(regexp_split_to_array({_SMALL}, '[.,;:!?
-
]')), '[ 	]+'), lambda x: x <> '') AS w
  FROM documents),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
    FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k))
  GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS cut FROM c),
scored AS (SELECT cuts.lang, cuts.size, cuts.phrase, cuts.a, cuts.w, cuts.cut, x.f AS l, y.f AS r,
    CAST((CAST(2000000 AS HUGEINT) * cuts.a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.k = cuts.cut AND x.phrase = array_to_string(cuts.w[1:cuts.cut], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.k = cuts.size - cuts.cut AND y.phrase = array_to_string(cuts.w[cuts.cut + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
spans AS (SELECT lang, a AS f, w, size, unnest(range(2, size)) AS k FROM c WHERE size > 2),
covers AS (SELECT lang, phrase, max(f) AS cover
  FROM (SELECT lang, f, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, size - k + 2)]) AS phrase FROM spans)
  GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN covers USING (lang, phrase) JOIN totals USING (lang)
WHERE cover IS NULL OR 100 * cover < 80 * a
QUALIFY rank <= 2000
"""


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id,
    list_distinct(regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
sizes AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, sizes GROUP BY term, docs),
norms AS (SELECT r, doc_id, 50 + ((50 * len(w) * docs) // terms) AS m FROM d, sizes WHERE len(w) > 0),
scores AS (SELECT q, item_id, r, doc_id, CAST(sum(weights.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM (SELECT q, item_id, unnest(w) AS term FROM i) JOIN weights USING (term) JOIN tf USING (term) JOIN norms USING (r)
  GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_warc": op4_warc,
    "op5_embedding_copies": op5_embedding_copies,
    "op6_substring": op6_substring,
    "op7_main_text": op7_main_text,
    "op8_decontamination": op8_decontamination,
    "op9_token_files": op9_token_files,
    "op10_toxicity": op10_toxicity,
    "op11_secrets": op11_secrets,
    "op12_collocations": op12_collocations,
    "op13_ranked_search": op13_ranked_search,
}
CHECKS = {"op1_chat_formatting": OP1_SQL, "op4_warc": OP4_SQL, "op6_substring": OP6_SQL, "op12_collocations": OP12_SQL, "op13_ranked_search": OP13_SQL}
