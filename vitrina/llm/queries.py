"""One registered query per operator of this subpackage, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import attribution, chat, extraction, langid, minhash, mixing, packing, phrases, quality, rans, runs, topk, trie
from vitrina.llm.common import table
from vitrina.session import scratch_dir

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(function):
    LLM_QUERIES[function.__name__] = function
    return function


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors, k=10)


LLM_SQL["op4_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


LLM_SQL["op9_near_duplicates"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM worded),
nodes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
owned AS (SELECT node, n, unnest(s) AS x FROM nodes),
links AS (
  SELECT a.node AS a, b.node AS b FROM owned a JOIN owned b ON a.x = b.x AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reached AS (
  SELECT node AS a, node AS b FROM nodes
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a AS node, min(b) AS component FROM reached GROUP BY a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component, d.doc_id) AS kept
FROM sets d LEFT JOIN nodes o ON d.s = o.s LEFT JOIN least c ON c.node = o.node
"""


def learnt_from(docs: DataFrame) -> DataFrame:
    """The documents that a language model may learn from."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(learnt_from(docs))
    found = docs.select("doc_id", langid.prediction(model, F.col("text")).alias("p"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score", "p.margin", "p.rejected")


# Grades: toxic, poor, good.
GRADES = 3


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, ratings(spark, sf_dir), GRADES)
    found = docs.select("doc_id", quality.grading(model, F.col("text")).alias("g"))
    return found.select("doc_id", "g.expected_grade", "g.p_top", (F.col("g.p_top") >= 0.5).alias("kept"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed_words(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests come from the formatted conversations, read back."""
    control = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), control.alias("prompt"), control.alias("response"))
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(extra))
    read = chat.formatted(turns).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.trained_text(F.col("segments")).alias("trained"),
    )
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


LLM_SQL["op2_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
counted AS (
  SELECT *, len(regexp_extract_all(role, '<\\*(?:s>|/s>|<SYS>>|</SYS>>|\|)|\[\\*(?:INST\]|/INST\])'))
    + len(regexp_extract_all(text, '<\\*(?:s>|/s>|<SYS>>|</SYS>>|\|)|\[\\*(?:INST\]|/INST\])')) AS escapes FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS spoken,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS trained,
    sum(length(role) + length(text) + escapes + length('<|start|><|message|><|end|>')) AS formatted_chars
  FROM counted GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(spoken) AS turns_sha256,
  CAST(length(trained) AS BIGINT) AS loss_chars, sha256(trained) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""


@query
def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", "url", extraction.extracted(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return attribution.attributed(table(spark, sf_dir, "documents"), rule="largest")


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compared(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to files and read back; the digests are of what the files hold."""
    path = scratch_dir(spark, "token-files")
    rans.write(table(spark, sf_dir, "documents"), path)
    return rans.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(trie.chunks(table(spark, sf_dir, "conversations"))))


# The checksum of a decimal number, bit by bit, as an expression over its digits.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({digits}, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, d: list_reduce(list_prepend(xor(c, d), [0::BIGINT FOR _ IN range(8)]),
      lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

LLM_SQL["op11_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
    struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS v
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(v ORDER BY p) AS vs FROM turns GROUP BY c),
taken AS (SELECT *, CAST({_CRC32.format(digits="CAST(c AS VARCHAR)")} % 6 AS BIGINT) AS h FROM own),
whole AS (
  SELECT o.c, list_concat(CASE WHEN o.h > 0 THEN coalesce(b.vs, [])[1:o.h] ELSE [] END, o.vs[o.h + 1:]) AS s
  FROM taken o LEFT JOIN own b ON b.c = o.c - o.c % 100),
reached AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS depth FROM whole),
begun AS (
  SELECT c, depth, len(s) = depth AS ends, CASE WHEN depth = 0 THEN [] ELSE s[1:depth] END AS path,
    CASE WHEN depth = 0 THEN 0 ELSE length(s[depth].t) END AS chars FROM reached),
nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ends
  FROM begun GROUP BY path, depth),
families AS (
  SELECT depth - 1 AS depth, CASE WHEN depth = 1 THEN [] ELSE path[1:depth - 1] END AS path, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY ALL),
kin AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(f.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN families f ON f.depth = n.depth AND f.path = n.path
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = (CASE WHEN n.depth = 1 THEN [] ELSE n.path[1:n.depth - 1] END)),
above AS (SELECT *, unnest(range(0, depth + 1)) AS up FROM kin),
sums AS (
  SELECT CASE WHEN up = 0 THEN [] ELSE path[1:up] END AS path, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM above GROUP BY 1)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, k.parent_conv_id, CAST(k.n_convs AS BIGINT) AS n_convs,
  CAST(k.n_children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  sha256(k.ends) AS ends_sha256
FROM kin k JOIN sums s ON s.path = k.path
"""

LLM_SQL["op13_periodic_runs"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    CASE WHEN doc_id IS NULL THEN 1 ELSE CAST({_CRC32.format(digits="CAST(doc_id AS VARCHAR)")} AS BIGINT) END AS h FROM documents),
planted AS (
  SELECT d, doc_id, len(w) AS n, w, h % 10 = 0 AND len(w) > 0 AS p, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS m FROM docs),
words AS (
  SELECT d, n, i, CASE WHEN p AND i >= a THEN w[a + (i - a) % (1 + (n - a) // m) + 1] ELSE w[i + 1] END AS x
  FROM (SELECT *, unnest(range(0, n)) AS i FROM planted)),
grams AS (
  SELECT d, n, i, x, hash(x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g FROM words
  WINDOW o AS (PARTITION BY d ORDER BY i)),
matched AS (
  SELECT DISTINCT l.d, l.i - e.i AS q, l.i + s.s AS i FROM grams l
  JOIN grams e ON l.d = e.d AND l.g = e.g AND e.i < l.i AND 4 * (l.i - e.i) <= l.n
  JOIN (SELECT unnest(range(0, 5)) AS s) s ON l.i + s.s < l.n),
islands AS (SELECT d, q, i, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS k FROM matched),
stretches AS (SELECT d, min(i) - q AS start, count(*) + q AS length, q FROM islands GROUP BY d, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT d, start, length, min(q) AS period FROM stretches GROUP BY d, start, length),
listed AS (
  SELECT d, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS all_runs,
    max(struct_pack(l := length, s := -start, p := -period)) AS best FROM runs GROUP BY d),
dropped AS (SELECT DISTINCT d, unnest(range(start + period, start + length)) AS i FROM runs),
collapsed AS (
  SELECT w.d, string_agg(w.x, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN dropped r ON w.d = r.d AND w.i = r.i GROUP BY w.d)
SELECT p.doc_id, CAST(coalesce(l.n_runs, 0) AS BIGINT) AS n_runs, CAST(-l.best.s AS BIGINT) AS start,
  CAST(l.best.l AS BIGINT) AS length, CAST(-l.best.p AS BIGINT) AS period,
  CAST(1000 * l.best.l // -l.best.p AS BIGINT) AS exponent_milli, sha256(coalesce(l.all_runs, '')) AS runs_sha256,
  sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM planted p LEFT JOIN listed l ON l.d = p.d LEFT JOIN collapsed c ON c.d = p.d
"""
