"""SQL counterparts of the registered queries, for DuckDB on the same tables.

Written from the definitions: similarity metrics enumerate all pairs, label
separation averages pair means, positions come from a sort.
"""

from __future__ import annotations

from vitrina.functions import spanish as es
from vitrina.plans.catalog import AUTO_STORE_PREFIX, BUCKET, MARKETS, SHORT_QUERIES
from vitrina.sources.readers import NULL_MARKERS

ORACLE: dict[str, str] = {}

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MARKET_LIST = ", ".join(f"'{m}'" for m in MARKETS)
MARKERS = ", ".join("'" + m + "'" for m in NULL_MARKERS)


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def normalized(c: str) -> str:
    lower = f"lower(coalesce({c}, ''))"
    no_url = f"regexp_replace({lower}, 'https?://[^{WS}]+|www\\.[^{WS}]+', ' ', 'g')"
    letters = f"regexp_replace(translate({no_url}, '_/-', '   '), '[^\\p{{L}}{WS}]+', '', 'g')"
    return f"trim(regexp_replace({letters}, '[{WS}]+', ' ', 'g'))"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


CATALOG = """catalog AS (
  SELECT d.doc_id AS id, d.lang AS country_code, d.source AS city_code, d.source AS store_name,
    split_part(d.text, chr(10), 1) AS product_name, CAST(e.label AS VARCHAR) AS collection_section,
    d.text AS product_description,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 11 = 0 THEN '  '
      ELSE 'dataset/' || d.doc_id || '.png' END AS s3_path,
    e.embedding AS text_vector
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

FILTERED = f"""filtered AS (
  SELECT * FROM catalog
  WHERE s3_path IS NOT NULL AND trim(s3_path) <> '' AND {strip('product_description')} <> ''
    AND NOT starts_with(store_name, '{AUTO_STORE_PREFIX}') AND country_code IN ({MARKET_LIST}))"""

VECTORS = """vectors AS (
  SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS v, CAST(e.label AS VARCHAR) AS label,
    coalesce(d.lang, 'None') AS country, coalesce(d.source, 'None') AS city
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
units AS (
  SELECT *, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS u FROM vectors)"""

MIXED = """mixed AS (
  SELECT id, v AS a, label, list_transform(range(1, 65), lambda i:
    0.25 * v[i] + 0.5 * v[65 - i] + 0.9 * v[CASE WHEN i = 1 THEN 64 ELSE i - 1 END]) AS m
  FROM vectors),
two AS (
  SELECT id, a, label, list_transform(m, lambda x: x / (sqrt(list_dot_product(m, m)) + 1e-8)) AS b FROM mixed),
pairs AS (
  SELECT id, label, a, b,
    list_transform(a, lambda x: x / (sqrt(list_dot_product(a, a)) + 1e-8)) AS ua,
    list_transform(b, lambda x: x / (sqrt(list_dot_product(b, b)) + 1e-8)) AS ub
  FROM two)"""

SIMS = """sims AS (
  SELECT x.id, y.id AS other, x.label = y.label AS same, x.country, y.country AS other_country,
    x.city, y.city AS other_city, x.label, y.label AS other_label,
    list_dot_product(x.u, y.u) AS exact, round(list_dot_product(x.u, y.u), 10) AS s
  FROM units x, units y WHERE x.id <> y.id)"""

NEIGHBOURS = SIMS + """,
near AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rank FROM sims)"""

# --- lexical building blocks ---------------------------------------------------

# The published Spanish stop words, in their published order. The library takes them from Spark; these
# texts must also be there without a session.
STOP_WORDS = """
de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta
entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese
eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual
poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosostros vosostras os mío mía
míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros
vuestras esos esas estoy estás está estamos estáis están esté estés estemos estéis estén estaré estarás estará
estaremos estaréis estarán estaría estarías estaríamos estaríais estarían estaba estabas estábamos estabais estaban
estuve estuviste estuvo estuvimos estuvisteis estuvieron estuviera estuvieras estuviéramos estuvierais estuvieran
estuviese estuvieses estuviésemos estuvieseis estuviesen estando estado estada estados estadas estad he has ha hemos
habéis han haya hayas hayamos hayáis hayan habré habrás habrá habremos habréis habrán habría habrías habríamos
habríais habrían había habías habíamos habíais habían hube hubiste hubo hubimos hubisteis hubieron hubiera hubieras
hubiéramos hubierais hubieran hubiese hubieses hubiésemos hubieseis hubiesen habiendo habido habida habidos habidas
soy eres es somos sois son sea seas seamos seáis sean seré serás será seremos seréis serán sería serías seríamos
seríais serían era eras éramos erais eran fui fuiste fue fuimos fuisteis fueron fuera fueras fuéramos fuerais fueran
fuese fueses fuésemos fueseis fuesen sintiendo sentido sentida sentidos sentidas siente sentid tengo tienes tiene
tenemos tenéis tienen tenga tengas tengamos tengáis tengan tendré tendrás tendrá tendremos tendréis tendrán tendría
tendrías tendríamos tendríais tendrían tenía tenías teníamos teníais tenían tuve tuviste tuvo tuvimos tuvisteis
tuvieron tuviera tuvieras tuviéramos tuvierais tuvieran tuviese tuvieses tuviésemos tuvieseis tuviesen teniendo
tenido tenida tenidos tenidas tened
""".split()
STOPS = ", ".join("('" + w + "')" for w in STOP_WORDS)
SHORT = ", ".join(f"({1_000_000 + i}, '{t}')" for i, t in enumerate(SHORT_QUERIES))
QUERIES = f"""queries AS (
  SELECT CAST(item_id AS BIGINT) AS query_id, text FROM benchmark
  UNION ALL SELECT CAST(query_id AS BIGINT), text FROM (VALUES {SHORT}) q(query_id, text))"""

V, C = f"[{es.VOWELS}]", f"[^{es.VOWELS}]"


def _ending(word: str, suffixes: list[str]) -> str:
    return f"regexp_extract({word}, '({'|'.join(suffixes)})$', 1)"


def _in(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _drop(base: str, suffixes: list[str], start: str = "r2") -> str:
    second = _ending(base, suffixes)
    return (
        f"CASE WHEN {second} <> '' AND length({base}) - length({second}) >= {start} "
        f"THEN left({base}, length({base}) - length({second})) ELSE {base} END"
    )


_STANDARD = (
    es.PLAIN_SUFFIXES + es.IC_SUFFIXES + es.LOG_SUFFIXES + es.U_SUFFIXES + es.ENTE_SUFFIXES + ["amente", "mente"]
    + es.IDAD_SUFFIXES + es.IVA_SUFFIXES
)
_HOST = f"({'|'.join(es.PRONOUN_HOSTS)})({'|'.join(sorted(es.PRONOUNS, key=len, reverse=True))})$"

# The Snowball steps as one CTE each, over the distinct words.
STEMS = f"""stem0 AS (
  SELECT w AS word, w,
    CASE WHEN regexp_matches(w, '^(.{C}+{V}|{V}{V}+{C}|{C}{V}.)')
      THEN length(regexp_extract(w, '^(.{C}+{V}|{V}{V}+{C}|{C}{V}.)', 0)) ELSE length(w) END AS rv,
    CASE WHEN regexp_matches(w, '^{C}*{V}+{C}')
      THEN length(regexp_extract(w, '^{C}*{V}+{C}', 0)) ELSE length(w) END AS r1,
    CASE WHEN regexp_matches(w, '^{C}*{V}+{C}+{V}+{C}')
      THEN length(regexp_extract(w, '^{C}*{V}+{C}+{V}+{C}', 0))
      WHEN regexp_matches(w, '^{C}*{V}+{C}{V}+{C}')
      THEN length(regexp_extract(w, '^{C}*{V}+{C}{V}+{C}', 0)) ELSE length(w) END AS r2,
    regexp_extract(w, '{_HOST}', 0) AS e
  FROM distinct_words),
stem1 AS (
  SELECT word, rv, r1, r2, CASE
    WHEN e <> '' AND length(w) - length(e) >= rv AND (NOT starts_with(e, 'yendo') OR regexp_matches(w, 'u{_HOST}'))
    THEN left(w, length(w) - length(e)) || translate(regexp_extract(e, '{_HOST}', 1), 'áéí', 'aei') ELSE w END AS w
  FROM stem0),
stem2 AS (SELECT *, {_ending('w', _STANDARD)} AS e FROM stem1),
stem3 AS (SELECT *, left(w, length(w) - length(e)) AS base FROM stem2),
stem4 AS (
  SELECT word, rv, w, CASE
    WHEN {_in('e', es.PLAIN_SUFFIXES)} AND length(base) >= r2 THEN base
    WHEN {_in('e', es.IC_SUFFIXES)} AND length(base) >= r2 THEN {_drop('base', ['ic'])}
    WHEN {_in('e', es.LOG_SUFFIXES)} AND length(base) >= r2 THEN base || 'log'
    WHEN {_in('e', es.U_SUFFIXES)} AND length(base) >= r2 THEN base || 'u'
    WHEN {_in('e', es.ENTE_SUFFIXES)} AND length(base) >= r2 THEN base || 'ente'
    WHEN e = 'amente' AND length(base) >= r1 THEN CASE
      WHEN ends_with(base, 'ativ') AND length(base) - 4 >= r2 THEN left(base, length(base) - 4)
      ELSE {_drop('base', ['iv', 'os', 'ic', 'ad'])} END
    WHEN e = 'mente' AND length(base) >= r2 THEN {_drop('base', ['ante', 'able', 'ible'])}
    WHEN {_in('e', es.IDAD_SUFFIXES)} AND length(base) >= r2 THEN {_drop('base', ['abil', 'ic', 'iv'])}
    WHEN {_in('e', es.IVA_SUFFIXES)} AND length(base) >= r2 THEN {_drop('base', ['at'])}
    END AS s1
  FROM stem3),
stem5 AS (
  SELECT *, {_ending('substr(w, rv + 1)', es.Y_VERB_SUFFIXES)} AS y,
    {_ending('substr(w, rv + 1)', es.GU_VERB_SUFFIXES + es.VERB_SUFFIXES)} AS ve
  FROM stem4),
stem6 AS (
  SELECT word, rv, CASE
    WHEN s1 IS NOT NULL THEN s1
    WHEN y <> '' AND ends_with(left(w, length(w) - length(y)), 'u') THEN left(w, length(w) - length(y))
    WHEN {_in('ve', es.GU_VERB_SUFFIXES)} AND ends_with(left(w, length(w) - length(ve)), 'gu')
      THEN left(w, length(w) - length(ve) - 1)
    WHEN ve <> '' THEN left(w, length(w) - length(ve))
    ELSE w END AS w
  FROM stem5),
stem7 AS (SELECT *, {_ending('w', es.RESIDUAL_PLAIN + es.RESIDUAL_GU)} AS e FROM stem6),
stems AS (
  SELECT word, translate(CASE
    WHEN e = '' OR length(w) - length(e) < rv THEN w
    WHEN {_in('e', es.RESIDUAL_GU)} AND ends_with(left(w, length(w) - length(e)), 'gu')
      AND length(w) - length(e) - 1 >= rv THEN left(w, length(w) - length(e) - 1)
    ELSE left(w, length(w) - length(e)) END, 'áéíóú', 'aeiou') AS term
  FROM stem7)"""

WORDS = rf"""doc_words AS (
  SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM (
    SELECT id, list_filter(regexp_split_to_array(lower(coalesce(product_name, '') || ' ' ||
      coalesce(product_description, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM catalog)),
query_words AS (
  SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+'),
    lambda x: x <> '')) AS w FROM queries),
stops AS (SELECT * FROM (VALUES {STOPS}) s(w)),
distinct_words AS (
  SELECT DISTINCT w FROM (SELECT w FROM doc_words UNION ALL SELECT w FROM query_words)
  WHERE w NOT IN (SELECT w FROM stops))"""

TERMS = """doc_terms AS (SELECT d.id, d.pos, s.term FROM doc_words d JOIN stems s ON d.w = s.word),
query_terms AS (SELECT DISTINCT q.query_id, s.term FROM query_words q JOIN stems s ON q.w = s.word),
term_counts AS (SELECT query_id, count(*) AS n_terms FROM query_terms GROUP BY 1),
hits AS (
  SELECT q.query_id, d.id, d.pos, d.term FROM doc_terms d JOIN query_terms q ON d.term = q.term),
matched AS (
  SELECT h.query_id, h.id, t.n_terms FROM hits h JOIN term_counts t USING (query_id)
  GROUP BY 1, 2, 3 HAVING count(DISTINCT h.term) = t.n_terms)"""

# Right ends of covers with the latest possible left end; a cover is minimal when
# the left end moved on since the hit before.
COVERS = """numbered AS (
  SELECT h.*, row_number() OVER (PARTITION BY query_id, id ORDER BY pos) AS n
  FROM hits h JOIN matched USING (query_id, id)),
last_of_term AS (
  SELECT e.query_id, e.id, e.pos, e.n, x.term, max(x.n) AS last_n
  FROM numbered e JOIN numbered x ON e.query_id = x.query_id AND e.id = x.id AND x.n <= e.n
  GROUP BY 1, 2, 3, 4, 5),
spans AS (
  SELECT l.query_id, l.id, l.pos, l.n, min(last_n) AS first_n
  FROM last_of_term l JOIN term_counts t USING (query_id)
  GROUP BY 1, 2, 3, 4, t.n_terms HAVING count(*) = t.n_terms),
opened AS (
  SELECT *, lag(first_n) OVER (PARTITION BY query_id, id ORDER BY n) AS before FROM spans),
lex_scores AS (
  SELECT o.query_id, o.id,
    sum(0.1 / (1 + (o.pos - f.pos) - (o.n - o.first_n))) AS lex_score
  FROM opened o JOIN numbered f ON f.query_id = o.query_id AND f.id = o.id AND f.n = o.first_n
  WHERE o.before IS NULL OR o.first_n > o.before
  GROUP BY 1, 2),
lexical AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lex_score, 10) DESC, id) AS rank
  FROM lex_scores) WHERE rank <= 60)"""

LEXICAL = [CATALOG, QUERIES, WORDS, STEMS, TERMS, COVERS]


def hashed(source: str, key: str, text: str) -> str:
    """CTEs ``cells``: non-zero (key, bucket, value) of the hashed unit vectors."""
    return f"""tokens AS (SELECT {key}, unnest(string_split({text}, ' ')) AS t FROM {source} WHERE {text} <> ''),
counted AS (
  SELECT {key}, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS c FROM tokens GROUP BY 1, 2),
lengths AS (SELECT {key}, sqrt(sum(c * c)) AS length FROM counted GROUP BY 1),
cells AS (
  SELECT {key}, bucket, CAST(round(CAST(CAST(c / length AS FLOAT) AS DOUBLE), 6) AS FLOAT) AS value
  FROM counted JOIN lengths USING ({key}))"""


VECTOR_LIST = (
    f"""asked AS (SELECT query_id, {strip('text')} AS text FROM queries)""",
    hashed("asked", "query_id", "text"),
    """query_vectors AS (
  SELECT query_id, list_transform(range(0, 64), lambda b: coalesce(m[b], 0.0)) AS q FROM (
    SELECT query_id, map(list(bucket), list(CAST(value AS DOUBLE))) AS m FROM cells GROUP BY 1)),
items AS (SELECT id, CAST(text_vector AS DOUBLE[]) AS v FROM catalog WHERE text_vector IS NOT NULL),
vec_scores AS (
  SELECT query_id, id, round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) + 1e-8)
    / (sqrt(list_dot_product(v, v)) + 1e-8), 10) AS score
  FROM query_vectors, items),
vector AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM vec_scores) WHERE rank <= 20)""",
)

FUSE = """joined AS (
  SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.id, v.id) AS id, l.rank AS lex_rank,
    v.rank AS vec_rank, l.lex_score, v.score
  FROM lexical l FULL OUTER JOIN vector v ON l.query_id = v.query_id AND l.id = v.id),
scored AS (
  SELECT *, coalesce(1.0 / (60 + lex_rank), 0) + coalesce(1.0 / (60 + vec_rank), 0) AS hybrid_score FROM joined),
fused AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score, 12) DESC,
    lex_rank NULLS LAST, vec_rank NULLS LAST, id) AS rank FROM scored) WHERE rank <= 20)"""

HYBRID = [*LEXICAL, *VECTOR_LIST, FUSE]
FUSED_COLUMNS = "query_id, id, lex_rank, vec_rank, round(hybrid_score, 6) AS hybrid_score, rank"

# --- sources and sinks ------------------------------------------------------------

ORACLE["csv_source"] = with_(CATALOG) + f"""SELECT id,
  CASE WHEN product_name NOT IN ({MARKERS}) THEN product_name END AS product_name,
  md5(CASE WHEN product_description NOT IN ({MARKERS}) THEN product_description END) AS description_md5,
  CASE WHEN s3_path NOT IN ({MARKERS}) THEN s3_path END AS s3_path FROM catalog"""
ORACLE["parquet_sink"] = with_(CATALOG, FILTERED) + "SELECT country_code, city_code, count(*) AS n_rows FROM filtered GROUP BY 1, 2"
ORACLE["parquet_source"] = "SELECT vec_id, CAST(label AS BIGINT) AS label, len(embedding) AS dimension FROM embeddings"
ORACLE["append_products"] = with_(CATALOG, FILTERED) + "SELECT 'load-' || country_code AS load_batch, count(*) AS n_rows FROM filtered GROUP BY 1"
ORACLE["sample_by_id"] = with_(CATALOG) + (
    "SELECT id, country_code, collection_section FROM catalog WHERE text_vector IS NOT NULL ORDER BY id LIMIT 250"
)
ORACLE["image_source"] = with_(CATALOG) + """SELECT CASE id % 3 WHEN 0 THEN 'documents' WHEN 1 THEN 'embeddings' ELSE 'pages' END
  || '.parquet' AS object, count(*) AS n_rows, true AS has_content
FROM catalog WHERE text_vector IS NULL AND s3_path IS NOT NULL AND s3_path <> '' GROUP BY 1"""
ORACLE["metrics_sink"] = """SELECT 'text_vector' AS embedding, 'overall' AS scope, 'samples' AS metric,
  CAST(count(*) AS DOUBLE) AS value FROM embeddings
UNION ALL SELECT 'text_vector', 'overall', 'unique_labels', CAST(count(DISTINCT label) AS DOUBLE) FROM embeddings"""
ORACLE["trace_sink"] = with_(*HYBRID) + """SELECT q.query_id, 'hybrid_text' AS intent,
  (SELECT count(*) FROM vector v WHERE v.query_id = q.query_id AND v.rank <= 5) AS n_vector,
  (SELECT count(*) FROM fused f WHERE f.query_id = q.query_id) AS n_final FROM queries q"""

# --- projections and filters --------------------------------------------------------

ORACLE["catalog_filter"] = with_(CATALOG, FILTERED) + "SELECT id, country_code, store_name, s3_path FROM filtered"
ORACLE["first_n"] = with_(CATALOG, FILTERED) + "SELECT id, country_code FROM filtered ORDER BY id LIMIT 100"
ORACLE["conform_schema"] = """SELECT lang AS country_code, CAST(NULL AS VARCHAR) AS city_code, source AS store_name,
  CAST(NULL AS VARCHAR) AS product_name, CAST(NULL AS VARCHAR) AS collection_section,
  CAST(NULL AS VARCHAR) AS product_description, CAST(NULL AS VARCHAR) AS s3_path, CAST(NULL AS VARCHAR) AS s3_url
FROM documents"""
ORACLE["derive_url"] = with_(CATALOG) + f"""SELECT id, ' ' || s3_path || ' ' AS s3_path,
  CASE WHEN trim(s3_path) <> '' THEN 's3://{BUCKET}/ ' || s3_path || ' ' END AS s3_url FROM catalog"""
ORACLE["clean_strings"] = with_(CATALOG) + f"""SELECT id, nullif(trim(s3_path), '') AS s3_path,
  CASE WHEN trim(s3_path) <> '' THEN 's3://{BUCKET}/' || s3_path END AS s3_url,
  md5(nullif({strip('product_description')}, '')) AS description_md5 FROM catalog"""
# Rule: the name, then every other part that is not empty behind its separator.
PARTS = [(" · ", "store_name"), (" · ", "collection_section"), (". ", "product_description")]
COMPOSED = "trim(concat(product_name, " + ", ".join(f"'{mark}' || nullif({part}, '')" for mark, part in PARTS) + "))"
ORACLE["compose_text"] = with_(CATALOG) + f"SELECT id, md5({COMPOSED}) AS text_md5, length({COMPOSED}) AS n_chars FROM catalog"
ORACLE["text_template"] = "SELECT p_partkey, 'a product photo of ' || p_name || '. ' || p_type AS prompt FROM part"
ORACLE["normalize_text"] = f"""SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars
FROM (SELECT doc_id, {normalized('text')} AS t FROM documents)"""
ORACLE["normalize_text_pages"] = f"""SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5
FROM (SELECT page_id, {normalized("url || ' ' || html")} AS t FROM pages)"""
ORACLE["pending_rows"] = with_(CATALOG) + "SELECT id, s3_path FROM catalog WHERE text_vector IS NULL AND s3_path IS NOT NULL AND s3_path <> ''"
ORACLE["reset_column"] = with_(CATALOG) + "SELECT country_code, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_vectors FROM catalog GROUP BY 1"
ORACLE["assign_ids"] = with_(CATALOG, FILTERED) + """SELECT id, country_code,
  (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY id) AS new_id FROM filtered"""
ORACLE["image_location"] = with_(CATALOG) + f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'other' ELSE '{BUCKET}' END AS bucket, s3_path AS key
FROM catalog WHERE s3_path IS NOT NULL"""
ORACLE["parse_vector"] = """SELECT vec_id, CASE WHEN vec_id % 5 <> 0 AND vec_id % 7 <> 0 THEN len(embedding) END AS dimension,
  CASE WHEN vec_id % 5 <> 0 AND vec_id % 7 <> 0 THEN round(list_sum(list_transform(embedding, lambda x:
    CAST(CAST(printf('%.6f', CAST(x AS DOUBLE)) AS FLOAT) AS DOUBLE))), 6) END AS total FROM embeddings"""
ORACLE["round_vector"] = """SELECT vec_id, unnest(range(0, len(embedding))) AS pos,
  round(CAST(CAST(round(CAST(unnest(embedding) AS DOUBLE), 6) AS FLOAT) AS DOUBLE), 6) AS x FROM embeddings"""
ORACLE["l2_normalize"] = with_(VECTORS) + """SELECT id AS vec_id, round(sqrt(list_dot_product(u, u)), 6) AS length,
  round(u[1], 6) AS first, round(u[len(u)], 6) AS last FROM units"""
ORACLE["normalize_label"] = with_(CATALOG) + rf"""SELECT id, lower(coalesce(collection_section, 'None')) AS section,
  array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(product_name),
    '[^\p{{L}}\p{{N}}_{WS}]+', '', 'g'), '[{WS}]+', ' ', 'g')), ' '), lambda t: t <> ''
    AND NOT regexp_matches(t, '^\p{{Nd}}+$') AND t NOT IN ('ml', 'g', 'kg', 'l', 'pack', 'pcs'))[1:3], ' ') AS name FROM catalog"""
ORACLE["pick_column"] = "SELECT 'text_vector' AS chosen, count(e.vec_id) AS n_values FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"
ORACLE["vector_checks"] = """SELECT count(*) AS pairs, CAST(64 AS BIGINT) AS text_dim, CAST(64 AS BIGINT) AS image_dim,
  CAST(NULL AS VARCHAR) AS warning, 'same' AS "case" FROM embeddings
UNION ALL SELECT 0, 64, 32, 'dimension_mismatch: text_dim=64 image_dim=32', 'different'"""

# --- joins ----------------------------------------------------------------------------

ORACLE["merge_embeddings"] = with_(CATALOG) + """SELECT c.id, round(CAST(coalesce(e.embedding[len(e.embedding)], c.text_vector[1]) AS DOUBLE), 6) AS first
FROM catalog c LEFT JOIN (SELECT * FROM embeddings WHERE label < 5) e ON c.id = e.vec_id"""
ORACLE["align_pairs"] = with_(CATALOG) + """SELECT id, round(CAST(text_vector[1] AS DOUBLE), 6) AS a1,
  round(CAST(text_vector[len(text_vector)] AS DOUBLE), 6) AS b1 FROM catalog WHERE text_vector IS NOT NULL AND id % 4 <> 0"""
ORACLE["filtered_candidates"] = with_(VECTORS) + """SELECT id, count(*) OVER (PARTITION BY country, city) - 1 AS candidates,
  count(*) OVER (PARTITION BY country, city, label) - 1 AS relevant FROM vectors"""
ORACLE["pairwise_similarity"] = with_(VECTORS, MIXED) + """SELECT x.id, count(*) AS n_pairs,
  round(avg(list_dot_product(x.ua, y.ub)), 6) AS mean_similarity, round(max(list_dot_product(x.ua, y.ub)), 6) AS max_similarity,
  round(min(list_dot_product(x.ua, y.ub)), 6) AS min_similarity FROM pairs x, pairs y GROUP BY 1"""
ORACLE["knn_join"] = with_(VECTORS, NEIGHBOURS) + """SELECT id, other AS neighbour_id, rank, round(s, 6) AS similarity
FROM near WHERE rank <= 10"""
ORACLE["knn_join_pruned"] = ORACLE["knn_join"]
ORACLE["ann_knn_all_cells"] = with_(VECTORS, NEIGHBOURS) + """SELECT id AS query_id, other AS id, rank, round(s, 6) AS score
FROM near WHERE rank <= 10"""

# --- search -----------------------------------------------------------------------------

ORACLE["analyze_text"] = with_(CATALOG, QUERIES, WORDS, STEMS, TERMS.split(",\nquery_terms")[0]) + """SELECT id, count(*) AS n_terms,
  count(DISTINCT term) AS n_distinct, CAST(sum(pos) AS BIGINT) AS positions,
  CAST(sum(pos * length(term)) AS BIGINT) AS checksum, min(term) AS first_term, max(term) AS last_term
FROM doc_terms GROUP BY 1"""
ORACLE["match_all_terms"] = with_(*LEXICAL[:5]) + "SELECT query_id, id, n_terms FROM matched"
ORACLE["cover_density_rank"] = with_(*LEXICAL) + "SELECT query_id, id, round(lex_score, 6) AS lex_score FROM lex_scores"
ORACLE["lexical_search"] = with_(*LEXICAL) + "SELECT query_id, id, round(lex_score, 6) AS lex_score, rank FROM lexical"
ORACLE["lexical_search_postings"] = ORACLE["lexical_search"]
BM25 = """sizes AS (SELECT id, count(*) AS doc_terms FROM doc_terms GROUP BY 1),
corpus AS (
  SELECT (SELECT count(*) FROM catalog) AS n_docs,
    CAST((SELECT count(*) FROM doc_terms) AS DOUBLE) / (SELECT count(*) FROM catalog) AS avg_terms),
tf AS (SELECT id, term, count(*) AS tf FROM doc_terms GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm25_scores AS (
  SELECT q.query_id, tf.id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * doc_terms / avg_terms))) AS bm25
  FROM query_terms q JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (id), corpus GROUP BY 1, 2)"""
ORACLE["bm25_search"] = with_(*LEXICAL[:4], TERMS, BM25) + """SELECT query_id, id, round(bm25, 6) AS bm25, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 10) DESC, id) AS rank FROM bm25_scores)
WHERE rank <= 60"""
ORACLE["vector_search"] = with_(CATALOG, QUERIES, *VECTOR_LIST) + "SELECT query_id, id, round(score, 6) AS score, rank FROM vector"
ORACLE["search_by_vector_column"] = with_(VECTORS, MIXED) + """SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT x.id AS query_id, y.id, round(list_dot_product(x.ua, y.ub), 10) AS score FROM pairs x, pairs y))
WHERE rank <= 5"""
ORACLE["hybrid_search"] = with_(*HYBRID) + """SELECT f.query_id, f.id, lex_rank, vec_rank, round(hybrid_score, 6) AS hybrid_score,
  rank, c.product_name AS name, c.s3_path AS image_path FROM fused f JOIN catalog c ON c.id = f.id"""
ORACLE["rrf_fusion"] = with_(*HYBRID) + f"SELECT {FUSED_COLUMNS} FROM fused"
BLEND = """scaled_lex AS (
  SELECT query_id, id, rank, CASE WHEN max(lex_score) OVER w > min(lex_score) OVER w
    THEN (lex_score - min(lex_score) OVER w) / (max(lex_score) OVER w - min(lex_score) OVER w) ELSE 1.0 END AS s
  FROM lexical WINDOW w AS (PARTITION BY query_id)),
scaled_vec AS (
  SELECT query_id, id, rank, CASE WHEN max(score) OVER w > min(score) OVER w
    THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s
  FROM vector WINDOW w AS (PARTITION BY query_id)),
blended AS (
  SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.id, v.id) AS id, l.rank AS lex_rank,
    v.rank AS vec_rank, 0.5 * coalesce(l.s, 0) + 0.5 * coalesce(v.s, 0) AS hybrid_score
  FROM scaled_lex l FULL OUTER JOIN scaled_vec v ON l.query_id = v.query_id AND l.id = v.id)"""
ORACLE["blend_fusion"] = with_(*LEXICAL, *VECTOR_LIST, BLEND) + f"""SELECT {FUSED_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score, 12) DESC, lex_rank NULLS LAST,
    vec_rank NULLS LAST, id) AS rank FROM blended) WHERE rank <= 20"""
ORACLE["fuse_join"] = with_(*HYBRID) + """SELECT query_id, id, lex_rank, vec_rank, round(lex_score, 6) AS lex_score,
  round(score, 6) AS score FROM joined"""
ORACLE["answer_summary"] = with_(*HYBRID) + """SELECT q.query_id, 'Resultados top: ' || coalesce((
  SELECT string_agg(c.product_name, ', ' ORDER BY f.rank) FROM fused f JOIN catalog c ON c.id = f.id
  WHERE f.query_id = q.query_id AND f.rank <= 5), 'sin resultados') AS answer FROM queries q"""


def _ids(table: str, limit: str = "") -> str:
    return f"(SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FROM {table} t WHERE t.query_id = q.query_id{limit})"


ORACLE["trace_top5"] = with_(*HYBRID) + f"""SELECT q.query_id, 'hybrid_text' AS intent, CAST(20 AS BIGINT) AS k,
  {_ids('vector', ' AND rank <= 5')} AS vector_top, {_ids('lexical', ' AND rank <= 5')} AS lexical_top,
  {_ids('fused')} AS final FROM queries q"""

# --- backfill ---------------------------------------------------------------------------

ORACLE["pending_count"] = with_(CATALOG) + """SELECT count(*) FILTER (text_vector IS NULL) AS pending_text_vector,
  count(*) AS pending_image_vector FROM catalog"""
BACKFILL = (
    CATALOG,
    f"texts AS (SELECT id, {normalized(COMPOSED)} AS text FROM catalog WHERE text_vector IS NULL)",
    hashed("texts", "id", "text"),
)
ORACLE["embed_backfill"] = with_(*BACKFILL) + """SELECT id, bucket, round(CAST(value AS DOUBLE), 6) AS value FROM cells
UNION ALL SELECT * FROM (
  SELECT id, unnest(range(0, 64)) AS bucket, round(CAST(unnest(text_vector) AS DOUBLE), 6) AS value
  FROM catalog WHERE text_vector IS NOT NULL) WHERE value <> 0"""
ORACLE["encode_pending"] = with_(*BACKFILL) + """SELECT c.id, round(CASE WHEN c.text_vector IS NOT NULL
    THEN sqrt(list_dot_product(CAST(c.text_vector AS DOUBLE[]), CAST(c.text_vector AS DOUBLE[])))
    ELSE coalesce(x.length, 0) END, 6) AS length, CAST(64 AS BIGINT) AS dimension
FROM catalog c LEFT JOIN (
  SELECT id, sqrt(sum(CAST(value AS DOUBLE) * CAST(value AS DOUBLE))) AS length FROM cells GROUP BY 1) x ON x.id = c.id"""

# --- metrics ------------------------------------------------------------------------------

ORACLE["hybrid_recall"] = with_(VECTORS, SIMS, """pools AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rank
  FROM sims WHERE country = other_country AND city = other_city),
per_query AS (
  SELECT id, count(*) AS pool, count(*) FILTER (same) AS relevant, count(*) FILTER (same AND rank <= 1) AS h1,
    count(*) FILTER (same AND rank <= 5) AS h5, count(*) FILTER (same AND rank <= 10) AS h10
  FROM pools GROUP BY 1 HAVING count(*) FILTER (same) > 0)""") + """SELECT round(sum(h1) / sum(relevant), 6) AS recall_1,
  round(sum(h5) / sum(relevant), 6) AS recall_5, round(sum(h10) / sum(relevant), 6) AS recall_10,
  count(*) AS queries_evaluated, round(avg(pool), 6) AS avg_pool_size FROM per_query"""


def separation(label: str) -> str:
    return f"""SELECT round(i.intra, 6) AS intra_mean, round(x.inter, 6) AS inter_mean,
  round(i.intra - x.inter, 6) AS separation, '{label}' AS scope FROM (
  SELECT sum(m * w) / sum(w) AS intra FROM (
    SELECT {label}, avg(exact) AS m, least(300, count(*) / 2) AS w FROM sims WHERE {label} = other_{label} GROUP BY 1)) i, (
  SELECT avg(m) AS inter FROM (
    SELECT {label}, other_{label}, avg(exact) AS m FROM sims WHERE {label} <> other_{label} GROUP BY 1, 2)) x"""


ORACLE["filter_separation"] = with_(VECTORS, SIMS) + separation("label") + "\nUNION ALL " + separation("city")
ORACLE["knn1_accuracy"] = with_(VECTORS, NEIGHBOURS) + "SELECT round(avg(CAST(same AS INT)), 6) AS knn_1_acc FROM near WHERE rank = 1"
SHARES = """avg(CAST(same AS INT)) FILTER (rank <= 1) AS label_consistency_1,
  avg(CAST(same AS INT)) FILTER (rank <= 5) AS label_consistency_5, avg(CAST(same AS INT)) FILTER (rank <= 10) AS label_consistency_10"""
ORACLE["label_consistency"] = with_(VECTORS, NEIGHBOURS, f"""shares AS (SELECT id, {SHARES} FROM near GROUP BY 1)""") + """SELECT
  round(avg(label_consistency_1), 6) AS label_consistency_1, round(avg(label_consistency_5), 6) AS label_consistency_5,
  round(avg(label_consistency_10), 6) AS label_consistency_10 FROM shares"""


def silhouettes(label: str, group: str) -> str:
    """CTE ``shape``: silhouette value of every row inside its group."""
    return f"""distances AS (
  SELECT id, {group} AS grp, {label} AS l, other_{label} AS m, avg(1 - exact) AS d FROM grouped_sims GROUP BY 1, 2, 3, 4),
members AS (SELECT {group} AS grp, {label} AS l, count(*) AS n FROM grouped GROUP BY 1, 2),
ab AS (
  SELECT g.id, g.{group} AS grp, m.n, max(d.d) FILTER (d.l = d.m) AS a, min(d.d) FILTER (d.l <> d.m) AS b
  FROM grouped g JOIN members m ON m.grp = g.{group} AND m.l = g.{label} LEFT JOIN distances d ON d.id = g.id GROUP BY 1, 2, 3),
shape AS (SELECT id, grp, CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


ORACLE["silhouette"] = with_(
    VECTORS, SIMS, "grouped AS (SELECT *, 'all' AS whole FROM vectors)", "grouped_sims AS (SELECT *, 'all' AS whole FROM sims)",
    silhouettes("label", "whole"),
) + """SELECT round(avg(s), 6) AS silhouette, count(*) AS rows,
  (SELECT count(DISTINCT label) FROM vectors) AS labels FROM shape"""


def agreement(source: str, label: str, cluster: str, group: str) -> str:
    """CTE ``agreement``: (grp, ari, nmi)."""
    return f"""cells AS (SELECT {group} AS grp, {label} AS l, {cluster} AS c, count(*) AS n FROM {source} GROUP BY 1, 2, 3),
ls AS (SELECT grp, l, sum(n) AS n FROM cells GROUP BY 1, 2),
cs AS (SELECT grp, c, sum(n) AS n FROM cells GROUP BY 1, 2),
tot AS (SELECT grp, CAST(sum(n) AS DOUBLE) AS t FROM cells GROUP BY 1),
pair_counts AS (
  SELECT t.grp, t.t, (SELECT sum(n * (n - 1) / 2.0) FROM cells x WHERE x.grp = t.grp) AS ij,
    (SELECT sum(n * (n - 1) / 2.0) FROM ls x WHERE x.grp = t.grp) AS i,
    (SELECT sum(n * (n - 1) / 2.0) FROM cs x WHERE x.grp = t.grp) AS j,
    (SELECT sum(x.n / t2.t * ln(x.n * t2.t / (a.n * b.n))) FROM cells x JOIN ls a ON a.grp = x.grp AND a.l = x.l
      JOIN cs b ON b.grp = x.grp AND b.c = x.c JOIN tot t2 ON t2.grp = x.grp WHERE x.grp = t.grp) AS mi,
    (SELECT -sum(x.n / t2.t * ln(x.n / t2.t)) FROM ls x JOIN tot t2 ON t2.grp = x.grp WHERE x.grp = t.grp) AS hl,
    (SELECT -sum(x.n / t2.t * ln(x.n / t2.t)) FROM cs x JOIN tot t2 ON t2.grp = x.grp WHERE x.grp = t.grp) AS hc
  FROM tot t),
agreement AS (
  SELECT grp, (ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)) AS ari, mi / ((hl + hc) / 2) AS nmi
  FROM pair_counts)"""


CLUSTERED = "clustered AS (SELECT *, id % 10 AS cluster, 'all' AS whole FROM vectors)"
ORACLE["ari"] = with_(VECTORS, CLUSTERED, agreement("clustered", "label", "cluster", "whole")) + "SELECT round(ari, 6) AS ari FROM agreement"
ORACLE["agreement_by_grain"] = with_(
    VECTORS, CLUSTERED, """grains AS (
  SELECT CASE WHEN grouping(country) = 1 THEN 'overall' ELSE 'group' END AS grain, country, label, cluster, count(*) AS n
  FROM clustered GROUP BY GROUPING SETS ((country, label, cluster), (label, cluster)))""",
    """rows_of AS (SELECT grain || coalesce(country, '') AS whole, label, cluster, unnest(range(0, n)) AS i FROM grains)""",
    agreement("rows_of", "label", "cluster", "whole"),
) + """SELECT g.grain, g.country AS "group", round(any_value(a.ari), 6) AS ari, round(any_value(a.nmi), 6) AS nmi,
  CAST(sum(n) AS BIGINT) AS samples, count(DISTINCT label) AS unique_labels
FROM grains g JOIN agreement a ON a.grp = g.grain || coalesce(g.country, '') GROUP BY ALL"""
ORACLE["nmi"] = with_(VECTORS, CLUSTERED, agreement("clustered", "label", "cluster", "whole")) + "SELECT round(nmi, 6) AS nmi FROM agreement"

DISTANCES = """shifted AS (
  SELECT *, coalesce(lag(b) OVER (ORDER BY id), last_value(b) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS n,
    coalesce(lag(ub) OVER (ORDER BY id), last_value(ub) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS un
  FROM pairs),
distances AS (
  SELECT id, list_dot_product(ua, ub) AS cos_pos, list_distance(a, b) AS euc_pos,
    list_dot_product(ua, un) AS cos_neg, list_distance(a, n) AS euc_neg FROM shifted)"""
ORACLE["pair_separation"] = with_(VECTORS, MIXED, DISTANCES) + """SELECT count(*) AS count, round(avg(cos_pos), 6) AS pos_cos_mean,
  round(avg(cos_neg), 6) AS neg_cos_mean, round(avg(cos_pos) - avg(cos_neg), 6) AS cos_separation,
  round(avg(euc_pos), 6) AS pos_euc_mean, round(avg(euc_neg), 6) AS neg_euc_mean,
  round(avg(euc_neg) - avg(euc_pos), 6) AS euc_separation,
  (SELECT round(avg(list_dot_product(x.ua, y.ub)), 6) FROM pairs x, pairs y WHERE x.id <> y.id) AS neg_cos_expected FROM distances"""
STATS = """count(*) AS count, round(avg(cos_pos), 6) AS cos_pos_mean, round(median(cos_pos), 6) AS cos_pos_median,
  round(quantile_cont(cos_pos, 0.95), 6) AS cos_pos_p95, round(avg(euc_pos), 6) AS euc_pos_mean,
  round(median(euc_pos), 6) AS euc_pos_median, round(quantile_cont(euc_pos, 0.05), 6) AS euc_pos_p05,
  round(avg(cos_neg), 6) AS cos_neg_mean, round(quantile_cont(cos_neg, 0.95), 6) AS cos_neg_p95,
  round(avg(euc_neg), 6) AS euc_neg_mean, round(quantile_cont(euc_neg, 0.05), 6) AS euc_neg_p05"""
ORACLE["pair_stats"] = with_(VECTORS, MIXED, DISTANCES) + f"SELECT {STATS} FROM distances"
POSITIONS = """cross_sims AS (
  SELECT x.id AS i, y.id AS j, x.label, round(list_dot_product(x.ua, y.ub), 10) AS s FROM pairs x, pairs y),
positions AS (
  SELECT 'text_to_image' AS direction, i AS id, label, p FROM (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS p FROM cross_sims) WHERE i = j
  UNION ALL SELECT 'image_to_text', j, label, p FROM (
    SELECT *, row_number() OVER (PARTITION BY j ORDER BY s DESC, i) AS p FROM cross_sims) WHERE i = j)"""


def recalls(*ks: int) -> str:
    return ", ".join(f"round(avg(CAST(p <= {k} AS INT)), 6) AS recall_{k}" for k in ks)


def ndcgs(*ks: int) -> str:
    return ", ".join(f"round(avg(CASE WHEN p <= {k} THEN 1 / log2(1 + p) ELSE 0 END), 6) AS ndcg_{k}" for k in ks)


ORACLE["retrieval_metrics"] = with_(VECTORS, MIXED, POSITIONS) + f"""SELECT direction, count(*) AS pairs, {recalls(1, 5, 10)},
  round(avg(1.0 / p), 6) AS mrr FROM positions GROUP BY 1"""
ORACLE["ndcg"] = with_(VECTORS, MIXED, POSITIONS) + f"SELECT direction, {ndcgs(1, 5, 10)} FROM positions GROUP BY 1"
ORACLE["text_pair_retrieval"] = with_(VECTORS, MIXED, DISTANCES, POSITIONS) + f"""SELECT * FROM
  (SELECT {STATS} FROM distances) a, (SELECT {recalls(1, 5, 10)}, {ndcgs(1, 5, 10)}, round(avg(1.0 / p), 6) AS mrr
  FROM positions WHERE direction = 'text_to_image') b"""
ORACLE["by_group"] = with_(
    VECTORS, SIMS, CLUSTERED, "grouped AS (SELECT * FROM vectors)",
    "grouped_sims AS (SELECT * FROM sims WHERE country = other_country)", silhouettes("city", "country"),
    agreement("clustered", "city", "cluster", "country"), f"""ranked AS (
  SELECT id, country, city = other_city AS same, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rank FROM grouped_sims),
shares AS (SELECT country, id, {SHARES} FROM ranked GROUP BY 1, 2),
near AS (
  SELECT country, avg(label_consistency_1) AS c1, avg(label_consistency_5) AS c5, avg(label_consistency_10) AS c10 FROM shares GROUP BY 1),
sizes AS (SELECT country, count(*) AS samples, count(DISTINCT city) AS unique_labels FROM vectors GROUP BY 1)""",
) + """SELECT z.country AS "group", round(n.c1, 6) AS knn_1_acc,
  CASE WHEN unique_labels <= samples - 1 THEN round((SELECT avg(s) FROM shape WHERE grp = z.country), 6) END AS silhouette,
  round(g.ari, 6) AS ari, round(g.nmi, 6) AS nmi, round(n.c1, 6) AS label_consistency_1, round(n.c5, 6) AS label_consistency_5,
  round(n.c10, 6) AS label_consistency_10, samples, unique_labels
FROM sizes z LEFT JOIN near n ON n.country = z.country LEFT JOIN agreement g ON g.grp = z.country
WHERE samples >= 3 AND unique_labels >= 2"""
ORACLE["label_cardinality"] = "SELECT count(*) AS samples, count(DISTINCT label) AS unique_labels FROM embeddings"
ORACLE["recall_by_section"] = with_(VECTORS, MIXED, POSITIONS) + f"""SELECT label AS section, count(*) AS pairs, {recalls(1, 5, 10, 50)}
FROM positions WHERE direction = 'text_to_image' GROUP BY 1"""
ORACLE["precision_map"] = with_(VECTORS, NEIGHBOURS, """running AS (
  SELECT id, same, rank, sum(CAST(same AS INT)) OVER (PARTITION BY id ORDER BY rank) AS h FROM near WHERE rank <= 10),
per_query AS (
  SELECT r.id, sum(CAST(same AS INT)) / 10 AS p, sum(CASE WHEN same THEN h / rank ELSE 0 END) AS ap FROM running r GROUP BY 1),
relevant AS (SELECT id, count(*) FILTER (same) AS n FROM sims GROUP BY 1)""") + """SELECT round(avg(p), 6) AS precision_at_k,
  round(avg(ap / least(n, 10)), 6) AS map_at_k, count(*) AS n_queries FROM per_query JOIN relevant USING (id) WHERE n > 0"""
ORACLE["count_by_section_in_city"] = with_(CATALOG) + """SELECT coalesce(collection_section, 'None') AS collection_section,
  count(*) AS n_products FROM catalog WHERE city_code = 'src3' GROUP BY 1"""
ORACLE["balanced_sample"] = with_(VECTORS) + """SELECT id, label FROM (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR)), id) AS rn FROM vectors) WHERE rn <= 20"""
ORACLE["near_duplicates"] = f"""SELECT md5(t) AS text_key, count(*) AS copies, min(doc_id) AS kept_id
FROM (SELECT doc_id, {normalized('text')} AS t FROM documents) GROUP BY 1 HAVING count(*) > 1"""
ORACLE["similar_groups"] = f"""WITH RECURSIVE worded AS (
  SELECT doc_id AS id, list_filter(string_split({normalized('text')}, ' '), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM worded),
nodes AS (SELECT s, min(id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
owned AS (SELECT node, n, unnest(s) AS x FROM nodes),
links AS (
  SELECT a.node AS a, b.node AS b FROM owned a JOIN owned b ON a.x = b.x AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reached AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a AS node, min(b) AS least FROM reached GROUP BY a)
SELECT d.id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.least, d.id) AS group_id
FROM sets d LEFT JOIN nodes o ON d.s = o.s LEFT JOIN least c ON c.node = o.node"""
ORACLE["stream_ingest"] = f"""SELECT lang AS country_code, source AS city_code, count(*) AS n_rows,
  CAST(sum(length({strip('text')})) AS BIGINT) AS n_chars, max('s3://{BUCKET}/dataset/' || doc_id) AS last_url
FROM documents WHERE lang IN ({MARKET_LIST}) AND NOT starts_with(source, '{AUTO_STORE_PREFIX}') AND {strip('text')} <> ''
GROUP BY 1, 2"""

ORACLE["encode_image_files"] = """WITH pixels AS (
  SELECT vec_id AS id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings
  JOIN documents ON doc_id = vec_id WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0),
levels AS (SELECT id, 7 - i // 8 AS r, i % 8 AS c,
  greatest(0, least(255, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INT))) AS p FROM pixels),
cells AS (SELECT id, (r // 2) * 4 + c // 2 AS cell, sum(255 - p) AS red, sum(p) AS other FROM levels GROUP BY 1, 2),
colours AS (
  SELECT id, cell * 3 AS place, (2 * red + 4) // 8 AS v FROM cells
  UNION ALL SELECT id, cell * 3 + k, (2 * other + 4) // 8 FROM cells, (VALUES (1), (2)) t(k)),
units AS (SELECT id, place, v / 255.0 / sqrt(sum((v / 255.0) * (v / 255.0)) OVER (PARTITION BY id)) AS u FROM colours)
SELECT id, CAST(place AS BIGINT) AS place,
  round(CAST(CAST(round(CAST(CAST(u AS FLOAT) AS DOUBLE), 6) AS FLOAT) AS DOUBLE), 6) AS value FROM units"""

ORACLE["stream_load"] = f"""SELECT row_number() OVER (ORDER BY doc_id) AS id, 's3://{BUCKET}/dataset/' || doc_id AS s3_url,
  CAST(64 AS BIGINT) AS dimension, 'stream-0000000000' AS load_batch
FROM documents WHERE lang IN ({MARKET_LIST}) AND NOT starts_with(source, '{AUTO_STORE_PREFIX}') AND {strip('text')} <> ''"""

# --- forms that must agree with others -------------------------------------------

ORACLE["bm25_impacts"] = ORACLE["bm25_search"]
ORACLE["merge_embeddings_stored"] = ORACLE["merge_embeddings"]
ORACLE["ann_knn_stored"] = ORACLE["ann_knn_all_cells"]
ORACLE["hybrid_search_indexed"] = ORACLE["rrf_fusion"]
ORACLE["ann_recall"] = f"SELECT count(*) AS n, true AS enough FROM ({ORACLE['ann_knn_all_cells']})"
ORACLE["encode_images"] = """
SELECT doc_id AS id, CAST(64 AS BIGINT) AS dimension FROM documents
WHERE doc_id % 7 <> 0 AND doc_id % 3 <> 2
"""
