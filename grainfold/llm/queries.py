"""One query per operator, over its whole table, in the columns that its users asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainfold.llm import (
    decontaminate, html_text, langid, lexical_search, licenses, minhash, packing, quality, suffix_dedup, token_files, toxicity, urls, vector_codes)
from grainfold.llm.frames import held_out
from grainfold.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op2_decontaminate", f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, list_aggregate(w[p : p + least(len(w), 13) - 1], 'string_agg', ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, list_aggregate(w[p : p + k - 1], 'string_agg', ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes)),
hit AS (SELECT doc_id, p, dw.k AS k, item_id FROM dw JOIN iw USING (k, g)),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op2_decontaminate(read):
    found = decontaminate.scan(read("documents"), read("benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


_BLANKLESS = "'[^\\x20\\x09-\\x0D]+'"


@query("op3_quality_rules", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_BLANKLESS}) AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, p, list_aggregate(w[p : p + 7], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM again) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]'))) AS bare
      FROM d LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * n_dup_lines > n_lines OR 10 * bare > 4 * n_words) AS kept
FROM b
""")
def op3_quality_rules(read):
    return quality.judge(read("documents")).drop("rejected_by")


_URL_RULES = (
    urls.HostRule("block", "net", "/"), urls.HostRule("allow", "example.net", "/en/"),
    urls.HostRule("block", "example.com", "/de/"), urls.HostRule("allow", "org", "/fr/"),
)
_HOST = "CASE WHEN contains(url, '://') THEN translate(regexp_extract(url[strpos(url, '://') + 3 :], '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN contains(url, '://') THEN regexp_extract(url[strpos(url, '://') + 3 :], '^[^/?#]*([^?#]*)', 1) ELSE '' END"
#: words that hosts of spam farms carry in the table; the list is made of the URLs that lie on such hosts
_SPAM_HOST = "(^|[.])(spam|cheap)-"


@query("op6_url_filter", f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN concat(regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', ''), '/', regexp_replace(path, '^/+|/+$', '', 'g')) END AS key FROM p),
l AS (SELECT DISTINCT key FROM k WHERE regexp_matches(host, '{_SPAM_HOST}')),
r AS (SELECT page_id, host, path, key,
      CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
           WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
           WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
           WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM k)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
            ELSE CASE WHEN key IN (SELECT key FROM l WHERE key IS NOT NULL) THEN 'block' ELSE 'allow' END END AS verdict
FROM r
""")
def op6_url_filter(read):
    pages = read("pages").select("page_id", "url")
    listed = pages.where(urls.host_of(F.col("url")).rlike(_SPAM_HOST))
    return urls.judge(pages, listed, _URL_RULES).drop("listed")


def _licence_sql() -> str:
    """Runs of lines and clauses between the ends of sentences, compared with the known sentences one by one.

    The tables hold one-sentence notices only, so that the SQL needs no rule of several sentences; a run has at most 20 pieces.
    """
    singles = {licenses.SENTENCES[r.sequence[0] - 1]: r.licence for r in licenses.RULES if len(r.sequence) == 1}
    rows = ", ".join(f"('{s}', '{singles.get(s, '')}')" for s in licenses.SENTENCES)
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) AS t(s, licence)),
lines AS (SELECT doc_id, n, i, trim(regexp_replace(l, '[^a-z0-9]+', ' ', 'g')) = '' AS blank, regexp_replace(regexp_replace(concat(l, ' '), '[.!?]+\\s', chr(10), 'g'), '[:;]+\\s', chr(9), 'g') AS l
  FROM (SELECT doc_id, n, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
    SELECT doc_id, row_number() OVER () AS n, string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(13), 'abcdefghijklmnopqrstuvwxyz  '), chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
joined AS (SELECT doc_id, n, string_agg(CASE WHEN blank AND NOT contains(l, chr(10)) THEN chr(10) ELSE l END, chr(9) ORDER BY i) AS x FROM lines GROUP BY doc_id, n),
hard AS (SELECT doc_id, n, generate_subscripts(hs, 1) AS h, list_filter(list_transform(string_split(unnest(hs), chr(9)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS soft
  FROM (SELECT doc_id, n, string_split(x, chr(10)) AS hs FROM joined)),
starts AS (SELECT doc_id, n, h, soft, unnest(range(1, len(soft) + 1)) AS a FROM hard),
runs AS (SELECT doc_id, n, h, a, k, list_aggregate(soft[a : a + k - 1], 'string_agg', ' ') AS s FROM (SELECT *, unnest(range(1, least(20, len(soft) - a + 1) + 1)) AS k FROM starts)),
m AS (SELECT n, count(*) AS n_known, count(*) FILTER (licence <> '') AS n_matches, string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (licence <> '') AS licences
  FROM (SELECT n, h, a, arg_max(licence, k) AS licence FROM runs JOIN t USING (s) GROUP BY n, h, a) GROUP BY n)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n_known, 0) AS n_known, coalesce(n_matches, 0) AS n_matches
FROM (SELECT doc_id, n FROM joined UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL) LEFT JOIN m USING (n)
"""


@query("op5_license_scan", _licence_sql())
def op5_license_scan(read):
    found = licenses.scan(read("documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_known", F.size("matches").cast("long").alias("n_matches"))


@query("op7_language_id")
def op7_language_id(read):
    docs = read("documents")
    model = langid.fit(docs, ~held_out("doc_id"))
    return langid.predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op1_toxicity")
def op1_toxicity(read):
    docs = read("documents")
    model = toxicity.fit(docs, read("labels"), ~held_out("doc_id"))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_best_fit_packing")
def op4_best_fit_packing(read):
    return packing.pack(read("documents"), tokenizer_path())


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(read):
    return minhash.near_duplicates(read("documents"))


@query("op8_suffix_array_dedup")
def op8_suffix_array_dedup(read):
    return suffix_dedup.measure(read("documents"))


@query("op10_html_extraction")
def op10_html_extraction(read):
    return html_text.extract(read("pages"))


@query("op11_token_files")
def op11_token_files(read):
    return token_files.read(token_files.write(read("documents"), tokenizer_path()))


def _vector_code_sql(rounds: int = 6) -> str:
    """The rounds written out one after another."""
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT vec_id, p, part, min([dist, e]) AS best FROM (SELECT vec_id, p, part, e,
      list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM parts JOIN c{k} USING (p)) GROUP BY ALL)"""

    def replaced(k: int) -> str:
        return f"""c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.entry, c.entry) AS entry FROM c{k} c LEFT JOIN (
      SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS entry FROM (
        SELECT p, best[2] AS e, i, sum(part[i])::BIGINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL) n USING (p, e))"""

    steps = ",\n".join(f"{assigned(k)},\n{replaced(k)}" for k in range(rounds))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS part FROM (SELECT *, unnest(range(8)) AS p FROM kept)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry FROM parts
                    WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),
{steps},
{assigned(rounds)},
coded AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(entry) AS x, generate_subscripts(entry, 1) AS i FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM book) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


@query("op12_vector_codes", _vector_code_sql())
def op12_vector_codes(read):
    coded, books = vector_codes.compress(read("embeddings"))
    code = F.lower(F.hex("code"))  # a byte for each part
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


@query("op13_lexical_search", """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
norm AS (SELECT doc_id, 100 - 25 + (25 * len(w) * n_docs) // n_terms AS m FROM d, total WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS uses FROM (SELECT item_id, unnest(w) AS term FROM i) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY term, n_docs),
scores AS (SELECT item_id, doc_id, sum(uses * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM q JOIN tf USING (term) JOIN df USING (term) JOIN norm USING (doc_id) GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 20
""")
def op13_lexical_search(read):
    return lexical_search.search(read("documents"), read("benchmark"))
