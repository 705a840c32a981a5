"""One query for each corpus operator, with production parameters over whole tables, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .divergence import LEAST_DOCUMENTS, SCALE, TOP, divergence
from .exact_dedup import exact_dedup
from .jaccard import jaccard_classes
from .license_texts import TEMPLATES
from .licenses import DICE, PHRASE, license_scan, phrases, template_bigrams
from .mixing import BELOW, BOUND_ROUNDS, KEEP, KEEPS, LANG, NEAR, ROUNDS, SOURCE, TOPIC, TOPICS, mix
from .packing import best_fit_packing
from .ppm import lm_scores
from .quality import quality_rules
from .rlz import substring_dedup
from .simhash import simhash_classes
from .suffix import suffix_dedup
from .trie import prefix_trie
from .urls import URL, derived_captures, derived_entries, listed

#: How many of a conversation's first turns another gives, and which.
HEAD, BASE = "crc32(cast(conv_id as string)) % 9", "conv_id - conv_id % 5"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op2_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` has neither fetch times nor lists: both are derived from it by rule."""
    pages = table(spark, sf_dir, "pages")
    return listed(derived_captures(pages), derived_entries(pages)).withColumnRenamed("id", "page_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mix(table(spark, sf_dir, "documents")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations begin with up to eight turns of the one that starts their group of five."""
    return prefix_trie(table(spark, sf_dir, "conversations"), HEAD, BASE)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


def rounded(mixed: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_best_fit_packing, op2_rlz_dedup, op3_suffix_dedup, op4_exact_dedup, op5_ppm,
        op6_quality_rules, op7_url_filter, op8_license_scan, op9_mixing, op10_jaccard_join,
        op11_source_divergence, op12_prefix_trie, op13_simhash,
    )
    return {f.__name__: f for f in listed}


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def mixing_sql(documents: str = "documents", keep: float = KEEP, rounds: int = ROUNDS) -> str:
    r"""op9's rows: the steps of raking and of calibration, unrolled."""
    word = r"[^\x20\x09-\x0D]+"
    flatten = {"source": SOURCE, "lang": LANG, "topic": TOPIC}
    steps = [
        f"""rows_ AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
            ('0x' || substr(md5(lower(regexp_extract(coalesce(text, ''), '({word})', 1))), 1, 4))::BIGINT % {TOPICS} AS topic,
            len(regexp_extract_all(coalesce(text, ''), '{word}'))::BIGINT AS tokens FROM {documents})""",
        "cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows_ GROUP BY ALL)",
        "t AS (SELECT *, " + ", ".join(f"sum(tokens) OVER (PARTITION BY {d}) AS t_{d}" for d in flatten) + " FROM cells)",
        "norms AS (SELECT sum(tokens) AS total, " + ", ".join(f"sum(pow(t_{d}, {p}) * tokens / t_{d}) FILTER (t_{d} > 0) AS norm_{d}" for d, p in flatten.items()) + " FROM t)",
        "w0 AS (SELECT t.*, " + ", ".join(f"CASE WHEN t_{d} > 0 THEN pow(t_{d}, {p}) / norm_{d} * total END AS goal_{d}" for d, p in flatten.items()) + ", 1.0::DOUBLE AS w FROM t, norms)",
    ]
    n = 0
    for _ in range(rounds):
        for d in flatten:
            got = f"sum(tokens * w) OVER (PARTITION BY {d})"
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {got} > 0 THEN w * goal_{d} / {got} ELSE w END AS w) FROM w{n})")
            n += 1
    least = ", ".join(f"t_{d} / goal_{d}" for d in flatten)
    steps += [
        f"ends AS (SELECT least({keep}, {BELOW} * min(least({least})) FILTER (tokens > 0)) AS hi, max(w) FILTER (tokens > 0) AS top FROM w{n})",
        "edges AS (SELECT hi, least(hi, 1 / top) AS lo FROM ends)",
        f"keeps AS (SELECT k, CASE WHEN k = {KEEPS - 1} THEN hi ELSE lo * pow(hi / lo, k / {float(KEEPS - 1)}) END AS keep FROM edges, range({KEEPS}) AS r(k))",
        f"u0 AS (SELECT w{n}.*, k, keep, keep * w AS u, 0.0::DOUBLE AS miss FROM w{n}, keeps)",
    ]

    def sums(d: str, of: str) -> str:
        same = f"OVER (PARTITION BY k, {d})"
        return f"""SELECT *, sum(CASE WHEN u >= 1 THEN tokens ELSE 0 END) {same} AS fixed, sum(CASE WHEN u < 1 THEN tokens * u ELSE 0 END) {same} AS free,
            keep * goal_{d} AS want FROM {of}"""

    n = 0
    for _ in range(BOUND_ROUNDS):
        for d in flatten:
            newton, ratio = "(want - fixed) / nullif(free, 0)", "want / nullif(fixed + free, 0)"
            f = f"CASE WHEN fixed + free <= 0 THEN 1.0 WHEN free <= 0 THEN least(1.0, {ratio}) WHEN {ratio} >= 1 THEN {newton} ELSE greatest({newton}, {ratio} / 2) END"
            steps.append(f"u{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (fixed, free, want) REPLACE (u * coalesce({f}, 1.0) AS u) FROM ({sums(d, f'u{n}')}))")
            n += 1
    for d in flatten:
        steps.append(f"u{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (fixed, free, want) REPLACE (greatest(miss, CASE WHEN tokens > 0 THEN abs((fixed + free) / want - 1) ELSE 0 END) AS miss) FROM ({sums(d, f'u{n}')}))")
        n += 1
    steps += [
        f"worst AS (SELECT k, max(miss) AS miss FROM u{n} GROUP BY k)",
        f"best AS (SELECT k FROM worst ORDER BY miss > {NEAR}, CASE WHEN miss > {NEAR} THEN miss ELSE -k END LIMIT 1)",
        f"p AS (SELECT source, lang, topic, w, least(1.0, u) AS p FROM u{n} WHERE k = (SELECT k FROM best))",
    ]
    return f"""WITH {", ".join(steps)}
        SELECT doc_id, source, lang, topic, r.tokens, round(w, 6) AS weight, round(p, 6) AS probability,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / {float(1 << 48)} < p AS kept
        FROM rows_ r JOIN p USING (source, lang, topic)"""


def url_sql() -> str:
    """op7's rows."""
    url = URL.replace("'", "''")
    host = f"nullif(rtrim(lower(regexp_extract(url, '{url}', 1)), '.'), '')"
    return f"""WITH p AS (SELECT page_id, url, {host} AS host, nullif(regexp_extract(url, '{url}', 2), '') AS part,
            DATE '2024-01-01' + ((page_id * 7919 % 366 + 366) % 366)::INTEGER AS fetched FROM pages),
        x AS (SELECT host, h // 4 AS h FROM (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS h FROM p WHERE host IS NOT NULL) WHERE h % 4 = 0),
        e AS (SELECT host AS pattern, 'add' AS action, DATE '2024-01-01' + (h % 200)::INTEGER AS dated FROM x
            UNION ALL SELECT host, 'remove', DATE '2024-01-01' + (h % 200 + 30)::INTEGER FROM x WHERE h % 2 = 0
            UNION ALL SELECT host, 'add', DATE '2024-01-01' + (h % 200 + 90)::INTEGER FROM x WHERE h % 6 = 0
            UNION ALL SELECT '.cheap-pills.example.com', 'add', DATE '2024-01-01'),
        i AS (SELECT pattern, action, dated AS valid_from, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS valid_to
            FROM (SELECT pattern, dated, max(action) AS action FROM e GROUP BY ALL)),
        k AS (SELECT page_id, url, fetched, host, host AS key FROM p
            UNION ALL SELECT page_id, url, fetched, host, '.' || array_to_string(string_split(host, '.')[j:], '.')
                FROM p, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(j) WHERE host IS NOT NULL
            UNION ALL SELECT page_id, url, fetched, host, host || '/' || part FROM p WHERE part IS NOT NULL)
        SELECT page_id, url, fetched, host, count(DISTINCT pattern) > 0 AS listed, count(DISTINCT pattern) AS n_entries, min(pattern) AS pattern
        FROM k LEFT JOIN i ON key = pattern AND action = 'add' AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
        GROUP BY page_id, url, fetched, host"""


def license_sql(dice: float = DICE) -> str:
    """op8's rows, without the bounds."""
    places = ", ".join(map(str, phrases(TEMPLATES)))
    rows = ", ".join(f"('{k}', [{', '.join(repr(g) for g in v)}])" for k, v in sorted(template_bigrams(TEMPLATES).items()))
    return f"""WITH t(name, grams) AS (VALUES {rows}),
        u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '[.!?]+[ \\t\\r]+|\\n'), string_split_regex(text, '\\n[ \\t\\r]*\\n'), [text])) AS unit
            FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
        w AS (SELECT doc_id, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS words FROM u),
        g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) > 1),
        ph(phrase, name, before, n) AS (VALUES {places}),
        a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS words FROM documents),
        s AS (SELECT a.doc_id, words, i, array_to_string(words[i:i + {PHRASE - 1}], ' ') AS phrase FROM a, unnest(range(1, len(words) - {PHRASE - 2})) AS r(i)),
        x AS (SELECT doc_id, name, words[greatest(i - before, 1):greatest(i - before, 1) + n - 1] AS words FROM s JOIN ph USING (phrase)),
        y AS (SELECT doc_id, name, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM x),
        c AS (SELECT doc_id, name, len(list_intersect(g.grams, t.grams)) AS common, len(g.grams) + len(t.grams) AS both_ FROM g, t
            UNION ALL SELECT doc_id, name, len(list_intersect(y.grams, t.grams)), len(y.grams) + len(t.grams) FROM y JOIN t USING (name)),
        d AS (SELECT doc_id, name, max({{'dice': (2.0 * common / both_)::DOUBLE, 'common': common}}) AS v FROM c WHERE (2.0 * common / both_)::DOUBLE >= {dice} GROUP BY ALL),
        n AS (SELECT doc_id, count(DISTINCT split_part(name, '/', 1)) AS n FROM d GROUP BY doc_id),
        b AS (SELECT doc_id, split_part(name, '/', 1) AS name, v.dice AS dice, row_number() OVER (PARTITION BY doc_id ORDER BY v.common DESC, v.dice DESC, name) AS place FROM d)
        SELECT a.doc_id, b.name AS license, round(b.dice, 6) AS dice, coalesce(n.n, 0)::BIGINT AS n_licenses
        FROM (SELECT DISTINCT doc_id FROM documents) a LEFT JOIN b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND b.place = 1 LEFT JOIN n ON a.doc_id IS NOT DISTINCT FROM n.doc_id"""


def divergence_sql(least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> str:
    """op11's rows: every kept term of every pair."""
    p = lambda n, total, v: f"(1 + ({SCALE}::HUGEINT * ({n} + 2)) // ({total} + 2 * {v}))"
    return f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
        df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {least_documents}),
        n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN df USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total, coalesce(any_value(v), 0) AS v FROM g LEFT JOIN n USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
        gp AS (SELECT gn.lang, gn.source, df.term, coalesce(n.n, 0) AS n, {p("coalesce(n.n, 0)", "total", "gn.v")} AS p
            FROM gn JOIN df USING (lang) LEFT JOIN n ON n.lang = gn.lang AND n.source = gn.source AND n.term = df.term),
        lq AS (SELECT lang, term, {p("sum(n)", "any_value(total)", "any_value(v)")} AS q
            FROM n JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM n GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gp x ON x.lang = a.lang AND x.source = a.source
            LEFT JOIN gp y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
        terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM gp JOIN lq USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
        UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
        FROM terms QUALIFY rank <= {top}"""


def trie_sql() -> str:
    """op12's rows: every node with every node at or below it. CRC-32 by its table, which is made by rule."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table_ = "SELECT k, k::BIGINT AS c FROM range(256) AS r(k)"
    for _ in range(8):
        table_ = f"SELECT k, {step} AS c FROM ({table_})"
    return f"""WITH t AS (SELECT list(c ORDER BY k) AS crc FROM ({table_})),
        o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS place, role, text
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
        c AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
            xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda r, b: xor(r >> 8, crc[(xor(r, b) & 255) + 1])), 4294967295) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM o), t),
        r AS (SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN o ON o.conv_id = base AND place <= h
            UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND place > h),
        s AS (SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, place) FILTER (place IS NOT NULL), []) AS turns FROM c LEFT JOIN r USING (conv_id) GROUP BY ALL),
        m AS (SELECT conv_id, d, turns[1:d] AS node, len(turns) = d AS ends FROM s, unnest(range(0, len(turns) + 1)) AS u(d)),
        n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
            CASE WHEN d > 0 THEN (count(*) - 1) * octet_length(encode(node[d]['text'])) ELSE 0 END AS saved FROM m GROUP BY node, d),
        k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
        w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.node = n.node),
        b AS (SELECT node[1:a] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM w, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL)
        SELECT w.conv_id, w.d AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
        FROM w JOIN b ON b.node = w.node LEFT JOIN w AS up ON w.d > 0 AND up.node = w.node[1:w.d - 1]"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op7_url_filter": url_sql(), "op8_license_scan": license_sql(), "op9_mixing": mixing_sql(), "op11_source_divergence": divergence_sql(), "op12_prefix_trie": trie_sql()}
