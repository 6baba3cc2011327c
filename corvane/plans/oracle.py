"""Named subqueries in SQL, from which the registered queries' reference SQL is put together."""

from __future__ import annotations

import re


def norm(e: str) -> str:
    return f"trim(regexp_replace(translate(lower(nfc_normalize(coalesce({e}, ''))), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))"


def words(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda x: x <> '')"


def clean(e: str) -> str:
    return rf"trim(regexp_replace(coalesce({e}, ''), '\s+', ' ', 'g'))"


def fold(e: str, modulus: int = 5) -> str:
    return f"CAST(CAST('0x' || substr(sha256({e}), 1, 16) AS UBIGINT) % {modulus} AS INTEGER)"


def hex_id(kind: str, e: str) -> str:
    return f"substr(md5('{kind}' || CAST({e} AS VARCHAR)), 1, 16)"


def _search(k: str, text: str, variant: str) -> str:
    return (
        f"{text} || ' ' || {variant} AS search_query, ({k} * 7) % 20 AS search_location_id, {k} % 2 = 0 AS search_is_delivery_search, "
        f"'en src' || CAST(({k} * 7) % 20 AS VARCHAR) AS search_infm_params_text, {k} % 7 AS search_category"
    )


def _counts(docs: str, chars: bool = False) -> str:
    if chars:
        grams = """SELECT doc, substr(w, p::INT, n::INT) AS term FROM (SELECT doc, w, n, unnest(range(1, length(w) - n + 2)) AS p FROM (
                   SELECT doc, w, unnest(range(3, least(5, length(w)) + 1)) AS n FROM (SELECT doc, ' ' || unnest(tk) || ' ' AS w FROM d)))"""
    else:
        grams = "SELECT doc, unnest(tk) AS term FROM d UNION ALL SELECT doc, unnest(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS term FROM d WHERE len(tk) > 1"
    return f"WITH d AS ({docs}), g AS ({grams}) SELECT doc, term, count(*) AS tf FROM g GROUP BY ALL"


def _vocab(counts: str, most: int) -> str:
    return f"SELECT term, df, cf, ln((1.0 + (SELECT count(*) FROM items)) / (1.0 + df)) + 1.0 AS idf FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {counts} GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {most})"


def _post(counts: str, vocab: str) -> str:
    return f"SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS w FROM (SELECT doc, term, (1.0 + ln(tf)) * idf AS raw FROM {counts} JOIN {vocab} USING (term))"


def _sims(q: str, i: str) -> str:
    return f"SELECT * FROM (SELECT q.doc AS qid, i.doc AS item_id, round(sum(q.w * i.w), 9) AS score FROM {q} q JOIN {i} i USING (term) GROUP BY ALL) WHERE score > 0"


def top(source: str, limit: int, per: str = "qid", score: str = "score", tie: str = "item_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY {score} DESC, {tie}) AS rank FROM {source} QUALIFY rank <= {limit}"


def _local(q: str, i: str, places: str) -> str:
    inner = f"(SELECT q.doc AS qid, i.doc AS item_id, round(sum(q.w * i.w), 9) AS score FROM {q} q JOIN {places} p ON p.qid = q.doc JOIN items c ON c.item_location_id = p.location JOIN {i} i ON i.doc = c.item_id AND i.term = q.term GROUP BY ALL)"
    return f"SELECT * FROM ({top(inner, 120)}) WHERE score > 0"


def _near_keys(post: str, limit: int) -> str:
    return f"SELECT qid, item_id AS key, score, rank FROM ({top(f'({_sims("q_words", post)})', limit)})"


_TITLE = norm("item_title_raw")

PARTS: dict[str, str] = {
    "items": f"""SELECT substr(string_split(text, chr(10))[1], 1, 80) AS item_title_raw, CAST(doc_id % 97 - 1 AS DOUBLE) AS item_rating_reviews_count, CASE WHEN doc_id % 13 <> 0 THEN CAST(doc_id % 5 AS DOUBLE) END AS item_rating,
        CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 7919 % 100000) / 7.0::DOUBLE END AS item_price, doc_id % 40 AS item_microcat_id, 20 + (doc_id * 17 % 3000) / 100.0::DOUBLE AS item_longitude,
        CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS item_location_id, 40 + (doc_id * 31 % 1000) / 100.0::DOUBLE AS item_latitude, doc_id % 2 = 0 AS item_is_phone_hidden, doc_id % 3 = 0 AS item_is_message_forbidden,
        concat_ws(' ', lang, source) AS item_infm_params_text, {hex_id("i", "doc_id")} AS item_id, text AS item_description_raw, doc_id % 7 AS item_category_id FROM documents""",
    "queries": f"SELECT {hex_id('q', 'item_id')} AS qid, {_search('item_id', 'text', chr(39) * 2)} FROM benchmark",
    "train": f"SELECT * FROM (SELECT {_search('b.item_id', 'b.text', 'e.event_type')}, {hex_id('i', '(e.event_id * 13 + e.user_id) % (SELECT count(*) FROM documents)')} AS item_id FROM events e JOIN benchmark b ON e.user_id % (SELECT count(*) FROM benchmark) = b.item_id) JOIN items USING (item_id)",
    "keyed": f"SELECT *, {norm('search_query')} AS key FROM train",
    "folded": f"SELECT *, {fold('key')} AS fold FROM keyed",
    "units": "SELECT substr(md5(concat_ws('|', search_query, search_location_id, search_infm_params_text, search_category)), 1, 16) AS qid, * FROM (SELECT search_query, search_location_id, search_is_delivery_search, search_infm_params_text, search_category, list_sort(list(DISTINCT item_id)) AS relevant_items FROM folded WHERE fold = 2 GROUP BY ALL)",
    "past": "SELECT * FROM folded WHERE fold NOT IN (2, 3)",
    "fields": f"SELECT item_id, {_TITLE} AS title, {norm('item_infm_params_text')} AS params, {norm('item_description_raw')} AS description FROM items",
    "word_counts": _counts(f"""SELECT item_id AS doc, {words("concat_ws(' ', title, title, title, substr(params, 1, 1200), substr(params, 1, 1200), substr(description, 1, 900))")} AS tk FROM fields"""),
    "char_counts": _counts(f"SELECT item_id AS doc, {words('title')} AS tk FROM fields", chars=True),
    "vocab": _vocab("word_counts", 140_000),
    "char_vocab": _vocab("char_counts", 120_000),
    "word_post": _post("word_counts", "vocab"),
    "char_post": _post("char_counts", "char_vocab"),
    "filter_post": _post(f"({_counts(f'SELECT item_id AS doc, {words("substr(params, 1, 1200)")} AS tk FROM fields')})", "vocab"),
    "title_post": _post(f"({_counts(f'SELECT item_id AS doc, {words("title")} AS tk FROM fields')})", "vocab"),
    "q_words": _post(f"({_counts(f'SELECT qid AS doc, {words(norm("search_query"))} AS tk FROM queries')})", "vocab"),
    "q_chars": _post(f"({_counts(f'SELECT qid AS doc, {words(norm("search_query"))} AS tk FROM queries', chars=True)})", "char_vocab"),
    "q_filters": _post(f"({_counts(f'SELECT qid AS doc, {words(norm("search_infm_params_text"))} AS tk FROM queries')})", "vocab"),
    "word_top": top(f"({_sims('q_words', 'word_post')})", 120),
    "char_top": top(f"({_sims('q_chars', 'char_post')})", 120),
    "filter_top": top(f"({_sims('q_filters', 'filter_post')})", 120),
    "category_prior": "SELECT search_category, item_category_id, ln(1.0 + n) / ln(1.0 + max(n) OVER (PARTITION BY search_category)) AS prior FROM (SELECT search_category, item_category_id, count(*) AS n FROM train GROUP BY ALL)",
    "location_prior": "SELECT search_location_id, item_location_id, ln(1.0 + n) / ln(1.0 + max(n) OVER (PARTITION BY search_location_id)) AS prior FROM (SELECT search_location_id, item_location_id, count(*) AS n FROM train WHERE item_location_id IS NOT NULL GROUP BY ALL)",
    "compatible": top("location_prior", 3, "search_location_id", "prior", "item_location_id"),
    "places": "SELECT qid, coalesce(item_location_id, search_location_id) AS location FROM queries LEFT JOIN compatible USING (search_location_id)",
    "word_local": _local("q_words", "word_post", "places"),
    "char_local": _local("q_chars", "char_post", "places"),
    "popular": "SELECT item_id, CASE WHEN max(n) OVER () > 0 THEN ln(1.0 + n) / ln(1.0 + max(n) OVER ()) ELSE 0.0 END AS popularity FROM (SELECT i.item_id, count(t.item_id) AS n FROM items i LEFT JOIN train t USING (item_id) GROUP BY ALL)",
    "fallback": "SELECT * FROM popular ORDER BY popularity DESC, item_id LIMIT 120",
    "history": "SELECT key, item_id, rank, ln(1.0 + n) / ln(1.0 + max(n) OVER (PARTITION BY key)) AS click FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, item_id) AS rank FROM (SELECT key, item_id, count(*) AS n FROM keyed WHERE key <> '' AND item_id IN (SELECT item_id FROM items) GROUP BY ALL) QUALIFY rank <= 30)",
    "microcats": "SELECT key, item_microcat_id, n / sum(n) OVER (PARTITION BY key) AS p FROM (SELECT key, item_microcat_id, count(*) AS n FROM keyed WHERE key <> '' GROUP BY ALL)",
    "key_post": _post(f"({_counts(f'SELECT key AS doc, {words("key")} AS tk FROM (SELECT DISTINCT key FROM keyed WHERE key <> {chr(39) * 2})')})", "vocab"),
    "near12": _near_keys("key_post", 12),
    "near16": _near_keys("key_post", 16),
    "history_found": f"SELECT qid, item_id, max(score) AS score FROM (SELECT qid, item_id, click AS score FROM (SELECT qid, {norm('search_query')} AS key FROM queries) JOIN history USING (key) UNION ALL SELECT qid, item_id, score * click AS score FROM near12 JOIN history USING (key)) GROUP BY ALL HAVING max(score) > 0",
    "microcat_found": "SELECT qid, item_microcat_id, sum(score * score * p) / any_value(whole) AS score FROM near16 JOIN (SELECT qid, sum(score * score) AS whole FROM near16 GROUP BY qid) USING (qid) JOIN microcats USING (key) GROUP BY ALL",
    "mean_local": "SELECT avg(CASE WHEN search_location_id = item_location_id THEN 1.0 ELSE 0.0 END) AS mean FROM train",
    "key_local": "SELECT key, count(*) AS n, sum(CASE WHEN search_location_id = item_location_id THEN 1 ELSE 0 END)::BIGINT AS hits, (hits + 3.0 * (SELECT mean FROM mean_local)) / (n + 3.0) AS propensity FROM keyed GROUP BY key",
    "microcat_local": "SELECT item_microcat_id, count(*) AS n, sum(CASE WHEN search_location_id = item_location_id THEN 1 ELSE 0 END)::BIGINT AS hits, (hits + 20.0 * (SELECT mean FROM mean_local)) / (n + 20.0) AS propensity FROM train GROUP BY item_microcat_id",
    "query_local": "SELECT qid, coalesce(s, (SELECT mean FROM mean_local)) AS locality FROM queries LEFT JOIN (SELECT qid, sum(score * score * propensity) / sum(score * score) AS s FROM near16 JOIN key_local USING (key) GROUP BY qid) USING (qid)",
    # vectors
    "vectors": f"SELECT {hex_id('i', 'vec_id')} AS item_id, vec_id % 5 AS location, embedding::DOUBLE[] AS v FROM embeddings",
    "query_vectors": f"SELECT {hex_id('q', 'vec_id')} AS qid, vec_id // 20 * 7 % 5 AS location, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0",
    "cosines": "SELECT qid, item_id, q.location = i.location AS same, round(list_cosine_similarity(q.v, i.v), 9) AS score FROM query_vectors q, vectors i",
    "dense_top": top("(SELECT qid, item_id, score FROM cosines)", 1000),
    "dense_local": top("(SELECT qid, item_id, score FROM cosines WHERE same)", 200),
    "dense_pairs": "SELECT qid, item_id FROM dense_local UNION SELECT qid, item_id FROM dense_top WHERE rank <= 50",
    # the candidate union
    "parts": """SELECT qid, item_id, 'word' AS channel, score AS value, 'global_word_rank' AS source, rank AS place FROM word_top
        UNION ALL SELECT qid, item_id, 'char', score, 'global_char_rank', rank FROM char_top UNION ALL SELECT qid, item_id, 'filter', score, 'global_filter_rank', rank FROM filter_top
        UNION ALL SELECT qid, item_id, 'word', score, 'geo3_word_rank', rank FROM word_local UNION ALL SELECT qid, item_id, 'char', score, 'geo3_char_rank', rank FROM char_local
        UNION ALL SELECT qid, item_id, 'history', score, 'history_source', 1 FROM history_found
        UNION ALL SELECT qid, item_id, 'popularity', popularity, 'fallback_source', 1 FROM queries, fallback WHERE popularity > 0""",
    "merged": """SELECT qid, item_id, coalesce(max(value) FILTER (channel = 'word'), 0.0) AS word, coalesce(max(value) FILTER (channel = 'char'), 0.0) AS char, coalesce(max(value) FILTER (channel = 'filter'), 0.0) AS filter,
        coalesce(max(value) FILTER (channel = 'history'), 0.0) AS history_value, coalesce(max(value) FILTER (channel = 'popularity'), 0.0) AS popularity,
        min(place) FILTER (source = 'global_word_rank') AS global_word_rank, min(place) FILTER (source = 'global_char_rank') AS global_char_rank, min(place) FILTER (source = 'global_filter_rank') AS global_filter_rank,
        min(place) FILTER (source = 'geo3_word_rank') AS geo3_word_rank, min(place) FILTER (source = 'geo3_char_rank') AS geo3_char_rank, min(place) FILTER (source = 'history_source') AS history_source,
        min(place) FILTER (source = 'fallback_source') AS fallback_source FROM parts GROUP BY ALL""",
    "wide": f"""SELECT m.* EXCLUDE (history_value), history_value AS history, coalesce(cp.prior, 0.0) AS category, coalesce(lp.prior, 0.0) AS location, coalesce(ew.score, 0.0) AS exact_word, coalesce(ec.score, 0.0) AS exact_char,
        coalesce(ef.score, 0.0) AS exact_filter, coalesce(et.score, 0.0) AS title, coalesce(round(mc.score, 9), 0.0) AS microcat
        FROM merged m JOIN queries USING (qid) JOIN (SELECT item_id, item_category_id, item_location_id, item_microcat_id FROM items) USING (item_id)
        LEFT JOIN category_prior cp USING (search_category, item_category_id) LEFT JOIN location_prior lp USING (search_location_id, item_location_id)
        LEFT JOIN ({_sims('q_words', 'word_post')}) ew USING (qid, item_id) LEFT JOIN ({_sims('q_chars', 'char_post')}) ec USING (qid, item_id)
        LEFT JOIN ({_sims('q_filters', 'filter_post')}) ef USING (qid, item_id) LEFT JOIN ({_sims('q_words', 'title_post')}) et USING (qid, item_id) LEFT JOIN microcat_found mc USING (qid, item_microcat_id)""",
    "scored": """SELECT *, round(1.0 * exact_word + 0.35 * exact_char + 0.05 * category + 0.7 * location + 0.03 * popularity + 0.4 * microcat, 9) AS base_score FROM wide
        WHERE global_word_rank <= 120 OR geo3_word_rank <= 120 OR global_char_rank <= 120 OR geo3_char_rank <= 120 OR global_filter_rank <= 120 OR history_source IS NOT NULL OR fallback_source IS NOT NULL""",
    "answered": "SELECT qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, item_id) AS rank FROM (SELECT qid, item_id, base_score AS s FROM scored) QUALIFY rank <= 50",
    # clicks of the log stand for relevance
    "truth": "SELECT qid, list_sort(list(DISTINCT t.item_id)) AS relevant_items FROM queries q JOIN train t ON t.search_location_id = q.search_location_id AND t.search_category = q.search_category GROUP BY qid",
    "recalls": "SELECT qid, len(relevant_items) AS relevant, coalesce(hits, 0) AS hits, coalesce(hits, 0) / len(relevant_items) AS recall FROM truth LEFT JOIN (SELECT qid, count(*) AS hits FROM answered JOIN (SELECT qid, unnest(relevant_items) AS item_id FROM truth) USING (qid, item_id) GROUP BY qid) USING (qid)",
    "centers": "SELECT item_location_id, median(item_latitude) AS latitude, median(item_longitude) AS longitude FROM items WHERE item_location_id IS NOT NULL GROUP BY item_location_id",
}

# the candidate union with dense candidates, and every item and query with a vector of its own
PARTS |= {
    "item_vectors": f"SELECT {hex_id('i', 'doc_id')} AS item_id, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS location, embedding::DOUBLE[] AS v FROM documents d JOIN embeddings e ON d.doc_id % (SELECT count(*) FROM embeddings) = e.vec_id",
    "search_vectors": f"SELECT {hex_id('q', 'item_id')} AS qid, item_id * 7 % 20 AS location, embedding::DOUBLE[] AS v FROM benchmark b JOIN embeddings e ON (b.item_id * 3 + 1) % (SELECT count(*) FROM embeddings) = e.vec_id",
    "cosines52": "SELECT qid, item_id, q.location = i.location AS same, round(list_cosine_similarity(q.v, i.v), 9) AS score FROM search_vectors q, item_vectors i",
    "dense_top52": top("(SELECT qid, item_id, score FROM cosines52)", 1000),
    "dense_local52": top("(SELECT qid, item_id, score FROM cosines52 WHERE same)", 200),
    "dense_pairs52": "SELECT qid, item_id FROM dense_local52 UNION SELECT qid, item_id FROM dense_top52 WHERE rank <= 50",
    "parts52": PARTS["parts"] + " UNION ALL SELECT qid, item_id, 'dense', 0.0, 'dense_source', 1 FROM dense_pairs52",
    "merged52": PARTS["merged"].replace("FROM parts", ", min(place) FILTER (source = 'dense_source') AS dense_source FROM parts52"),
    "wide52": PARTS["wide"].replace("FROM merged m", "FROM merged52 m"),
    "scored52": PARTS["scored"].replace("FROM wide", "FROM wide52") + " OR dense_source IS NOT NULL",
}


def sql(select: str, **extra: str) -> str:
    """select with every named part that it needs, directly or not, in front."""
    parts = PARTS | extra
    need: list[str] = []

    def visit(text: str, path: tuple[str, ...] = ()) -> None:
        for name in parts:
            if name not in need and name not in path and re.search(rf"\b{name}\b", text):
                visit(parts[name], (*path, name))
                if name not in need:
                    need.append(name)

    visit(select)
    if not need:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({parts[n]})" for n in need) + f"\n{select}"
