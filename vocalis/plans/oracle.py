"""The same queries as plain SQL over the provided tables, for comparison."""

from __future__ import annotations

from vocalis.functions import text as T
from vocalis.functions import words as W
from vocalis.operators.lexicon_sentiment import WORD_WITH_MARK
from vocalis.plans import views as V


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


STOP = _in(T.STOP_WORDS + T.EXTRA_STOP_WORDS)
RE2_HANDLE = r"(^|[^A-Za-z0-9_!@#$%&*])@[A-Za-z0-9_]{1,20}"


def plain(text: str) -> str:
    return f"regexp_replace(translate({text}, {_q(T.PUNCTUATION)}, ''), {_q(T.URL)}, '', 'g')"


def shortened(chars: str) -> str:
    """Text from its list of characters, runs of a sign other than an ASCII letter or digit cut
    to three."""
    same = " AND ".join(f"{chars}[i] = {chars}[i - {k}]" for k in (1, 2, 3))
    return (
        f"array_to_string(list_transform(range(1, len({chars}) + 1), lambda i: CASE WHEN i > 3 AND {same} "
        f"AND NOT regexp_matches({chars}[i], '[a-zA-Z0-9]') THEN '' ELSE {chars}[i] END), '')"
    )


def tokenize(text: str) -> str:
    return (
        f"list_transform(regexp_extract_all({text}, {_q(T.TOKEN)}), "
        f"lambda x: CASE WHEN contains(x, '8') AND regexp_matches(x, {_q(T.EMOTICON)}) THEN x ELSE lower(x) END)"
    )


def no_stop(tokens: str) -> str:
    return f"list_filter({tokens}, lambda x: length(x) > 1 AND x NOT IN {STOP})"


def no_tags(tokens: str) -> str:
    return f"list_filter({tokens}, lambda x: NOT starts_with(x, '#'))"


def bigrams(t: str) -> str:
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || '_' || {t}[i + 1])"


def flat(t: str) -> str:
    return f"coalesce(array_to_string({t}, ' '), '')"


def even(value: str, digits: int) -> str:
    """Round half to even, values within 1e-6 of a tie being ties."""
    y = f"(({value}) * {10.0**digits}::DOUBLE)"
    return (
        f"(CASE WHEN abs({y} - floor({y}) - 0.5) < 1e-6 THEN floor({y}) + abs(floor({y}) % 2) "
        f"ELSE floor({y} + 0.5) END / {10.0**digits}::DOUBLE)"
    )


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def voiced(text: str) -> str:
    for old, new in ((" of ", " very "), (" to ", " not "), (" was ", " but "), (" and ", "! "), (" in ", " IN ")):
        text = f"replace({text}, {_q(old)}, {_q(new)})"
    return text


BRANCHES = _list(V.BRANCHES)
LOW, HIGH = V.LEXICON_RANKS

# Common table expressions by name; each entry lists what it needs.
CTES: dict[str, tuple[str, str]] = {
    "posts": ("", f"""
        SELECT doc_id AS post_id, CAST(date '2018-01-01' + CAST(doc_id % 500 AS INTEGER) AS DATE) AS post_date,
               replace(replace(text, ' the ', ' @the '), ' of ', ' #of ') AS text, source AS user_id,
               n_chars % 100 AS retweet_count, doc_id % 37 AS favorite_count,
               ({BRANCHES})[1 + CAST((doc_id // 20) % 4 AS INTEGER)] AS branch
        FROM documents"""),
    "accounts": ("", """
        SELECT 't_' || user_id AS token, user_id, 'https://example.org/' || user_id AS link,
               CASE CAST(substr(user_id, 4) AS INTEGER) % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 2 THEN 'O' END AS party_affiliation
        FROM (SELECT DISTINCT source AS user_id FROM documents WHERE source <> 'src19')"""),
    "preds": ("", """
        SELECT doc_id AS post_id, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS prediction_raw,
               CAST((doc_id * 7919 % 1000) / 1000.0::DOUBLE > 0.5 AS INTEGER) AS prediction_class
        FROM documents"""),
    "raw": ("posts", f"SELECT * EXCLUDE (p), {tokenize('p')} AS tokens FROM (SELECT * EXCLUDE (l), {shortened('l')} AS p FROM (SELECT *, string_split({plain('text')}, '') AS l FROM posts))"),
    "toks": ("raw", f"SELECT * EXCLUDE (tokens), {no_stop('tokens')} AS tokens FROM raw"),
    "grams": ("toks", f"""
        SELECT *, list_concat(words, pairs) AS grams
        FROM (SELECT *, {bigrams('words')} AS pairs FROM (SELECT *, {no_tags('tokens')} AS words FROM toks))"""),
    "lexicon": ("grams", f"""
        SELECT bigram, CASE WHEN r % 8 = 7 THEN 'x' ELSE 'topic_' || (r % 5) END AS topic
        FROM (SELECT bigram, row_number() OVER (ORDER BY count(*) DESC, bigram) - 1 AS r
              FROM (SELECT unnest(list_distinct(pairs)) AS bigram FROM grams) GROUP BY bigram)
        WHERE r >= {LOW} AND r < {HIGH}"""),
    "matched": ("lexicon", """
        SELECT post_id, list_sort(list(DISTINCT topic)) AS topics
        FROM (SELECT post_id, unnest(list_distinct(grams)) AS bigram FROM grams) JOIN lexicon USING (bigram)
        WHERE topic <> 'x' GROUP BY post_id"""),
    "tagged": ("matched", """
        SELECT g.*, coalesce(m.topics, []) AS topics FROM grams g LEFT JOIN matched m USING (post_id)"""),
    "master": ("tagged accounts", """
        SELECT DISTINCT post_id, post_date, text, t.user_id, retweet_count, favorite_count, tokens, topics,
               branch IN ('house', 'senate') AS leadership,
               CASE WHEN branch = 'democrat' THEN true WHEN branch = 'republican' THEN false
                    WHEN party_affiliation = 'D' THEN true WHEN party_affiliation = 'R' THEN false END AS democrat
        FROM tagged t LEFT JOIN accounts a ON t.user_id = a.user_id
        WHERE len(topics) > 0 AND (branch IN ('democrat', 'republican') OR a.user_id IS NOT NULL)"""),
    "grouped": ("master", """
        SELECT *, CASE WHEN democrat AND leadership THEN 'dem-lead' WHEN democrat AND NOT leadership THEN 'dem-base'
                       WHEN NOT democrat AND leadership THEN 'rep-lead' WHEN NOT democrat AND NOT leadership THEN 'rep-base'
                       ELSE '' END AS grp FROM master"""),
    "scored": ("grouped preds", "SELECT * FROM grouped JOIN preds USING (post_id)"),
    "cells": ("scored", """
        SELECT topic, grp, prediction_class, term, count(*) AS n
        FROM (SELECT topic, grp, prediction_class, unnest(tokens) AS term
              FROM (SELECT unnest(topics) AS topic, grp, prediction_class, tokens FROM scored WHERE grp <> ''))
        GROUP BY ALL"""),
    "terms": ("toks", "SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM toks) GROUP BY term"),
    "bags": ("toks", "SELECT post_id, term, count(*) AS tf FROM (SELECT post_id, unnest(tokens) AS term FROM toks) GROUP BY ALL"),
    "dfs": ("bags", "SELECT term, count(*) AS df FROM bags GROUP BY term"),
    "labelled": ("", """
        SELECT doc_id, quality AS label, prediction FROM labels
        JOIN (SELECT doc_id, CAST((doc_id * 7919 % 1000) / 1000.0::DOUBLE > 0.5 AS INTEGER) AS prediction FROM documents) USING (doc_id)"""),
    "cut": ("labelled", """
        SELECT *, CASE WHEN k <= floor(n * CAST(0.1 AS DOUBLE) + 0.5) THEN 'test'
                       WHEN k <= floor(n * CAST(0.3 AS DOUBLE) + 0.5) THEN 'valid' ELSE 'train' END AS split
        FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n,
                     row_number() OVER (PARTITION BY label ORDER BY md5('1234:' || doc_id)) AS k FROM labelled)"""),
}


def _valence_ctes(source: str, keys: str) -> str:
    """Rule-based sentiment of ``source(keys, text)``; ends in a table ``sent``."""
    words = f"""list_transform(list_filter(regexp_split_to_array(text, {_q('[' + T.SPACE + ']+')}), lambda w: length(w) > 1),
        lambda w: regexp_replace(w, {_q(WORD_WITH_MARK)}, '\\1\\2'))"""
    caps = lambda w: f"({w} = upper({w}) AND {w} <> lower({w}))"
    neg = lambda w: f"coalesce({w} IN {_in(W.NEGATIONS)} OR contains({w}, 'n''t'), false)"

    def boost(n: int, v: str) -> str:
        sign = f"CASE WHEN {v} < 0 THEN -1 ELSE 1 END"
        loud = f"CASE WHEN mixed AND {caps(f'p{n}')} THEN CASE WHEN {v} > 0 THEN {W.CAPS} ELSE -{W.CAPS} END ELSE 0 END"
        return (
            f"CASE WHEN l{n} IN {_in(W.BOOSTERS_UP)} THEN {W.BOOST} * {sign} + {loud} "
            f"WHEN l{n} IN {_in(W.BOOSTERS_DOWN)} THEN -{W.BOOST} * {sign} + {loud} ELSE 0 END"
        )

    so = lambda n: f"coalesce(p{n} IN ('so', 'this'), false)"
    never = lambda n: f"coalesce(p{n} = 'never', false)"
    return f"""
    vwords AS (
        SELECT {words} AS w FROM (SELECT {voiced('text')} AS text FROM documents)),
    valences AS (
        SELECT token, CAST(r % 9 - 4 AS DOUBLE) AS valence FROM (
            SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS r
            FROM (SELECT unnest(list_distinct(list_transform(w, lambda x: lower(x)))) AS token FROM vwords)
            WHERE token NOT IN {_in(W.BOOSTERS_UP + W.BOOSTERS_DOWN + W.NEGATIONS + ['but'])}
            GROUP BY token) WHERE r < {V.VALENCE_WORDS}),
    s0 AS (SELECT {keys}, text, {words} AS w FROM {source}),
    s1 AS (
        SELECT {keys}, w, len(w) AS nw, len(list_filter(w, lambda x: {caps('x')})) AS nc,
            CASE WHEN list_contains(w, 'but') THEN list_position(w, 'but') WHEN list_contains(w, 'BUT') THEN list_position(w, 'BUT') END AS b,
            length(text) - length(replace(text, '!', '')) AS bang, length(text) - length(replace(text, '?', '')) AS ask
        FROM s0),
    s2 AS (SELECT {keys}, nc > 0 AND nc < nw AS mixed, b, w, unnest(range(1, nw + 1)) AS i FROM s1),
    s3 AS (
        SELECT {keys}, mixed, b, i, w[i] AS x, lower(w[i]) AS l, lower(w[i + 1]) AS nx,
            CASE WHEN i > 1 THEN w[i - 1] END AS p1, CASE WHEN i > 2 THEN w[i - 2] END AS p2, CASE WHEN i > 3 THEN w[i - 3] END AS p3
        FROM s2),
    s4 AS (
        SELECT s3.*, v.valence AS v0, lower(p1) AS l1, lower(p2) AS l2, lower(p3) AS l3,
            p1 IS NOT NULL AND lower(p1) NOT IN (SELECT token FROM valences) AS f1,
            p2 IS NOT NULL AND lower(p2) NOT IN (SELECT token FROM valences) AS f2,
            p3 IS NOT NULL AND lower(p3) NOT IN (SELECT token FROM valences) AS f3
        FROM s3 JOIN valences v ON v.token = l
        WHERE l NOT IN {_in(W.BOOSTERS_UP + W.BOOSTERS_DOWN)} AND NOT coalesce(l = 'kind' AND nx = 'of', false)),
    s5 AS (SELECT *, CASE WHEN mixed AND {caps('x')} THEN CASE WHEN v0 > 0 THEN v0 + {W.CAPS} ELSE v0 - {W.CAPS} END ELSE v0 END AS va FROM s4),
    s6 AS (SELECT *, CASE WHEN NOT f1 THEN va ELSE (va + {boost(1, 'va')}) * CASE WHEN {neg('l1')} THEN {W.NEGATE} ELSE 1 END END AS vb FROM s5),
    s7 AS (SELECT *, CASE WHEN NOT f2 THEN vb ELSE (vb + ({boost(2, 'vb')}) * 0.95) * CASE
            WHEN {never(2)} AND {so(1)} THEN 1.5 WHEN {neg('l2')} THEN {W.NEGATE} ELSE 1 END END AS vc FROM s6),
    s8 AS (SELECT *, CASE WHEN NOT f3 THEN vc ELSE (vc + ({boost(3, 'vc')}) * 0.9) * CASE
            WHEN ({never(3)} AND {so(2)}) OR {so(1)} THEN 1.25 WHEN {neg('l3')} THEN {W.NEGATE} ELSE 1 END END AS vd FROM s7),
    s9 AS (SELECT {keys}, vd * CASE WHEN f1 AND l1 = 'least' AND NOT coalesce(l2 IN ('at', 'very'), false) THEN {W.NEGATE} ELSE 1 END
            * CASE WHEN b IS NULL OR i = b THEN 1 WHEN i < b THEN 0.5 ELSE 1.5 END AS v FROM s8),
    sums AS (
        SELECT {keys}, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS n,
            count(*) FILTER (v <> 0) AS scored FROM s9 GROUP BY ALL),
    amps AS (
        SELECT {keys}, nw, nw - coalesce(scored, 0) AS z, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(n, 0) AS n,
            least(bang, 4) * 0.292::DOUBLE + CASE WHEN ask <= 1 THEN 0 WHEN ask <= 3 THEN ask * 0.18::DOUBLE ELSE 0.96 END AS amp
        FROM s1 LEFT JOIN sums USING ({keys})),
    parts AS (
        SELECT {keys}, nw, z, CASE WHEN s > 0 THEN s + amp WHEN s < 0 THEN s - amp ELSE s END AS t,
            CASE WHEN p > n THEN p + amp ELSE p END AS p, CASE WHEN p < n THEN n + amp ELSE n END AS n FROM amps),
    sent AS (
        SELECT {keys}, CASE WHEN nw > 0 THEN {even('n / (p + n + z)', 3)} ELSE 0 END AS negative,
            CASE WHEN nw > 0 THEN {even('z / (p + n + z)', 3)} ELSE 0 END AS neutral,
            CASE WHEN nw > 0 THEN {even('p / (p + n + z)', 3)} ELSE 0 END AS positive,
            {even('greatest(-1.0, least(1.0, t / sqrt(t * t + 15)))', 4)} AS compound FROM parts)"""


def _with(names: str, body: str, extra: str = "") -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0].split():
            add(needed)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    parts = [f"{n} AS {'MATERIALIZED ' if n in ('grams', 'tagged', 'master', 'toks', 'bags') else ''}({CTES[n][1]})" for n in order]
    if extra:
        parts.append(extra)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


MASTER_SENT = "mtext AS (SELECT post_id, {v} AS text FROM grouped),".format(v=voiced("text")) + _valence_ctes("mtext", "post_id")
MELTED = "UNION ALL ".join(
    f"SELECT post_id, grp AS \"group\", '{v}' AS variable, {v} AS value FROM sent JOIN grouped USING (post_id) WHERE grp <> '' "
    for v in ("negative", "neutral", "positive", "compound")
)
STATS = ", ".join(
    f"round(avg({v}), 10) AS {v}_mean, round(stddev_samp({v}), 10) AS {v}_std" for v in ("negative", "neutral", "positive", "compound")
)
TOPIC_FLAGS = ", ".join(f"CAST(list_contains(topics, '{t}') AS INTEGER) AS {t}" for t in V.TOPICS)
METRICS = """count(*) AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END), 10) AS accuracy,
    round(coalesce(sum(label * prediction) / nullif(sum(prediction), 0), 0), 10) AS "precision",
    round(coalesce(sum(label * prediction) / nullif(sum(label), 0), 0), 10) AS recall"""
GROUPS = ["dem-lead", "dem-base", "rep-lead", "rep-base"]
TOPIC_STATS = """
    SELECT topic AS "Topic", grp AS "Group", round(avg(prediction_class), 10) AS "Mean_Class", round(stddev_samp(prediction_raw), 10) AS "Std"
    FROM (SELECT unnest(topics) AS topic, grp, prediction_class, prediction_raw FROM scored WHERE grp <> '') GROUP BY ALL"""


def _tfidf(tokens: str, idf: str, min_df: float) -> str:
    return _with("toks", """SELECT post_id, term, tf, round(CASE WHEN norm > 0 THEN w / norm ELSE 0 END, 6) AS tfidf
        FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY post_id)) AS norm FROM wt)""", f"""
        tw AS (SELECT post_id, unnest({tokens}) AS term FROM toks),
        bag AS MATERIALIZED (SELECT post_id, term, count(*) AS tf FROM tw GROUP BY ALL),
        size AS (SELECT count(*) AS n FROM documents),
        idf AS (SELECT term, {idf} AS idf FROM (SELECT term, count(*) AS df FROM bag GROUP BY term), size WHERE df >= {min_df} * n),
        wt AS (SELECT post_id, term, tf, tf * idf AS w FROM bag JOIN idf USING (term))""")


def _splits(table: str, key: str, seed: int) -> str:
    return f"""SELECT {key}, CASE WHEN k <= floor(n * CAST(0.7 AS DOUBLE) + 0.5) THEN 'train'
        WHEN k <= floor(n * CAST(0.9 AS DOUBLE) + 0.5) THEN 'test' ELSE 'valid' END AS split
        FROM (SELECT {key}, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('{seed}:' || {key})) AS k FROM {table})"""


ORACLE: dict[str, str] = {
    "scan_csv_typed": _with("posts", f"SELECT CAST(post_id AS VARCHAR) AS tweet_id, {day('post_date')} AS tweet_date, text AS tweet_text, user_id, CAST(retweet_count AS INTEGER) AS retweet_count, CAST(favorite_count AS INTEGER) AS favorite_count FROM posts"),
    "scan_lookup": _with("accounts", "SELECT * FROM accounts"),
    "scan_id_list": "SELECT CAST(doc_id AS VARCHAR) AS id FROM labels",
    "hydrate_ids": _with("posts", f"SELECT post_id, {day('post_date')} AS post_date, text, user_id, retweet_count, favorite_count FROM posts WHERE post_id IN (SELECT doc_id FROM labels) AND post_id % 10 <> 3"),
    "scan_projected": "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem",
    "sink_replace_table": _with("posts", f"SELECT post_id, {day('post_date')} AS post_date, user_id, branch, retweet_count FROM posts"),
    "sink_csv": _with("toks", f"SELECT post_id, {flat('tokens')} AS tokens FROM toks"),
    "check_constraints": _with("posts", """
        SELECT * FROM (
        SELECT 'tweet_id' AS "column", 'not_null' AS rule, count(*) FILTER (post_id % 17 = 0) AS violations FROM posts UNION ALL
        SELECT 'user_id', 'not_null', count(*) FILTER (user_id IS NULL) FROM posts UNION ALL
        SELECT 'tweet_id', 'max_length_2', count(*) FILTER (post_id % 17 <> 0 AND length(CAST(post_id AS VARCHAR)) > 2) FROM posts UNION ALL
        SELECT 'tweet_text', 'max_length_1500', count(*) FILTER (length(text) > 1500) FROM posts UNION ALL
        SELECT 'user_id', 'max_length_4', count(*) FILTER (length(user_id) > 4) FROM posts)"""),
    "rename_columns": "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer",
    "drop_columns": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
    "cast_columns": f"SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(trunc(o_totalprice) AS INTEGER) AS price_int, CAST(o_orderkey AS DOUBLE) AS key_double, CAST(o_orderstatus = 'F' AS INTEGER) AS finished, {day('o_orderdate')} AS day, TRY_CAST(o_orderpriority AS INTEGER) AS not_a_number FROM orders",
    "recode_label": "SELECT doc_id, quality AS label FROM labels JOIN documents USING (doc_id)",
    "filter_date_range": _with("posts", f"SELECT post_id, {day('post_date')} AS post_date FROM posts WHERE post_date BETWEEN date '2018-01-01' AND date '2019-01-01'"),
    "filter_keyword": _with("toks", f"SELECT post_id, {flat('tokens')} AS tokens FROM toks WHERE post_date BETWEEN date '2018-01-01' AND date '2019-01-01' AND len(list_filter(tokens, lambda x: contains(x, 'th'))) > 0 ORDER BY post_id LIMIT 10000"),
    "filter_nonempty_tokens": _with("toks", "SELECT post_id, CAST(n AS INTEGER) AS n FROM (SELECT post_id, len(list_filter(tokens, lambda x: starts_with(x, '#'))) AS n FROM toks) WHERE n > 0"),
    "filter_topic": _with("master", "SELECT post_id, user_id, leadership FROM master WHERE list_contains(topics, 'topic_2')"),
    "filter_tagged": _with("tagged", "SELECT post_id, branch FROM tagged WHERE len(topics) > 0"),
    "filter_in_list": _with("grouped", f"SELECT * FROM ({MELTED}) WHERE variable IN ('negative', 'positive')", MASTER_SENT),
    "flag_leadership": _with("posts", "SELECT post_id, CAST(branch IN ('senate', 'house') AS INTEGER) AS leadership FROM posts"),
    "map_party": _with("accounts", "SELECT user_id, CASE party_affiliation WHEN 'D' THEN 1 WHEN 'R' THEN 0 END AS democrat FROM accounts"),
    "assign_group": _with("grouped", 'SELECT post_id, grp AS "group" FROM grouped'),
    "class_indicators": _with("preds", "SELECT post_id, CAST(prediction_class = 0 AS INTEGER) AS negative, CAST(prediction_class = 1 AS INTEGER) AS positive FROM preds"),
    "threshold_prediction": "SELECT doc_id, round(p, 6) AS p, CAST(p > 0.5 AS INTEGER) AS prediction FROM (SELECT doc_id, 1.0 / (1.0 + exp(-(doc_id % 201 - 100) / 25.0::DOUBLE)) AS p FROM documents)",
    "parse_token_list": _with("toks", "SELECT post_id, coalesce(array_to_string(list_transform(tokens, lambda x: CASE WHEN contains(x, 'th') THEN x || '''s' ELSE x END), ' '), '') AS tokens FROM toks"),
    "join_accounts": _with("posts accounts", "SELECT post_id, user_id, branch, CASE party_affiliation WHEN 'D' THEN 1 WHEN 'R' THEN 0 END AS democrat FROM posts JOIN accounts USING (user_id)"),
    "join_predictions": _with("scored", "SELECT post_id, user_id, prediction_raw, prediction_class FROM scored"),
    "join_lexicon": _with("matched", f"SELECT post_id, {flat('topics')} AS topics FROM matched"),
    "join_idf": _with("dfs", "SELECT post_id, term, tf, 1.0::DOUBLE / df AS weight FROM bags JOIN dfs USING (term)"),
    "join_embeddings": f"""WITH lab AS (SELECT doc_id, {no_stop('t')} AS tokens FROM (SELECT doc_id, {tokenize('p')} AS t FROM (SELECT doc_id, {shortened('l')} AS p FROM (SELECT doc_id, string_split({plain('text')}, '') AS l FROM documents JOIN labels USING (doc_id))))),
        tk AS (SELECT doc_id, unnest(tokens) AS term FROM lab),
        voc AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS vec_id FROM tk GROUP BY term ORDER BY count(*) DESC, term LIMIT 25000),
        vec AS (SELECT term, CAST(embedding[1] AS DOUBLE) AS f FROM voc JOIN embeddings USING (vec_id))
        SELECT doc_id, count(*) AS n_tokens, CAST(count(*) FILTER (f <> 0) AS BIGINT) AS n_known, round(coalesce(sum(f), 0), 4) AS sum_first FROM tk LEFT JOIN vec USING (term) GROUP BY doc_id""",
    "anti_join_stopwords": _with("raw", f"SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM raw) WHERE term NOT IN {STOP} GROUP BY term"),
    "agg_sentiment_by_group": _with("grouped", f"SELECT democrat, leadership, {STATS}, count(*) AS negative_count FROM sent JOIN grouped USING (post_id) WHERE democrat IS NOT NULL GROUP BY ALL", MASTER_SENT),
    "count_by_topic": _with("master", "SELECT " + ", ".join(f"CAST(sum(CAST(list_contains(topics, '{t}') AS INTEGER)) AS BIGINT) AS {t}" for t in V.TOPICS) + " FROM master"),
    "class_size": _with("preds", "SELECT prediction_class, count(*) AS n FROM preds GROUP BY ALL"),
    "group_mean": _with("scored", 'SELECT grp AS "group", round(avg(prediction_class), 10) AS mean_prediction_class FROM scored GROUP BY ALL'),
    "topic_group_stats": _with("scored", f"""
        SELECT "Topic", "Group", "Mean_Class", "Std" FROM (
            SELECT * FROM (SELECT unnest({_list(V.TOPICS + ['topic_without_posts'])}) AS "Topic"),
                          (SELECT unnest({_list(GROUPS)}) AS "Group")) grid
        LEFT JOIN ({TOPIC_STATS}) cells USING ("Topic", "Group")"""),
    "pivot_topic_group": _with("scored", 'SELECT "Topic", ' + ", ".join(
        f"max(\"{v}\") FILTER (\"Group\" = '{g}') AS {v}_{g.replace('-', '_')}" for v in ("Mean_Class", "Std") for g in GROUPS
    ) + f' FROM ({TOPIC_STATS}) GROUP BY "Topic"'),
    "melt_scores": _with("grouped", MELTED, MASTER_SENT),
    "multilabel_binarize": _with("tagged", f"SELECT post_id, {TOPIC_FLAGS} FROM tagged"),
    "distinct_topics": _with("tagged", "SELECT DISTINCT unnest(topics) AS topic FROM tagged"),
    "term_counts": _with("terms", "SELECT term, n FROM terms"),
    "bag_of_words": _with("bags", "SELECT * FROM bags"),
    "doc_frequency": _with("dfs", "SELECT term, df, 1.0::DOUBLE / df AS weight FROM dfs"),
    "dictionary_build": _with("dfs", "SELECT term, df, row_number() OVER (ORDER BY md5('dictionary:' || term)) - 1 AS term_id FROM dfs"),
    "dictionary_filter_extremes": _with("dfs", "SELECT term, df FROM dfs WHERE df >= 15 AND df <= floor(0.8 * (SELECT count(*) FROM documents)) ORDER BY df DESC, term LIMIT 10000"),
    "vocab_topn": _with("terms", "SELECT term, n, row_number() OVER (ORDER BY n DESC, term) + 1 AS term_id FROM terms QUALIFY term_id <= 25001 UNION ALL SELECT '<unk>', 0, 0 UNION ALL SELECT '<pad>', 0, 1"),
    "split_sizes": f"SELECT split, count(*) AS n FROM ({_splits('documents', 'doc_id', 1234)}) GROUP BY split",
    "binary_metrics": _with("labelled", f"SELECT {METRICS} FROM labelled"),
    "mean_by_variable_group": _with("grouped", f'SELECT variable, "group", round(avg(value), 10) AS mean FROM ({MELTED}) GROUP BY ALL', MASTER_SENT),
    "top_words_per_group": _with("cells", 'SELECT topic, grp AS "group", prediction_class AS "class", term, n FROM cells QUALIFY row_number() OVER (PARTITION BY topic, grp, prediction_class ORDER BY n DESC, term) <= 10'),
    "top_tfidf_per_group": _with("cells", """
        SELECT topic, grp AS "group", prediction_class AS "class", term, round(n * w, 6) AS score FROM cells JOIN (
            SELECT term, 1.0::DOUBLE / count(*) AS w FROM (SELECT unnest(list_distinct(tokens)) AS term FROM scored) GROUP BY term) USING (term)
        QUALIFY row_number() OVER (PARTITION BY topic, grp, prediction_class ORDER BY n * w DESC, term) <= 10"""),
    "topn_terms": _with("toks", f"SELECT term, count(*) AS n FROM (SELECT unnest(list_filter({bigrams('tokens')}, lambda x: NOT regexp_matches(x, '(^|_)[#@]'))) AS term FROM toks) GROUP BY term ORDER BY n DESC, term LIMIT 1000"),
    "sample_n": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY md5('7:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey) LIMIT 20000",
    "sample_n_per_source": _with("posts", "SELECT branch, post_id FROM posts WHERE post_date BETWEEN date '2018-01-01' AND date '2019-01-01' QUALIFY row_number() OVER (PARTITION BY branch ORDER BY md5('5:' || post_id)) <= 100"),
    "sample_large_per_source": "SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('5:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey)) <= 15000",
    "sample_n_per_group": _with("grouped", "SELECT grp AS \"group\", post_id FROM grouped WHERE grp <> '' QUALIFY row_number() OVER (PARTITION BY grp ORDER BY md5('3:' || post_id)) <= 10"),
    "preview": _with("posts", f"SELECT post_id, {day('post_date')} AS post_date, user_id, text FROM posts ORDER BY post_id LIMIT 5"),
    "union_distinct_master": _with("master", f"SELECT post_id, {day('post_date')} AS post_date, user_id, retweet_count, favorite_count, {flat('tokens')} AS tokens, CAST(leadership AS INTEGER) AS leadership, CAST(democrat AS INTEGER) AS democrat, {TOPIC_FLAGS} FROM master"),
    "union_all_docs": "SELECT 'documents' AS origin, doc_id AS id, length(text) AS chars FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark UNION ALL SELECT 'conversations', conv_id, length(text) FROM conversations",
    "bigram_lexicon_intersect": _with("tagged", "SELECT post_id, CAST(len(topics) > 0 AS INTEGER) AS political FROM tagged"),
    "strip_punctuation": f"SELECT doc_id, translate(text, {_q(T.PUNCTUATION)}, '') AS text FROM documents",
    "strip_urls": f"SELECT page_id, regexp_replace(url || ' ' || html, {_q(T.URL)}, '', 'g') AS text, {plain('(url || chr(32) || html)')} AS glued FROM pages",
    "tokenize_text": _with("raw", f"SELECT post_id, {flat('tokens')} AS tokens FROM raw"),
    "strip_handles": _with("posts", f"SELECT post_id, regexp_replace(text, {_q(RE2_HANDLE)}, '\\1 ', 'g') AS text FROM posts"),
    "strip_hashtags": _with("raw", f"SELECT post_id, CAST(len(tokens) AS INTEGER) AS n, {flat(no_tags('tokens'))} AS none, {flat(chr(108) + 'ist_filter(tokens, lambda x: x <> ' + _q('#of') + ')')} AS unlisted FROM raw"),
    "remove_stopwords": _with("toks", f"SELECT post_id, {flat('tokens')} AS tokens FROM toks"),
    "make_bigrams": _with("toks", f"SELECT post_id, CAST(len(pairs) AS INTEGER) AS n, {flat('pairs')} AS pairs FROM (SELECT post_id, {bigrams('tokens')} AS pairs FROM toks)"),
    "tokens_plus_bigrams": _with("grams", f"SELECT post_id, {flat('grams')} AS grams FROM grams"),
    "filter_marked_bigrams": _with("toks", f"SELECT post_id, {flat('pairs')} AS pairs FROM (SELECT post_id, list_filter({bigrams('tokens')}, lambda x: NOT regexp_matches(x, '(^|_)[#@]')) AS pairs FROM toks) WHERE len(pairs) > 0"),
    "join_tokens": _with("toks", f"SELECT post_id, {flat('tokens')} AS doc FROM toks"),
    "token_length": _with("toks", "SELECT post_id, CAST(len(tokens) AS INTEGER) AS len FROM toks"),
    "tag_topics": _with("tagged", f"SELECT post_id, {flat('topics')} AS topics FROM tagged"),
    "tfidf_features": _tfidf(f"regexp_extract_all(array_to_string(tokens, ' '), {_q(T.VECTOR_WORD)})", "ln((1.0 + n) / (1.0 + df)) + 1.0", 1e-4),
    "tfidf_log2": _tfidf("tokens", "log2(n::DOUBLE / df)", 0),
    "stratified_split": _with("cut", "SELECT doc_id, label, split FROM cut"),
    "random_split": _splits("orders", "o_orderkey", 11),
    "stratified_folds": "SELECT doc_id, quality AS label, CAST(row_number() OVER (PARTITION BY quality ORDER BY md5('1234:fold:' || doc_id)) % 5 AS INTEGER) AS fold FROM labels",
    "evaluate_splits": _with("cut", f"SELECT 'fixed' AS family, split, {METRICS} FROM cut WHERE split <> 'train' GROUP BY split"),
    "lexicon_sentiment": "WITH src AS (SELECT doc_id, " + voiced("text") + " AS text FROM documents)," + _valence_ctes("src", "doc_id") + " SELECT * FROM sent",
    "lexicon_sentiment_by_topic": _with("grouped", f"SELECT topic, democrat, leadership, {STATS}, count(*) AS negative_count FROM (SELECT unnest(topics) AS topic, democrat, leadership, negative, neutral, positive, compound FROM sent JOIN grouped USING (post_id) WHERE democrat IS NOT NULL) GROUP BY ALL", MASTER_SENT),
}

_LEMMA = """
    words AS (SELECT DISTINCT unnest(tokens) AS term FROM raw),
    lem AS (
        SELECT term AS token, 'n' AS pos, substr(term, 1, length(term) - 1) AS lemma FROM words WHERE term LIKE '%s' AND length(term) > 3
        UNION ALL SELECT term, 'v', substr(term, 1, length(term) - 3) FROM words WHERE term LIKE '%ing' AND length(term) > 5),
    known AS (SELECT * FROM lem WHERE lemma IN (SELECT term FROM words)),
"""


def _lemmatized(source: str) -> str:
    return f"""
    ex AS (SELECT post_id, unnest(tokens) AS t, unnest(range(1, len(tokens) + 1)) AS i FROM {source}),
    lx AS (SELECT post_id, list(coalesce(lemma, t) ORDER BY i) AS lemmas FROM ex
           LEFT JOIN known ON token = t AND pos = CASE WHEN t LIKE '%ing' THEN 'v' ELSE 'n' END GROUP BY post_id)"""


ORACLE["lemmatize_lookup"] = _with(
    "raw", f"SELECT post_id, {flat('lemmas')} AS tokens FROM raw LEFT JOIN lx USING (post_id)", _LEMMA.strip() + _lemmatized("raw")
)
ORACLE["clean_chain"] = _with("lexicon raw", f"""
    SELECT post_id, user_id, branch, {flat('fin.tokens')} AS tokens, CAST(branch IN ('senate', 'house') AS INTEGER) AS leadership, {TOPIC_FLAGS}
    FROM fin JOIN hit USING (post_id) JOIN posts USING (post_id)""", _LEMMA.strip() + f"""
    stripped AS (SELECT post_id, list_filter({tokenize('p')}, lambda x: x <> '#of') AS tokens
                 FROM (SELECT post_id, {shortened('l')} AS p FROM (
                     SELECT post_id, string_split(regexp_replace({plain('text')}, {_q(RE2_HANDLE)}, '\\1 ', 'g'), '') AS l FROM posts))),
    {_lemmatized('stripped').strip()},
    fin AS (SELECT post_id, {no_stop('lemmas')} AS tokens FROM lx),
    fw AS (SELECT post_id, {no_tags('tokens')} AS w FROM fin),
    fg AS (SELECT post_id, list_concat(w, {bigrams('w')}) AS g FROM fw),
    hit AS (SELECT post_id, list_sort(list(DISTINCT topic)) AS topics FROM (SELECT post_id, unnest(list_distinct(g)) AS bigram FROM fg)
            JOIN lexicon USING (bigram) WHERE topic <> 'x' GROUP BY post_id)""")
ORACLE["clean_pipeline"] = ORACLE["clean_chain"]
# Rows whose ids repeat: every turn stands for itself, so the twins number the rows.
ORACLE["sentiment_repeated_ids"] = (
    "WITH src AS (SELECT row_number() OVER () AS k, conv_id, " + voiced("text") + " AS text FROM conversations),"
    + _valence_ctes("src", "k") + " SELECT conv_id, sent.* EXCLUDE (k) FROM sent JOIN src USING (k)"
)
ORACLE["tags_repeated_ids"] = _with("lexicon", f"""
    SELECT conv_id, CAST(len(t) AS INTEGER) AS n, coalesce({flat('topics')}, '') AS topics FROM turns LEFT JOIN hit USING (k)""", f"""
    turns AS (SELECT row_number() OVER () AS k, conv_id, string_split(text, ' ') AS t FROM conversations),
    hit AS (SELECT k, list_sort(list(DISTINCT topic)) AS topics FROM (SELECT k, unnest(list_distinct({bigrams('t')})) AS bigram FROM turns)
            JOIN lexicon USING (bigram) WHERE topic <> 'x' GROUP BY k)""")
ORACLE["lemmas_repeated_ids"] = _with("raw", f"SELECT conv_id, {flat('lemmas')} AS tokens FROM turns JOIN lx ON post_id = k", _LEMMA.strip() + f"""
    turns AS (SELECT row_number() OVER () AS k, conv_id, string_split(text, ' ') AS tokens FROM conversations),
    {_lemmatized('(SELECT k AS post_id, tokens FROM turns)').strip()}""")
ORACLE["model_save_load"] = "SELECT doc_id, 1 AS same FROM labels JOIN documents USING (doc_id)"
ORACLE["sample_lines_per_file"] = _with("posts", "SELECT branch, CAST(post_id AS VARCHAR) AS value FROM posts QUALIFY row_number() OVER (PARTITION BY branch ORDER BY md5('0:' || post_id || ':1')) <= 5")
ORACLE["mean_with_ci_by_topic"] = _with("grouped", f"""
    SELECT topic, variable, "group", round(avg(value), 10) AS mean, 1 AS inside
    FROM (SELECT post_id, unnest(topics) AS topic FROM grouped) JOIN ({MELTED}) USING (post_id) GROUP BY ALL""", MASTER_SENT)


# ---- classifiers -----------------------------------------------------------------------
def _features(body: str) -> str:
    """The labelled texts (``lsplit``) and their weighted terms (``lx``), fitted on the training part."""
    raw = f"SELECT doc_id, label, {tokenize('p')} AS tokens FROM (SELECT doc_id, label, {shortened('l')} AS p FROM (SELECT doc_id, quality AS label, string_split({plain('text')}, '') AS l FROM labels JOIN documents USING (doc_id)))"
    return f"""WITH ltoks AS MATERIALIZED (SELECT doc_id, label, {no_stop('tokens')} AS tokens FROM ({raw})),
    lsplit AS MATERIALIZED (
        SELECT doc_id, label, tokens, CASE WHEN k <= floor(n * CAST(0.1 AS DOUBLE) + 0.5) THEN 'test'
            WHEN k <= floor(n * CAST(0.3 AS DOUBLE) + 0.5) THEN 'valid' ELSE 'train' END AS split
        FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5('1234:' || doc_id)) AS k
              FROM ltoks WHERE len(tokens) > 0)),
    lbag AS MATERIALIZED (
        SELECT doc_id, split, term, count(*) AS tf
        FROM (SELECT doc_id, split, unnest(regexp_extract_all(array_to_string(tokens, ' '), {_q(T.VECTOR_WORD)})) AS term FROM lsplit) GROUP BY ALL),
    lsize AS (SELECT count(*) AS n FROM lsplit WHERE split = 'train'),
    lidf AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
             FROM (SELECT term, count(*) AS df FROM lbag WHERE split = 'train' GROUP BY term), lsize WHERE df >= 0.0001 * n),
    lx AS MATERIALIZED (SELECT doc_id, term, w / norm AS x FROM (
        SELECT doc_id, term, w, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS norm FROM (SELECT doc_id, term, tf * idf AS w FROM lbag JOIN lidf USING (term)))),
    ltrain AS (SELECT doc_id, label FROM lsplit WHERE split = 'train'),
    {body}"""


def _gaussian() -> str:
    per = lambda text: ", ".join(text.format(k=k) for k in (0, 1))
    return _features(f"""
    sizes AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM ltrain),
    moments AS (
        SELECT term, sum(x) AS s, sum(x * x) AS q, {per('coalesce(sum(x) FILTER (label = {k}), 0) AS s{k}, coalesce(sum(x * x) FILTER (label = {k}), 0) AS q{k}')}
        FROM lx JOIN ltrain USING (doc_id) GROUP BY term),
    eps AS (SELECT 1e-9 * max(q / n - (s / n) * (s / n)) AS e FROM moments, sizes),
    spread AS MATERIALIZED (SELECT term, {per('s{k} / n{k} AS m{k}, greatest(q{k} / n{k} - (s{k} / n{k}) * (s{k} / n{k}), 0) + e AS v{k}')} FROM moments, sizes, eps),
    base AS (SELECT {per('ln(any_value(n{k}) / any_value(n)) - 0.5 * sum(ln(2 * pi() * v{k}) + m{k} * m{k} / v{k}) AS b{k}')} FROM spread, sizes),
    sums AS (SELECT doc_id, {per('sum((x * m{k} - 0.5 * x * x) / v{k}) AS t{k}')} FROM lx JOIN spread USING (term) GROUP BY doc_id),
    said AS (SELECT doc_id, split, label, CAST(coalesce(t1, 0) + b1 > coalesce(t0, 0) + b0 AS INTEGER) AS prediction FROM lsplit LEFT JOIN sums USING (doc_id), base)
    SELECT split, {METRICS} FROM said GROUP BY split""")


def _logistic(result: str) -> str:
    step, reg = 1 / (0.5 + V.LOGISTIC["reg"]), V.LOGISTIC["reg"]
    rounds = ["w0 AS MATERIALIZED (SELECT term, 0.0::DOUBLE AS w, 0.0::DOUBLE AS p FROM (SELECT DISTINCT term FROM lall JOIN ltrain USING (doc_id)))"]
    t = 1.0
    for k in range(V.LOGISTIC["rounds"]):
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        rounds.append(f"""v{k} AS MATERIALIZED (SELECT term, w, w + {(t - 1) / after!r}::DOUBLE * (w - p) AS v FROM w{k}),
    r{k} AS (SELECT doc_id, 1.0 / (1.0 + exp(-sum(x * v))) - any_value(label) AS r FROM lall JOIN ltrain USING (doc_id) JOIN v{k} USING (term) GROUP BY doc_id),
    w{k + 1} AS MATERIALIZED (
        SELECT term, v - {step!r}::DOUBLE * (g / n + CASE WHEN term = '' THEN 0 ELSE {reg!r}::DOUBLE * v END) AS w, w AS p
        FROM v{k} JOIN (SELECT term, sum(r * x) AS g FROM lall JOIN r{k} USING (doc_id) GROUP BY term) USING (term), lsize)""")
        t = after
    return _features(f"""
    lall AS MATERIALIZED (SELECT doc_id, term, x FROM lx UNION ALL SELECT doc_id, '', 1.0 FROM lsplit),
    {", ".join(rounds)},
    said AS (SELECT doc_id, 1.0 / (1.0 + exp(-sum(x * w))) AS p FROM lall JOIN w{V.LOGISTIC["rounds"]} USING (term) GROUP BY doc_id)
    SELECT doc_id, {result} FROM said""")


ORACLE["master_by_chunks"] = ORACLE["union_distinct_master"]
ORACLE["train_gaussian_nb"] = _gaussian()
ORACLE["predict_class"] = _logistic("CAST(p > 0.5 AS INTEGER) AS prediction")
ORACLE["predict_proba"] = _logistic("round(p, 6) AS p")
