"""The queries of ``plans.queries`` in plain SQL, for checking on whole tables.

Written step by step and apart from the Spark code; long statements are put
together from common table expressions.
"""

from __future__ import annotations

from phrasemill.functions.params import params_text
from phrasemill.functions.tokens import SMALL_NUMBERS
from phrasemill.operators.words import COLOURS
from phrasemill.plans.classifiers import CLASSIFIERS, combinations
from phrasemill.plans.tables import CATEGORIES, DIM, RUNS, SOME_NEIGHBOURS

CATS = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
NAMES = "[" + ", ".join(f"'{n}'" for n in SMALL_NUMBERS) + "]"
SPACE = r"[ \t\n\x0B\f\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROPPED = "'^(@|&|http|www)'"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _tokens(text: str) -> str:
    spaced = rf"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '(http|www|@|#)', ' \1', 'g')"
    return f"list_filter(regexp_split_to_array({spaced}, '{SPACE}+'), lambda t: t <> '')"


def _words(text: str) -> str:
    kept = f"array_to_string(list_filter({_tokens(text)}, lambda t: NOT regexp_matches(t, {DROPPED})), ' ')"
    plain = f"list_filter(string_split(regexp_replace({kept}, '[^a-z0-9]', ' ', 'g'), ' '), lambda w: w <> '')"
    return (f"list_transform({plain}, lambda w: CASE WHEN regexp_full_match(w, '0*(1?[0-9]|2[01])') "
            f"THEN {NAMES}[TRY_CAST(w AS INTEGER) + 1] ELSE w END)")


def _word_lists(name: str, source: str, keep: str, text: str = "text") -> str:
    return (f"{name} AS (SELECT * FROM (SELECT {keep}, {_words(text)} AS words FROM {source}) WHERE len(words) > 0)")


LABEL = f"CAST(list_position({CATS}, lang) - 1 AS INTEGER) AS label"
DOCS = f"docs AS (SELECT doc_id AS row_id, {LABEL}, text FROM documents)"
LISTS = _word_lists("lists", "docs", "row_id, label")
VOCAB = """dfreq AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS word FROM lists) GROUP BY word),
vocab AS (SELECT word, df, row_number() OVER (ORDER BY df DESC, word) - 1 AS rank FROM dfreq),
vectors AS (SELECT word, df, rank, CAST(embedding AS DOUBLE[]) AS vec FROM vocab JOIN embeddings ON rank = vec_id)"""
TEXTS = [DOCS, LISTS]
WORDS = [DOCS, LISTS, VOCAB]


def _positions(name: str, source: str, keep: str) -> str:
    return (f"{name} AS (SELECT {keep}, unnest(words) AS word, "
            f"unnest(range(0, CAST(len(words) AS BIGINT))) AS pos FROM {source})")


def _sums(name: str, source: str, keep: str) -> str:
    """Sum of the word vectors of each text of ``source``."""
    each = ", ".join(f"coalesce(sum(vec[{i}]), 0.0)" for i in range(1, DIM + 1))
    return (f"{_positions(name + '_tokens', source, keep)},\n"
            f"{name} AS (SELECT {keep}, [{each}] AS vec FROM {name}_tokens LEFT JOIN vectors USING (word) GROUP BY {keep})")


TEXT_POINTS = WORDS + [_sums("points", "lists", "row_id, label")]
POINTS = ["points AS (SELECT vec_id AS row_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"]


def _ntile(folds: int, name: str, source: str, out: str = "fold") -> str:
    return (f"{name} AS (SELECT *, CAST(ntile({folds}) OVER (PARTITION BY label ORDER BY row_id) - 1 AS INTEGER) "
            f"AS {out} FROM {source})")


SPLIT = [_ntile(5, "cut", "points"),
         "split AS (SELECT * EXCLUDE (fold), fold = 0 AS is_test, CAST(NULL AS INTEGER) AS cv_fold FROM cut WHERE fold = 0 "
         "UNION ALL SELECT * EXCLUDE (fold), false, CAST(ntile(5) OVER (PARTITION BY label ORDER BY row_id) - 1 AS INTEGER) "
         "FROM cut WHERE fold > 0)"]
HELD_OUT = POINTS + SPLIT


def _distance(p: int | str) -> str:
    """For a power that is only known to the query, as a SQL expression, all three forms."""
    if isinstance(p, str):
        forms = [_distance(i) for i in (1, 2)] + [_distance(3).replace(", 3)", f", {p})").replace("1.0 / 3", f"1.0 / {p}")]
        return f"CASE {p} WHEN 1 THEN {forms[0]} WHEN 2 THEN {forms[1]} ELSE {forms[2]} END"
    gaps = [f"(q.vec[{i}] - t.vec[{i}])" for i in range(1, DIM + 1)]
    if p == 1:
        return "round(" + " + ".join(f"abs{g}" for g in gaps) + ", 9)"
    if p == 2:
        return "round(sqrt(" + " + ".join(f"{g} * {g}" for g in gaps) + "), 9)"
    return "round(pow(" + " + ".join(f"pow(abs{g}, {p})" for g in gaps) + f", 1.0 / {p}), 9)"


def _near(queries: str, train: str, k: int | str, p: int | str, keep: str = "", cond: str = "true",
          name: str = "near") -> str:
    """Neighbours: query columns, ``tid``, ``tlabel``, ``d``, ``place`` (from 0), ``first`` (smallest d)."""
    return f"""{name} AS (
SELECT *, min(d) OVER (PARTITION BY row_id) AS first FROM (
SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, tid) - 1 AS place FROM (
SELECT q.row_id{keep}, t.row_id AS tid, t.label AS tlabel, {_distance(p)} AS d
FROM {queries} q JOIN {train} t ON {cond})) WHERE place < {k})"""


WEIGHT = {"uniform": "1.0", "distance": "CASE WHEN first = 0 THEN CAST(d = 0 AS INTEGER) ELSE 1.0 / d END"}
WEIGHT["best"] = f"CASE (SELECT weights FROM top) WHEN 'uniform' THEN 1.0 ELSE {WEIGHT['distance']} END"


def _votes(weights: str, keep: str, classes: str, source: str = "near") -> list[str]:
    """``votes``: one row per query and class with its share; ``predicted``: the winning class."""
    names = [c for c in keep.split(", ") if c]
    cols = ", ".join(["row_id", *names])
    return [
        f"cast_votes AS (SELECT {cols}, tlabel, sum(CAST({WEIGHT[weights]} AS DOUBLE)) AS v FROM {source} GROUP BY {cols}, tlabel)",
        f"votes AS (SELECT {cols}, c.tlabel, coalesce(v, 0.0) AS v, coalesce(v, 0.0) / sum(v) OVER (PARTITION BY row_id) AS share "
        f"FROM (SELECT DISTINCT {cols} FROM {source}) CROSS JOIN ({classes}) c LEFT JOIN cast_votes USING ({cols}, tlabel))",
        f"predicted AS (SELECT {cols}, tlabel AS prediction, share AS best FROM votes "
        f"QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(v, 9) DESC, tlabel) = 1)"]


POINT_CLASSES = "SELECT DISTINCT label AS tlabel FROM points"
TEST = "(SELECT * FROM split WHERE is_test)"
TRAIN = "(SELECT * FROM split WHERE NOT is_test)"


def _predict(weights: str, k: int, p: int) -> list[str]:
    return HELD_OUT + [_near(TEST, TRAIN, k, p, ", q.label")] + _votes(weights, "label", POINT_CLASSES)


def _r(value: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) + 0.0"


ORACLE: dict[str, str] = {}

# Texts and tokens

ORACLE["labelled_scan"] = _with(*TEXTS) + """
SELECT row_id, label, CAST(len(words) AS INTEGER) AS n_words, array_to_string(words, ' ') AS words FROM lists"""
ORACLE["processed_lines"] = _with(*TEXTS) + """
SELECT row_id, CAST(label AS VARCHAR) || ' ' || array_to_string(words, ',') AS line FROM lists"""
ORACLE["processed_roundtrip"] = _with(*TEXTS) + """
SELECT label, CAST(len(words) AS INTEGER) AS n_words, array_to_string(words, ' ') AS words FROM lists"""
ORACLE["category_dim"] = """
SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS idx, lang AS name
FROM (SELECT DISTINCT lang FROM documents)"""
ORACLE["tokenize"] = _with(*TEXTS) + """
SELECT row_id, CAST(len(words) AS INTEGER) AS n_words, CAST(len(list_distinct(words)) AS INTEGER) AS n_distinct,
md5(array_to_string(words, ' ')) AS digest FROM lists"""
ORACLE["token_filter_counts"] = _with(
    DOCS, f"toks AS (SELECT label, unnest({_tokens('text')}) AS t FROM docs)") + f"""
SELECT label, count(*) AS tokens, count(*) FILTER (WHERE regexp_matches(t, {DROPPED})) AS dropped FROM toks GROUP BY label"""
ORACLE["number_words"] = _with(*TEXTS) + f"""
SELECT label, word, count(*) AS n FROM (SELECT label, unnest(words) AS word FROM lists)
WHERE list_contains({NAMES}, word) GROUP BY label, word"""
FOLDED = r"regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')"
ORACLE["ascii_fold"] = f"""
SELECT doc_id AS row_id, CAST(length({FOLDED}) AS INTEGER) AS n_chars, md5({FOLDED}) AS digest FROM documents"""
ONE_LINE = f"replace(regexp_replace({FOLDED}, '^{SPACE}+|{SPACE}+$', '', 'g'), chr(10), '')"
MESSAGES = f"""messages AS (SELECT * FROM (
SELECT *, CAST(len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda t: t <> '')) AS INTEGER) AS n_tokens
FROM (SELECT doc_id AS row_id, {ONE_LINE} AS text FROM documents WHERE lang = 'en')) WHERE n_tokens >= 5)"""
ORACLE["stream_prefilter"] = _with(MESSAGES) + "SELECT row_id, n_tokens, md5(text) AS digest FROM messages"

# Words

ORACLE["unique_words"] = _with(*TEXTS) + "SELECT DISTINCT unnest(words) AS word FROM lists"
ONCE = "once AS (SELECT label, unnest(list_distinct(words)) AS word FROM lists)"
ORACLE["word_category_counts"] = _with(*TEXTS, ONCE) + """
SELECT word, label, count(*) AS n FROM once WHERE length(word) > 2 GROUP BY word, label"""
PROFILE = ("profile AS (SELECT word, count(*) AS total, "
           + ", ".join(f"count(*) FILTER (WHERE label = {i}) AS n_{c}" for i, c in enumerate(CATEGORIES))
           + " FROM once GROUP BY word)")
FREQUENT = ("frequent AS (SELECT * FROM profile WHERE length(word) > 2 AND total >= 3 "
            "AND word IN (SELECT word FROM vectors))")
LIST_N = "[" + ", ".join(f"n_{c}" for c in CATEGORIES) + "]"
DOMINANT = f"CAST(list_position({LIST_N}, list_max({LIST_N})) - 1 AS INTEGER)"
ORACLE["frequent_words"] = _with(*WORDS, ONCE, PROFILE, FREQUENT) + "SELECT * FROM frequent"
ORACLE["dominant_category"] = _with(*TEXTS, ONCE, PROFILE) + f"SELECT word, {DOMINANT} AS label, total FROM profile"


def _mixed(channel: int) -> str:
    cubes = [f"CAST(n_{c} AS DOUBLE) * n_{c} * n_{c}" for c in CATEGORIES]
    top = " + ".join(f"{float(COLOURS[i][channel])} * ({cube})" for i, cube in enumerate(cubes))
    return _r(f"({top}) / ({' + '.join(cubes)})")


ORACLE["word_category_mix"] = _with(*WORDS, ONCE, PROFILE, FREQUENT) + f"""
SELECT word, {_mixed(0)} AS red, {_mixed(1)} AS green, {_mixed(2)} AS blue FROM frequent"""
ORACLE["top_words_per_category"] = _with(*WORDS, ONCE, PROFILE, FREQUENT) + f"""
SELECT * FROM (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY total DESC, word) AS INTEGER) AS place,
word, total FROM (SELECT *, {DOMINANT} AS category FROM frequent)) WHERE place <= 75"""
ORACLE["word_vectors"] = _with(*WORDS) + """
SELECT word, rank, df, CAST(len(vec) AS INTEGER) AS dim,
CAST(list_sum(list_transform(vec, lambda x: CAST(round(x * 1000000) AS BIGINT))) AS BIGINT) AS checksum FROM vectors"""
ORACLE["vocab_coverage"] = _with(*WORDS) + """
SELECT count(*) AS words, count(v.word) AS covered, round(100.0 * count(v.word) / count(*), 2) AS percent
FROM dfreq LEFT JOIN vectors v ON v.word = dfreq.word"""
ORACLE["oov_words"] = _with(DOCS, LISTS.replace("AS (", "AS MATERIALIZED (", 1), VOCAB.split(",\nvectors AS")[0]) + """
SELECT word, df FROM vocab LEFT JOIN embeddings ON rank = vec_id WHERE vec_id IS NULL"""
ORACLE["token_vectors"] = _with(*WORDS, _positions("toks", "lists", "row_id")) + """
SELECT row_id, count(*) AS covered, CAST(min(pos) AS INTEGER) AS first_pos, CAST(sum(rank) AS BIGINT) AS rank_sum,
CAST(sum(CAST(round(vec[1] * 1000000) AS BIGINT)) AS BIGINT) AS units FROM toks JOIN vectors USING (word) GROUP BY row_id"""


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}[{i}] * {b}[{i}]" for i in range(1, DIM + 1)) + ")"


def _cosine(a: str, b: str) -> str:
    return f"{_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"


ORACLE["most_similar"] = _with(*WORDS) + f"""
SELECT v.word, round(100.0 * ({_cosine('v.vec', 'w.vec')}), 4) AS similarity
FROM vectors v JOIN vectors w ON w.word = 'the' AND v.word <> 'the' ORDER BY similarity DESC, v.word LIMIT 10"""
ORACLE["pairwise_similarity"] = _with(*WORDS, """sides AS (SELECT DISTINCT least(a, b) AS w1, greatest(a, b) AS w2 FROM (
SELECT unnest(words[1:len(words) - 1]) AS a, unnest(words[2:len(words)]) AS b FROM lists WHERE len(words) > 1))""") + f"""
SELECT w1, w2, round({_cosine('a.vec', 'b.vec')}, 6) AS similarity
FROM sides JOIN vectors a ON a.word = w1 JOIN vectors b ON b.word = w2 WHERE w1 < w2"""

# Text vectors

ORACLE["sum_embedding"] = _with(*TEXT_POINTS) + f"""
SELECT row_id, label, CAST(pos AS INTEGER) AS pos, {_r('value')} AS value
FROM (SELECT row_id, label, unnest(vec) AS value, unnest(range(0, {DIM})) AS pos FROM points)"""
ORACLE["concat_embedding"] = _with(*WORDS, _positions("toks", "lists", "row_id, label"), f"""
firsts AS (SELECT * FROM (SELECT row_id, vec, row_number() OVER (PARTITION BY row_id ORDER BY pos) - 1 AS slot
FROM toks JOIN vectors USING (word)) WHERE slot < 30),
items AS (SELECT row_id, slot * {DIM} + unnest(range(1, {DIM} + 1)) AS i, unnest(vec) AS v FROM firsts),
packed AS (SELECT row_id, count(*) FILTER (WHERE v <> 0) AS filled,
sum(CAST(round(v * 1000000) AS BIGINT) * i) AS checksum FROM items GROUP BY row_id)""") + f"""
SELECT row_id, label, CAST({30 * DIM} AS INTEGER) AS dim, CAST(coalesce(filled, 0) AS INTEGER) AS filled,
CAST(coalesce(checksum, 0) AS BIGINT) AS checksum FROM lists LEFT JOIN packed USING (row_id)"""

# Folds

ORACLE["class_balance"] = _with(*TEXTS) + "SELECT label, count(*) AS n FROM lists GROUP BY label"
ORACLE["stratified_folds"] = _with(*POINTS, _ntile(5, "cut", "points")) + "SELECT row_id, label, fold FROM cut"
ORACLE["folds_sparse_ids"] = _with("points AS (SELECT (vec_id * 7919 % 1000003) * 4294967296 + vec_id AS row_id, label FROM embeddings)",
                                   _ntile(5, "cut", "points")) + "SELECT row_id, label, fold FROM cut"
ORACLE["labelled_file_folds"] = _with(
    DOCS, "numbered AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, label, text FROM docs)",
    _word_lists("lists", "numbered", "row_id, label"), _ntile(5, "cut", "lists")) + "SELECT row_id, label, fold FROM cut"
ORACLE["nested_folds"] = _with(*HELD_OUT) + "SELECT row_id, label, is_test, coalesce(cv_fold, -1) AS cv_fold FROM split"
# The number of folds follows from the number of rows, so both that are possible at small sizes are cut here
# by position: the first block of a class of n rows has ceil(n / folds) rows.
ORACLE["stratified_sample"] = _with(DOCS, f"""sized AS (SELECT row_id, label,
row_number() OVER (PARTITION BY label ORDER BY row_id) AS place, count(*) OVER (PARTITION BY label) AS n,
greatest(CAST(floor(count(*) OVER () / {100.0 * len(CATEGORIES)}) AS BIGINT), 3) AS folds FROM docs)""") + """
SELECT row_id, label FROM sized WHERE place <= ceil(n / CAST(folds AS DOUBLE))"""
ORACLE["train_test_complement"] = _with(*HELD_OUT) + "SELECT row_id, label FROM split WHERE NOT is_test"
ORACLE["param_grid"] = _with(*POINTS, _ntile(5, "cut", "points")) + """
SELECT fold, count(*) AS n_test, (SELECT count(*) FROM points) - count(*) AS n_train,
CAST(pow(10.0, c) AS DOUBLE) AS "C", round(pow(10.0, g), 12) AS gamma
FROM cut CROSS JOIN range(3, 12) a(c) CROSS JOIN range(-7, -2) b(g) GROUP BY fold, c, g"""

# Nearest neighbours

ORACLE["knn_neighbors"] = _with(*HELD_OUT, _near(TEST, TRAIN, 12, 2)) + f"""
SELECT row_id, CAST(place AS INTEGER) AS place, tid AS neighbour_id, {_r('d')} AS distance FROM near"""
ORACLE["knn_cells"] = ORACLE["knn_neighbors"]
ORACLE["knn_predict"] = _with(*_predict("uniform", 12, 2)) + "SELECT row_id, label, prediction FROM predicted"
ORACLE["knn_predict_weighted"] = _with(*_predict("distance", 12, 1)) + "SELECT row_id, label, prediction FROM predicted"
SHARES = f"""SELECT row_id, CAST((SELECT count(*) FROM ({POINT_CLASSES}) c WHERE c.tlabel < votes.tlabel) AS INTEGER) AS pos,
{_r('share')} AS value FROM votes"""
ORACLE["knn_proba"] = _with(*_predict("uniform", 12, 3)) + SHARES
ORACLE["normalise_proba"] = _with(*_predict("distance", 12, 1)) + SHARES
ORACLE["confident_filter"] = _with(*_predict("uniform", 5, 2)) + f"""
SELECT row_id, prediction, {_r('best')} AS best FROM predicted WHERE row_id IN (
SELECT row_id FROM votes WHERE share >= 0.4 AND tlabel < (SELECT max(label) FROM points))"""
SCORE = """round(100.0 * avg(CAST(label = prediction AS INTEGER)), 2) AS score,
CAST(sum(CAST(label = prediction AS INTEGER)) AS BIGINT) AS hits, count(*) AS n"""
ORACLE["evaluate_split"] = _with(
    *HELD_OUT, _near("split", TRAIN, 12, 1, ", q.label, q.is_test"),
    *_votes("distance", "label, is_test", POINT_CLASSES)) + f"""
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, {SCORE} FROM predicted GROUP BY is_test"""
FOLDS = POINTS + [_ntile(5, "cut", "points")]
ORACLE["cross_validate_knn"] = _with(
    *FOLDS, _near("cut", "cut", 12, 2, ", q.label, q.fold", "q.fold <> t.fold"),
    *_votes("uniform", "label, fold", POINT_CLASSES)) + f"SELECT fold, {SCORE} FROM predicted GROUP BY fold"
ORACLE["sweep_without_pca"] = ORACLE["cross_validate_knn"].replace(f"SELECT fold, {SCORE} FROM predicted GROUP BY fold", """
SELECT fold, is_pca, CAST(sum(CAST(label = prediction AS INTEGER)) AS BIGINT) AS hits, count(*) AS n
FROM predicted CROSS JOIN (SELECT unnest([true, false]) AS is_pca) GROUP BY fold, is_pca""")


def _grid(ks: list[int], ps: list[int], source: str, fold: str) -> list[str]:
    """``picked``: one prediction per query and setting."""
    parts = [_near(source, source, max(ks), p, f", q.label, q.{fold} AS fold, {p} AS p", f"q.{fold} <> t.{fold}", f"near{p}")
             for p in ps]
    both = " UNION ALL ".join(f"SELECT * FROM near{p}" for p in ps)
    return parts + [f"near AS ({both})", f"""picked AS (
SELECT row_id, label, fold, p, n_neighbors, weights, tlabel AS prediction FROM (
SELECT row_id, label, fold, p, n_neighbors, weights, tlabel,
round(sum(CASE WHEN weights = 'uniform' THEN 1.0 ELSE {WEIGHT['distance']} END), 9) AS v
FROM near JOIN (SELECT unnest({ks}) AS n_neighbors) k ON place < n_neighbors
CROSS JOIN (SELECT unnest(['uniform', 'distance']) AS weights) w
GROUP BY row_id, label, fold, p, n_neighbors, weights, tlabel)
QUALIFY row_number() OVER (PARTITION BY row_id, p, n_neighbors, weights ORDER BY v DESC, tlabel) = 1)"""]


GRID = CLASSIFIERS["NearestNeighborsAlgorithm"].grid
WHOLE = _grid(GRID["n_neighbors"], GRID["p"], "cut", "fold")
ORACLE["cv_micro"] = _with(*FOLDS, *WHOLE) + """
SELECT CAST(n_neighbors AS INTEGER) AS n_neighbors, CAST(p AS INTEGER) AS p, weights,
round(100.0 * avg(CAST(label = prediction AS INTEGER)), 6) AS cv FROM picked GROUP BY ALL"""
ORACLE["cv_macro"] = _with(*FOLDS, *WHOLE) + """
SELECT CAST(n_neighbors AS INTEGER) AS n_neighbors, CAST(p AS INTEGER) AS p, weights, round(100.0 * avg(m), 6) AS cv FROM (
SELECT n_neighbors, p, weights, fold, avg(CAST(label = prediction AS INTEGER)) AS m FROM picked GROUP BY ALL)
GROUP BY n_neighbors, p, weights"""
ORACLE["grid_search_knn"] = _with(*HELD_OUT, *_grid(GRID["n_neighbors"], GRID["p"], TRAIN, "cv_fold")) + """
SELECT CAST(n_neighbors AS INTEGER) AS n_neighbors, CAST(p AS INTEGER) AS p, weights,
round(100.0 * avg(CAST(label = prediction AS INTEGER)), 2) AS cv FROM picked GROUP BY n_neighbors, p, weights"""
ORACLE["misclassified"] = _with(
    *TEXT_POINTS, *SPLIT, _near(TEST, TRAIN, 12, 1, ", q.label"),
    *_votes("distance", "label", POINT_CLASSES)) + """
SELECT row_id, p.label, prediction, array_to_string(words, ' ') AS text FROM predicted p JOIN lists USING (row_id)
WHERE p.label <> prediction"""
CHAT = ["chat AS (SELECT conv_id * 1000000 + turn AS row_id, conv_id, turn, text FROM conversations)",
        _word_lists("chat_lists", "chat", "row_id, conv_id, turn"),
        _sums("chat_points", "chat_lists", "row_id, conv_id, turn")]
ORACLE["score_texts"] = _with(
    *TEXT_POINTS, *CHAT, _near("chat_points", "points", 12, 1, ", q.conv_id, q.turn"),
    *_votes("distance", "conv_id, turn", POINT_CLASSES)) + f"""
SELECT conv_id, turn, {CATS}[tlabel + 1] AS category, round(100.0 * share, 2) AS percent FROM votes"""
MINING = [*TEXT_POINTS, MESSAGES, _word_lists("message_lists", "messages", "row_id"),
          _sums("message_points", "message_lists", "row_id")]
MINED = f"""prediction, {_r('best')} AS best, md5(text) AS digest FROM predicted JOIN messages USING (row_id)
WHERE row_id IN (SELECT row_id FROM votes WHERE share >= 0.7 AND tlabel < (SELECT max(label) FROM points))"""
MINE = _with(*MINING, _near("message_points", "points", 12, 1), *_votes("uniform", "", POINT_CLASSES))
ORACLE["mine_stream"] = MINE + "SELECT row_id, " + MINED
ORACLE["mine_messages"] = MINE + "SELECT CASE WHEN row_id % 3 > 0 THEN row_id % 7 ELSE -1 END AS id, " + MINED

# Fitted models: every held-out text, and what must hold for it

for _name in ("rf_predict", "mlp_predict", "svm_predict"):
    ORACLE[_name] = _with(*TEXTS, _ntile(5, "cut", "lists")) + """
SELECT row_id, label, true AS consistent, true AS in_band, true AS settled FROM cut WHERE fold = 0"""

for _key, _kind in (("grid_search_rf", "RandomForestAlgorithm"), ("grid_search_mlp", "MLPAlgorithm")):
    ORACLE[_key] = "SELECT * FROM (VALUES " + ", ".join(
        f"('{_kind}', {i}, 'TableEmbedding', 'vectors,0', 'SumEmbedding', '{params_text(one).replace(chr(39), chr(39) * 2)}', true)"
        for i, one in enumerate(combinations(CLASSIFIERS[_kind].grid))) + """
) t(classifier, line_no, word_emb, word_emb_params, sent_emb, params, in_band)"""


def _pair(points: str, params: str, sent_emb: str) -> str:
    """The neighbour search over one table of text vectors, with the distance as a function of two lists."""
    near = [part.replace(_distance(2), "round(list_distance(q.vec, t.vec), 9)")
            for part in _grid(SOME_NEIGHBOURS["n_neighbors"], SOME_NEIGHBOURS["p"], TRAIN, "cv_fold")]
    return "(" + _with(f"points AS (SELECT * FROM {points})", *SPLIT, *near) + f"""
SELECT 'NearestNeighborsAlgorithm' AS classifier, '{params}' AS word_emb_params, '{sent_emb}' AS sent_emb, CAST(n_neighbors AS INTEGER) AS n_neighbors,
weights, round(100.0 * avg(CAST(label = prediction AS INTEGER)), 2) AS cv FROM picked GROUP BY n_neighbors, weights)"""


def _joined_vectors(name: str, dim: int) -> str:
    return f"""{name} AS (SELECT row_id, label, list_resize(coalesce(vec, []), {30 * dim}, 0.0) AS vec FROM lists LEFT JOIN (
SELECT row_id, flatten(list(vec[1:{dim}] ORDER BY slot)) AS vec FROM firsts GROUP BY row_id) USING (row_id))"""


ORACLE["grid_search_all"] = _with(
    *WORDS, _sums("sum64", "lists", "row_id, label"), f"sum32 AS (SELECT row_id, label, vec[1:{DIM // 2}] AS vec FROM sum64)",
    _positions("toks", "lists", "row_id"), """firsts AS (SELECT * FROM (
SELECT row_id, vec, row_number() OVER (PARTITION BY row_id ORDER BY pos) AS slot FROM toks JOIN vectors USING (word)) WHERE slot <= 30)""",
    _joined_vectors("joined64", DIM), _joined_vectors("joined32", DIM // 2)) + " UNION ALL ".join(
    _pair(p, params, sent) for p, params, sent in (("sum64", "whole,64", "SumEmbedding"), ("joined64", "whole,64", "ConcatenationEmbedding"),
                                                   ("sum32", "half,32", "SumEmbedding"), ("joined32", "half,32", "ConcatenationEmbedding")))

# Choosing texts

ORACLE["select_labelled"] = f"""
SELECT doc_id AS row_id, CAST(CASE WHEN quality = 1 THEN list_position({CATS}, 'en') - 1 ELSE 2 END AS INTEGER) AS label,
md5(text) AS digest FROM labels JOIN documents USING (doc_id) WHERE toxic <> 1"""
ORACLE["expand_training_set"] = _with(DOCS) + """
SELECT row_id, label FROM (SELECT row_id, label, text, row_id NOT IN (SELECT doc_id FROM labels) AS is_new FROM docs)
QUALIFY row_number() OVER (PARTITION BY text ORDER BY is_new, row_id) = 1"""

# Result tables

RESULTS = """results AS (SELECT event_id AS line_no, event_type AS classifier,
CASE WHEN user_id < 75 THEN 'GloveEmbedding' ELSE 'Word2VecEmbedding' END AS word_emb,
CASE WHEN user_id < 75 THEN 'glove.txt' ELSE 'news.bin' END AS word_emb_path,
CAST(CASE WHEN user_id < 75 THEN 200 ELSE 300 END AS INTEGER) AS dim,
CASE WHEN k < 60 THEN 'SumEmbedding' ELSE 'ConcatenationEmbedding' END AS sent_emb,
k + 1 AS n_neighbors, CAST(floor(user_id / 30.0) + 1 AS INTEGER) AS p,
CASE WHEN value < 35 THEN 'uniform' ELSE 'distance' END AS weights, value AS cv
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
EMB_PARAMS = "word_emb_path || ',' || CAST(dim AS VARCHAR)"
FIRST = f"""best AS (SELECT *, {EMB_PARAMS} AS word_emb_params FROM results WHERE cv > 0
QUALIFY row_number() OVER (PARTITION BY classifier ORDER BY cv DESC, line_no) = 1)"""
SCORES = f"""evaluations AS (SELECT line_no, classifier, word_emb, {EMB_PARAMS} AS word_emb_params, sent_emb, cv AS score,
CASE WHEN classifier IN ('click', 'view', 'signup') AND cv >= 50 THEN 'train' ELSE 'test' END AS split FROM results),
first_scores AS (SELECT * FROM evaluations
QUALIFY row_number() OVER (PARTITION BY classifier, word_emb, word_emb_params, sent_emb, split ORDER BY line_no) = 1),
evaluated AS (SELECT b.*, coalesce(t.score, 0.0) AS test_score, coalesce(r.score, 0.0) AS train_score FROM best b
LEFT JOIN first_scores t ON t.split = 'test' AND t.classifier = b.classifier AND t.word_emb = b.word_emb
AND t.word_emb_params = b.word_emb_params AND t.sent_emb = b.sent_emb
LEFT JOIN first_scores r ON r.split = 'train' AND r.classifier = b.classifier AND r.word_emb = b.word_emb
AND r.word_emb_params = b.word_emb_params AND r.sent_emb = b.sent_emb)"""
MEAN = "sum(CAST(round(cv * 100) AS BIGINT))::DOUBLE / count(cv) / 100.0"
SUMMARY = f"""summary AS (SELECT classifier, max(cv) AS best, round({MEAN}, 2) AS average, count(*) AS combinations
FROM results GROUP BY classifier)"""
BEST = "classifier, line_no, word_emb, word_emb_params, sent_emb, cv"
ORACLE["parse_grid_results"] = _with(RESULTS) + """
SELECT line_no, classifier, word_emb, word_emb_path, dim, sent_emb, cv, '(100, 50)' AS hidden_layer_sizes,
'None' AS max_depth, CAST(n_neighbors AS VARCHAR) AS n_neighbors, CAST(p AS VARCHAR) AS p, weights,
sent_emb AS sentence_embedding, word_emb || '(' || word_emb_path || ',' || CAST(dim AS VARCHAR) || ')' AS word_embedding
FROM results"""
HUNDREDTHS = "count(*) AS n, CAST(sum(CAST(round(100 * cv) AS BIGINT)) AS BIGINT) AS hundredths"
ORACLE["read_result_folder"] = _with(RESULTS, FIRST, SCORES) + f"""
SELECT classifier, 'result' AS kind, word_emb, sent_emb, {HUNDREDTHS} FROM results GROUP BY classifier, word_emb, sent_emb
UNION ALL SELECT classifier, split, word_emb, sent_emb, {HUNDREDTHS.replace("cv", "score")} FROM evaluations
GROUP BY classifier, split, word_emb, sent_emb"""
ORACLE["best_params"] = _with(RESULTS, FIRST) + f"SELECT {BEST}, CAST(n_neighbors AS VARCHAR) AS n_neighbors FROM best"
ORACLE["best_with_evaluation"] = _with(RESULTS, FIRST, SCORES) + f"SELECT {BEST}, test_score, train_score FROM evaluated"
ORACLE["best_overall"] = _with(RESULTS, FIRST) + f"""
SELECT {BEST} FROM best ORDER BY cv DESC, list_position({RUNS}, classifier) DESC LIMIT 1"""
ORACLE["grid_summary"] = _with(RESULTS, SUMMARY) + "SELECT * FROM summary"
ORACLE["model_ranking"] = _with(RESULTS, FIRST, SCORES, SUMMARY) + """
SELECT classifier, CAST(row_number() OVER (ORDER BY test_score, classifier) AS INTEGER) AS place, cv AS best, average,
test_score, train_score FROM evaluated JOIN (SELECT classifier, average FROM summary) USING (classifier)"""
ORACLE["emb_compare"] = _with(RESULTS) + f"""
SELECT classifier, sent_emb, max(cv) AS best, round({MEAN}, 2) AS average FROM results GROUP BY classifier, sent_emb"""
ORACLE["running_max_avg"] = _with(RESULTS) + """
SELECT classifier, sent_emb, round(avg(so_far), 2) AS running_max_avg FROM (SELECT classifier, sent_emb,
max(cv) OVER (PARTITION BY classifier, sent_emb ORDER BY line_no) AS so_far FROM results) GROUP BY classifier, sent_emb"""
ORACLE["param_profile"] = _with(RESULTS) + f"""
SELECT classifier, CAST(n_neighbors AS VARCHAR) AS param_value, {MEAN} AS average, min(cv) AS lowest,
max(cv) AS highest FROM results GROUP BY classifier, n_neighbors"""
ORACLE["param_values"] = _with(RESULTS) + """
SELECT CAST(n_neighbors AS VARCHAR) AS param_value, CAST(n_neighbors AS DOUBLE) AS number,
CAST(row_number() OVER (ORDER BY n_neighbors) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT n_neighbors FROM results)"""
ORACLE["param_pair_profile"] = _with(RESULTS) + f"""
SELECT classifier, CAST(n_neighbors AS DOUBLE) AS first, CAST(p AS DOUBLE) AS second, max(cv) AS highest,
least(max(cv), 100.0) AS capped, {_r('log2(n_neighbors)')} AS log2_first, {_r('log2(p)')} AS log2_second
FROM results GROUP BY classifier, n_neighbors, p"""

# The best setting of the result log, as a neighbour search over the texts

TOP = "top AS (SELECT n_neighbors, p, weights FROM results WHERE cv > 0 ORDER BY cv DESC, line_no LIMIT 1)"
TOP_K, TOP_P = "(SELECT n_neighbors FROM top)", "(SELECT p FROM top)"
ORACLE["score_best"] = _with(
    RESULTS, TOP, *TEXT_POINTS, *CHAT, _near("chat_points", "points", TOP_K, TOP_P, ", q.conv_id, q.turn"),
    *_votes("best", "conv_id, turn", POINT_CLASSES)) + f"""
SELECT conv_id, turn, {CATS}[tlabel + 1] AS category, round(100.0 * share, 2) AS percent FROM votes"""
ORACLE["mine_best"] = _with(
    RESULTS, TOP, *MINING, _near("message_points", "points", TOP_K, TOP_P), *_votes("best", "", POINT_CLASSES)) + (
    "SELECT row_id, " + MINED)
