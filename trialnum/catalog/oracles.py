"""DuckDB SQL for every query that SQL can state.

Written apart from the Spark side: tokens are unnested to rows, neighbours and
keywords are window functions, pair sums are a self-join, runs of number words
are found by gaps and islands and valued in closed form, and evaluation joins
row by row.
"""

from __future__ import annotations

from trialnum.catalog import fixtures as fx
from trialnum.catalog.fixed_network import confidence_sql
from trialnum.functions import features as feat
from trialnum.functions.numbers import NUMBER_WORDS, SCALE_EXPONENTS
from trialnum.functions.tokens import DEFAULT_LEXICON, PUNCTUATION_TAGS, TAGS


def _table(sql: str) -> str:
    return sql.replace("{orders}", "orders")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(_text(w) for w in words) + ")"


TRIALS = f"src AS ({_table(fx.TRIAL_ABSTRACTS)})"
NORMAL = f"src AS ({_table(fx.NORMAL_ABSTRACTS)})"
DOCUMENTS = "src AS (SELECT doc_id AS pmid, text AS abstract FROM documents)"

SPACE = (
    r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
JOINED = (
    r"j AS (SELECT *, regexp_replace(abstract, '([^\p{Nd}][0-9]{1,3})[" + SPACE
    + r",]([0-9]{3}[^\p{Nd}])', '\1\2', 'g') AS t FROM src)"
)
NUMBER_TOKEN = r"[.,;'']|[A-Za-z0-9\x{130}\x{131}\x{17F}\x{212A}]+"
TOKEN = r"[nN]=[0-9]+(?:[.,][0-9]+)*|\p{L}+(?:-[0-9]+)+|[0-9]+(?:[.,][0-9]+)*|\p{L}+|[^\s]"

_WORD_ROWS = ", ".join(
    f"('{w}', {v}, {SCALE_EXPONENTS.get(w, 'NULL')})" for w, v in NUMBER_WORDS.items()
)
# runs of number words and their values, over j (pmid, t)
RUNS = f"""
sp AS (SELECT pmid, t, regexp_extract_all(t, '{NUMBER_TOKEN}') AS toks,
  string_split_regex(t, '{NUMBER_TOKEN}') AS gaps FROM j),
tk AS (SELECT pmid, unnest(toks) AS tok, unnest(gaps[1:len(toks)]) AS gap,
  unnest(range(len(toks))) AS k FROM sp),
nw(word, v, e) AS (VALUES {_WORD_ROWS}),
tv AS (SELECT tk.*, nw.v, nw.e, tok IN ('and', ',') AS dropped
  FROM tk LEFT JOIN nw ON lower(tok) = word),
tg AS (SELECT *, sum(CASE WHEN NOT dropped AND v IS NULL THEN 1 ELSE 0 END)
  OVER (PARTITION BY pmid ORDER BY k) AS g FROM tv),
nm AS (SELECT * FROM tg WHERE v IS NOT NULL),
later AS (SELECT a.pmid, a.g, a.k, b.e, max(b.e) OVER (PARTITION BY a.pmid, a.k ORDER BY b.k
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM nm a JOIN nm b ON a.pmid = b.pmid AND a.g = b.g AND b.k > a.k AND b.e IS NOT NULL
  WHERE a.e IS NULL),
expo AS (SELECT pmid, k, sum(e) AS e FROM later WHERE before IS NULL OR e >= before GROUP BY ALL),
runs AS (SELECT nm.pmid, nm.g, min(nm.k) AS first_k, max(nm.k) AS last_k,
  CAST(coalesce(sum(CASE WHEN nm.e IS NULL THEN nm.v * CAST(power(10, coalesce(expo.e, 0)) AS BIGINT) END), 0)
    AS VARCHAR) AS value
  FROM nm LEFT JOIN expo ON nm.pmid = expo.pmid AND nm.k = expo.k GROUP BY ALL),
pieces AS (SELECT tg.pmid, tg.k, gap, tok, first_k, last_k, value
  FROM tg LEFT JOIN runs r ON tg.pmid = r.pmid AND tg.g = r.g AND tg.k BETWEEN first_k AND last_k)
"""
_RUN_WORDS = """
SELECT pmid, row_number() OVER (PARTITION BY pmid ORDER BY first_k) AS grp,
  string_agg(CASE WHEN k = first_k THEN tok ELSE gap || tok END, '' ORDER BY k) AS words,
  any_value(value) AS value
FROM pieces WHERE first_k IS NOT NULL GROUP BY pmid, first_k
"""
REBUILT = """
body AS (SELECT pmid, string_agg(CASE WHEN first_k IS NULL THEN gap || tok
    WHEN k = first_k THEN gap || value ELSE '' END, '' ORDER BY k) AS body FROM pieces GROUP BY pmid),
normal AS (SELECT sp.pmid, coalesce(body, '') || gaps[-1] AS t FROM sp LEFT JOIN body ON sp.pmid = body.pmid)
"""

# tokens as rows, n= rewritten, integers cast; over a text column
INTEGER = "CASE WHEN regexp_full_match(tok, '[+-]?[0-9]+') THEN TRY_CAST(tok AS HUGEINT) END"


def tokens(source: str, text: str = "abstract", more: str = "") -> str:
    return f"""
rt AS (SELECT pmid, {more} unnest(l) AS raw, unnest(range(len(l))) AS idx
  FROM (SELECT *, regexp_extract_all({text}, '{TOKEN}') AS l FROM {source})),
tok AS (SELECT *, CASE WHEN contains(lower(raw), 'n=') THEN replace(split_part(raw, '=', 2), ')', '')
  ELSE raw END AS tok FROM rt),
num AS (SELECT *, {INTEGER} AS num FROM tok)
"""


def _near(name: str, words: list[str]) -> str:
    return f"""max(CASE WHEN idx > 0 AND lower(tok) IN {_list(words)} THEN 1.0 ELSE 0.0 END)
  OVER (PARTITION BY pmid ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING) AS {name}"""


def _follows(name: str, words: list[str]) -> str:
    return f"""coalesce(max(CASE WHEN lower(tok) IN {_list(words)} THEN 1.0 ELSE 0.0 END)
  OVER (PARTITION BY pmid ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0.0) AS {name}"""


def _tag(column: str) -> str:
    marks = " ".join(f"WHEN {column} = {_text(m)} THEN {_text(t)}" for m, t in PUNCTUATION_TAGS.items())
    words = " ".join(f"WHEN lower({column}) IN {_list(w)} THEN '{t}'" for t, w in DEFAULT_LEXICON.items())
    return f"CASE WHEN regexp_full_match({column}, '[0-9]+([.,][0-9]+)*') THEN 'CD' {marks} {words} ELSE 'XX' END"


def _lexicon_tag(column: str) -> str:
    """Tag by the length of a word that the trial texts have, as the lexicon query makes it."""
    marks = " ".join(f"WHEN {column} = {_text(m)} THEN {_text(t)}" for m, t in PUNCTUATION_TAGS.items())
    known = f"lower({column}) IN (SELECT token FROM vocab)"
    return f"""CASE WHEN {column} IS NULL THEN 'XX' {marks} WHEN {known} THEN (['NN', 'VB', 'JJ'])[1 + length({column}) % 3]
  WHEN regexp_full_match({column}, '[0-9]+([.,][0-9]+)*') THEN 'CD' ELSE 'XX' END"""


FEATURES = f"""
win AS (SELECT *, count(*) OVER (PARTITION BY pmid) AS n,
  lag(lower(tok), 2, 'BoS') OVER w AS ll, lag(lower(tok), 1, 'BoS') OVER w AS l,
  lead(lower(tok), 1, 'LoS') OVER w AS r, lead(lower(tok), 2, '') OVER w AS rr,
  lag(raw, 1) OVER w AS l_raw, lead(raw, 1) OVER w AS r_raw,
  {_near("years_near", feat.YEAR_WORDS)},
  {_follows("patients_follow", feat.PATIENT_WORDS)},
  {_follows("people_follow", feat.PEOPLE_WORDS)},
  {_near("enroll_near", feat.ENROLL_WORDS)},
  {_near("analysis_near", feat.ANALYSIS_WORDS)}
  FROM num WINDOW w AS (PARTITION BY pmid ORDER BY idx)),
cnt AS (SELECT pmid, num, count(*) AS c FROM num WHERE num IS NOT NULL GROUP BY ALL),
sums AS (SELECT DISTINCT x.pmid, x.num FROM cnt x JOIN cnt a ON a.pmid = x.pmid
  JOIN cnt b ON b.pmid = x.pmid AND b.num = x.num - a.num AND (b.num <> a.num OR a.c > 1)),
f AS (SELECT win.*,
  CASE WHEN l_raw IS NULL THEN 'XX' ELSE {_tag("l_raw")} END AS left_pos,
  CASE WHEN r_raw IS NULL THEN 'XX' ELSE {_tag("r_raw")} END AS right_pos,
  CASE WHEN win.num >= max(win.num) OVER (PARTITION BY win.pmid) THEN 1.0 ELSE 0.0 END AS biggest,
  CASE WHEN win.num BETWEEN 1940 AND 2022 THEN 1.0 ELSE 0.0 END AS looks_like_year,
  CASE WHEN count(*) OVER (PARTITION BY win.pmid, win.num) > 1 THEN 1.0 ELSE 0.0 END AS repeated,
  CASE WHEN sums.num IS NOT NULL THEN 1.0 ELSE 0.0 END AS sum_of_two,
  CAST(rank() OVER (PARTITION BY win.pmid ORDER BY win.num) - 1 AS DOUBLE)
    / count(*) OVER (PARTITION BY win.pmid) AS rank_prop
  FROM win LEFT JOIN sums ON sums.pmid = win.pmid AND sums.num = win.num
  WHERE win.num IS NOT NULL)
"""


def features(source: str, columns: str) -> str:
    return f"WITH {source}, {tokens('src')}, {FEATURES} SELECT pmid, idx, CAST(num AS VARCHAR) AS num, {columns} FROM f"


def _doubles(names: list[str]) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def token_text(source: str, column: str) -> str:
    return f"""WITH {source}, {tokens('src')}
SELECT s.pmid, count(tok) AS n, coalesce(string_agg({column}, '|' ORDER BY idx), '') AS tokens
FROM src s LEFT JOIN tok ON s.pmid = tok.pmid GROUP BY s.pmid"""


def number_token_text(source: str) -> str:
    return f"""WITH {source}, l AS (SELECT pmid, list_filter(regexp_extract_all(abstract, '{NUMBER_TOKEN}'),
  lambda x: x NOT IN ('and', ',')) AS t FROM src)
SELECT pmid, len(t) AS n, coalesce(array_to_string(t, '|'), '') AS tokens FROM l"""


CONF = "CAST((num % 100) * 37 % 100 AS DOUBLE) / 100"
BEST = f"""best AS (SELECT pmid, idx, num, {CONF} AS conf FROM num WHERE num IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY {CONF} DESC, idx) = 1)"""


def best_number(source: str, report: float = 0.2) -> str:
    return f"""WITH {source}, {tokens('src')}, {BEST}
SELECT s.pmid, CASE WHEN conf >= 0.25 AND conf >= {report} THEN CAST(num AS VARCHAR) END AS pred_ss,
  CASE WHEN conf >= 0.25 THEN conf END AS conf
FROM src s LEFT JOIN best b ON s.pmid = b.pmid"""


LABEL = "CASE WHEN num = tt_sample_size THEN 1.0 ELSE 0.0 END"


def labels(source: str) -> str:
    return f"""WITH {source}, {tokens('src', more='tt_sample_size,')}
SELECT pmid, idx, CAST(num AS VARCHAR) AS num, CAST({LABEL} AS DOUBLE) AS label FROM num WHERE num IS NOT NULL"""


EXACT = "coalesce(tt_sample_size = pred_ss, false) OR (tt_sample_size IS NULL AND pred_ss IS NULL)"
LOOSE = """coalesce(known, false) AND (coalesce(pred_ss IN (poss_1, poss_2), false)
  OR coalesce(total = pred_ss, false)
  OR coalesce(CAST(total AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(0.1 AS DOUBLE)) <= pred_ss
    AND pred_ss <= CAST(total AS DOUBLE) * (CAST(1 AS DOUBLE) + CAST(0.1 AS DOUBLE)), false)
  OR (total IS NULL AND pred_ss IS NULL))"""


def matched(loose: bool = False, how: str = "FULL OUTER") -> str:
    return f"""{TRIALS}, pred AS ({_table(fx.PREDICTIONS)}), ann AS ({_table(fx.LOOSE_NUMBERS)}),
both_rows AS (SELECT coalesce(g.pmid, p.pmid) AS pmid, tt_sample_size, fold_id, pred_ss
  FROM src g {how} JOIN pred p ON g.pmid = p.pmid),
m AS (SELECT b.pmid, tt_sample_size, fold_id, pred_ss, tt_sample_size IS NULL AS no_ss,
  pred_ss IS NULL AS no_pred_ss, {LOOSE if loose else EXACT} AS same
  FROM both_rows b LEFT JOIN (SELECT *, true AS known FROM ann) a ON a.pmid = b.pmid),
cells AS (SELECT {{groups}} count(*) FILTER (same AND NOT no_ss) AS tp,
  count(*) FILTER (no_ss AND no_pred_ss) AS tn,
  count(*) FILTER (NOT same AND NOT no_pred_ss) AS fp,
  count(*) FILTER (no_pred_ss AND NOT no_ss) AS fn, count(*) AS joined_rows FROM m {{end}}),
conf AS (SELECT *, {{divisor}} AS gold_rows FROM cells),
mt AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
  (tp + tn) / nullif(gold_rows, 0) AS accuracy FROM conf),
scores AS (SELECT *, 2 * (precision * recall) / nullif(precision + recall, 0) AS f1 FROM mt)"""


def _filled(sql: str, by_fold: bool) -> str:
    values = (
        ("fold_id,", "WHERE fold_id IS NOT NULL GROUP BY fold_id", "joined_rows")
        if by_fold
        else ("", "", "(SELECT count(*) FROM src)")
    )
    for name, value in zip(("groups", "end", "divisor"), values):
        sql = sql.replace("{" + name + "}", value)
    return sql


def match_rows(loose: bool = False, how: str = "FULL OUTER") -> str:
    base = _filled(matched(loose, how), False)
    return f"WITH {base} SELECT pmid, tt_sample_size, fold_id, pred_ss, no_ss, no_pred_ss, same FROM m"


def confusion(loose: bool = False, by_fold: bool = False) -> str:
    base = _filled(matched(loose), by_fold)
    return f"WITH {base} SELECT {'fold_id,' if by_fold else ''} tp, tn, fp, fn, joined_rows, gold_rows FROM conf"


def scores(loose: bool = False, by_fold: bool = False, how: str = "FULL OUTER") -> str:
    base = _filled(matched(loose, how), by_fold)
    cells = ", ".join(f"round({m}, 9) AS {m}" for m in ("precision", "recall", "accuracy", "f1"))
    return f"WITH {base} SELECT {'fold_id,' if by_fold else ''} {cells} FROM scores"


def summary(loose: bool = False) -> str:
    base = _filled(matched(loose), True)
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(min({m}), 9) AS min, round(max({m}), 9) AS max,"
        f" round(avg({m}), 9) AS mean FROM scores"
        for m in ("precision", "recall", "accuracy", "f1")
    )
    return f"WITH {base} {rows}"


_SEPARATORS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
WORDS = f"""vw AS (SELECT pmid, list_filter(string_split(translate(lower(abstract),
  {_text(_SEPARATORS)} || chr(9) || chr(10), repeat(' ', {len(_SEPARATORS) + 2})), ' '), lambda x: x <> '') AS l FROM src),
wr AS (SELECT pmid, unnest(l) AS token, unnest(range(len(l))) AS pos FROM vw),
wc AS (SELECT token, count(*) AS cnt, min(pmid * 1000000000 + pos) AS seen FROM wr GROUP BY token),
vocab AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, seen) AS id, cnt FROM wc)"""


def vocabulary(source: str, k: int) -> str:
    return f"WITH {source}, {WORDS} SELECT token, id, cnt FROM vocab WHERE id <= {k}"


def lexicon_tags() -> str:
    return f"""WITH raw_src AS ({_table(fx.TRIAL_ABSTRACTS)}), {WORDS.replace("FROM src", "FROM raw_src")}, {NORMAL}, {tokens('src')}
SELECT pmid, string_agg({_lexicon_tag('raw')}, ' ' ORDER BY idx) AS tags FROM tok GROUP BY pmid"""


def rewritten(known: str) -> str:
    return f"""WITH {DOCUMENTS}, {WORDS}
SELECT s.pmid, coalesce(string_agg(CASE WHEN {known} THEN wr.token ELSE 'unkunk' END, ' ' ORDER BY wr.pos), '')
  AS rewritten
FROM src s LEFT JOIN wr ON s.pmid = wr.pmid LEFT JOIN vocab v ON v.token = wr.token GROUP BY s.pmid"""


_IDS = ", ".join(f"coalesce(v_{c}.id, 0) AS {c}_id" for c in ("ll", "l", "rr", "r"))
_ID_JOINS = " ".join(
    f"LEFT JOIN (SELECT * FROM vocab WHERE id <= 10000) v_{c} ON v_{c}.token = f.{c}" for c in ("ll", "l", "rr", "r")
)
# words are counted in the texts as written, candidates come from the rewritten ones
ENCODED = f"""WITH raw_src AS ({_table(fx.TRIAL_ABSTRACTS)}),
{WORDS.replace("FROM src", "FROM raw_src")}, {NORMAL}, {tokens('src')}, {FEATURES}
SELECT f.pmid, f.idx, {_IDS} FROM f {_ID_JOINS}"""
_PAIRS = ", ".join(
    f"CAST(coalesce(length(v_{c}.token), 0) AS DOUBLE) AS {c}_len, CAST(coalesce(v_{c}.id, 0) AS DOUBLE) AS {c}_id"
    for c in ("ll", "l", "rr", "r")
)

_SCALED = ", ".join(
    f"coalesce(length(v_{c}.token), 0) / 10.0::DOUBLE AS {c}_len, coalesce(v_{c}.id, 0) / 1000.0::DOUBLE AS {c}_id" for c in ("ll", "l", "rr", "r")
)


def network(kind: str) -> str:
    """The fixed network over the features of every candidate."""
    return ENCODED.replace(f"SELECT f.pmid, f.idx, {_IDS}", f", n AS (SELECT f.*, {_SCALED}") + f""")
SELECT pmid, idx, CAST(num AS VARCHAR) AS num, round({confidence_sql(kind)}, 9) AS conf FROM n"""


_TAG_LIST = "[" + ", ".join(_text(t) for t in TAGS) + "]"

LINES = f"lines AS ({_table(fx.STANDOFF_LINES)}), ids AS ({_table(fx.TITLES)})"
ENTITIES = """ent AS (SELECT pmid, line_no,
  CAST(regexp_extract(line, '^T([0-9]+)', 1) AS INT) AS standoff_id,
  upper(substr(x[1], 1, 1)) || lower(substr(x[1], 2)) AS entity_type,
  CAST(x[2] AS INT) AS offset_start, CAST(x[3] AS INT) AS offset_end, word
  FROM (SELECT *, string_split(split_part(line, chr(9), 2), ' ') AS x, split_part(line, chr(9), 3) AS word
    FROM lines WHERE line[1] = 'T')),
nums AS (SELECT *, CASE word WHEN 'one hundred and twenty three' THEN 123 WHEN '1,234' THEN 1234
   WHEN '1 250' THEN 1250 WHEN 'about fifty' THEN NULL WHEN 'hundred' THEN 0 WHEN 'Fifty-two' THEN 52
   ELSE TRY_CAST(word AS BIGINT) END AS num,
  CASE word WHEN 'one hundred and twenty three' THEN '123' WHEN 'about fifty' THEN 'about 50'
   WHEN 'hundred' THEN '0' WHEN 'Fifty-two' THEN '52' ELSE word END AS norm FROM ent)"""
RELATIONS = """rel AS (SELECT pmid, line_no, CAST(regexp_extract(line, '^R([0-9]+)', 1) AS INT) AS standoff_id,
  regexp_extract(line, '\\t([^ ]+) ', 1) AS name,
  CAST(regexp_extract(line, 'Arg1:T([0-9]+)', 1) AS INT) AS standoff_entity1_id,
  CAST(regexp_extract(line, 'Arg2:T([0-9]+)', 1) AS INT) AS standoff_entity2_id
  FROM lines WHERE line[1] = 'R')"""


def nested(rows: str, table: str, item: str) -> str:
    return f"""WITH {LINES}, {rows} SELECT i.pmid, count(line_no) AS n,
  coalesce(string_agg({item}, '|' ORDER BY line_no), '') AS items
FROM ids i LEFT JOIN {table} e ON i.pmid = e.pmid GROUP BY i.pmid"""


BLANKS = tokens("src").replace(f"regexp_extract_all(abstract, '{TOKEN}')", "string_split(abstract, ' ')")

ORACLES: dict[str, str] = {
    "raw_candidates": f"""WITH {TRIALS}, {tokens('src')}
SELECT pmid, idx, CAST(num AS VARCHAR) AS num FROM num WHERE num IS NOT NULL""",
    "own_tokenizer": f"""WITH {TRIALS}, {BLANKS}
SELECT pmid, idx, CAST(num AS VARCHAR) AS num FROM num WHERE num IS NOT NULL""",
    "fold_check": "SELECT count(*) AS n, 5 AS folds, 1 AS even, count(*) AS pairs FROM orders",
    "cv_check": """SELECT count(*) AS n, count(*) AS pmids, 0 AS wrong_fold, 0 AS wrong_number, 0 AS wrong_conf
FROM orders""",
    "pretrain_check": "SELECT 1 AS in_range, 1 AS some_held_out",
    "thousands_join": f"WITH {TRIALS}, {JOINED} SELECT pmid, t AS text FROM j",
    "thousands_join_documents": f"WITH {DOCUMENTS}, {JOINED} SELECT pmid, t AS text FROM j",
    "number_word_tokens": number_token_text(TRIALS),
    "number_word_tokens_documents": number_token_text(DOCUMENTS),
    "number_words": f"WITH {TRIALS}, {JOINED}, {RUNS} {_RUN_WORDS}",
    "number_normalize": f"WITH {NORMAL} SELECT pmid, abstract AS text FROM src",
    "number_normalize_documents": f"WITH {DOCUMENTS}, {JOINED}, {RUNS}, {REBUILT} SELECT pmid, t AS text FROM normal",
    "tokenize": token_text(NORMAL, "raw"),
    "tokenize_documents": token_text(DOCUMENTS, "raw"),
    "n_equals": token_text(NORMAL, "tok"),
    "token_tags": f"""WITH {NORMAL}, {tokens('src')}
SELECT pmid, string_agg({_tag('raw')}, ' ' ORDER BY idx) AS tags FROM tok GROUP BY pmid""",
    "token_tags_lexicon": lexicon_tags(),
    "token_tags_joined": lexicon_tags(),
    "pos_tags_lexicon": f"""WITH raw_src AS ({_table(fx.TRIAL_ABSTRACTS)}), {WORDS.replace("FROM src", "FROM raw_src")},
{NORMAL}, {tokens('src')}, {FEATURES}
SELECT pmid, idx, CAST(num AS VARCHAR) AS num, {_lexicon_tag("l_raw")} AS left_pos, {_lexicon_tag("r_raw")} AS right_pos FROM f""",
    "candidates": f"WITH {NORMAL}, {tokens('src')} SELECT pmid, idx, CAST(num AS VARCHAR) AS num FROM num WHERE num IS NOT NULL",
    "candidates_documents": f"""WITH {DOCUMENTS}, {JOINED}, {RUNS}, {REBUILT}, {tokens('normal', 't')}
SELECT pmid, idx, CAST(num AS VARCHAR) AS num FROM num WHERE num IS NOT NULL""",
    "neighbour_words": features(NORMAL, "ll, l, rr, r"),
    "pos_tags": features(NORMAL, "left_pos, right_pos"),
    "keyword_windows": features(
        NORMAL, _doubles(["years_near", "patients_follow", "people_follow", "enroll_near", "analysis_near"])
    ),
    "number_stats": features(NORMAL, _doubles(["biggest", "looks_like_year", "repeated"])),
    "pair_sum": features(NORMAL, _doubles(["sum_of_two"])),
    "pair_sum_spread": features(NORMAL, _doubles(["sum_of_two"]) + ", rank_prop"),
    "rank_prop": features(NORMAL, "rank_prop"),
    "features": features(NORMAL, "ll, l, rr, r, left_pos, right_pos, " + _doubles(feat.OTHER_FEATURES)),
    "features_documents": f"""WITH {DOCUMENTS}, {JOINED}, {RUNS}, {REBUILT}, {tokens('normal', 't')}, {FEATURES}
SELECT pmid, idx, CAST(num AS VARCHAR) AS num, ll, l, rr, r, {_doubles(feat.OTHER_FEATURES)} FROM f""",
    "labels": labels(NORMAL),
    "training_rows": labels(TRIALS),
    "token_labels": f"""WITH {TRIALS}, {tokens('src', more='tt_sample_size,')}
SELECT pmid, string_agg(CASE WHEN num = tt_sample_size THEN 'N' ELSE 'O' END, '' ORDER BY idx) AS marks
FROM num GROUP BY pmid""",
    "top_candidate": f"WITH {NORMAL}, {tokens('src')}, {BEST} SELECT pmid, idx, CAST(num AS VARCHAR) AS num, conf FROM best WHERE conf >= 0.25",
    "extract_all_docs": best_number(NORMAL),
    "extract_all_docs_joined": best_number(NORMAL),
    "extract_documents": f"""WITH {DOCUMENTS}, {JOINED}, {RUNS}, {REBUILT}, {tokens('normal', 't')}, {BEST}
SELECT s.pmid, CASE WHEN conf >= 0.25 THEN CAST(num AS VARCHAR) END AS pred_ss, CASE WHEN conf >= 0.25 THEN conf END AS conf
FROM src s LEFT JOIN best b ON s.pmid = b.pmid""",
    "report_threshold": best_number(NORMAL, 0.6),
    "first_documents": f"WITH {TRIALS} SELECT pmid, abstract FROM src ORDER BY pmid LIMIT 20",
    "match_rows_exact": match_rows(),
    "match_rows_inner": match_rows(how="INNER"),
    "match_rows_loose": match_rows(loose=True),
    "confusion_exact": confusion(),
    "confusion_exact_cv": confusion(by_fold=True),
    "confusion_loose": confusion(loose=True),
    "confusion_loose_cv": confusion(loose=True, by_fold=True),
    "eval_exact": scores(),
    "eval_exact_cv": scores(by_fold=True),
    "eval_loose": scores(loose=True),
    "eval_loose_cv": scores(loose=True, by_fold=True),
    "eval_inner": scores(how="INNER"),
    "fold_summary": summary(),
    "fold_summary_loose": summary(loose=True),
    "vocab_counts": f"WITH {DOCUMENTS}, {WORDS} SELECT token, cnt FROM wc",
    "vocab_topk": vocabulary(DOCUMENTS, 10_000),
    "vocab_topk_trials": vocabulary(TRIALS, 40),
    "vocab_all": f"WITH {DOCUMENTS}, {WORDS} SELECT token, id, cnt FROM vocab",
    "unk_rewrite": rewritten("v.id <= 10000"),
    "unk_rewrite_joined": rewritten("v.cnt > 1"),
    "encode_words": ENCODED,
    "encode_words_joined": ENCODED.replace("WHERE id <= 10000", ""),
    "embed_words": ENCODED.replace(_IDS, _PAIRS),
    "embed_words_joined": ENCODED.replace(_IDS, _PAIRS),
    "vocab_vectors": f"""WITH {DOCUMENTS}, {WORDS}
SELECT token, 2 AS dim, CASE WHEN length(token) % 2 = 0 THEN CAST(length(token) AS DOUBLE) END AS given,
  CASE WHEN length(token) % 2 = 0 THEN 0 ELSE 1 END AS in_range FROM vocab WHERE id <= 10000""",
    "tag_one_hot": f"""WITH {NORMAL}, {tokens('src')}, {FEATURES}
SELECT pmid, idx, list_position({_TAG_LIST}, left_pos) - 1 AS left_at,
  list_position({_TAG_LIST}, right_pos) - 1 AS right_at FROM f""",
    "network_mlp": network("mlp"),
    "network_mlp_in_tasks": network("mlp"),
    "network_logistic": network("logistic"),
    "network_logistic_in_tasks": network("logistic"),
    "model_agreement": f"""WITH {NORMAL}, {tokens('src')}
SELECT count(*) AS n, 0 AS different FROM num WHERE num IS NOT NULL""",
    "standoff_entities": f"""WITH {LINES}, {ENTITIES}
SELECT pmid, standoff_id, entity_type, offset_start, offset_end, word FROM ent""",
    "standoff_relations": f"""WITH {LINES}, {RELATIONS}
SELECT pmid, standoff_id, name, standoff_entity1_id, standoff_entity2_id FROM rel""",
    "entities_nested": nested(ENTITIES, "ent", "concat_ws(':', standoff_id, entity_type, word)"),
    "relations_nested": nested(RELATIONS, "rel", "concat_ws(':', name, standoff_entity1_id, standoff_entity2_id)"),
    "annotated_numbers": f"""WITH {LINES}, {ENTITIES}
SELECT pmid, standoff_id, word, num, norm, TRY_CAST(CASE WHEN regexp_full_match(norm, '[0-9]+') THEN norm END AS BIGINT)
  AS norm_num FROM nums WHERE entity_type = 'Total_sample_size'""",
    "gold_per_doc": f"""WITH {LINES}, {ENTITIES}
SELECT i.pmid, num AS tt_sample_size FROM ids i LEFT JOIN (SELECT * FROM nums WHERE entity_type = 'Total_sample_size') e
ON i.pmid = e.pmid""",
    "loose_dict": f"""WITH {LINES}, {ENTITIES},
last_total AS (SELECT pmid, num FROM nums WHERE entity_type = 'Total_sample_size'
  QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY line_no DESC) = 1),
poss AS (SELECT pmid, string_agg(CAST(num AS VARCHAR), '|' ORDER BY num) AS poss FROM nums
  WHERE entity_type = 'Poss_total_sample' GROUP BY pmid)
SELECT i.pmid, t.num AS total, coalesce(poss, '') AS poss
FROM ids i LEFT JOIN last_total t ON i.pmid = t.pmid LEFT JOIN poss p ON i.pmid = p.pmid""",
    "assemble_sections": f"""WITH titles AS ({_table(fx.TITLES)}), sections AS ({_table(fx.SECTIONS)}),
body AS (SELECT pmid, string_agg(coalesce(label || ': ', '') || coalesce(text, '') || chr(10), '' ORDER BY pos) AS body
  FROM sections GROUP BY pmid)
SELECT pmid, 'TITLE: ' || coalesce(title, '') || chr(10) || body AS abstract, row_number() OVER (ORDER BY pmid) AS record_no
FROM titles JOIN body USING (pmid)""",
    "even_fold_sizes": """SELECT f.fold_id, n // 7 + CASE WHEN f.fold_id < n % 7 THEN 1 ELSE 0 END AS n
FROM (SELECT count(DISTINCT o_orderkey) AS n FROM orders) c, (SELECT unnest(range(7)) AS fold_id) f""",
    "train_test_split": f"""WITH {TRIALS}, {tokens('src', more='tt_sample_size, fold_id,')},
rows AS (SELECT fold_id, {LABEL} AS label FROM num WHERE num IS NOT NULL)
SELECT h AS held_out, CASE WHEN fold_id = h THEN 'test' ELSE 'train' END AS part, count(*) AS n,
  CAST(sum(label) AS DOUBLE) AS positive
FROM rows, (SELECT unnest(range(5)) AS h) GROUP BY ALL""",
}
