r"""SQL for another engine (DuckDB) that computes the same results by other means.

Tokens come from a chain of replacements instead of one pattern, language from a join with a table of letter runs, copies go before
scoring instead of after it, and stems from regular expressions over marked words.
"""

from __future__ import annotations

from lexiscore.catalog import fixtures as fx
from lexiscore.config import CALENDAR_COLUMNS, GRANULARITIES, LANGUAGE_SAMPLES, driver_groups
from lexiscore.functions.language import UNSEEN, sample_text
from lexiscore.functions.timestamps import COMMON_PATTERNS

ORACLES: dict[str, str] = {}


def _values(rows) -> str:
    def cell(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


# Tokens

_S = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"


def _sub(text: str, pattern: str, new: str) -> str:
    quote = "'"
    return f"regexp_replace({text}, '{pattern.replace(quote, quote * 2)}', '{new.replace(quote, quote * 2)}', 'g')"


def tokens(text: str, period: str = "") -> str:
    """``period`` stands for one right after a word at a sentence end; without it, such a period is a token like others."""
    s = f"lower({text})"
    s = _sub(s, rf"""(^|[{_S}(\[{{<])("|'')""", r"\1 `` ")
    s = f"""replace({s}, '"', ' '''' ')"""
    if period:
        s = _sub(s, rf"""([^.{_S}])\.([\])}}>'"»”’]*)([{_S}]|$)""", rf"\1 {period} \2 \3")
    s = _sub(s, rf"""(^|[^.])\.([\])}}>"'»”’]*)([{_S}]|$)""", r"\1 . \2 \3")
    s = _sub(s, r"([:,])([^0-9]|$)", r" \1 \2")
    s = _sub(s, r"[;@#$%&?!*()\[\]{}<>«»“”„‘’]|`+|--|\.\.+|''", r" \0 ")
    s = _sub(s, r"'([^\P{L}mtsdn]|[\p{N}_])([^\p{L}\p{N}_]|$)", r"' \1\2")
    s = _sub(s, rf"([^'{_S}])('s|'m|'d|'ll|'re|'ve|n't|')([{_S}]|$)", r"\1 \2 \3")
    s = _sub(s, rf"(^|[{_S}])(?:(can)(not)|(gim)(me)|(gon)(na)|(got)(ta))\b", r"\1\2\4\6\8 \3\5\7\9")
    s = _sub(s, rf"(^|[{_S}])(?:(lem)(me)|(wan)(na)|(d)('ye)|(more)('n))\b", r"\1\2\4\6\8 \3\5\7\9")
    s = _sub(s, rf"(^|[{_S}])('t)(is|was)\b", r"\1\2 \3")
    return f"list_filter(regexp_split_to_array({s}, '[{_S}]+'), lambda t: t <> '')"


# Posts

POSTS = """posts AS (
  SELECT d.doc_id AS tweet_id, o.o_orderdate + to_hours(CAST(d.doc_id % 24 AS INTEGER)) AS created_at, d.text, d.source,
         d.doc_id AS ord
  FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey)"""
_FLAGS = _values([(i, v) for i, v in enumerate(fx.FLAG_TEXTS)])
MESSY = f"""{POSTS},
flags(pos, flag) AS (VALUES {_FLAGS}),
copied AS (
  SELECT p.*, f.flag AS retweet FROM posts p JOIN flags f ON p.ord % {len(fx.FLAG_TEXTS)} = f.pos
  UNION ALL
  SELECT * REPLACE (ord + 10000000 AS ord), 'no' FROM posts WHERE tweet_id % 5 = 0
  UNION ALL
  SELECT * REPLACE (ord + 20000000 AS ord, 'RT ' || text AS text), 'TRUE' FROM posts WHERE tweet_id % 5 = 0),
messy AS (
  SELECT CASE WHEN tweet_id % 11 = 0 THEN tweet_id - 1 ELSE tweet_id END AS tweet_id,
         CASE WHEN tweet_id % 13 = 0 THEN NULL ELSE created_at END AS created_at,
         text, retweet, source, ord
  FROM copied)"""
_TRUE = "coalesce(lower(trim(retweet)) IN ('true', '1', 'yes'), false)"


def _runs(keys: str, source: str, other: str = "'[^\\p{L}]'") -> str:
    """A query of the runs of three characters around each letter of ``text``, all other characters being spaces."""
    return f"""SELECT {keys}, a || b || c AS gram FROM (
    SELECT {keys}, unnest(chars) AS a, unnest(chars[2:]) AS b, unnest(chars[3:]) AS c FROM (
      SELECT {keys}, string_split(' ' || regexp_replace(lower(text), {other}, ' ', 'g') || ' ', '') AS chars FROM {source} WHERE text <> ''))
    WHERE c IS NOT NULL AND b <> ' '"""


def language_model(samples: str, model: str = "model") -> str:
    """CTEs that end in ``model(language, gram, weight)`` for a relation ``samples(language, text)``."""
    return f"""{model}_runs AS (SELECT language, gram, count(*) AS n FROM ({_runs("language", samples)}) GROUP BY ALL),
{model} AS (SELECT * FROM (
  SELECT language, gram, CAST(floor(ln(n * {float(UNSEEN)}::DOUBLE / sum(n) OVER (PARTITION BY language)) * 1000 + 0.5) AS INTEGER) AS weight
  FROM {model}_runs) WHERE weight > 0)"""


def language_scores(source: str, key: str, languages: str, model: str = "model") -> str:
    """CTEs that end in ``lang_of(key, language, margin)``; ``languages(place, language)`` gives their order."""
    return f"""letters AS (SELECT string_agg(DISTINCT letter, '') AS known FROM (
  SELECT unnest(string_split(gram, '')) AS letter FROM {model}) WHERE letter <> ' '),
spoken AS ({_runs(key, source + ", letters", "'[^' || known || ']'")}),
lang_sums AS (SELECT {key}, language, sum(weight) AS score FROM spoken JOIN {model} USING (gram) GROUP BY ALL),
judged AS (SELECT {key}, language, score, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, place) AS nth
  FROM lang_sums JOIN {languages} USING (language)),
lang_of AS (SELECT {key}, any_value(language) FILTER (nth = 1) AS language,
  CAST(max(score) - coalesce(any_value(score) FILTER (nth = 2), 0) AS BIGINT) AS margin FROM judged GROUP BY {key})"""


def language(source: str, key: str) -> str:
    """CTEs that end in ``lang_of(key, language, margin)`` for each row of ``source``, by the model that is the default."""
    samples = [(i, lang, sample_text(lang)) for i, lang in enumerate(LANGUAGE_SAMPLES)]
    return f"""samples(place, language, text) AS (VALUES {_values(samples)}),
{language_model("samples")}, {language_scores(source, key, "samples")}"""


# Rows that may be scored, in one language and without copies.
CLEAN = f"""{MESSY},
original AS (SELECT * FROM messy WHERE NOT {_TRUE}),
{language("original", "ord")},
english AS (SELECT o.* FROM original o JOIN lang_of l USING (ord) WHERE l.language = 'en'),
clean AS (SELECT * EXCLUDE rn FROM (
  SELECT *, row_number() OVER (PARTITION BY text, tweet_id ORDER BY ord) AS rn FROM english) WHERE rn = 1)"""


def bag(source: str, keys: str) -> str:
    return f"""term_bag AS (
  SELECT {keys}, term, count(*) AS frequency
  FROM (SELECT {keys}, unnest({tokens("text")}) AS term FROM {source}) GROUP BY ALL)"""


LEXICON = f"lexicon(term, {', '.join(fx.SCORE_COLUMNS)}) AS (VALUES {_values(fx.lexicon_rows())})"
EXTRA = f"extra(term, safety_pos, safety_neg) AS (VALUES {_values(fx.EXTRA_ROWS)})"
MERGED = "merged AS (SELECT * FROM lexicon JOIN extra USING (term))"
EXTRA_COLUMNS = [*fx.SCORE_COLUMNS, "safety_pos", "safety_neg"]


def weighted_sums(lexicon: str, columns: list[str], name: str = "sums") -> str:
    cols = ", ".join(f"CAST(sum(frequency * {c}) AS BIGINT) AS {c}" for c in columns)
    return f"{name} AS (SELECT tweet_id, {cols} FROM term_bag JOIN {lexicon} USING (term) GROUP BY tweet_id)"


_CALENDAR = {
    "year": "CAST(year(created_at) AS INTEGER)",
    "quarter": "CAST(quarter(created_at) AS INTEGER)",
    "month": "CAST(month(created_at) AS INTEGER)",
    "week": "CAST(week(created_at) AS INTEGER)",
}
_CALENDAR_LIST = ", ".join(f"{sql} AS {c}" for c, sql in _CALENDAR.items())


def nets_and_drivers(source: str, total: str, extra: str | None = None) -> str:
    """A query that adds nets, drivers and the total to all columns of ``source``."""
    groups = driver_groups(extra)
    nets = ", ".join(f"CAST({s}_pos - {s}_neg AS BIGINT) AS {s}_net" for subs in groups.values() for s in subs)
    drivers = ", ".join(f"({' + '.join(s + '_net' for s in subs)}) / {len(subs)}.0::DOUBLE AS {b}_Driver" for b, subs in groups.items())
    add = " + ".join(f"{b}_Driver" for b in groups)
    return f"""SELECT *, {add} AS "{total}" FROM (SELECT *, {drivers} FROM (SELECT *, {nets} FROM {source}))"""


def scored(raw: str = "messy", extra: str | None = None) -> str:
    """CTE ``scored``: rows of ``raw`` with calendar, sums, nets, drivers and reputation."""
    attach = f"attached AS (SELECT r.*, {_CALENDAR_LIST}, s.* EXCLUDE tweet_id FROM {raw} r JOIN sums s USING (tweet_id))"
    return f"{attach}, scored AS ({nets_and_drivers('attached', 'Brand_Reputation', extra)})"


_ROUND_POST = ["Value_Driver", "Brand_Driver", "Relationship_Driver", "Brand_Reputation"]


def _rounded(columns: list[str]) -> str:
    return "* REPLACE (" + ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in columns) + ")"


SUMS = f"{CLEAN}, {bag('clean', 'ord, tweet_id')}, {LEXICON}, {weighted_sums('lexicon', fx.SCORE_COLUMNS)}"
SCORED = f"{SUMS}, {scored()}"
EXTRA_SCORED = (
    f"{CLEAN}, {bag('clean', 'ord, tweet_id')}, {LEXICON}, {EXTRA}, {MERGED}, "
    f"{weighted_sums('merged', EXTRA_COLUMNS)}, {scored(extra='safety')}"
)


def series(keys: list[str], columns: list[str], extra: str | None = None, sets: str | None = None) -> str:
    """CTEs that end in ``final``: z-scored periods of ``scored``."""
    sums = ", ".join(f"sum({c}) AS {c}" for c in columns)
    by = sets or ", ".join(keys)
    level = "granularity" if sets else "1"
    name = ""
    if sets:
        # The grouping id tells the levels apart: one bit per absent column.
        bits = {"Weekly": 0, "Monthly": 1, "Quarterly": 3, "Yearly": 7}
        name = f"CASE grouping({', '.join(keys)}) " + " ".join(f"WHEN {b} THEN '{g}'" for g, b in bits.items()) + " END AS granularity, "
    groups = driver_groups(extra)
    out = []
    for b, subs in groups.items():
        out += [f"{s}_net" for s in subs] + [f"{b}_Driver"]
    out.append("Brand Reputation")
    z = ", ".join(
        f"""round(CASE WHEN stddev_samp("{c}") OVER w IS NULL OR stddev_samp("{c}") OVER w <= 1e-12 * max(abs("{c}")) OVER w THEN 0.0::DOUBLE
        ELSE ("{c}" - avg("{c}") OVER w) / stddev_samp("{c}") OVER w END, 6) + 0.0 AS "{c}" """
        for c in out
    )
    shown = ", ".join((["granularity"] if sets else []) + keys)
    return f"""periods AS (
  SELECT {name}{", ".join(keys)}, arg_min(created_at, ord) AS created_at, count(tweet_id) AS total_tweets, {sums}
  FROM scored WHERE created_at IS NOT NULL GROUP BY {by}),
measured AS ({nets_and_drivers("periods", "Brand Reputation", extra)}),
final AS (SELECT {shown}, created_at, total_tweets, {z} FROM measured WINDOW w AS (PARTITION BY {level}))"""


# Ingest

ORACLES["ingest_csv_roundtrip"] = f"WITH {POSTS} SELECT * FROM posts"
ORACLES["ingest_csv_inferred"] = f"""WITH {POSTS}
SELECT *, CASE WHEN ord % 3 <> 0 THEN ord / 8 END AS share, CAST(NULL AS VARCHAR) AS none FROM posts"""
ORACLES["map_columns"] = "SELECT conv_id AS tweet_id, turn AS created_at, role, text FROM conversations"
ORACLES["missing_columns"] = """SELECT missing_column, count(*) AS n_posts FROM documents
  CROSS JOIN (VALUES ('tweet_id'), ('created_at')) v(missing_column) GROUP BY 1"""
ORACLES["preview"] = f"WITH {MESSY} SELECT tweet_id, created_at, text, retweet FROM messy ORDER BY ord LIMIT 5"
ORACLES["first_n_large"] = """WITH keyed AS (SELECT l_orderkey, l_linenumber, l_returnflag,
  CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_quantity AS BIGINT) END AS quantity FROM lineitem)
SELECT quantity, l_orderkey, l_linenumber, l_returnflag FROM keyed
ORDER BY quantity NULLS LAST, l_orderkey, l_linenumber LIMIT (SELECT count(*) // 3 FROM lineitem)"""
ORACLES["first_n_by_price"] = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice END AS l_extendedprice
FROM lineitem ORDER BY 3 NULLS LAST, 1, 2 LIMIT (SELECT count(*) // 2 FROM lineitem)"""
ORACLES["first_n_by_time"] = """SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders
ORDER BY o_orderdate, o_orderpriority, o_orderkey LIMIT (SELECT count(*) // 4 FROM orders)"""
ORACLES["first_n"] = f"WITH {MESSY} SELECT * FROM messy ORDER BY ord LIMIT 300"

# Time

TIMES = """times AS (
  SELECT o_orderkey AS tweet_id, o_orderdate + to_seconds(CAST((o_orderkey * 97) % 86400 AS INTEGER)) AS moment FROM orders)"""
_by_pattern = ", ".join(
    f"try_strptime(CASE WHEN tweet_id % 10 = 3 THEN 'n/a' ELSE strftime(moment, '{p}') END, '{p}') AS p{i:02d}"
    for i, p in enumerate(COMMON_PATTERNS)
)
ORACLES["parse_time_by_pattern"] = f"WITH {TIMES} SELECT tweet_id, {_by_pattern} FROM times"
_forms = " ".join(f"WHEN {i} THEN strftime(moment, '{p}')" for i, p in enumerate(COMMON_PATTERNS))
_n = len(COMMON_PATTERNS) + 1
MIXED = f"{TIMES}, mixed AS (SELECT tweet_id, CASE tweet_id % {_n} {_forms} ELSE 'n/a' END AS t FROM times)"
_best = "coalesce(" + ", ".join(f"try_strptime(t, '{p}')" for p in COMMON_PATTERNS) + ")"
ORACLES["parse_time_best_effort"] = f"WITH {MIXED} SELECT tweet_id, {_best} AS created_at FROM mixed"
_two = r"'^\s*(\d{1,2})(?:/(\d{1,2})/|\.(\d{1,2})\.|-(\d{1,2})-)\d{4}(?:\D.*)?$'"
_second = f"CAST(regexp_extract(t, {_two}, 2) || regexp_extract(t, {_two}, 3) || regexp_extract(t, {_two}, 4) AS INTEGER)"
ORACLES["date_shapes"] = f"""WITH {MIXED},
split AS (SELECT t, CAST(regexp_extract(t, {_two}, 1) AS INTEGER) AS a, {_second} AS b FROM mixed WHERE regexp_matches(t, {_two}))
SELECT regexp_replace(t, '[0-9]', '9', 'g') AS shape, count(*) AS n_rows, count(*) FILTER (a > 12 AND b <= 12) AS n_day_first,
       count(*) FILTER (b > 12 AND a <= 12) AS n_month_first FROM split GROUP BY 1"""
ORACLES["parse_time_one_order"] = f"""WITH {TIMES}
SELECT tweet_id, CASE WHEN tweet_id % 31 = 30 THEN NULL WHEN tweet_id % 2 = 0 THEN date_trunc('minute', moment)
  ELSE date_trunc('day', moment) END AS created_at, CAST(NULL AS VARCHAR) AS fmt FROM times"""
ORACLES["parse_ratio"] = f"""WITH {MIXED}
SELECT round(avg(CASE WHEN {_best} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) + 0.0 AS ok_ratio FROM mixed"""
_LOCAL = "AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Paris'"
# The first 20 texts are all day/month/year, of which some days exceed 12, so that is the detected form.
ORACLES["normalise_created_at"] = f"""WITH {TIMES}
SELECT tweet_id, CASE WHEN tweet_id % 29 = 28 THEN NULL ELSE moment {_LOCAL} END AS created_at,
       '%d/%m/%Y %H:%M:%S' AS fmt FROM times"""
ORACLES["to_paris_time"] = f"WITH {TIMES} SELECT tweet_id, moment {_LOCAL} AS created_at FROM times"
ORACLES["calendar_columns"] = f"""WITH {TIMES}
SELECT tweet_id, created_at, {_CALENDAR_LIST} FROM (SELECT tweet_id, moment AS created_at FROM times)"""
ORACLES["format_timestamp"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events"

ORACLES["prepare_posts"] = f"""WITH {MESSY}
SELECT * REPLACE (created_at {_LOCAL} AS created_at, {_TRUE} AS retweet) FROM messy"""

# Each form that is inferred, as strftime writes it, with the precision that it has.
_INFERRED_SQL = [
    ("strftime(moment, '%a %b %d %H:%M:%S +0000 %Y')", "moment"),
    ("strftime(moment, '%b %-d, %Y')", "date_trunc('day', moment)"),
    ("strftime(moment, '%-d %B %Y %H:%M')", "date_trunc('minute', moment)"),
    ("strftime(moment, '%Y%m%d')", "date_trunc('day', moment)"),
    ("strftime(moment, '%m/%d/%Y %I:%M %p')", None),
    ("strftime(moment, '%d-%m-%Y')", "date_trunc('day', moment)"),
    ("strftime(moment, '%d.%m.%Y %H:%M')", "date_trunc('minute', moment)"),
    ("'n/a'", "NULL"),
]
_inferred = " ".join(
    f"WHEN {i} THEN {value or 'try_strptime(' + text + ', $$%m/%d/%Y %I:%M %p$$)'}" for i, (text, value) in enumerate(_INFERRED_SQL)
)
ORACLES["parse_time_inferred"] = f"""WITH {TIMES}
SELECT tweet_id, CAST(CASE tweet_id % {len(_INFERRED_SQL)} {_inferred} END AS TIMESTAMP) AS created_at FROM times"""

# Flags

ORACLES["coerce_flag_csv"] = f"""WITH {POSTS}
SELECT tweet_id, created_at {_LOCAL} AS created_at, text, false AS retweet, source, ord FROM posts
WHERE ord % 4 NOT IN (0, 3)"""
ORACLES["coerce_flag_string"] = f"WITH {MESSY} SELECT ord, {_TRUE} AS retweet FROM messy"
_NUMBERS = _values([(i, v) for i, v in enumerate(fx.FLAG_NUMBERS)])
ORACLES["coerce_flag_numeric"] = f"""WITH numbers(pos, flag) AS (VALUES {_NUMBERS})
SELECT o_orderkey, trunc(coalesce(flag, 0)) <> 0 AS retweet
FROM orders JOIN numbers ON o_orderkey % {len(fx.FLAG_NUMBERS)} = pos"""
ORACLES["coerce_flag_missing"] = "SELECT o_orderkey, false AS retweet FROM orders"
_reposted = "CASE WHEN tweet_id % 7 = 0 THEN 'RT ' || text ELSE text END"
ORACLES["infer_repost"] = f"WITH {POSTS} SELECT ord, coalesce(left({_reposted}, 2) = 'RT', false) AS retweet FROM posts"
ORACLES["drop_reposts"] = f"WITH {MESSY} SELECT * REPLACE (false AS retweet) FROM messy WHERE NOT {_TRUE}"

# Text and language

ORACLES["dedupe_keep_first"] = f"""WITH {MESSY} SELECT * EXCLUDE rn FROM (
  SELECT *, row_number() OVER (PARTITION BY text, tweet_id ORDER BY ord) AS rn FROM messy) WHERE rn = 1"""
ORACLES["term_frequency"] = f"WITH {bag('documents', 'doc_id')} SELECT * FROM term_bag"
ORACLES["term_rows"] = f"""WITH {CLEAN}, {bag("clean", "ord, tweet_id, created_at")}
SELECT ord, tweet_id, created_at, term, frequency FROM term_bag"""
ORACLES["clean_texts"] = f"""WITH {CLEAN} SELECT ord, tweet_id, created_at, lower(coalesce(text, '')) AS text FROM clean"""
ORACLES["detect_language"] = f"""WITH {language("documents", "doc_id")}
SELECT doc_id, language FROM documents LEFT JOIN lang_of USING (doc_id)"""
_LABELLED = "labelled AS (SELECT lang AS language, text FROM documents), places AS (SELECT DISTINCT language, language AS place FROM labelled)"
ORACLES["train_language_model"] = f"""WITH {_LABELLED}, {language_model("labelled")}
SELECT language AS lang, gram, weight FROM model"""
ORACLES["language_margins"] = f"""WITH {_LABELLED}, {language_model("labelled")},
said AS (SELECT row_number() OVER () AS nth_row, conv_id, turn, role, text FROM conversations),
{language_scores("said", "nth_row", "places")}
SELECT conv_id, turn, role, language, coalesce(margin, 0) AS margin FROM said LEFT JOIN lang_of USING (nth_row)"""
ORACLES["filter_language"] = f"""WITH {MESSY}, {language("messy", "ord")}
SELECT m.* REPLACE (false AS retweet) FROM messy m JOIN lang_of USING (ord) WHERE language = 'fr' AND NOT {_TRUE}"""


# Stems: words with marked consonant y (as Y), so that vowels are a, e, i, o, u, y.


def _mark(w: str) -> str:
    return f"regexp_replace(regexp_replace({w}, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')"


def _cut(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _m0(w: str) -> str:
    return f"regexp_matches({_mark(w)}, '[aeiouy][^aeiouy]')"


def _m1(w: str) -> str:
    return f"regexp_matches({_mark(w)}, '[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]')"


def _short(w: str) -> str:
    return f"regexp_matches({_mark(w)}, '[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$')"


def _rules(w: str, rules: str, condition) -> str:
    """CASE over ``suffix:new`` rules; the first suffix that fits decides."""
    arms = []
    for rule in rules.split():
        suffix, new = rule.split(":")
        base = _cut(w, len(suffix))
        arms.append(f"WHEN {w} LIKE '%{suffix}' THEN CASE WHEN {condition(base, suffix)} THEN {base} || '{new}' ELSE {w} END")
    return "CASE " + " ".join(arms) + f" ELSE {w} END"


_RULES_2 = """ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize
ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble fulli:ful logi:log"""
_RULES_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_RULES_4 = "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ion: ou: ism: ate: iti: ous: ive: ize:"
_IRREGULAR = """sky:sky skies:sky dying:die lying:lie tying:tie news:news innings:inning inning:inning outings:outing
outing:outing cannings:canning canning:canning howe:howe proceed:proceed exceed:exceed succeed:succeed"""


def stems(source: str) -> str:
    """CTEs that end in ``stems(term, stem)`` for the distinct ``term`` of ``source``."""
    second = _rules("w", _RULES_2, lambda base, suffix: _m0(_cut("w", 3) if suffix == "logi" else base))
    fourth = _rules(
        "w", _RULES_4, lambda base, suffix: _m1(base) + (f" AND regexp_matches({base}, '[st]$')" if suffix == "ion" else "")
    )
    last_e = f"({_m1(_cut('w', 1))} OR ({_m0(_cut('w', 1))} AND NOT {_short(_cut('w', 1))}))"
    irregular = _values([tuple(pair.split(":")) for pair in _IRREGULAR.split()])
    return f"""irregular(term, stem) AS (VALUES {irregular}),
vocabulary AS (SELECT DISTINCT term FROM {source}),
s1a AS (SELECT term, CASE WHEN term LIKE '%ies' AND length(term) = 4 THEN left(term, 3)
  WHEN term LIKE '%sses' OR term LIKE '%ies' THEN {_cut("term", 2)} WHEN term LIKE '%ss' THEN term
  WHEN term LIKE '%s' THEN {_cut("term", 1)} ELSE term END AS w FROM vocabulary),
s1b AS (SELECT term, w, CASE WHEN w LIKE '%ied' OR w LIKE '%eed' THEN NULL
  WHEN w LIKE '%ed' AND regexp_matches({_mark(_cut("w", 2))}, '[aeiouy]') THEN {_cut("w", 2)}
  WHEN w LIKE '%ing' AND regexp_matches({_mark(_cut("w", 3))}, '[aeiouy]') THEN {_cut("w", 3)} END AS b FROM s1a),
s1c AS (SELECT term, CASE
  WHEN w LIKE '%ied' THEN CASE WHEN length(w) = 4 THEN {_cut("w", 1)} ELSE {_cut("w", 2)} END
  WHEN w LIKE '%eed' THEN CASE WHEN {_m0(_cut("w", 3))} THEN {_cut("w", 1)} ELSE w END
  WHEN b IS NULL THEN w
  WHEN b LIKE '%at' OR b LIKE '%bl' OR b LIKE '%iz' THEN b || 'e'
  WHEN length(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND regexp_matches({_mark("b")}, '[^aeiouy]$')
    THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE {_cut("b", 1)} END
  WHEN {_m0("b")} AND NOT {_m1("b")} AND {_short("b")} THEN b || 'e' ELSE b END AS w FROM s1b),
s2 AS (SELECT term, CASE WHEN w LIKE '%y' AND length(w) > 2 AND regexp_matches({_mark(_cut("w", 1))}, '[^aeiouy]$')
  THEN {_cut("w", 1)} || 'i' ELSE w END AS w FROM s1c),
s2b AS (SELECT term, CASE WHEN w LIKE '%alli' AND {_m0(_cut("w", 4))} THEN {_cut("w", 2)} ELSE w END AS w FROM s2),
s3 AS (SELECT term, {second} AS w FROM s2b),
s4 AS (SELECT term, {_rules("w", _RULES_3, lambda base, suffix: _m0(base))} AS w FROM s3),
s5a AS (SELECT term, {fourth} AS w FROM s4),
s5b AS (SELECT term, CASE WHEN w LIKE '%e' AND {last_e} THEN {_cut("w", 1)} ELSE w END AS w FROM s5a),
s6 AS (SELECT term, CASE WHEN w LIKE '%ll' AND {_m1(_cut("w", 1))} THEN {_cut("w", 1)} ELSE w END AS w FROM s5b),
stems AS (SELECT s6.term, coalesce(i.stem, CASE WHEN length(s6.term) <= 2 THEN s6.term ELSE w END) AS stem
  FROM s6 LEFT JOIN irregular i ON s6.term = i.term)"""


_WORDS = f"words AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents)"
ORACLES["stem_vocabulary"] = f"WITH {_WORDS}, {stems('words')} SELECT term, stem FROM stems"
ORACLES["stem_sentence"] = f"""WITH bags AS (SELECT doc_id, {tokens("text")} AS bag FROM documents),
placed AS (SELECT doc_id, unnest(bag) AS term, generate_subscripts(bag, 1) AS pos FROM bags),
{stems("placed")},
joined AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS text_stemmed FROM placed JOIN stems USING (term) GROUP BY 1)
SELECT doc_id, coalesce(text_stemmed, '') AS text_stemmed FROM documents LEFT JOIN joined USING (doc_id)"""
_surface_cols = ", ".join(f"l.{c}" for c in fx.SCORE_COLUMNS)
ORACLES["score_posts_stemmed"] = f"""WITH {CLEAN}, {bag("clean", "ord, tweet_id")}, {LEXICON}, {stems("term_bag")},
surface AS (SELECT s.term, {_surface_cols} FROM stems s JOIN lexicon l ON s.stem = l.term),
{weighted_sums("surface", fx.SCORE_COLUMNS)}, {scored()}
SELECT {_rounded(_ROUND_POST)} FROM scored"""

# Lexicons

VOCABULARY = f"""doc_words AS (SELECT lang, unnest({tokens("text")}) AS term FROM documents),
vocabulary_lexicon AS (SELECT term, count(*) FILTER (lang = 'en') AS cool_pos,
  count(*) FILTER (lang IS DISTINCT FROM 'en') AS cool_neg FROM doc_words GROUP BY term)"""
SPOKEN = f"""said AS (SELECT role, unnest({tokens("text")}) AS term FROM conversations),
conversation_lexicon AS (SELECT term, count(*) FILTER (role = 'user') AS trust_pos,
  count(*) FILTER (role IS DISTINCT FROM 'user') AS trust_neg FROM said GROUP BY term)"""
ORACLES["merge_lexicon"] = f"""WITH {VOCABULARY}, {SPOKEN}
SELECT term, cool_pos, cool_neg, trust_pos, trust_neg FROM vocabulary_lexicon JOIN conversation_lexicon USING (term)"""
ORACLES["validate_lexicon"] = f"""WITH {VOCABULARY}, {SPOKEN}
SELECT 'cool_pos' AS column_name, CAST(sum(cool_pos) AS BIGINT) AS weight_sum, false AS paired, true AS free_of_net
FROM vocabulary_lexicon
UNION ALL SELECT 'trust_pos', CAST(sum(trust_pos) AS BIGINT), true, true FROM conversation_lexicon
UNION ALL SELECT 'trust_neg', CAST(sum(trust_neg) AS BIGINT), true, true FROM conversation_lexicon"""
ORACLES["read_lexicon_file"] = f"""WITH {POSTS}, {bag("posts", "ord, tweet_id")}, {LEXICON},
{weighted_sums("lexicon", fx.SCORE_COLUMNS)} SELECT * FROM sums"""
ORACLES["posts_without_text"] = "SELECT event_id AS ord, ts AS created_at, '' AS text, '' AS tweet_id FROM events"
ORACLES["post_sums_vocabulary_lexicon"] = f"""WITH {CLEAN}, {bag("clean", "ord, tweet_id")}, {VOCABULARY},
{weighted_sums("vocabulary_lexicon", ["cool_pos", "cool_neg"])} SELECT * FROM sums"""

ORACLES["post_sums_conversation_lexicon"] = f"""WITH {CLEAN}, {bag("clean", "ord, tweet_id")}, {SPOKEN},
{weighted_sums("conversation_lexicon", ["trust_pos", "trust_neg"])} SELECT * FROM sums"""

_shortened = "text"
for _long_form, _short_form in fx.SHORTENED.items():
    _shortened = f"replace({_shortened}, '{_long_form}', '{_short_form}')"
_MARK = "﷐"
ABBREVIATIONS = f"""bags AS (SELECT doc_id, {tokens(_shortened, _MARK)} AS bag FROM documents),
around AS (
  SELECT doc_id, unnest(bag) AS term, unnest(bag[2:] || [NULL]) AS after, unnest([NULL] || bag[:-2]) AS before FROM bags WHERE len(bag) > 0),
counted AS (
  SELECT term, count(*) AS n, count(*) FILTER (after = '{_MARK}') AS n_period FROM around WHERE term <> '{_MARK}' GROUP BY term),
judged_words AS (
  SELECT term, n, n_period, length(replace(term, '.', '')) AS letters, length(term) - length(replace(term, '.', '')) + 1 AS periods,
         least((SELECT sum(n_period) / sum(n) FROM counted), 0.99::DOUBLE) AS share
  FROM counted WHERE n_period > 0 AND regexp_matches(term, '^\\p{{L}}[\\p{{L}}\\p{{N}}.-]*$')),
abbreviations AS (SELECT * FROM (
  SELECT term, n, n_period, 2 * (n_period * ln(0.99::DOUBLE / share) + (n - n_period) * ln(0.01::DOUBLE / (1 - share)))
         * exp(-letters) * periods / pow(letters::DOUBLE, n - n_period) AS score
  FROM judged_words) WHERE score >= 0.3)"""
ORACLES["abbreviation_scores"] = f"""WITH {ABBREVIATIONS}
SELECT term, n, n_period, round(score, 6) + 0.0 AS score FROM abbreviations"""
ORACLES["term_frequency_abbreviations"] = f"""WITH {ABBREVIATIONS},
kept AS (
  SELECT doc_id, CASE WHEN a.term = '{_MARK}' THEN '.' WHEN a.after = '{_MARK}' AND k.term IS NOT NULL THEN a.term || '.' ELSE a.term END AS term
  FROM around a LEFT JOIN abbreviations k ON a.term = k.term LEFT JOIN abbreviations b ON a.before = b.term
  WHERE NOT (a.term = '{_MARK}' AND b.term IS NOT NULL))
SELECT doc_id, term, count(*) AS frequency FROM kept GROUP BY ALL"""

# Scores

_term_scores = ", ".join(f"CAST(frequency * {c} AS BIGINT) AS {c}" for c in fx.SCORE_COLUMNS)
ORACLES["term_scores"] = f"""WITH {POSTS}, {bag("posts", "ord, tweet_id")}, {LEXICON}
SELECT ord, tweet_id, term, frequency, {_term_scores} FROM term_bag JOIN lexicon USING (term)"""
ORACLES["post_term_sums"] = f"""WITH {POSTS}, {bag("posts", "ord, tweet_id")}, {LEXICON},
{weighted_sums("lexicon", fx.SCORE_COLUMNS)} SELECT * FROM sums"""
ORACLES["score_posts"] = f"WITH {SCORED} SELECT {_rounded(_ROUND_POST)} FROM scored"
ORACLES["score_posts_clean_reattach"] = f"""WITH {SUMS},
clean_flag AS (SELECT * REPLACE (false AS retweet) FROM clean), {scored("clean_flag")}
SELECT {_rounded(_ROUND_POST)} FROM scored"""
ORACLES["score_posts_extra_driver"] = f"""WITH {EXTRA_SCORED}
SELECT {_rounded([*_ROUND_POST, "safety_Driver"])} FROM scored"""

ORACLES["score_posts_bucketed"] = ORACLES["score_posts"]
ORACLES["score_posts_stored"] = ORACLES["score_posts"]
_sides = {end: " + ".join(c for c in fx.SCORE_COLUMNS if c.endswith(end)) for end in ("_pos", "_neg")}
ORACLES["index_two_lexicons"] = f"""WITH {SUMS}, {VOCABULARY}, {weighted_sums("vocabulary_lexicon", ["cool_pos", "cool_neg"], "big_sums")}
SELECT 'hand-made' AS lexicon, tweet_id, CAST({_sides["_pos"]} AS BIGINT) AS pos, CAST({_sides["_neg"]} AS BIGINT) AS neg FROM sums
UNION ALL SELECT 'vocabulary', tweet_id, cool_pos, cool_neg FROM big_sums"""

# Series

for _name, _keys in {
    "score_series_monthly": GRANULARITIES["Monthly"],
    "series_weekly": GRANULARITIES["Weekly"],
    "series_quarterly": GRANULARITIES["Quarterly"],
    "series_yearly": GRANULARITIES["Yearly"],
    "series_pooled_month": ["month"],
}.items():
    ORACLES[_name] = f"WITH {SCORED}, {series(_keys, fx.SCORE_COLUMNS)} SELECT * FROM final ORDER BY created_at"
ORACLES["series_merged_state"] = ORACLES["series_weekly"]
ORACLES["series_merged_moments"] = ORACLES["score_series_monthly"]
# Each text of an id counts for itself, at its own time.
_per_post = ", ".join(f"CAST(sum(frequency * {c}) AS BIGINT) AS {c}" for c in fx.SCORE_COLUMNS)
_STREAMED = CLEAN.replace("CASE WHEN tweet_id % 11 = 0 THEN tweet_id - 1 ELSE tweet_id END AS tweet_id,", "tweet_id,")
ORACLES["series_streamed"] = f"""WITH {_STREAMED}, {bag("clean", "ord")}, {LEXICON},
post_sums AS (SELECT ord, {_per_post} FROM term_bag JOIN lexicon USING (term) GROUP BY ord),
scored AS (SELECT c.tweet_id, c.created_at, {_CALENDAR_LIST}, p.* FROM post_sums p JOIN clean c USING (ord)),
{series(GRANULARITIES["Weekly"], fx.SCORE_COLUMNS)} SELECT * FROM final ORDER BY created_at"""
_sets = "GROUPING SETS (" + ", ".join(f"({', '.join(keys)})" for keys in GRANULARITIES.values()) + ")"
ORACLES["series_all_levels"] = (
    f"WITH {SCORED}, {series(CALENDAR_COLUMNS, fx.SCORE_COLUMNS, sets=_sets)} SELECT * FROM final"
)
ORACLES["series_extra_driver"] = (
    f"WITH {EXTRA_SCORED}, {series(GRANULARITIES['Monthly'], EXTRA_COLUMNS, 'safety')} SELECT * FROM final ORDER BY created_at"
)
_shared = " UNION ALL ".join(
    f"""SELECT '{name}' AS granularity, count(*) AS n_periods, CAST(sum(total_tweets) AS BIGINT) AS n_posts,
    max(created_at) AS last_at FROM (WITH {series(keys, fx.SCORE_COLUMNS)} SELECT * FROM final)"""
    for name, keys in GRANULARITIES.items()
)
ORACLES["series_shared"] = f"WITH {SCORED} {_shared}"
_MONTHLY = f"{SCORED}, {series(GRANULARITIES['Monthly'], fx.SCORE_COLUMNS)}"
ORACLES["series_long"] = f"WITH {_MONTHLY} " + " UNION ALL ".join(
    f"""SELECT year, quarter, month, created_at, '{c}' AS driver, "{c}" AS score FROM final"""
    for c in ("Brand Reputation", "Value_Driver", "Brand_Driver")
)
ORACLES["series_plot"] = f"""WITH {_MONTHLY} SELECT created_at, "Brand Reputation" FROM final ORDER BY created_at"""

# Export

_cell = """CASE WHEN regexp_matches({c}, '[",\\n\\r]') THEN '"' || replace({c}, '"', '""') || '"' ELSE coalesce({c}, '') END"""
_flag = f"CASE WHEN {_TRUE} THEN 'True' ELSE 'False' END"
ORACLES["export_rows"] = f"""WITH {MESSY}
SELECT concat_ws(',', tweet_id, coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S'), ''), {_cell.format(c="text")}, {_flag},
  {_cell.format(c="source")}, ord) AS row FROM messy"""
ORACLES["export_csv"] = f"WITH {MESSY} SELECT * REPLACE ({_TRUE} AS retweet) FROM messy"
ORACLES["export_txt"] = ORACLES["export_csv"]
ORACLES["export_parquet_naive"] = f"SELECT event_id, ts {_LOCAL} AS created_at FROM events"
