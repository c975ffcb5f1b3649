"""DuckDB SQL for the registered queries, written from the rules and not from the plans."""

from __future__ import annotations

from layoutlens.functions.layout import KEYS, TYPED_ENGLISH, TYPED_PERSIAN
from layoutlens.functions.predicates import DELIMITERS, EXCLUDED, MODIFIERS, NAVIGATION, excluded_names
from layoutlens.operators.lexicon import REJECTED_PERSIAN, SHORT_ENGLISH, SHORT_PERSIAN

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_FA = lambda w: f"translate({w}, {_Q(TYPED_ENGLISH)}, {_Q(TYPED_PERSIAN)})"
_EN = lambda w: f"translate({w}, {_Q(TYPED_PERSIAN[:31])}, {_Q(TYPED_ENGLISH[:31])})"
_SHAPE = lambda w: f"regexp_full_match({w}, '[a-z]+(''[a-z]+)?')"

_TOKENS = f"""
t AS (SELECT CASE WHEN lang IN ('en', 'de') THEN 1 ELSE 2 END AS lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
cnt AS (SELECT lang, CASE lang WHEN 1 THEN w ELSE {_FA("w")} END AS form, count(*) AS n FROM t GROUP BY ALL)"""
_LEXICON = f"""{_TOKENS},
fit AS (SELECT * FROM cnt WHERE length(form) BETWEEN 3 AND 32),
ranked AS (SELECT lang, form, row_number() OVER (PARTITION BY lang ORDER BY n DESC, form) AS rank FROM fit),
short AS (SELECT 1 AS lang, unnest([{", ".join(map(_Q, SHORT_ENGLISH))}]) AS form UNION ALL SELECT 2, unnest([{", ".join(map(_Q, SHORT_PERSIAN))}])),
tier AS (
    SELECT lang, form, 'is_short' AS tier FROM short UNION ALL SELECT lang, form, 'is_word' FROM fit WHERE n >= 2
    UNION ALL SELECT lang, form, 'is_common' FROM ranked WHERE rank <= 20000
    UNION ALL SELECT lang, form, 'is_frequent' FROM ranked WHERE rank <= 2000 UNION ALL SELECT lang, form, 'is_frequent' FROM short
    UNION ALL SELECT lang, left(form, k), 'is_prefix' FROM (SELECT lang, form, unnest(range(3, length(form))) AS k FROM fit WHERE n >= 2)
    UNION ALL SELECT lang, left(form, k), 'is_common_prefix' FROM (SELECT lang, form, unnest(range(3, length(form))) AS k FROM ranked WHERE rank <= 20000)),
lex AS (SELECT lang, form, {", ".join(f"bool_or(tier = '{x}') AS {x}" for x in ("is_short", "is_word", "is_common", "is_frequent", "is_prefix", "is_common_prefix"))}
        FROM tier GROUP BY lang, form)"""
_PRIORS = f"""
side AS (SELECT lang, form, n, sum(n) OVER (PARTITION BY lang) AS total FROM fit WHERE n >= 2),
pri AS (SELECT e.form AS english, f.form AS persian,
        CAST(greatest(-75, least(75, round_even(24.0 * (log10(f.n * 1e9 / f.total) - log10(e.n * 1e9 / e.total)), 0))) AS INTEGER) AS points
        FROM side e JOIN side f ON e.lang = 1 AND f.lang = 2 AND f.form = {_FA("e.form")})"""


def _classified(source: str, columns: str, common: bool = True) -> str:
    """CTE cls: rows of `source` (en, fa and more) with the flags of both readings."""
    length = "CASE WHEN length(s.en) <= 2 THEN {0}.is_short ELSE " + ("({0}.is_word OR {0}.is_common)" if common else "{0}.is_word") + " END"
    return f"""
cls AS (SELECT *, en_known AND ef AS en_frequent, fa_known AND pf AS fa_frequent FROM (
    SELECT {columns}, {_SHAPE("s.lo")} AND coalesce({length.format("e")}, false) AS en_known,
        coalesce({length.format("p")}, false) OR coalesce({length.format("m")}, false) AS fa_known,
        coalesce(e.is_frequent, false) AS ef, coalesce(p.is_frequent, false) AS pf,
        coalesce(e.is_prefix, false) AS en_prefix, coalesce(p.is_prefix, false) AS fa_prefix,
        coalesce(e.is_common_prefix, false) AS en_common_prefix, coalesce(p.is_common_prefix, false) AS fa_common_prefix
    FROM (SELECT *, translate(en, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lo FROM {source}) s
    LEFT JOIN lex e ON e.lang = 1 AND e.form = s.lo
    LEFT JOIN lex p ON p.lang = 2 AND p.form = s.fa
    LEFT JOIN lex m ON m.lang = 2 AND left(s.fa, 1) = 'ا' AND m.form = 'آ' || substr(s.fa, 2)))"""


_TYPED = f"typed AS (SELECT DISTINCT en, {_FA('en')} AS fa FROM (SELECT CASE lang WHEN 1 THEN form ELSE {_EN('form')} END AS en FROM cnt WHERE length(form) <= 32))"
_FLAGS = "en_known, fa_known, en_frequent, fa_frequent, en_prefix, fa_prefix, en_common_prefix, fa_common_prefix"
_TYPED_CLASSES = f"{_TYPED}, {_classified('typed', 's.en, s.fa')}"


def _decide(phase: int, reduced: bool = False, common: bool = True) -> str:
    """Decisions of a phase in all cases; `reduced`: without frequent words and prefixes of common ones."""
    bonus = {0: 0, 1: 5, 2: 10}[phase]
    acts = {
        0: "CASE WHEN length(en) = 2 THEN 1 WHEN ak AND context = target AND strength >= 4 THEN 2 WHEN ap THEN 1 ELSE 2 END",
        1: "CASE WHEN length(en) <> 2 AND NOT ak AND ac THEN 1 ELSE 2 END",
        2: "2",
    }[phase]
    almost = "ok AND ak AND strength < 5 AND ev < limit_ AND ev + 5 >= limit_" if phase == 0 else "false"
    flag = lambda name: "false" if reduced and name in ("frequent", "common_prefix") else "{0}_" + name
    of = lambda name, own, other: f"CASE active WHEN 1 THEN {flag(name).format(own)} ELSE {flag(name).format(other)} END"
    return f"""
WITH {_LEXICON}, {_PRIORS}, {_TYPED}, {_classified("typed", "s.en, s.fa", common)},
cases AS (SELECT a AS active, s AS sensitivity, c.context, c.strength, b AS sentence_start FROM (SELECT unnest([1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS s),
          (VALUES (0, 0), (1, 2), (2, 3), (1, 5)) c(context, strength), (SELECT unnest([false, true]) AS b)),
r AS (SELECT *, 3 - active AS target, {of("known", "en", "fa")} AS ak, {of("known", "fa", "en")} AS tk, {of("frequent", "en", "fa")} AS af, {of("frequent", "fa", "en")} AS tf,
        {of("prefix", "en", "fa")} AS ap, {of("common_prefix", "en", "fa")} AS ac, coalesce(points, 0) * CASE active WHEN 1 THEN 1 ELSE -1 END AS prior
      FROM cls LEFT JOIN pri ON pri.english = cls.en, cases WHERE en_known OR fa_known),
x AS (SELECT *, length(en) >= CASE WHEN sensitivity <= 0 THEN 4 ELSE 2 END AND tk AS ok,
        CASE WHEN sensitivity <= 0 THEN 45 WHEN sensitivity >= 2 THEN 25 ELSE 35 END AS limit_,
        CASE WHEN strength >= 5 THEN 100 ELSE CASE WHEN context = target THEN 30 * strength WHEN context = active THEN -30 * strength ELSE 0 END
          + CASE WHEN tf AND NOT af THEN 45 WHEN af AND NOT tf THEN -45 ELSE 0 END
          + CASE WHEN sentence_start AND length(en) >= 3 THEN prior ELSE prior // 4 END + {bonus} END AS ev FROM r),
y AS (SELECT *, ok AND (NOT ak OR CASE WHEN strength >= 5 THEN context = target ELSE ev >= limit_ END) AS made, {almost} AS nearly FROM x),
z AS (SELECT *, CASE WHEN made THEN {acts} WHEN nearly THEN 1 ELSE 0 END AS action,
        CASE WHEN NOT made THEN 0 WHEN NOT ak THEN CASE WHEN length(en) >= 5 THEN 100 WHEN length(en) >= 3 THEN 95 ELSE 90 END
             ELSE greatest(0, least(100, ev)) END AS confidence,
        CASE WHEN made THEN CASE active WHEN 1 THEN fa ELSE en END ELSE '' END AS replacement FROM y)
SELECT active, sensitivity, context, strength, sentence_start, action, confidence, count(*) AS n, min(replacement) AS first_replacement FROM z GROUP BY ALL
"""


_SENTENCES = f"""
parts AS (SELECT conv_id, turn, unnest(s) AS s, unnest(range(0, len(s))) AS sentence FROM (SELECT conv_id, turn, regexp_split_to_array(lower(text), '[.!?\\n]') AS s FROM conversations WHERE text IS NOT NULL)),
raw AS (SELECT conv_id, turn, CAST(sentence AS INTEGER) AS sentence, unnest(w) AS en, unnest(range(0, len(w))) AS p FROM (SELECT conv_id, turn, sentence, regexp_extract_all(s, '[a-z]+') AS w FROM parts)),
broken AS (SELECT * FROM (SELECT *, count(*) FILTER (length(en) > 32) OVER (PARTITION BY conv_id, turn, sentence ORDER BY p) AS part FROM raw) WHERE length(en) <= 32),
sw AS (SELECT conv_id, turn, sentence, part, CAST(row_number() OVER (PARTITION BY conv_id, turn, sentence, part ORDER BY p) AS INTEGER) AS pos, en, {_FA("en")} AS fa,
       CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS visible FROM broken)"""
_SENTENCE_CLASSES = f"{_SENTENCES}, {_classified('sw', 's.conv_id, s.turn, s.sentence, s.part, s.pos, s.en, s.fa, s.visible')}"
_POINTS = """
pts AS (SELECT *, CASE WHEN en_known THEN 30 + CASE WHEN en_frequent THEN 18 ELSE 0 END WHEN length(en) <= 2 THEN -16 ELSE -26 END AS e,
        CASE WHEN fa_known THEN 30 + CASE WHEN fa_frequent THEN 18 ELSE 0 END WHEN length(en) <= 2 THEN -16 ELSE -26 END AS f FROM cls)"""


_RUN = """
scored AS (SELECT *, CAST(se + CASE WHEN ke = words THEN 12 + words * 8 ELSE 0 END + CASE WHEN context = 1 AND strength BETWEEN 1 AND 4 THEN 8 * strength ELSE 0 END AS INTEGER) AS en_score,
           CAST(sf + CASE WHEN kf = words THEN 12 + words * 8 ELSE 0 END + CASE WHEN context = 2 AND strength BETWEEN 1 AND 4 THEN 8 * strength ELSE 0 END AS INTEGER) AS fa_score,
           CASE sensitivity WHEN 0 THEN 55 WHEN 1 THEN 40 ELSE 30 END AS least_margin FROM sums, asked),
made AS (SELECT *, CASE WHEN words BETWEEN 2 AND 32 AND en_score - fa_score >= least_margin AND ke = words THEN 1
                        WHEN words BETWEEN 2 AND 32 AND fa_score - en_score >= least_margin AND kf = words THEN 2 ELSE 0 END AS language FROM scored)"""


_CHARS = f"""
chars AS (SELECT conv_id, turn, unnest(c) AS c FROM (SELECT conv_id, turn, string_split(text, '') AS c FROM conversations WHERE text IS NOT NULL)),
ch AS (SELECT * FROM chars WHERE c <> '')"""
_LETTERS = ", ".join(_Q(k[1]) for k in KEYS) + ", " + ", ".join(_Q(k[2]) for k in KEYS)

_STATE = "{'language': CAST(0 AS INTEGER), 'strength': CAST(0 AS INTEGER), 'observed_words': CAST(0 AS BIGINT), 'l': CAST(0 AS INTEGER), 'e': CAST(0 AS INTEGER)}"

_SEEN = """
o AS (SELECT *, CASE WHEN CASE visible WHEN 1 THEN en_known ELSE fa_known END THEN visible ELSE 3 - visible END AS l,
        CASE WHEN en_known AND fa_known THEN 1 WHEN CASE visible WHEN 1 THEN en_frequent ELSE fa_frequent END THEN 3 ELSE 2 END AS e FROM cls WHERE en_known OR fa_known)"""
_LISTED = "list({{'language': CAST(0 AS INTEGER), 'strength': CAST(0 AS INTEGER), 'observed_words': CAST(0 AS BIGINT), 'l': CAST(l AS INTEGER), 'e': CAST(e AS INTEGER)}} ORDER BY {0})"
_FOLDED = f"""list_reduce(rows, lambda s, r: {{
        'language': CAST(CASE WHEN s.language = 0 OR s.strength <= 0 OR s.language = r.l THEN r.l WHEN s.strength > r.e THEN s.language WHEN s.strength = r.e THEN 0 ELSE r.l END AS INTEGER),
        'strength': CAST(CASE WHEN s.language = 0 OR s.strength <= 0 THEN r.e WHEN s.language = r.l THEN CASE WHEN s.strength < r.e THEN r.e ELSE least(4, s.strength + 1) END ELSE abs(s.strength - r.e) END AS INTEGER),
        'observed_words': s.observed_words + 1, 'l': r.l, 'e': r.e}}, {_STATE})"""
_WORD_KEYS = ", ".join(_Q(c) for k in KEYS for c in (k[1], k[2]) if c != ".")
_STROKES = f"""
tc AS (SELECT conv_id, turn, unnest(s) AS c, unnest(range(0, len(s))) AS ix FROM (SELECT conv_id, turn, string_split(text, '') AS s FROM conversations WHERE text IS NOT NULL)),
tp AS (SELECT *, conv_id * 7 + turn * 5 + ix AS place, c IN ({_WORD_KEYS}) AS is_key FROM tc WHERE c <> ''),
tk AS (SELECT *, CASE WHEN place % 503 = 0 THEN 40 ELSE 1 END AS stuck, CASE WHEN place % 11 = 0 THEN ix % 3 + 1 WHEN place % 97 = 0 THEN 12 ELSE 0 END AS back FROM tp),
strokes AS (SELECT conv_id, turn, ix * 100 + j AS seq, ix * 200 + ix * 37 % 101 + ix // 50 * 2000 + j AS ts_ms, CASE WHEN j >= stuck THEN 'back' WHEN is_key THEN 'key' ELSE 'end' END AS stroke, c AS english,
            {_FA("translate(c, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS persian FROM (SELECT *, unnest(range(0, stuck + back)) AS j FROM tk))"""
_SPANS = """
ended AS (SELECT *, coalesce(sum(CASE stroke WHEN 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span,
          CASE WHEN stroke = 'key' AND lag(stroke) OVER (PARTITION BY conv_id, turn ORDER BY seq) = 'key' THEN ts_ms - lag(ts_ms) OVER (PARTITION BY conv_id, turn ORDER BY seq) END AS d FROM strokes),
num AS (SELECT * REPLACE (CAST(span AS BIGINT) AS span), row_number() OVER (PARTITION BY conv_id, turn, span ORDER BY seq) AS k FROM ended WHERE stroke <> 'end'),
spans AS (SELECT conv_id, turn, CAST(span AS BIGINT) AS span, count(*) FILTER (stroke = 'key') AS strokes, count(*) FILTER (stroke = 'back') AS erased, count(d) AS intervals, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
          FROM ended GROUP BY conv_id, turn, span)"""

_HASHES = """
b AS (SELECT *, list_transform(range(0, octet_length(encode(form))), lambda i: CAST('0x' || hex(encode(form))[2 * i + 1 : 2 * i + 2] AS BIGINT)) AS bytes FROM {0}),
h AS (SELECT *, list_reduce(bytes, lambda a, x: (xor(a, x) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS h1,
             list_reduce(bytes, lambda a, x: xor((a * 33) & 4294967295, x), CAST(5381 AS BIGINT)) AS h2 FROM b)"""
_SPOTS = "list_transform(range(0, {0}), lambda i: (h1 + i * (((h2 * 2) | 1) & 4294967295) + ((i * i * 2654435769) & 4294967295)) & ({1} - 1))"
_LONG = f"{_TOKENS}, long AS (SELECT lang, form, n FROM cnt WHERE length(form) >= 3)"
_NUMBER = "(ascii(form) * 7 + ascii(right(form, 1)) + length(form) * 3)"
_RAW = f"""
d1 AS (SELECT *, {_NUMBER} AS k, translate(form, 'یک', 'يك') AS r0 FROM cnt WHERE lang = 2),
d2 AS (SELECT *, CASE WHEN k % 5 = 0 THEN left(r0, 2) || chr(8204) || substr(r0, 3) ELSE r0 END AS r1 FROM d1),
d3 AS (SELECT *, CASE WHEN k % 7 = 0 THEN r1 || chr(1614) ELSE r1 END AS r2 FROM d2),
d4 AS (SELECT *, CASE WHEN k % 11 = 0 THEN r2 || '9' ELSE r2 END AS raw FROM d3),
nor AS (SELECT *, regexp_replace(nfc_normalize(replace(translate(raw, 'يك', 'یک'), chr(8204), '')), '\\p{{Mn}}', '', 'g') AS plain FROM d4)"""


def _read(key: tuple, shift: bool, caps: bool) -> str:
    scan, low, high, fa, fa_high = key
    upper = shift != caps if low in "abcdefghijklmnopqrstuvwxyz" else shift
    return f"({scan}, {shift}, {caps}, {_Q(high if upper else low)}, {_Q(fa_high if shift else fa)})"


_READINGS = "base(scan, shift, caps, en, fa) AS (VALUES " + ", ".join(_read(k, s, c) for k in KEYS for s in (False, True) for c in (False, True)) + ")"
_VARIANT = "own(scan, shift, caps, ven, vfa) AS (VALUES " + ", ".join(f"(43, {s}, {c}, {_Q('|' if s else chr(92))}, 'پ')" for s in (False, True) for c in (False, True)) + ", (50, false, false, NULL, 'ئ'))"
_NAMES = [*MODIFIERS, *NAVIGATION, *DELIMITERS, "Letter"]
_LIST = lambda names: "[" + ", ".join(map(_Q, names)) + "]"

ORACLES = {
    "keymap_words": f"""
WITH {_TOKENS} SELECT form AS english, {_FA('form')} AS persian, {_FA("upper(left(form, 1)) || substr(form, 2)")} AS raised, form AS back, length(form) AS keys FROM cnt WHERE lang = 1""",
    "word_shapes": f"""
WITH w AS (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM conversations), l AS (SELECT w, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lo FROM w WHERE w <> '')
SELECT {_SHAPE("lo")} AS shaped, length(w) AS length, count(*) AS n FROM l GROUP BY ALL""",
    "bloom_positions": f"WITH {_LONG}, {_HASHES.format('long')} SELECT lang, form, h1, h2, array_to_string({_SPOTS.format(10, 1 << 20)}, ',') AS positions FROM h",
    "bloom_build": f"WITH {_LONG}, {_HASHES.format('long')} SELECT DISTINCT lang, unnest({_SPOTS.format(10, 1 << 17)}) AS bit FROM h",
    "bloom_members": f"""
WITH {_LONG}, {_HASHES.format("long")}, s AS (SELECT list(DISTINCT bit) AS bits FROM (SELECT unnest({_SPOTS.format(4, 1 << 14)}) AS bit FROM h WHERE lang = 1 AND n >= 3)),
x AS (SELECT form, unnest({_SPOTS.format(4, 1 << 14)}) AS bit FROM h), y AS (SELECT DISTINCT unnest(bits) AS bit, true AS there FROM s)
SELECT form, bool_and(coalesce(there, false)) AS contained FROM x LEFT JOIN y USING (bit) GROUP BY form""",
    "lexicon_prefixes": f"WITH {_LONG} SELECT DISTINCT lang, left(form, k) AS form FROM (SELECT lang, form, unnest(range(3, length(form))) AS k FROM long)",
    "lexicon_package": f"""
WITH {_LEXICON}, {_PRIORS}, filter(lang, tier, bits, hashes) AS (VALUES (1, 'is_word', 2097152, 9), (2, 'is_word', 4194304, 9), (1, 'is_prefix', 2097152, 14), (2, 'is_prefix', 2097152, 14), (1, 'is_common', 1048576, 10),
  (2, 'is_common', 1048576, 10), (1, 'is_frequent', 131072, 10), (2, 'is_frequent', 131072, 10), (1, 'is_common_prefix', 1048576, 14), (2, 'is_common_prefix', 1048576, 14)),
f AS (SELECT DISTINCT lang, form FROM tier), {_HASHES.format("f")}, m AS (SELECT DISTINCT lang, form, tier FROM tier),
s AS (SELECT lang, tier, any_value(bits) AS bits, any_value(hashes) AS hashes, count(DISTINCT spot) AS bits_set, count(DISTINCT form) AS words
      FROM (SELECT h.lang, m.tier, h.form, bits, hashes, unnest({_SPOTS.format("hashes", "bits")}) AS spot FROM h JOIN m ON h.lang = m.lang AND h.form = m.form JOIN filter ON filter.lang = m.lang AND filter.tier = m.tier) GROUP BY lang, tier)
SELECT lang, tier, CAST(bits AS BIGINT) AS bits, CAST(hashes AS BIGINT) AS hashes, true AS valid, bits_set, words, (SELECT count(*) FROM pri) AS priors, (SELECT CAST(sum(points) AS BIGINT) FROM pri) AS points FROM s""",
    "eligible_words": f"""
WITH {_TOKENS}, {_RAW}
SELECT 1 AS lang, form || CASE WHEN length(form) % 3 = 0 THEN '''s' ELSE '' END AS form FROM cnt WHERE lang = 1 AND length(form) + CASE WHEN length(form) % 3 = 0 THEN 2 ELSE 0 END >= 3 AND ({_NUMBER} % 9 <> 0 OR length(form) % 3 = 1)
UNION ALL SELECT DISTINCT 2, plain FROM nor WHERE length(plain) >= 3 AND NOT regexp_matches(plain, '[0-9]')""",
    "ranked_words": f"""
WITH {_TOKENS}, {_RAW}
SELECT 1 AS lang, form, 1000000 - n AS rank FROM cnt WHERE lang = 1 AND length(form) >= 3
UNION ALL SELECT 2, plain, min(1000000 - n) FROM nor WHERE length(plain) >= 3 AND position(chr(8204) IN raw) = 0 AND NOT regexp_matches(plain, '[0-9]') AND plain NOT IN ({", ".join(map(_Q, REJECTED_PERSIAN))}) GROUP BY plain""",
    "lexicon_tiers": f"WITH {_LEXICON} SELECT * FROM lex",
    "lexicon_report": f"WITH {_LEXICON} SELECT lang, "
    + ", ".join(f"count(*) FILTER (is_{x}) AS n_{x}" for x in ("short", "word", "common", "frequent", "prefix", "common_prefix"))
    + " FROM lex GROUP BY lang",
    "collision_priors": f"WITH {_LEXICON}, {_PRIORS} SELECT * FROM pri",
    "classify_words": f"WITH {_LEXICON}, {_TYPED_CLASSES} SELECT en, fa, {_FLAGS} FROM cls",
    "decide_live": _decide(0),
    "decide_idle": _decide(1),
    "decide_boundary": _decide(2),
    "decide_basic": f"""
WITH {_LEXICON}, {_TYPED_CLASSES},
a AS (SELECT *, length(en) AS k FROM cls, (SELECT unnest([1, 2]) AS active), (SELECT unnest([2, 4]) AS least)),
m AS (SELECT *, k BETWEEN least AND 32 AND CASE active WHEN 1 THEN fa_known AND NOT en_known ELSE en_known AND NOT fa_known END AS made, CASE active WHEN 1 THEN en_prefix ELSE fa_prefix END AS goes_on FROM a)
SELECT active, least, CASE WHEN made THEN 2 ELSE 0 END AS action, CAST(CASE WHEN made THEN k ELSE 0 END AS INTEGER) AS keys, CASE WHEN made THEN 3 - active ELSE 0 END AS target,
       CASE WHEN NOT made THEN 0 WHEN goes_on THEN 1 ELSE 2 END AS live, count(*) AS n, max(CASE WHEN NOT made THEN '' WHEN active = 1 THEN en ELSE fa END) AS last_original
FROM m GROUP BY ALL""",
    "decide_reduced": " UNION ALL ".join(f"SELECT *, {common} AS common, {phase} AS phase FROM ({_decide(phase, True, common)})" for common in (True, False) for phase in (1, 2)),
    "word_repair": f"""
WITH {_LEXICON}, w AS (SELECT doc_id, en, {_FA("en")} AS fa, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS active
                       FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS en FROM documents)),
{_classified("w", "s.doc_id, s.active, s.en, s.fa")}
SELECT doc_id, active, count(*) AS words, count(*) FILTER (length(en) BETWEEN 2 AND 32 AND CASE active WHEN 1 THEN fa_known AND NOT en_known ELSE en_known AND NOT fa_known END) AS repaired
FROM cls GROUP BY doc_id, active""",
    "sequence_scores": f"""
WITH {_LEXICON}, {_SENTENCE_CLASSES}, {_POINTS}, asked AS (SELECT * FROM (SELECT unnest([0, 1, 2]) AS sensitivity), (VALUES (1, 2), (2, 5)) c(context, strength)),
sums AS (SELECT conv_id, turn, sentence, part, count(*) AS words, sum(e) AS se, sum(f) AS sf, count(*) FILTER (en_known) AS ke, count(*) FILTER (fa_known) AS kf FROM pts GROUP BY ALL),
{_RUN}
SELECT conv_id, turn, sentence, part, words, language, CASE language WHEN 0 THEN 0 ELSE least(100, abs(en_score - fa_score)) END AS confidence, en_score, fa_score,
       CAST(ke AS INTEGER) AS en_known, CAST(kf AS INTEGER) AS fa_known, sensitivity, strength FROM made""",
    "sequence_repair": f"""
WITH RECURSIVE {_LEXICON}, {_SENTENCE_CLASSES}, {_POINTS}, asked AS (SELECT 1 AS one),
held AS (SELECT *, sum(length(en) + 1) OVER (PARTITION BY conv_id, turn, sentence, part ORDER BY pos) - 1 - length(en) - 1 AS chars_before FROM pts),
h AS (SELECT * FROM held WHERE pos <= 32 AND chars_before <= 479),
every AS (SELECT a.conv_id, a.turn, a.sentence, a.part, a.pos, b.pos AS start, count(*) AS words, sum(c.e) AS se, sum(c.f) AS sf, count(*) FILTER (c.en_known) AS ke, count(*) FILTER (c.fa_known) AS kf
         FROM h a JOIN h b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.sentence = b.sentence AND a.part = b.part AND b.pos < a.pos
         JOIN h c ON a.conv_id = c.conv_id AND a.turn = c.turn AND a.sentence = c.sentence AND a.part = c.part AND c.pos BETWEEN b.pos AND a.pos GROUP BY ALL),
sums AS (SELECT *, conv_id % 3 AS sensitivity, 1 + turn % 2 AS context, (conv_id + turn) % 6 AS strength FROM every),
{_RUN},
pick AS (SELECT *, row_number() OVER () AS id FROM made WHERE language > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn, sentence, part, pos ORDER BY start) = 1),
sent AS (SELECT conv_id, turn, sentence, part, list(en ORDER BY pos) AS ens, list(fa ORDER BY pos) AS fas, list(CAST(visible AS INTEGER) ORDER BY pos) AS seen FROM h GROUP BY ALL),
step AS (SELECT sent.conv_id, sent.turn, sent.sentence, sent.part, ix, start, language FROM (SELECT *, unnest(range(1, len(ens) + 1)) AS ix FROM sent) sent
         LEFT JOIN pick ON pick.conv_id = sent.conv_id AND pick.turn = sent.turn AND pick.sentence = sent.sentence AND pick.part = sent.part AND pick.pos = ix),
walk AS (
  SELECT conv_id, turn, sentence, part, CAST(1 AS BIGINT) AS ix, seen FROM sent
  UNION ALL
  -- How the screen stands before the word `ix`: what the run at the word before left in its language.
  SELECT w.conv_id, w.turn, w.sentence, w.part, w.ix + 1,
         CASE WHEN s.language IS NULL THEN w.seen ELSE list_transform(w.seen, lambda x, i: CASE WHEN i BETWEEN s.start AND s.ix THEN CAST(s.language AS INTEGER) ELSE x END) END
  FROM walk w JOIN step s ON s.conv_id = w.conv_id AND s.turn = w.turn AND s.sentence = w.sentence AND s.part = w.part AND s.ix = w.ix WHERE w.ix < len(w.seen)),
out AS (SELECT k.*, ens, fas, w.seen, unnest(range(k.start, k.pos + 1)) AS i FROM pick k JOIN sent USING (conv_id, turn, sentence, part) JOIN walk w ON w.conv_id = k.conv_id AND w.turn = k.turn AND w.sentence = k.sentence AND w.part = k.part AND w.ix = k.pos)
SELECT conv_id, turn, sentence, part, pos, start, language, least(100, abs(en_score - fa_score)) AS confidence, bool_or(seen[i] <> language) AS needs_change,
       string_agg(CASE seen[i] WHEN 2 THEN fas[i] ELSE ens[i] END, ' ' ORDER BY i) AS original, string_agg(CASE language WHEN 2 THEN fas[i] ELSE ens[i] END, ' ' ORDER BY i) AS replacement
FROM out GROUP BY conv_id, turn, sentence, part, pos, start, language, en_score, fa_score""",
    "sentence_starts": f"WITH {_SENTENCES} SELECT en, count(*) FILTER (pos = 1) AS starts, count(*) AS n FROM sw GROUP BY en",
    "context_fold": f"""
WITH {_LEXICON}, {_SENTENCE_CLASSES}, {_SEEN},
g AS (SELECT conv_id, turn, {_LISTED.format("sentence, part, pos")} AS rows FROM o GROUP BY conv_id, turn),
f AS (SELECT conv_id, turn, {_FOLDED} AS s FROM g)
SELECT conv_id, turn, s.language AS language, s.strength AS strength, s.observed_words AS observed_words FROM f""",
    "context_sessions": f"""
WITH {_LEXICON}, {_SENTENCE_CLASSES}, {_SEEN},
timed AS (SELECT *, conv_id % 10 AS typist, CAST(turn % 2 AS VARCHAR) AS window_id, conv_id * 10000000000 + turn * 100000000 + sentence * 30000 + pos * 7 AS ts FROM o),
b AS (SELECT *, CASE WHEN window_id = lag(window_id) OVER w AND ts - lag(ts) OVER w <= 90000 THEN 0 ELSE 1 END AS fresh FROM timed WINDOW w AS (PARTITION BY typist ORDER BY ts, part, pos)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY typist ORDER BY ts, part, pos) AS session FROM b),
g AS (SELECT typist, session, any_value(window_id) AS window_id, min(ts) AS since_ms, max(ts) AS until_ms, {_LISTED.format("ts, part, pos")} AS rows FROM n GROUP BY typist, session),
f AS (SELECT *, {_FOLDED} AS s FROM g)
SELECT typist, CAST(session AS BIGINT) AS session, window_id, CAST(since_ms AS BIGINT) AS since_ms, CAST(until_ms AS BIGINT) AS until_ms, s.language AS language, s.strength AS strength, s.observed_words AS observed_words FROM f""",
    "typed_words": f"""
WITH RECURSIVE {_STROKES}, {_SPANS},
run AS (
  SELECT conv_id, turn, span, CAST(0 AS BIGINT) AS k, '' AS en, '' AS fa, false AS emptied FROM spans
  UNION ALL
  SELECT r.conv_id, r.turn, r.span, r.k + 1, CASE n.stroke WHEN 'key' THEN r.en || n.english ELSE left(r.en, greatest(length(r.en) - 1, 0)) END,
         CASE n.stroke WHEN 'key' THEN r.fa || n.persian ELSE left(r.fa, greatest(length(r.fa) - 1, 0)) END, r.emptied OR (n.stroke = 'back' AND length(r.en) <= 1)
  FROM run r JOIN num n ON n.conv_id = r.conv_id AND n.turn = r.turn AND n.span = r.span AND n.k = r.k + 1)
SELECT conv_id, turn, span, strokes, erased, emptied, greatest(length(en) - 32, 0) AS overflow, left(en, 32) AS en, left(fa, 32) AS fa, intervals, first_ms, last_ms
FROM run JOIN spans USING (conv_id, turn, span) WHERE k = strokes + erased AND strokes > 0""",
    "typing_cadence": f"""
WITH {_STROKES}, {_SPANS},
g AS (SELECT conv_id, turn, list(d ORDER BY seq) AS ds FROM num WHERE d IS NOT NULL GROUP BY conv_id, turn),
f AS (SELECT conv_id, turn, list_reduce(ds, lambda a, x: CASE WHEN x BETWEEN 20 AND 1500 THEN (CASE WHEN a BETWEEN 40 AND 500 THEN a ELSE 150 END * 3 + x) // 4 ELSE CASE WHEN a BETWEEN 40 AND 500 THEN a ELSE 150 END END, CAST(150 AS BIGINT)) AS cadence FROM g)
SELECT conv_id, turn, cadence, greatest(650, least(1200, 4 * greatest(40, least(500, cadence)))) AS delay_0, greatest(450, least(900, 3 * greatest(40, least(500, cadence)))) AS delay_1,
       greatest(280, least(650, 2 * greatest(40, least(500, cadence)))) AS delay_2 FROM f""",
    "cadence_fold": """
WITH i AS (SELECT user_id, ts, event_id, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events),
g AS (SELECT user_id, list(CAST(d // 20000 AS BIGINT) ORDER BY ts, event_id) AS ds FROM i WHERE d IS NOT NULL GROUP BY user_id),
f AS (SELECT user_id, list_reduce(ds, lambda a, x: CASE WHEN x BETWEEN 20 AND 1500 THEN (CASE WHEN a BETWEEN 40 AND 500 THEN a ELSE 150 END * 3 + x) // 4 ELSE CASE WHEN a BETWEEN 40 AND 500 THEN a ELSE 150 END END, CAST(150 AS BIGINT)) AS cadence FROM g)
SELECT user_id, cadence, greatest(650, least(1200, 4 * greatest(40, least(500, cadence)))) AS delay_0, greatest(450, least(900, 3 * greatest(40, least(500, cadence)))) AS delay_1,
       greatest(280, least(650, 2 * greatest(40, least(500, cadence)))) AS delay_2 FROM f""",
    "context_in_force": """
WITH e AS (SELECT CAST(event_id % 3 AS INTEGER) AS l, CAST(event_id % 5 AS INTEGER) AS s, CAST(event_id % 4 AS INTEGER) AS mode, (event_id * 7919) % 180001 AS age FROM events),
f AS (SELECT mode, CASE mode WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE CASE WHEN age <= 90000 AND s > 0 THEN l ELSE 0 END END AS language,
             CASE WHEN mode IN (1, 2) THEN 5 WHEN age <= 90000 AND s > 0 AND l > 0 THEN s ELSE 0 END AS strength FROM e)
SELECT language, strength, mode, count(*) AS n FROM f GROUP BY ALL""",
    "key_readings": f"""
WITH {_READINGS}, {_VARIANT},
e AS (SELECT CAST(event_id % 64 AS INTEGER) AS scan, event_id % 3 = 0 AS shift, event_id % 5 = 0 AS caps, CASE WHEN user_id % 2 = 0 THEN 'back' END AS variant FROM events),
j AS (SELECT e.*, coalesce(ven, en) AS a, coalesce(vfa, fa) AS b, e.scan BETWEEN 16 AND 27 OR e.scan BETWEEN 30 AND 40 OR e.scan BETWEEN 43 AND 51 AS word_key
      FROM e LEFT JOIN base ON base.scan = e.scan AND base.shift = e.shift AND base.caps = e.caps LEFT JOIN own ON e.variant = 'back' AND own.scan = e.scan AND own.shift = e.shift AND own.caps = e.caps)
SELECT scan, shift, caps, variant, CASE WHEN word_key AND a IS NOT NULL AND b IS NOT NULL THEN a END AS english, CASE WHEN word_key AND a IS NOT NULL AND b IS NOT NULL THEN b END AS persian, word_key, count(*) AS n
FROM j GROUP BY ALL""",
    "layout_languages": """
WITH l AS (SELECT CASE event_id % 64 WHEN 9 THEN 1 WHEN 41 THEN 2 ELSE 0 END AS language FROM events)
SELECT language, CASE language WHEN 1 THEN 'English' WHEN 2 THEN 'Persian' ELSE 'Unsupported' END AS name, count(*) AS n FROM l GROUP BY ALL""",
    "event_gates": f"""
WITH e AS (SELECT {_LIST(_NAMES)}[CAST(event_id % {len(_NAMES)} + 1 AS BIGINT)] AS vk, event_id % 4 <> 0 AND user_id % 3 <> 0 AND user_id % 5 <> 0 AS taken FROM events)
SELECT vk, list_contains({_LIST(MODIFIERS)}, vk) AS modifier, list_contains({_LIST(NAVIGATION)}, vk) AS navigation, list_contains({_LIST(DELIMITERS)}, vk) AS delimiter, taken, count(*) AS n FROM e GROUP BY ALL""",
    "previews": """
WITH p AS (SELECT conv_id, turn, left(text, 96) AS preview, length(array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:90], ' ')) AS chars FROM conversations)
SELECT conv_id, turn, preview, CASE WHEN chars <= 512 THEN chars END AS phrase_chars FROM p""",
    "boundary_keys": f"""
WITH {_CHARS}
SELECT c IN (' ', chr(10), chr(9), '.') AS boundary, c IN (chr(10), '.', '!', '?') AS ends, c IN ({_LETTERS}) AS letter, count(*) AS n FROM ch GROUP BY ALL""",
    "excluded_apps": f"""
WITH a AS (SELECT 'C:\\Apps\\' || CASE WHEN user_id % 5 = 0 THEN 'KEEPASS.exe' ELSE event_type || '.exe' END AS app FROM events)
SELECT app, lower(string_split(app, '\\')[-1]) IN ({", ".join(map(_Q, excluded_names(EXCLUDED)))}) AS excluded, count(*) AS n FROM a GROUP BY ALL""",
}
ORACLES["undone_edits"] = f"""
WITH m AS (SELECT * FROM ({ORACLES["sequence_repair"]}) WHERE needs_change),
ev AS (
  SELECT conv_id, turn, sentence, part, pos * 10 AS seq, pos * 100000 AS ts_ms, 'edit' AS kind, 'one' AS window_id, original, replacement, language FROM m
  UNION ALL SELECT conv_id, turn, sentence, part, pos * 10 + 2, pos * 100000 + 2, 'key', 'one', NULL, NULL, NULL FROM m WHERE (pos + start) % 5 = 0
  UNION ALL SELECT conv_id, turn, sentence, part, pos * 10 + 3, pos * 100000 + length(original) * pos * 137 % 20000 + 10, CASE WHEN pos % 2 = 0 THEN 'back' ELSE 'hotkey' END, CASE WHEN pos % 7 = 0 THEN 'two' ELSE 'one' END, NULL, NULL, NULL FROM m),
last AS (SELECT *, lag(kind) OVER w AS k, lag(window_id) OVER w AS win, lag(ts_ms) OVER w AS t, lag(original) OVER w AS o, lag(replacement) OVER w AS r, lag(language) OVER w AS l FROM ev WINDOW w AS (PARTITION BY conv_id, turn, sentence, part ORDER BY seq))
SELECT conv_id, turn, sentence, part, CAST(seq AS BIGINT) AS seq, CAST(ts_ms AS BIGINT) AS ts_ms, CAST(ts_ms - t AS BIGINT) AS age_ms, length(r) + 1 AS delete_count, o AS restored, CASE kind WHEN 'hotkey' THEN ' ' END AS delimiter, 3 - l AS target_language
FROM last WHERE kind IN ('back', 'hotkey') AND k = 'edit' AND win = window_id AND ts_ms - t <= 15000"""
